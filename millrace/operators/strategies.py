"""Named strategies of retrieval: which scorers vote, how their lists are fused, and what callers supply beside them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from millrace.operators import fusion, scorers

#: (queries, postings, key) to scored candidates. Callers add their own.
RETRIEVERS: dict[str, Callable[[DataFrame, DataFrame, str], DataFrame]] = {"bm25": scorers.bm25, "rare": scorers.rare_terms, "references": scorers.references}
FUSIONS: dict[str, Callable[[DataFrame, str], DataFrame]] = {"rrf": fusion.rrf, "combsum": fusion.combsum}
DEFAULTS = {"retrievers": ("bm25", "rare"), "fusion": "rrf", "candidates": 50, "keep": 10}


def merged(base: dict, change: dict) -> dict:
    """The base with a change; inner settings are merged, not replaced."""
    both = {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in change.items()}
    return {**base, **both}


def strategies(defaults: dict = DEFAULTS) -> dict[str, dict]:
    """A ladder that adds a scorer at a time (`+name`), `full`, and `full` without each part (`full-name`)."""
    names = tuple(defaults["retrievers"])
    ladder = {("" if i == 0 else "+") + name: merged(defaults, {"retrievers": names[: i + 1]}) for i, name in enumerate(names)}
    without = {f"full-{name}": merged(defaults, {"retrievers": tuple(n for n in names if n != name)}) for name in names}
    return {**ladder, "full": dict(defaults), **without, "full-rrf": merged(defaults, {"fusion": "combsum"})}


def configured(name: str = "full", change: dict | None = None) -> dict:
    known = strategies()
    if name not in known:
        raise ValueError(f"unknown strategy {name}: one of {', '.join(known)}")
    return merged(known[name], change or {})


def candidates(config: dict, queries: DataFrame, postings: DataFrame, key: str, retrievers: dict = RETRIEVERS) -> DataFrame:
    """(source, query_id, key, score, rank): the lists of the strategy's scorers. Give a written table of postings."""
    own = [scorers.ranked(retrievers[name](queries, postings, key), key, config["candidates"]).withColumn("source", F.lit(name)) for name in config["retrievers"]]
    return reduce(DataFrame.unionByName, own)


def retrieve(config: dict, lists: DataFrame, key: str, extra: DataFrame | None = None, boost: DataFrame | None = None, fallback: DataFrame | None = None) -> DataFrame:
    """(query_id, key, score, rank) from the lists (source, query_id, key, score, rank) of the strategy's scorers.

    `extra` lists vote like any other; `boost` lists only strengthen what others found; `fallback` rows (query_id, key, rank)
    come last, where nothing ranked them.
    """
    columns = ["source", "query_id", key, "score", "rank"]
    voting = lists.filter(F.col("source").isin(*config["retrievers"])).select(columns)
    if extra is not None:
        voting = voting.unionByName(extra.select(columns))
    if boost is not None:
        voting = voting.unionByName(fusion.boosted_only(boost.select(columns), voting, key))
    found = scorers.ranked(FUSIONS[config["fusion"]](voting, key), key, config["keep"])
    return found if fallback is None else fusion.with_fallback(found, fallback, key)
