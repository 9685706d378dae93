"""From requests in plain words to ranked answers under a budget: what a request names weighs by how it is spelled."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.functions import requests as reading, tokens
from millrace.operators import index, scorers, strategies
from millrace.sources.tables import written

# Weights by spelling, and the factor for the parts of a compound name.
WEIGHTS = {"symbol": 3.0, "identifier": 3.0, "concept": 1.0, "part": 0.5}
#: A path in a request that fits more documents than this names none.
AMBIGUOUS = 3


def _as(names: Column, weight: float) -> Column:
    return F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(weight).alias("w")))


def _spelled(weights: dict) -> Column:
    """Names that are spelled as code, with their weights."""
    dots = F.flatten(F.transform("dotted", lambda d: F.split(d, r"\.")))
    return F.concat(_as(F.col("symbols"), weights["symbol"]), _as(F.col("identifiers"), weights["identifier"]), _as(dots, weights["identifier"]))


def _greatest(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("query_id", name).agg(F.max("w").alias("w"))


def weighed_terms(analysis: DataFrame, key: str, weights: dict = WEIGHTS, generic: Sequence[str] = reading.GENERIC) -> DataFrame:
    """(query_id, term, w) for an index on expanded identifiers, from the columns of an analysis.

    A name counts whole by its spelling and in its parts by less; words of a path's file name count as names; other words
    in their normal form as concepts. The greatest weight of a term stays. A part without a subject is no term.
    """
    stems = F.flatten(F.transform("paths", lambda p: tokens.identifiers(F.substring_index(F.substring_index(p, "/", -1), ".", 1))))
    named = analysis.select(F.col(key).alias("query_id"), F.explode(F.concat(_spelled(weights), _as(stems, weights["identifier"]))).alias("s"))
    each = _greatest(named.select("query_id", "s.name", "s.w"), "name").select("query_id", "w", F.posexplode(tokens.expand(F.col("name"))).alias("at", "term"))
    told = each.filter((F.col("at") == 0) | ~F.col("term").isin(*generic))
    told = told.select("query_id", "term", F.when(F.col("at") == 0, F.col("w")).otherwise(F.col("w") * weights["part"]).alias("w"))
    concepts = analysis.select(F.col(key).alias("query_id"), F.explode("concepts").alias("c")).select("query_id", tokens.normalize(F.col("c")).alias("term"), F.lit(weights["concept"]).alias("w"))
    return _greatest(told.unionByName(concepts), "term")


def weighed_names(analysis: DataFrame, key: str, weights: dict = WEIGHTS) -> DataFrame:
    """(query_id, term, w): names as they are spelled, and other words in lower case as concepts."""
    rows = F.concat(_spelled(weights), _as(F.col("concepts"), weights["concept"]))
    return _greatest(analysis.select(F.col(key).alias("query_id"), F.explode(rows).alias("s")).select("query_id", F.col("s.name").alias("term"), "s.w"), "term")


def pinned(analysis: DataFrame, key: str, paths: DataFrame, document: str, most: int = AMBIGUOUS) -> DataFrame:
    """(query_id, document) for the documents (document, path) that a request names by path, whole or as the last steps."""
    asked = analysis.select(F.col(key).alias("query_id"), F.explode("paths").alias("p")).withColumn("base", F.substring_index("p", "/", -1))
    held = paths.select(document, "path", F.substring_index("path", "/", -1).alias("base"))
    fits = (F.col("path") == F.col("p")) | F.col("path").endswith(F.concat(F.lit("/"), "p"))
    hits = held.join(asked, "base").filter(fits).select("query_id", "p", document)
    clear = hits.groupBy("query_id", "p").agg(F.count("*").alias("n")).filter(F.col("n") <= most)
    return hits.join(clear, ["query_id", "p"], "left_semi").select("query_id", document).distinct()


def answered(requests: DataFrame, key: str, documents: DataFrame, document: str, text: str = "text", paths: DataFrame | None = None, defining: DataFrame | None = None,
             change: dict | None = None, weights: dict = WEIGHTS, generic: Sequence[str] = reading.GENERIC, budget: int = 4000) -> DataFrame:
    """(query_id, document, rank, score, agree, pinned, tokens, delivered): the answers to all requests (key, text).

    Requests are analysed, their terms weighed by spelling and matched with an index on expanded identifiers of whole
    texts; three scorers vote (lengths, rare terms, references of names that are spelled as code) and are fused by rank.
    Documents named by path come first. `agree` counts the lists that have a document, `tokens` is a quarter of its
    characters, rounded up, and answers are delivered in order while they fit the budget. Windows hold the candidates of
    a request, some 200 at most. Requests without a candidate have no row. Requests, documents and paths without a key
    don't take part and aren't counted.
    """
    requests, documents = requests.filter(F.col(key).isNotNull()), documents.filter(F.col(document).isNotNull())
    config = strategies.configured("full", {"retrievers": ("bm25", "rare", "references"), **(change or {})})
    analysis = written(reading.analysed(requests.select(key, text), text, generic).drop(text), "analysis")
    terms = written(weighed_terms(analysis, key, weights, generic), "asked")
    names = written(weighed_names(analysis, key, weights).filter(F.col("w") >= weights["identifier"]), "names")
    postings, counts, facts = index.asked_index(documents, document, text, terms, names)
    summed = [n for n in config["retrievers"] if n in scorers.GAINS]
    others = [n for n in config["retrievers"] if n not in scorers.GAINS]
    own = [scorers.voted(summed, terms, postings, document, facts, config["candidates"])] if summed else []
    if others:
        voters = {"references": lambda q, p, d: scorers.references(names, counts, d, defining)}
        own.append(strategies.candidates({**config, "retrievers": others}, terms, postings, document, voters))
    lists = written(reduce(DataFrame.unionByName, own), "lists")
    votes = lists.groupBy("query_id", document).agg(F.count("*").alias("agree"))
    found = strategies.FUSIONS[config["fusion"]](lists, document).join(votes, ["query_id", document])
    if paths is None:
        found = found.withColumn("pinned", F.lit(False))
    else:
        pins = pinned(analysis, key, paths.filter(F.col(document).isNotNull()), document).withColumn("pinned", F.lit(True))
        found = found.join(pins, ["query_id", document], "full_outer")
    found = found.select("query_id", document, F.round(F.coalesce("score", F.lit(0.0)), 9).alias("score"), F.coalesce("agree", F.lit(0)).alias("agree"), F.coalesce("pinned", F.lit(False)).alias("pinned"))
    order = Window.partitionBy("query_id").orderBy(F.desc("pinned"), F.desc("score"), document)
    top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= config["keep"])
    sized = top.join(facts.select(document, F.ceil(F.col("chars") / 4).alias("tokens")), document)
    spent = F.sum("tokens").over(Window.partitionBy("query_id").orderBy("rank"))
    return sized.withColumn("delivered", spent <= budget).select("query_id", document, "rank", "score", "agree", "pinned", "tokens", "delivered")
