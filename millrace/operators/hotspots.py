"""Paths that changes keep coming back to: seven features, their score, and a choice spread over folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.operators import cochange
from millrace.sources.tables import join_hot, wide, written

# What each feature weighs, and half of the penalty's weight is taken off.
WEIGHTS = {"edits": 1.0, "recency": 0.5, "fixes": 1.0, "incidents": 1.0, "symbols": 0.5, "partners": 0.5}
PENALTY = 1.0
#: Added before four places are kept, so that halves go up whatever the last bits of a sum are.
TIE = 1e-9
#: A commit with more paths is a bulk commit; so the pairs of others are few.
MOST_PATHS = 30


def features(touches: DataFrame, commits: DataFrame, refs: DataFrame, symbols: DataFrame | None = None, least_support: int = 2, most_paths: int = MOST_PATHS) -> DataFrame:
    """(path, score, penalty, reasons and the features) of every path with an edit.

    touches (commit, path), commits (commit, place, fix, release, bulk, merge; one row each, place 0 is the newest), refs
    (commit, ref), symbols (commit, path, symbol). Merges count nothing. A bulk commit is no edit: it and releases make the
    penalty, their share of all touches. Edits, fixes, distinct refs, distinct symbols and paths that changed together
    `least_support` times are log-scaled to their maximum; recency is 1 for the newest commit. Where symbols are None they
    are unknown and leave the average. reasons are the two features that weigh most, ties in the order of WEIGHTS. Flags
    that are null are false, repeated rows are one, touches with nulls or unknown commits are passed over.
    """
    touches = touches.select("commit", "path").filter("commit is not null and path is not null")
    with wide(touches.sparkSession, touches.count()):
        return _features(written(touches.distinct(), "touches"), commits, refs, symbols, least_support, most_paths)


def _features(own: DataFrame, commits: DataFrame, refs: DataFrame, symbols: DataFrame | None, least_support: int, most_paths: int) -> DataFrame:
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("fix", "release", "bulk", "merge")]
    total = max(1, commits.count())
    known = commits.select("commit", (1 - F.col("place") / total).alias("age"), *flags).filter("not merge")
    facts = known.join(own.groupBy("commit").agg(F.count("*").alias("held")), "commit").withColumn("bulk", F.col("bulk") | (F.col("held") > most_paths))
    met = written(join_hot(own, written(facts, "commits"), "commit", "held"), "met")
    edit = met.filter("not bulk")
    rows = met.groupBy("path").agg(
        F.count_if(~F.col("bulk")).alias("edits"),
        F.max(F.when(~F.col("bulk"), F.col("age"))).alias("recency"),
        F.count_if(~F.col("bulk") & F.col("fix")).alias("fixes"),
        F.count_if(F.col("bulk") | F.col("release")).alias("releases"),
    )
    incidents = edit.select("commit", "path").join(refs.select("commit", "ref").distinct(), "commit").groupBy("path").agg(F.count_distinct("ref").alias("incidents"))
    events = edit.select(F.col("commit").alias("basket"), F.col("path").alias("item"), F.lit(0).cast("timestamp").alias("at"))
    both = cochange.pairs(cochange.eligible(events, 2, most_paths)).filter(F.col("support") >= least_support)
    partners = both.select(F.explode(F.array("a", "b")).alias("path")).groupBy("path").agg(F.count("*").alias("partners"))
    rows = rows.filter("edits > 0").join(incidents, "path", "left").join(partners, "path", "left")
    if symbols is not None:
        seen = symbols.join(met.select("commit", "path"), ["commit", "path"], "left_semi")
        rows = rows.join(seen.groupBy("path").agg(F.count_distinct("symbol").alias("symbols")), "path", "left")
    used = {k: w for k, w in WEIGHTS.items() if k != "symbols" or symbols is not None}
    rows = written(rows.na.fill(0), "features")
    tops = rows.agg(*[F.max(F.log1p(c)).alias(f"top_{c}") for c in used if c != "recency"])

    def scaled(c: str) -> Column:
        return F.round(F.col(c) if c == "recency" else F.when(F.col(f"top_{c}") > 0, F.log1p(c) / F.col(f"top_{c}")).otherwise(0.0), 4).alias(c)

    penalty = F.col("releases") / (F.col("edits") + F.col("releases"))
    one = rows.join(F.broadcast(tops), F.lit(True)).select("path", *map(scaled, used), penalty.alias("penalty"))
    parts = [w * F.col(c) for c, w in used.items()]
    score = sum(parts[1:], parts[0]) / sum(used.values()) - PENALTY * F.col("penalty") * 0.5
    by_weight = F.array_sort(F.array(*[F.struct((-p).alias("w"), F.lit(i).alias("i"), F.lit(c).alias("name")) for i, (c, p) in enumerate(zip(used, parts, strict=True))]))
    return one.select("path", F.round(score + TIE, 4).alias("score"), F.round(F.col("penalty") + TIE, 4).alias("penalty"), F.array_join(F.transform(F.slice(by_weight, 1, 2), lambda x: x["name"]), ",").alias("reasons"), *used)


def chosen(rows: DataFrame, current: DataFrame, degrees: DataFrame, share: float = 0.15, most: int = 200) -> DataFrame:
    """(path, score, why) of the hotspots among rows (path, score): the size is a share of the current paths, `most` at most.

    ranked: the best by score, then path, of which a folder has three tenths at most (two at least). in_degree: beyond
    those a tenth more, of current paths by degrees (path, degree). module: the best path of each top folder that has none
    yet. No paths give no rows.
    """
    rows = written(rows.select("path", "score"), "scores")
    target = min(most, max(1, -(-current.count() * round(share * 100) // 100)))
    cap, reserve = max(2, -(-target * 3 // 10)), max(1, -(-target // 10))
    order = Window.partitionBy(F.regexp_replace("path", "/?[^/]*$", "")).orderBy(F.desc("score"), "path")
    best = rows.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= cap).orderBy(F.desc("score"), "path").limit(target)
    ranked = written(best.select("path", "score", F.lit("ranked").alias("why")), "ranked")
    free = current.select("path").distinct().join(F.broadcast(ranked.select("path")), "path", "left_anti")  # `most` rows at most
    linked = free.join(degrees.filter("degree > 0"), "path").orderBy(F.desc("degree"), "path").limit(reserve)
    first = written(ranked.union(linked.select("path", F.lit(0.0), F.lit("in_degree"))), "chosen")
    top = F.substring_index("path", "/", 1)
    covered = first.filter("path like '%/%'").select(top.alias("top")).distinct()
    rest = rows.filter("path like '%/%'").withColumn("top", top).join(F.broadcast(covered), "top", "left_anti")
    module = rest.groupBy("top").agg(F.min_by(F.struct("path", "score"), F.struct(-F.col("score"), "path")).alias("x"))
    return first.union(module.select("x.path", "x.score", F.lit("module")))
