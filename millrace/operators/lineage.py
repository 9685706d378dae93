"""Where paths of the past are now, by what renames and copies say."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from millrace.sources.tables import look_up, wide, written


def _steps(changes: DataFrame, current: DataFrame, least_score: int) -> DataFrame:
    """(path, now, label, at) of every path in changes or current, by its own moves: `at` is where it goes, without a label."""
    move = F.expr("kind in ('R', 'C') and source is not null and path is not null")
    bad = (F.col("kind") == "C") | (F.coalesce("score", F.lit(100)) < least_score)
    none = F.lit(None).cast("string")
    said = F.array(F.struct("path", none.alias("target"), F.lit(False).alias("bad"), F.lit(False).alias("now")), F.struct(F.when(move, F.col("source")).alias("path"), F.col("path").alias("target"), bad.alias("bad"), F.lit(False).alias("now")))
    rows = changes.select(F.inline(said)).unionByName(current.select("path", none.alias("target"), F.lit(False).alias("bad"), F.lit(True).alias("now"))).filter("path is not null")
    each = rows.groupBy("path").agg(F.min("target").alias("target"), F.max("target").alias("last"), F.bool_or("bad").alias("bad"), F.bool_or("now").alias("now"))
    doubted = F.col("bad") | (F.col("target") != F.col("last")) | (F.col("target") == F.col("path"))
    label = F.when(F.col("now"), "supported_rename").when(F.col("target").isNull(), "unresolved").when(doubted, "ambiguous")
    return each.select("path", "now", label.alias("label"), F.when(F.col("now"), F.col("path")).otherwise(F.col("target")).alias("at"))


def _onward(walks: DataFrame, known: DataFrame, label: str) -> DataFrame:
    """Walks (path, label, at, seen) without a label go on from where they are by the walk that is known of that place. Paths met
    before the end are in `seen`, none of them twice; null is the path alone."""
    there = known.select(F.col("path").alias("at"), F.col("label").alias("found"), F.col("at").alias("to"), F.col("seen").alias("then"))
    met = look_up(walks.filter("label is null").select("path", "at", "seen"), there, "at")
    met = met.withColumn("seen", F.coalesce("seen", F.array("path"))).withColumn("then", F.coalesce("then", F.array("at")))
    again = F.col("found").isNull() & (F.arrays_overlap("seen", "then") | F.array_contains("seen", F.col("to")))
    said = F.when(again, "ambiguous").otherwise(F.col("found"))
    return written(met.select("path", said.alias("label"), F.col("to").alias("at"), F.when(said.isNull(), F.concat("seen", "then")).alias("seen")), label)


def lineage(changes: DataFrame, current: DataFrame, hops: int = 8, least_score: int = 50) -> DataFrame:
    """(path, current, label) of every path in changes (path, source, kind, score) that is not in current (path).

    A path is followed through renames (kind R), from source to path, `hops` at most. supported_rename: it comes to a
    current path. ambiguous: on its way are several targets, a copy (kind C), a score below `least_score` or a path met
    before. unresolved: it ends elsewhere, or takes more hops. A move without a score is certain; of several scores of
    one move the least counts. Rows with other kinds, or without a source, are changes in place. Null paths and sources
    are no paths; repeated rows change nothing. Where many paths come to the same one, that key is joined apart.

    Moves of a path and whether it is current are brought together once. Then walks of twice the length are made of two, so
    eight hops take three joins; of a walk that has ended only the end is kept.
    """
    with wide(changes.sparkSession, changes.count()):
        steps = written(_steps(changes, current, least_score), "moves")
        done, parts = None, [steps.select("path", "label", "at", F.lit(None).cast("array<string>").alias("seen"))]
        left = hops
        while left:
            if left % 2:
                done = parts if done is None else [d.filter("label is not null") for d in done] + [_onward(reduce(DataFrame.unionByName, done), reduce(DataFrame.unionByName, parts), "walks")]
            left //= 2
            if left:
                walks = _onward(parts[-1], reduce(DataFrame.unionByName, parts), "powers")
                parts = [p.filter("label is not null") for p in parts] + [walks]
        ends = reduce(DataFrame.unionByName, done)
        last = look_up(ends.filter("label is null").select("path", "at"), steps.select(F.col("path").alias("at"), "now"), "at")
        last = written(last.select("path", F.when(F.col("now"), F.col("at")).alias("current"), F.when(F.col("now"), "supported_rename").otherwise("unresolved").alias("label")), "ends")
    arrived = F.when(F.col("label") == "supported_rename", F.col("at"))
    known = ends.filter("label is not null and not (label = 'supported_rename' and at = path)")  # a current path is not of the past
    return known.select("path", arrived.alias("current"), "label").unionByName(last)
