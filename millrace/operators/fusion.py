"""Fusion of candidate lists (query_id, source, key, rank, score), and what is done to lists and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def rrf(lists: DataFrame, key: str, k: int = 20, weight: Column | float = 1.0) -> DataFrame:
    """Sum of weight / (k + rank) over sources."""
    weight = F.lit(weight) if isinstance(weight, float) else weight
    return lists.groupBy("query_id", key).agg(F.sum(weight / (k + F.col("rank"))).alias("score"))


def combsum(lists: DataFrame, key: str) -> DataFrame:
    """Sum of scores, each relative to the best of its list."""
    best = F.max("score").over(Window.partitionBy("query_id", "source"))
    return lists.withColumn("part", F.col("score") / best).groupBy("query_id", key).agg(F.sum("part").alias("score"))


def grouped_rrf(lists: DataFrame, key: str, group: Column, k: int = 20) -> DataFrame:
    """Members of a group are fused first; the group then votes once."""
    inner = lists.withColumn("grp", group).groupBy("query_id", "grp", key).agg(F.sum(1 / (k + F.col("rank"))).alias("inner"))
    order = Window.partitionBy("query_id", "grp").orderBy(F.desc(F.round("inner", 9)), key)
    return inner.withColumn("rank", F.row_number().over(order)).groupBy("query_id", key).agg(F.sum(1 / (k + F.col("rank"))).alias("score"))


def damped(candidates: DataFrame, shares: DataFrame, key: str) -> DataFrame:
    """Scores times one less a document's share of the vocabulary (key, share), for hubs that match everything."""
    return candidates.join(shares, key, "left").withColumn("score", F.col("score") * (1 - F.coalesce("share", F.lit(0.0)))).drop("share")


def boosted_only(lists: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """A list that may strengthen what others found, and introduces nothing."""
    return lists.join(base.select("query_id", key).distinct(), ["query_id", key], "left_semi")


def with_fallback(found: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """Fallback rows (query_id, key, rank) that are not found yet, after those found."""
    last = found.groupBy("query_id").agg(F.max("rank").alias("last"))
    more = fallback.join(found.select("query_id", key), ["query_id", key], "left_anti").join(last, "query_id", "left")
    order = Window.partitionBy("query_id").orderBy("rank", key)
    more = more.withColumn("rank", (F.coalesce("last", F.lit(0)) + F.row_number().over(order)).cast("int")).select("query_id", key, "rank", F.lit("fallback").alias("origin"))
    return found.select("query_id", key, "rank", F.lit("found").alias("origin")).unionByName(more)


def confidence(ranked: DataFrame) -> DataFrame:
    """The relative gap between the best and the second of each query; null for a best of 0 or none other."""
    order = Window.partitionBy("query_id").orderBy("rank")
    gap = (F.col("score") - F.lead("score").over(order)) / F.when(F.col("score") != 0, F.col("score"))
    return ranked.withColumn("gap", gap).filter("rank = 1")


def displacement(before: DataFrame, after: DataFrame, key: str, k: int) -> DataFrame:
    """What entered and left the first k between two orders."""
    a = before.filter(F.col("rank") <= k).select("query_id", key, F.col("rank").alias("before"))
    b = after.filter(F.col("rank") <= k).select("query_id", key, F.col("rank").alias("after"))
    both = a.join(b, ["query_id", key], "full_outer")
    return both.groupBy("query_id").agg(F.count(F.when(F.col("before").isNull(), 1)).alias("entered"), F.count(F.when(F.col("after").isNull(), 1)).alias("left_out"), F.count(F.when(F.col("before") != F.col("after"), 1)).alias("moved"))
