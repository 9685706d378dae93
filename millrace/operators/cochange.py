"""Co-change of items in baskets, from events (basket, item, at)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from millrace.sources.tables import wide, written


def eligible(events: DataFrame, least: int = 2, most: int = 30) -> DataFrame:
    """Distinct items of baskets with `least` to `most` of them. The bound keeps the pairs of a basket few."""
    one = events.select("basket", "item", "at").dropDuplicates(["basket", "item"])
    sizes = one.groupBy("basket").agg(F.count("*").alias("n")).filter(F.col("n").between(least, most))
    return one.join(sizes.select("basket"), "basket", "left_semi")


def pairs(events: DataFrame, half_life_days: float | None = None) -> DataFrame:
    """(a, b, support, weight) with a < b; the weight of a basket halves with each half-life before the newest."""
    events = written(events.select("basket", "item", "at"), "baskets")
    with wide(events.sparkSession, events.count()):
        return written(_pairs(events, half_life_days), "pairs")


def _pairs(events: DataFrame, half_life_days: float | None) -> DataFrame:
    one = events.select("basket", F.struct("item", "at").alias("x"))
    held = one.groupBy("basket").agg(F.array_sort(F.collect_list("x.item")).alias("items"), F.max("x.at").alias("at"))
    both = held.select("at", F.posexplode("items").alias("i", "a"), "items").select("at", "a", F.explode(F.slice("items", F.col("i") + 2, F.size("items"))).alias("b"))
    weight = F.lit(1.0)
    if half_life_days:
        newest = events.agg(F.max("at").alias("newest"))
        both = both.join(F.broadcast(newest), F.lit(True))  # one row
        weight = F.pow(F.lit(0.5), (F.unix_seconds(F.col("newest").cast("timestamp")) - F.unix_seconds(F.col("at").cast("timestamp"))) / 86400.0 / half_life_days)
    return both.groupBy("a", "b").agg(F.count("*").alias("support"), F.sum(weight).alias("weight"))


def scored(events: DataFrame, statistic: str, least_support: int = 1) -> DataFrame:
    """Partners by jaccard, conditional (of b given a) or lift, rounded to four places."""
    counts = events.groupBy("item").agg(F.count("*").alias("n"))
    both = pairs(events).filter(F.col("support") >= least_support)
    met = both.join(counts.select(F.col("item").alias("a"), F.col("n").alias("na")), "a").join(counts.select(F.col("item").alias("b"), F.col("n").alias("nb")), "b")
    if statistic == "jaccard":
        return met.select("a", "b", "support", F.round(F.col("support") / (F.col("na") + F.col("nb") - F.col("support")), 4).alias("score"))
    if statistic == "conditional":
        either = met.select("a", "b", "support", "na").union(met.select("b", "a", "support", "nb"))
        return either.select("a", "b", "support", F.round(F.col("support") / F.col("na"), 4).alias("score"))
    total = events.agg(F.count_distinct("basket").alias("total"))
    return met.join(F.broadcast(total), F.lit(True)).select("a", "b", "support", F.round(F.col("support") * F.col("total") / (F.col("na") * F.col("nb")), 4).alias("score"))


def partners(scored: DataFrame, k: int = 10) -> DataFrame:
    """The k best partners of each item, from either side; ties by support, then by partner."""
    either = scored.select("a", "b", "support", "score").union(scored.select("b", "a", "support", "score"))
    order = Window.partitionBy("a").orderBy(F.desc("score"), F.desc("support"), "b")
    return either.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
