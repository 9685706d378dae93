"""Rates with unknown values, and statistics of paired outcomes (family, a, b)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from millrace.operators.packets import prefix_sums
from millrace.sources.tables import written


def rate(rows: DataFrame, by: list[str], hit: Column) -> DataFrame:
    """numerator, denominator, missing and rate; a null is neither a hit nor a miss, and no known value gives null."""
    n = F.count(F.when(hit, 1))
    return rows.groupBy(*by).agg(n.alias("numerator"), F.count(hit).alias("denominator"), (F.count("*") - F.count(hit)).alias("missing"), F.try_divide(n, F.count(hit)).alias("rate"))


def family_pairs(trials: DataFrame) -> DataFrame:
    """One pair for each family with both arms: the mean success of its repetitions."""
    mean = lambda arm: F.avg(F.when(F.col("first_arm") == arm, F.col("success").cast("double")))
    return trials.groupBy("family").agg(mean(True).alias("a"), mean(False).alias("b")).filter("a is not null and b is not null")


def tally(pairs: DataFrame) -> DataFrame:
    count = lambda c: F.count(F.when(c, 1))
    a, b = F.col("a"), F.col("b")
    return pairs.agg(F.count("*").alias("families"), count(a > b).alias("wins"), count(a < b).alias("losses"), count(a == b).alias("ties"), F.avg(a - b).alias("difference"))


def hoeffding(pairs: DataFrame, level: float) -> DataFrame:
    """Bounds of the mean difference, which lies in [-1, 1]."""
    h = 2 * F.sqrt(F.lit(math.log(2 / (1 - level))) / (2 * F.col("n")))
    got = pairs.agg(F.count("*").alias("n"), F.avg(F.col("a") - F.col("b")).alias("d"))
    return got.select("n", F.greatest(F.lit(-1.0), F.col("d") - h).alias("low"), F.least(F.lit(1.0), F.col("d") + h).alias("high"))


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """Adds i, the place by key (no ties) from 0. Ranges of the key are counted first, so that no task numbers all rows."""
    one = rows.withColumn("__one", F.lit(1)).withColumn("__all", F.lit(0))
    return prefix_sums(one, "__all", key, "__one").withColumn("i", F.col("used") - 1).drop("used", "__one", "__all")


def bootstrap(pairs: DataFrame, rounds: int, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(round_no, mean): in each round every pair gives its place to the one that md5 picks. A row makes `rounds` picks.

    Up to `broadcast_rows` pairs, sixteen bytes each, are sent to all tasks, so that picks are summed where they are made;
    more are joined by place. Both give the same means.
    """
    own = pairs.select("family", (F.col("a") - F.col("b")).alias("d"))
    ids = written(numbered(own, "family").select("i", "d"), "pairs")
    n = ids.count()
    draws = ids.select("i", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round_no"))
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", "round_no", "i")), 1, 8), 16, 10).cast("long") % F.lit(n)
    values = ids if n > broadcast_rows else F.broadcast(ids)
    return draws.select("round_no", pick.alias("i")).join(values, "i").groupBy(F.col("round_no").cast("long").alias("round_no")).agg(F.avg("d").alias("mean"))


def _places(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, c, upto, n): known values with how often they occur, the places they end at, and the group's size.

    Equal values are counted first, and the running counts of a large group are shared among tasks.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    total = counts.groupBy(F.col(group).alias("__h")).agg(F.sum("c").alias("n"))
    upto = prefix_sums(counts, group, value, "c").withColumnRenamed("used", "upto")
    return upto.join(total, F.col(group).eqNullSafe(F.col("__h"))).drop("__h")


def nearest_rank(rows: DataFrame, group: str, value: str, p: float) -> DataFrame:
    """The value at place ceil(p n) of each group, from 1."""
    place = F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("n")))
    return _places(rows, group, value).withColumn("place", place).filter("upto >= place and upto - c < place").select(group, F.col(value).alias("at"))


def median(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, median): the middle value, or the mean of the middle two. Groups without known values have no row."""
    middle = _places(rows, group, value).filter("upto >= floor((n + 1) / 2) and upto - c < ceil((n + 1) / 2)")
    return middle.groupBy(group).agg(F.avg(value).alias("median"))


def upper_median(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, upper_median): the middle value, or the upper of the middle two."""
    return _places(rows, group, value).filter("upto > floor(n / 2) and upto - c <= floor(n / 2)").select(group, F.col(value).alias("upper_median"))
