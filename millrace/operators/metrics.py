"""Measures of rankings (source, query_id, key, rank) against targets (query_id, key), and tests of paired outcomes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F


def per_query(ranked: DataFrame, targets: DataFrame, key: str, sources: list[str], ks: list[int]) -> DataFrame:
    """A row for each source and each query that has targets: recall, hit and all at each k, mrr and map.

    A query without targets has no row, and so never counts as perfect.
    """
    gold = targets.select("query_id", key).distinct()
    hits = ranked.join(gold, ["query_id", key], "left_semi")
    return measured(hits, gold.groupBy("query_id").agg(F.count("*").alias("targets")), key, sources, ks)


def measured(hits: DataFrame, counts: DataFrame, key: str, sources: list[str], ks: list[int]) -> DataFrame:
    """`per_query` from the ranked rows that are targets and (query_id, targets), so that targets which no list has are
    counted without being listed."""
    numbered = hits.withColumn("nth", F.row_number().over(Window.partitionBy("source", "query_id").orderBy("rank", key)))
    at = lambda k: F.count(F.when(F.col("rank") <= k, 1))
    found = numbered.groupBy("source", "query_id").agg(*[at(k).alias(f"n_{k}") for k in ks], F.min("rank").alias("best"), F.sum(F.col("nth") / F.col("rank")).alias("ap"))
    asked = counts.select("query_id", "targets", F.explode(F.array(*map(F.lit, sources))).alias("source"))
    met = asked.join(found, ["source", "query_id"], "left")
    n = lambda k: F.coalesce(F.col(f"n_{k}"), F.lit(0))
    columns = [c for k in ks for c in ((n(k) / F.col("targets")).alias(f"recall_{k}"), (n(k) > 0).cast("double").alias(f"hit_{k}"), (n(k) == F.col("targets")).cast("double").alias(f"all_{k}"))]
    return met.select("source", "query_id", "targets", *columns, F.coalesce(1 / F.col("best"), F.lit(0.0)).alias("mrr"), F.coalesce(F.col("ap") / F.col("targets"), F.lit(0.0)).alias("map"))


def overlap(ranked: DataFrame, key: str) -> DataFrame:
    """(a, b, shared): entries that two sources both found. An entry's sources are few, so its pairs are too."""
    per = ranked.groupBy("query_id", key).agg(F.array_sort(F.collect_set("source")).alias("s"))
    pairs = per.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).filter("a <= b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))


def sign_test(pairs: DataFrame, z: float = 1.959964, most_terms: int = 100_000) -> DataFrame:
    """One row: discordant pairs, exact two-sided sign p, and Wald's interval of the share; null with none discordant.

    The tail is summed from logarithms, term after term, on the one row of counts: up to `most_terms` from its end, and
    beyond from its greatest term down, as far as terms count in double precision.
    """
    count = lambda c: F.count(F.when(c, 1))
    got = pairs.agg(F.count("*").alias("n"), count(F.col("a") > F.col("b")).alias("wins"), count(F.col("a") < F.col("b")).alias("losses"))
    m, least = F.col("wins") + F.col("losses"), F.least("wins", "losses")
    start = F.struct((-m * math.log(2)).cast("double").alias("l"), F.exp(-m * math.log(2)).alias("s"))
    step = lambda a, k: F.struct((a["l"] + F.log((m - k + 1) / k)).alias("l"), (a["s"] + F.exp(a["l"] + F.log((m - k + 1) / k))).alias("s"))
    ks = F.when(least > 0, F.sequence(F.lit(1).cast("long"), least)).otherwise(F.array().cast("array<bigint>"))
    exact = F.aggregate(ks, start, step, lambda a: a["s"])
    # Stirling's series for ln n! is good to the last places at such sizes.
    log_factorial = lambda n: n * F.log(n) - n + F.log(2 * math.pi * n) / 2 + 1 / (12 * n) - 1 / (360 * n * n * n)
    x, k = m.cast("double"), least.cast("double")
    top = log_factorial(x) - log_factorial(k) - log_factorial(x - k) - x * math.log(2)
    down = lambda a, i: F.struct((a["l"] + F.log((k - i + 1) / (x - k + i))).alias("l"), (a["s"] + F.exp(a["l"] + F.log((k - i + 1) / (x - k + i)))).alias("s"))
    steps = F.sequence(F.lit(1).cast("long"), F.least(F.ceil(10 * F.sqrt(x)), least))
    bounded = F.aggregate(steps, F.struct(top.alias("l"), F.exp(top).alias("s")), down, lambda a: a["s"])
    tail = F.when(least <= most_terms, exact).otherwise(bounded)
    d = (F.col("wins") - F.col("losses")) / F.col("n")
    se = F.sqrt(F.greatest(F.lit(0.0), m - (F.col("wins") - F.col("losses")) ** 2 / F.col("n"))) / F.col("n")
    known = lambda c: F.when(m > 0, c)
    return got.select("n", "wins", "losses", known(F.least(F.lit(1.0), 2 * tail)).alias("sign_p"), known(d - z * se).alias("low"), known(d + z * se).alias("high"))


def block_bootstrap(pairs: DataFrame, rounds: int) -> DataFrame:
    """(round_no, mean): blocks are drawn whole, by md5, as many as there are. pairs has (block, a, b).

    Blocks are summed first; the draws meet those sums, not the rows."""
    sums = pairs.groupBy("block").agg(F.sum(F.col("a") - F.col("b")).alias("d"), F.count("*").alias("n"))
    ids = sums.withColumn("i", F.row_number().over(Window.orderBy("block")) - 1)  # a row for each block, not each pair
    total = sums.agg(F.count("*").alias("blocks"))
    draws = ids.select("i", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round_no")).join(F.broadcast(total), F.lit(True))
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", "round_no", "i")), 1, 8), 16, 10).cast("long") % F.col("blocks")
    return draws.select(F.col("round_no").cast("long").alias("round_no"), pick.alias("i")).join(ids, "i").groupBy("round_no").agg((F.sum("d") / F.sum("n")).alias("mean"))


def outcome(status: Column, passed: Column) -> Column:
    """True, false or null (not known yet). Invalid statuses are never known; failures and timeouts are false."""
    return F.when(status == "invalid", F.lit(None)).when(status.isin("failure", "timeout"), F.lit(False)).otherwise(passed)


def pair_class(left_status: Column, left: Column, right_status: Column, right: Column) -> Column:
    """What became of a pair; a null status means that the arm is missing."""
    both = F.when(left & right, "both_pass").when(~left & ~right, "both_fail").when(right, "improved").otherwise("regressed")
    return F.when(left_status.isNull() | right_status.isNull(), "missing_attempt").when((left_status == "invalid") | (right_status == "invalid"), "invalid").when(left.isNull() | right.isNull(), "pending").otherwise(both)


def verdict(n: Column, blocks: Column, low: Column, high: Column, violations: Column, least_n: int, least_blocks: int, threshold: float) -> Column:
    """Safety first, then coverage, then the interval: a missing interval decides nothing."""
    return F.when(violations > 0, "failed").when(n == 0, "not_run").when((n < least_n) | (blocks < least_blocks) | low.isNull() | high.isNull(), "inconclusive").when(low > threshold, "passed").when(high < 0, "failed").otherwise("inconclusive")


def arm_groups(lists: DataFrame, labels: DataFrame, arms: list[str], query: str, key: str, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(arm, grp, n_queries, mrr, hit_k, recall_k) by arm and group of labels, with the group `all` for their union.

    lists is (arm, query, key, rank), labels (query, grp, key). A query counts for a group in which it has a label, in each
    of the arms, also where an arm has no list for it. Of repeated rows the best rank counts. Null labels count for none.
    """
    each = labels.filter(F.col(key).isNotNull() & F.col("grp").isNotNull()).select(query, F.explode(F.array("grp", F.lit("all"))).alias("grp"), key).distinct()
    asked = each.withColumn("arm", F.explode(F.array(*map(F.lit, arms))))
    ranks = lists.groupBy("arm", query, key).agg(F.min("rank").alias("rank"))
    met = asked.join(ranks, ["arm", query, key], "left")
    within = [F.count(F.when(F.col("rank") <= k, 1)).alias(f"in_{k}") for k in ks]
    per = met.groupBy("arm", query, "grp").agg(F.count("*").alias("n"), F.min("rank").alias("first"), *within)
    hits = [F.avg(F.when(F.col(f"in_{k}") > 0, 1.0).otherwise(0.0)).alias(f"hit_{k}") for k in ks]
    recalls = [F.avg(F.col(f"in_{k}") / F.col("n")).alias(f"recall_{k}") for k in ks]
    return per.groupBy("arm", "grp").agg(F.count("*").alias("n_queries"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), *hits, *recalls)
