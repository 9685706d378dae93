"""Queries that report on trials, checks, health and routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators import reports
from millrace.plans.base import query
from millrace.sources.tables import table

_AVAILABLE = "CASE WHEN event_id % 5 = 0 THEN 'partial' WHEN event_id % 7 = 0 THEN 'none' ELSE 'complete' END"
_AMOUNT = "CASE WHEN event_id % 11 > 0 THEN CAST(event_id % 100 AS BIGINT) END"


@query(f"""WITH t AS (SELECT event_type, {_AVAILABLE} AS a, {_AMOUNT} AS v FROM events)
SELECT event_type, count(*) FILTER (a = 'complete' AND v IS NOT NULL) AS observed, count(*) - count(*) FILTER (a = 'complete' AND v IS NOT NULL) AS missing, CAST(sum(v) FILTER (a = 'complete') AS BIGINT) AS total,
CAST(sum(v) FILTER (a = 'partial') AS BIGINT) AS partial_total, count(*) FILTER (a = 'partial' AND v IS NOT NULL) AS partial_attempts FROM t GROUP BY event_type""")
def activity_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    trials = table(spark, sf_dir, "events").select("event_type", F.expr(_AVAILABLE).alias("a"), F.expr(_AMOUNT).alias("v"))
    return reports.activity(trials, "event_type", "v", "a")


_DISPLAY = "CASE WHEN s_acctbal < 0 THEN 'UNAVAILABLE' WHEN s_suppkey % 7 = 0 THEN 'AUTH_REQUIRED' WHEN s_suppkey % 5 = 0 THEN 'UNTESTED' ELSE 'HEALTHY' END"


@query(f"""WITH c AS (SELECT s_nationkey AS parent, {_DISPLAY} AS d FROM supplier), f AS (SELECT parent, bool_or(d = 'HEALTHY') AS works, bool_or(d IN ('UNAVAILABLE', 'AUTH_REQUIRED')) AS bad FROM c GROUP BY parent)
SELECT parent, CASE WHEN works AND bad THEN 'DEGRADED' WHEN works THEN 'HEALTHY' WHEN bad THEN 'UNAVAILABLE' ELSE 'UNTESTED' END AS display FROM f""")
def parent_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by the health of their suppliers."""
    children = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("parent"), F.expr(_DISPLAY).alias("d"))
    return reports.parent_health(children, "parent", "d")


@query(f"SELECT n_regionkey AS kind, {_DISPLAY} AS display, count(*) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2")
def health_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return met.groupBy(F.col("n_regionkey").alias("kind"), F.expr(_DISPLAY).alias("display")).agg(F.count("*").alias("n"))


@query("""SELECT event_type, count(*) AS trials, count(*) FILTER (event_id % 3 > 0) AS known, CASE WHEN count(*) FILTER (event_id % 3 > 0) > 0 THEN round(count(*) FILTER (event_id % 3 > 0 AND value > 10) / count(*) FILTER (event_id % 3 > 0), 6) END AS adopted FROM events GROUP BY 1""")
def helper_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the trials don't tell whether a helper was used."""
    known = F.col("event_id") % 3 > 0
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("trials"), F.count(F.when(known, 1)).alias("known"), reports.rate(F.col("value") > 10, known).alias("adopted"))


@query("""WITH s AS (SELECT o_orderpriority AS strategy, CASE WHEN o_totalprice < 50000 THEN 'ignore_weak' WHEN o_orderstatus = 'O' THEN 'use_limited' ELSE 'use' END AS state FROM orders)
SELECT strategy, state, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY strategy), 6)::DOUBLE AS share FROM s GROUP BY 1, 2""")
def memory_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the memory gate's states by strategy."""
    state = F.when(F.col("o_totalprice") < 50000, "ignore_weak").when(F.col("o_orderstatus") == "O", "use_limited").otherwise("use")
    return reports.shares(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("strategy"), state.alias("state")), "strategy", "state")


@query("""SELECT lang AS view, round(avg(CASE WHEN doc_id % 4 > 0 THEN n_chars % 2 END), 6) AS hit, round(avg(CASE WHEN doc_id % 5 > 0 THEN n_chars % 10 END), 6) AS gain, round(avg(n_chars), 3) AS packet, count(*) AS tasks FROM documents GROUP BY 1""")
def fact_view_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of what is known; views without a value count for none."""
    mean = lambda c, known, n=6: F.round(F.avg(F.when(known, c)), n)
    hit, gain = mean(F.col("n_chars") % 2, F.col("doc_id") % 4 > 0), mean(F.col("n_chars") % 10, F.col("doc_id") % 5 > 0)
    return table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("view")).agg(hit.alias("hit"), gain.alias("gain"), F.round(F.avg("n_chars"), 3).alias("packet"), F.count("*").alias("tasks"))


@query("""SELECT l_returnflag AS condition, round(max(l_tax) * 1000, 4) AS setup, round(sum(l_discount), 4) AS running, count(DISTINCT l_orderkey) AS tasks, round((max(l_tax) * 1000 + sum(l_discount)) / count(DISTINCT l_orderkey), 6) AS amortised FROM lineitem GROUP BY 1""")
def setup_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Setup is paid once and spread over the tasks of a condition."""
    setup, running, tasks = F.max("l_tax") * 1000, F.sum("l_discount"), F.count_distinct("l_orderkey")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("condition")).agg(F.round(setup, 4).alias("setup"), F.round(running, 4).alias("running"), tasks.alias("tasks"), F.round((setup + running) / tasks, 6).alias("amortised"))


@query("""SELECT user_id AS target, count(*) FILTER (event_type = 'click') AS writes, count(*) FILTER (event_type = 'error') AS cleanups, greatest(count(*) FILTER (event_type = 'click') - count(*) FILTER (event_type = 'error'), 0) AS left_behind FROM events GROUP BY 1""")
def outside_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.matched_writes(table(spark, sf_dir, "events").withColumnRenamed("user_id", "target"), "target", F.col("event_type") == "click", F.col("event_type") == "error")


@query("""SELECT event_type, count(*) FILTER (event_id % 4 > 0) AS observed, count(*) FILTER (event_id % 4 = 0) AS missing, CAST(sum(event_id % 6) FILTER (event_id % 4 > 0) AS BIGINT) AS excluded, CAST(sum(user_id % 3) FILTER (event_id % 4 > 0) AS BIGINT) AS calls FROM events GROUP BY 1""")
def exclusion_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over the calls that were observed, beside how many were not."""
    known = F.col("event_id") % 4 > 0
    total = lambda c: F.sum(F.when(known, c))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.when(known, 1)).alias("observed"), F.count(F.when(~known, 1)).alias("missing"), total(F.col("event_id") % 6).alias("excluded"), total(F.col("user_id") % 3).alias("calls"))


@query("""SELECT o_orderpriority AS route, round(avg((o_custkey % 5 = o_orderkey % 5)::INT), 6) AS top1, round(avg((o_custkey % 5 IN (o_orderkey % 5, (o_orderkey + 1) % 5))::INT), 6) AS acceptable, round(avg((o_custkey % 5 = (o_orderkey + 3) % 5)::INT), 6) AS avoided FROM orders GROUP BY 1""")
def routing_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = lambda n: (F.col("o_orderkey") + n) % 5
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("route"), (F.col("o_custkey") % 5).alias("chosen"), turn(0).alias("best"), F.array(turn(0), turn(1)).alias("fine"), F.array(turn(3)).alias("bad"))
    return reports.route_scores(rows, "route", "chosen", "best", "fine", "bad")


_CHECK = "CASE event_type WHEN 'click' THEN 'tests_passed' WHEN 'error' THEN 'tests_failed' WHEN 'view' THEN 'command_succeeded' ELSE 'timeout' END"


@query(f"""WITH o AS (SELECT user_id, arg_max(({_CHECK}, value > 10), event_id) AS l FROM events GROUP BY 1)
SELECT user_id, CASE l[1] WHEN 'tests_passed' THEN CASE WHEN l[2] THEN 'checked_success' ELSE 'stale_checks' END WHEN 'tests_failed' THEN 'failed_checks' WHEN 'command_succeeded' THEN 'exit_code_only' ELSE 'infrastructure_error' END AS outcome FROM o""")
def checked_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last check of each user says."""
    seen = table(spark, sf_dir, "events").select("user_id", "event_id", F.expr(_CHECK).alias("outcome"), F.when(F.col("value") > 10, "current").otherwise("expired").alias("freshness"))
    return reports.checked_outcome(seen, "user_id", "event_id")


@query("""WITH p AS (SELECT o_custkey % 100 AS family, max(o_totalprice) FILTER (o_orderstatus = 'F') AS before, max(o_totalprice) FILTER (o_orderstatus = 'O') AS after FROM orders GROUP BY 1),
s AS (SELECT count(*) FILTER (before IS NOT NULL AND after IS NOT NULL) AS pairs, count(*) FILTER (after > before) AS better, count(*) FILTER (after < before) AS worse, round(sum(after - before), 2) AS difference FROM p)
SELECT pairs, better, worse, difference, CASE WHEN pairs < 20 THEN 'too_few_pairs' WHEN worse > better THEN 'worse' WHEN better > worse THEN 'better' ELSE 'no_difference' END AS reason FROM s""")
def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row on a candidate: complete pairs, better and worse ones, and the reason of the decision."""
    at = lambda s: F.max(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    pairs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey") % 100).agg(at("F").alias("before"), at("O").alias("after"))
    count = lambda c: F.count(F.when(c, 1))
    met = pairs.agg(count(F.col("before").isNotNull() & F.col("after").isNotNull()).alias("pairs"), count(F.col("after") > F.col("before")).alias("better"), count(F.col("after") < F.col("before")).alias("worse"), F.round(F.sum(F.col("after") - F.col("before")), 2).alias("difference"))
    reason = F.when(F.col("pairs") < 20, "too_few_pairs").when(F.col("worse") > F.col("better"), "worse").when(F.col("better") > F.col("worse"), "better").otherwise("no_difference")
    return met.withColumn("reason", reason)
