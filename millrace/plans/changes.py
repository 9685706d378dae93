"""Queries on changes over time: co-change, hotspots, latest states and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from millrace.operators import cochange
from millrace.plans.base import query
from millrace.sources.tables import table

_ONE = "one AS (SELECT DISTINCT l_orderkey AS basket, l_partkey AS item FROM lineitem), ok AS (SELECT basket FROM one GROUP BY basket HAVING count(*) BETWEEN 2 AND 30), ev AS (SELECT * FROM one WHERE basket IN (SELECT basket FROM ok)), pr AS (SELECT x.item AS a, y.item AS b, count(*) AS support FROM ev x JOIN ev y ON x.basket = y.basket AND x.item < y.item GROUP BY x.item, y.item), c AS (SELECT item, count(*) AS n FROM ev GROUP BY item), met AS (SELECT a, b, support, ca.n AS na, cb.n AS nb FROM pr JOIN c ca ON ca.item = a JOIN c cb ON cb.item = b)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a basket of parts, changed at the order's date."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("basket"), F.col("o_orderdate").alias("at"))
    return cochange.eligible(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("basket"), F.col("l_partkey").alias("item")).join(orders, "basket", "left"))


@query(f"WITH {_ONE} SELECT a, b, support, round(support::DOUBLE / (na + nb - support), 4) AS score FROM met")
def cochange_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cochange.scored(_events(spark, sf_dir), "jaccard")


@query(f"WITH {_ONE} SELECT a, b, support, round(support::DOUBLE / na, 4) AS score FROM met UNION ALL SELECT b, a, support, round(support::DOUBLE / nb, 4) FROM met")
def cochange_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cochange.scored(_events(spark, sf_dir), "conditional")


@query(f"WITH {_ONE} SELECT a, b, support, round(support * (SELECT count(*) FROM ok)::DOUBLE / (na * nb), 4) AS score FROM met")
def cochange_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cochange.scored(_events(spark, sf_dir), "lift")


@query(f"WITH {_ONE}, w AS (SELECT o_orderkey AS basket, o_orderdate AS stamp FROM orders), nw AS (SELECT max(stamp) AS newest FROM w WHERE basket IN (SELECT basket FROM ok)) SELECT x.item AS a, y.item AS b, count(*) AS support, round(sum(pow(0.5::DOUBLE, (epoch(newest) - epoch(stamp)) / 86400.0::DOUBLE / 90)), 6) AS weight FROM ev x JOIN ev y ON x.basket = y.basket AND x.item < y.item JOIN w ON w.basket = x.basket, nw GROUP BY x.item, y.item")
def cochange_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cochange.pairs(_events(spark, sf_dir), 90.0).withColumn("weight", F.round("weight", 6))


@query(f"WITH {_ONE}, s AS (SELECT a, b, support, round(support::DOUBLE / (na + nb - support), 4) AS score FROM met), e AS (SELECT * FROM s UNION ALL SELECT b, a, support, score FROM s) SELECT a, b, support, score, CAST(row_number() OVER (PARTITION BY a ORDER BY score DESC, support DESC, b) AS INTEGER) AS rank FROM e QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, support DESC, b) <= 10")
def cochange_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cochange.partners(cochange.scored(_events(spark, sf_dir), "jaccard"))


@query("SELECT user_id, event_type, value, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def event_family_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = F.max_by(F.struct("value", "ts"), F.struct("ts", "event_id"))
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(latest.alias("x")).select("user_id", "event_type", "x.value", "x.ts")


@query("WITH e AS (SELECT user_id, count(*) AS edits, count(DISTINCT event_type) AS diversity, count(*) FILTER (value > 50) AS fixes, max(ts) AS last FROM events GROUP BY user_id) SELECT user_id, edits, diversity, fixes, round(ln(1 + edits) / max(ln(1 + edits)) OVER (), 6) AS edit_norm FROM e")
def hotspot_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximum over all is one row that is joined, so that no window gathers everything in one task."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("edits"), F.count_distinct("event_type").alias("diversity"), F.count(F.when(F.col("value") > 50, 1)).alias("fixes"))
    top = e.agg(F.max(F.log1p("edits")).alias("top"))
    return e.join(F.broadcast(top), F.lit(True)).select("user_id", "edits", "diversity", "fixes", F.round(F.log1p("edits") / F.col("top"), 6).alias("edit_norm"))


@query("WITH m AS (SELECT max(ts) AS newest FROM events) SELECT user_id, round(sum(CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'click' THEN 0.5 ELSE 0 END * pow(0.5::DOUBLE, (epoch(newest) - epoch(ts)) / 86400.0::DOUBLE / 30)), 6) AS weight FROM events, m GROUP BY user_id")
def outcome_weighted_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of events without a weight count nothing; ages are measured from the newest event."""
    e = table(spark, sf_dir, "events")
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    met = e.join(F.broadcast(e.agg(F.max("ts").alias("newest"))), F.lit(True))
    weight = F.when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type") == "click", 0.5).otherwise(0.0)
    return met.groupBy("user_id").agg(F.round(F.sum(weight * F.pow(F.lit(0.5), (seconds("newest") - seconds("ts")) / 86400.0 / 30)), 6).alias("weight"))


@query("SELECT event_type, count(DISTINCT user_id) FILTER (value >= 50) AS support, count(DISTINCT user_id) FILTER (value < 50) AS contradiction FROM events GROUP BY event_type HAVING count(DISTINCT user_id) FILTER (value >= 50) >= 3")
def pattern_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct(F.when(F.col("value") >= 50, F.col("user_id"))).alias("support"), F.count_distinct(F.when(F.col("value") < 50, F.col("user_id"))).alias("contradiction"))
    return e.filter("support >= 3")


@query("WITH c AS (SELECT doc_id, sha256(coalesce(text, '')) AS s FROM documents) SELECT min(doc_id) AS doc_id, s AS sha, count(*) AS copies FROM c GROUP BY s")
def content_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


_SIDES = "a AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN md5(text || '!') ELSE md5(text) END AS h FROM documents WHERE doc_id % 5 <> 0)"


@query(f"WITH {_SIDES} SELECT doc_id, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'deleted' WHEN a.h <> b.h THEN 'modified' ELSE 'same' END AS change FROM a FULL JOIN b USING (doc_id)")
def diff_added_deleted_modified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of the table that differ by stated rules, compared in full."""
    d = table(spark, sf_dir, "documents")
    a = d.filter("doc_id % 7 <> 0").select("doc_id", F.md5("text").alias("old"))
    b = d.filter("doc_id % 5 <> 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified").otherwise("same")
    return a.join(b, "doc_id", "full_outer").select("doc_id", change.alias("change"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("WITH f AS (SELECT user_id, event_id, event_type = 'error' AS bad, max(CASE WHEN event_type <> 'error' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS last_good FROM events) SELECT user_id, count(*) FILTER (bad AND event_id > coalesce(g, -1)) AS failures, 60 * least(8, count(*) FILTER (bad AND event_id > coalesce(g, -1))) AS cooldown FROM (SELECT user_id, event_id, bad, max(last_good) OVER (PARTITION BY user_id) AS g FROM f) GROUP BY user_id")
def breaker_open_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures since the last success of a user, and the seconds to wait: 60 each, 8 times at most."""
    e = table(spark, sf_dir, "events")
    good = e.filter("event_type <> 'error'").groupBy("user_id").agg(F.max("event_id").alias("g"))
    n = F.count(F.when((F.col("event_type") == "error") & (F.col("event_id") > F.coalesce("g", F.lit(-1))), 1))
    return e.join(good, "user_id", "left").groupBy("user_id").agg(n.alias("failures")).select("user_id", "failures", (60 * F.least(F.lit(8), "failures")).alias("cooldown"))


@query("WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) SELECT o_custkey, o_orderkey, CASE WHEN n = 1 THEN 'published' WHEN n <= 4 THEN 'superseded' ELSE 'retired' END AS state FROM r")
def generation_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest generation is published, three before it are kept, the others are retired."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(n == 1, "published").when(n <= 4, "superseded").otherwise("retired").alias("state"))
