"""Queries on tables that change: refreshes, sweeps, corrections, retention, ledgers, receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from millrace.operators import graph, index, state
from millrace.plans.base import query
from millrace.plans.retrieval import _TERMS
from millrace.sources.tables import table


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of the documents: in the first those of thirds 0 and 1, in the second those of thirds 1 and 2, of
    which every eleventh has a mark at its end."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    after = d.filter("doc_id % 3 <> 0").withColumn("text", F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit(" addendum"))).otherwise(F.col("text")))
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    return d.filter("doc_id % 3 <> 2").withColumn("sha", sha), after.withColumn("sha", sha)


_AFTER = "v AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN text || ' addendum' ELSE text END AS text FROM documents WHERE doc_id % 3 <> 0)"


@query(f"WITH {_AFTER} SELECT doc_id, CAST(len({_TERMS}) AS BIGINT) AS n_terms, sha256(coalesce(text, '')) AS sha FROM v")
def incremental_equals_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A refresh from the first version gives what building from the second alone gives: the SQL is the rebuild."""
    before, after = _versions(spark, sf_dir)
    terms = F.size(F.regexp_extract_all(F.lower("text"), F.lit(index.TERM), F.lit(0))).cast("long")
    compute = lambda rows: rows.select("doc_id", F.when(F.col("text").isNotNull(), terms).alias("n_terms"), "sha")
    return state.refreshed(after, compute(before), "doc_id", compute)


@query("SELECT count(*) FILTER (doc_id % 3 = 2 OR doc_id % 11 = 0) AS recomputed, count(*) FILTER (doc_id % 3 = 1 AND doc_id % 11 <> 0) AS reused FROM documents WHERE doc_id % 3 <> 0 AND text IS NOT NULL")
def refresh_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _versions(spark, sf_dir)
    work = state.changed(after, before, "doc_id").select("doc_id", F.lit(True).alias("work"))
    met = after.filter("text is not null").join(work, "doc_id", "left")
    return met.agg(F.count("work").alias("recomputed"), F.count(F.when(F.col("work").isNull(), 1)).alias("reused"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def sweep_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending orders are of an older generation: their lines go with them."""
    seen = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return state.swept(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), seen, ["l_orderkey"])


@query("WITH l AS (SELECT user_id, max_by(event_type, event_id) AS state FROM events GROUP BY user_id) SELECT state, count(*) AS n FROM l GROUP BY state")
def log_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("state"))
    return state.latest(log, "user_id", "event_id").groupBy("state").agg(F.count("*").alias("n"))


_RECORDED = "r AS (SELECT DISTINCT l_orderkey AS event_id, l_partkey AS path FROM lineitem)"


@query(f"WITH {_RECORDED}, c AS (SELECT l_orderkey AS event_id, l_partkey + l_linenumber % 2 AS path, max_by(CASE WHEN l_returnflag = 'R' THEN 'irrelevant' ELSE 'relevant' END, l_linenumber * 2 + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS verdict FROM lineitem WHERE l_linenumber % 3 = 0 GROUP BY 1, 2) SELECT event_id, path FROM r ANTI JOIN (SELECT * FROM c WHERE verdict = 'irrelevant') i USING (event_id, path) UNION SELECT event_id, path FROM c WHERE verdict = 'relevant'")
def experience_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of an order as its files; every third line corrects its own part or the next, and of one line
    number the taking away counts."""
    line = table(spark, sf_dir, "lineitem")
    rows = line.select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("path")).distinct()
    said = F.when(F.col("l_returnflag") == "R", "irrelevant").otherwise("relevant")
    fixes = line.filter("l_linenumber % 3 = 0").select(F.col("l_orderkey").alias("event_id"), (F.col("l_partkey") + F.col("l_linenumber") % 2).alias("path"), said.alias("verdict"), (F.col("l_linenumber") * 2 + (F.col("l_returnflag") == "R").cast("int")).alias("id"))
    return state.corrected(rows, fixes)


@query("WITH f AS (SELECT l_orderkey AS event_id, l_partkey AS path, CASE WHEN l_linenumber % 4 <> 0 THEN md5(p_name) END AS sha FROM lineitem JOIN part ON p_partkey = l_partkey), c AS (SELECT p_partkey AS path, CASE WHEN p_size = 7 THEN md5(p_type) ELSE md5(p_name) END AS now FROM part WHERE p_size <> 9), g AS (SELECT event_id, count(sha) AS known, count(*) FILTER (sha IS NOT NULL AND sha IS DISTINCT FROM now) AS moved FROM f LEFT JOIN c USING (path) GROUP BY event_id) SELECT event_id, CASE WHEN known = 0 THEN 'unknown' WHEN moved = 0 THEN 'compatible' WHEN moved < known THEN 'partially_changed' ELSE 'changed' END AS state FROM g")
def experience_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    files = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("path"), F.when(F.col("l_linenumber") % 4 != 0, F.md5("p_name")).alias("sha"))
    now = F.when(F.col("p_size") == 7, F.md5("p_type")).otherwise(F.md5("p_name"))
    return state.freshness(files, part.filter("p_size <> 9").select(F.col("p_partkey").alias("path"), now.alias("now")))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def retention_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return state.newest(e, "user_id", [F.desc("ts"), F.desc("event_id")], 20).select("user_id", "event_id")


@query("WITH m AS (SELECT max(ts) AS newest FROM events) SELECT event_type, count(*) FILTER (ts < newest - INTERVAL 7 DAY) AS would_go, count(*) FILTER (ts >= newest - INTERVAL 7 DAY) AS would_stay FROM events, m GROUP BY event_type")
def prune_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pruning by age would take, counted only; age is from the newest event."""
    e = table(spark, sf_dir, "events")
    old = F.col("ts") < F.col("newest") - F.expr("INTERVAL 7 DAYS")
    met = e.join(F.broadcast(e.agg(F.max("ts").alias("newest"))), F.lit(True))
    return met.groupBy("event_type").agg(F.count(F.when(old, 1)).alias("would_go"), F.count(F.when(~old, 1)).alias("would_stay"))


@query("WITH l AS (SELECT DISTINCT md5(text) AS h FROM documents WHERE doc_id % 4 = 0 AND text IS NOT NULL) SELECT doc_id, h IS NOT NULL AS delivered FROM documents LEFT JOIN l ON md5(text) = h WHERE doc_id % 4 <> 0")
def reuse_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that went out before (every fourth document) need no second delivery."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    return state.undelivered(d.filter("doc_id % 4 <> 0"), d.filter("doc_id % 4 = 0"), ["h"]).select("doc_id", "delivered")


@query("SELECT event_id, user_id FROM events WHERE event_id % 2 = 0 OR (event_id % 5 <> 0)")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even events are stored; all arrive again, twice; every fifth is buried."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    return state.inserted_once(e.filter("event_id % 2 = 0"), e.union(e), e.filter("event_id % 5 = 0"), "event_id")


@query("WITH m AS (SELECT max(ts) - INTERVAL 2 DAY AS seen FROM events) SELECT event_id, CASE WHEN ts > seen + INTERVAL 300 SECOND THEN 'rejected' WHEN user_id % 7 = 0 THEN 'historical' WHEN event_type <> 'signup' AND seen > ts + INTERVAL 5 DAY THEN 'expired' ELSE 'current' END AS state FROM events, m")
def receipt_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as receipts, judged two days before the newest; sign-ups do not expire."""
    e = table(spark, sf_dir, "events")
    met = e.join(F.broadcast(e.agg((F.max("ts") - F.expr("INTERVAL 2 DAYS")).alias("at"))), F.lit(True))
    expires = F.when(F.col("event_type") != "signup", F.col("ts") + F.expr("INTERVAL 5 DAYS"))
    session = F.when(F.col("user_id") % 7 != 0, F.col("user_id"))
    return met.select("event_id", state.receipt_state(F.col("ts"), expires, session, F.col("at"), F.expr("INTERVAL 300 SECONDS")).alias("state"))


@query("WITH e AS (SELECT o_custkey AS revision, count(*) AS declared, count(*) FILTER (o_orderstatus <> 'P') AS current, count(*) FILTER (o_orderstatus = 'P') AS withdrawn, count(DISTINCT o_orderpriority) FILTER (o_orderstatus <> 'P') AS families FROM orders GROUP BY o_custkey) SELECT *, families >= 2 AS supported FROM e")
def support_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the evidence of a customer's revision; pending ones were withdrawn."""
    good = F.col("o_orderstatus") != "P"
    got = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("revision")).agg(F.count("*").alias("declared"), F.count(F.when(good, 1)).alias("current"), F.count(F.when(~good, 1)).alias("withdrawn"), F.count_distinct(F.when(good, F.col("o_orderpriority"))).alias("families"))
    return got.withColumn("supported", F.col("families") >= 2)


@query("WITH t AS (SELECT user_id, event_type, max_by(value, event_id) AS v FROM events GROUP BY ALL) SELECT user_id, CASE WHEN max(v) FILTER (event_type = 'error') > 50 THEN 'failing' WHEN count(*) FILTER (event_type <> 'error' AND v > 50) = 4 THEN 'healthy' WHEN count(*) FILTER (event_type <> 'error' AND v > 50) > 0 THEN 'degraded' ELSE 'unverified' END AS display FROM t GROUP BY user_id")
def health_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest receipt of each operation, then one display state by rules in order."""
    last = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("v"))
    good = F.count(F.when((F.col("event_type") != "error") & (F.col("v") > 50), 1))
    per = last.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "error", F.col("v"))).alias("error"), good.alias("good"))
    return per.select("user_id", F.when(F.col("error") > 50, "failing").when(F.col("good") == 4, "healthy").when(F.col("good") > 0, "degraded").otherwise("unverified").alias("display"))


@query("WITH RECURSIVE b AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS needs, length(text) < 40 AS broken FROM (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL)), w AS (SELECT conv_id, turn AS origin, turn AS at, needs, broken FROM b UNION ALL SELECT w.conv_id, origin, b.turn, b.needs, w.broken OR b.broken FROM w JOIN b ON b.conv_id = w.conv_id AND b.turn = w.needs) SELECT conv_id, origin AS turn, count(*) - 1 AS dependencies, coalesce(bool_or(broken), false) AS broken FROM w GROUP BY conv_id, origin")
def dependency_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn needs the one before; its state is that of all it needs, however far back."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text")).withColumn("broken", F.coalesce(F.length("text") < 40, F.lit(False)))
    t = t.withColumn("needs", F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn")))
    return graph.closure(t.select("conv_id", "turn", "needs", "broken"), "conv_id", "turn", "needs", "broken")
