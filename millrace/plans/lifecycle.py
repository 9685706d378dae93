"""Queries on builds, caches, revisions, evictions and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from millrace.operators import lifecycle
from millrace.plans.base import query
from millrace.sources.tables import table

_PATH = "source || '/' || lang || '/d' || doc_id"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat("source", F.lit("/"), "lang", F.lit("/d"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), "n_chars", "text", "source", "lang")


@query(f"SELECT doc_id, path FROM (SELECT doc_id, {_PATH} AS path FROM documents) WHERE NOT (path = 'src7/en' OR starts_with(path, 'src7/en/')) AND NOT (path = 'src1' OR starts_with(path, 'src1/'))")
def prefix_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.without_prefixes(_files(spark, sf_dir).select("doc_id", "path"), "path", ["src7/en", "src1"])


@query(f"""WITH f AS (SELECT doc_id, {_PATH} AS path, sha256(coalesce(text, '')) AS sha FROM documents)
SELECT path, sha, CAST(CAST('0x' || substr(sha, 1, 4) AS INTEGER) % 16 AS INTEGER) AS shard, doc_id % 4 > 0 AS reused FROM f""")
def record_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of three quarters of the files as they are, and of the others with older content."""
    files = _files(spark, sf_dir)
    cache = files.select("path", F.when(F.col("doc_id") % 4 > 0, F.col("sha")).otherwise(F.sha2("path", 256)).alias("sha"))
    return lifecycle.reusable(files, cache)


@query(f"SELECT {_PATH} AS path FROM documents WHERE NOT (doc_id % 3 = 0 AND n_chars % 2 = 0)")
def resume_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    done = files.filter("doc_id % 3 = 0").select("path", F.when(F.col("n_chars") % 2 == 0, "building").otherwise("published").alias("state"))
    return lifecycle.remaining_work(files, done, "path").select("path")


@query(f"""WITH n AS (SELECT {_PATH} AS path, source, row_number() OVER (PARTITION BY source ORDER BY {_PATH}) - 1 AS i FROM documents)
SELECT source, path FROM n WHERE i % 7 = 0""")
def freshness_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh path of a source, in order; sampling is the feature."""
    order = Window.partitionBy("source").orderBy("path")
    return _files(spark, sf_dir).withColumn("i", F.row_number().over(order) - 1).filter("i % 7 = 0").select("source", "path")


@query("""WITH e AS (SELECT user_id % 40 AS revision, event_id AS seq, CASE event_type WHEN 'error' THEN 'rolled_back' WHEN 'view' THEN 'canary' ELSE 'active' END AS state, event_id + 500 AS expires, 300 AS most_uses FROM events),
l AS (SELECT revision, max(seq) AS seq FROM e GROUP BY revision), u AS (SELECT user_id % 40 AS revision, count(*) AS uses FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT revision, CASE WHEN state = 'canary' AND (expires < 10000 OR coalesce(uses, 0) >= most_uses) THEN 'expired' ELSE state END AS state FROM l JOIN e USING (revision, seq) LEFT JOIN u USING (revision)""")
def revision_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of revisions by their last event; views begin a canary, errors roll back."""
    events = table(spark, sf_dir, "events").withColumn("revision", F.col("user_id") % 40)
    state = F.when(F.col("event_type") == "error", "rolled_back").when(F.col("event_type") == "view", "canary").otherwise("active")
    log = events.select("revision", F.col("event_id").alias("seq"), state.alias("state"), (F.col("event_id") + 500).alias("expires"), F.lit(300).alias("most_uses"))
    uses = events.filter("event_type = 'click'").groupBy("revision").agg(F.count("*").alias("uses"))
    return lifecycle.eligible_revisions(log, F.lit(10000), uses)


@query("""WITH e AS (SELECT user_id, props AS entry, max(event_id) AS used FROM events GROUP BY 1, 2)
SELECT user_id, entry, used FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY used DESC, entry) <= 5""")
def lru_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "events").groupBy("user_id", F.col("props").alias("entry")).agg(F.max("event_id").alias("used"))
    return lifecycle.kept_by_use(entries, "user_id", "used", "entry", 5)


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size = 1 AND p_partkey IS NOT NULL)""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of deleted parts go with them."""
    gone = table(spark, sf_dir, "part").filter("p_size = 1").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(gone, "l_partkey", "left_anti")


@query("""SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal < 0) AS withdrawn FROM orders""")
def support_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that cite a supplier in debt are withdrawn."""
    evidence = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("source"))
    forgotten = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("source"))
    return lifecycle.supported(table(spark, sf_dir, "orders").select("o_orderkey"), evidence, forgotten, "o_orderkey")


@query("""WITH c AS (SELECT conv_id, turn, min(CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END) AS duty FROM conversations GROUP BY 1, 2)
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY duty, turn) AS INTEGER) AS evicted FROM c""")
def eviction_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In which order items make room: the least obligation first, the oldest first."""
    duty = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min(duty).alias("duty"))
    return turns.select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("duty", "turn")).alias("evicted"))


@query("""WITH r AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS line, CAST(sum(l_quantity * 40) AS BIGINT) AS need FROM lineitem GROUP BY 1, 2),
f AS (SELECT *, least(4000 // count(*) OVER (PARTITION BY l_orderkey), need) AS first FROM r),
m AS (SELECT *, 4000 - sum(first) OVER (PARTITION BY l_orderkey) AS rest, need - first AS more FROM f)
SELECT l_orderkey, l_partkey, CAST(first + greatest(0, least(more, rest - coalesce(sum(more) OVER (PARTITION BY l_orderkey ORDER BY line, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS given FROM m""")
def excerpt_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes for the parts of an order from 4000: equal shares, then what is left in order."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("line"), F.sum(F.col("l_quantity") * 40).cast("long").alias("need"))
    return lifecycle.allotted(rows, "l_orderkey", [F.col("line"), F.col("l_partkey")], "need", 4000).select("l_orderkey", "l_partkey", "given")


@query()
def window_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines around the middle of each document that fit into 400 characters. A fold, tested against a loop."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    fit = lifecycle.fitted(F.col("lines"), F.floor(F.size("lines") / 2), 400)
    docs = table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines"))
    return docs.select("doc_id", fit.alias("fit")).select("doc_id", "fit.first", "fit.last")
