"""Queries with windows, budgets and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from millrace.operators import budgets, packets
from millrace.plans.base import query
from millrace.sources.tables import table


@query("SELECT source, doc_id, n_chars, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rank FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 5")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", F.row_number().over(order).alias("rank")).filter("rank <= 5")


@query("SELECT source, doc_id, CAST(used AS BIGINT) AS used FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) WHERE used <= 20000")
def running_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return packets.prefix_sums(d, "source", "doc_id", "n_chars").filter("used <= 20000").select("source", "doc_id", "used")


@query("SELECT user_id, event_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 5 AS BIGINT) AS block FROM events")
def chrono_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("at"), F.lit(1).alias("one"))
    return packets.prefix_sums(e, "user_id", "at", "one").select("user_id", "event_id", F.floor((F.col("used") - 1) / 5).alias("block"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 1 AS seen_before FROM events")
def family_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and type is found by partial minima, and joined by its own id: no key is hot."""
    e = table(spark, sf_dir, "events")
    first = e.groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("at")).select(F.col("at.event_id").alias("event_id"), F.lit(True).alias("first"))
    return e.select("event_id").join(first, "event_id", "left").select("event_id", F.col("first").isNull().alias("seen_before"))


@query("SELECT l_orderkey, l_linenumber, CAST(coalesce(lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1, l_linenumber) AS INTEGER) AS end_line FROM lineitem")
def next_definition_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(F.lead("l_linenumber").over(order) - 1, F.col("l_linenumber")).alias("end_line"))


@query("WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents) SELECT lang, doc_id FROM r WHERE n <= CASE lang WHEN 'en' THEN 10 WHEN 'de' THEN 5 ELSE 3 END")
def quota_per_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))
    quota = F.when(F.col("lang") == "en", 10).when(F.col("lang") == "de", 5).otherwise(3)
    return table(spark, sf_dir, "documents").select("lang", "doc_id", (n <= quota).alias("kept")).filter("kept").drop("kept")


@query()
def greedy_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order are taken in turn where they still fit in 100 units."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return budgets.skip_if_too_big(lines, "l_orderkey", "l_linenumber", "l_quantity", 100.0)


@query()
def rerank_tie_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order in bands of five per cent below the band's first price."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return budgets.tie_bands(lines, "l_orderkey", "l_linenumber", "l_extendedprice", 0.05)


@query("SELECT doc_id, CAST(ceil(octet_length(encode(text)) / 2.0) AS BIGINT) AS tokens_by_bytes, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens_by_chars FROM documents")
def size_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.ceil(F.octet_length("text") / 2).alias("tokens_by_bytes"), F.ceil(F.length("text") / 4).alias("tokens_by_chars"))


@query("SELECT doc_id, CAST(('0x' || substr(sha256(doc_id::VARCHAR), 1, 4))::BIGINT % 16 AS INTEGER) AS shard FROM documents")
def hash_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 4)
    return table(spark, sf_dir, "documents").select("doc_id", (F.conv(digits, 16, 10).cast("long") % 16).cast("int").alias("shard"))
