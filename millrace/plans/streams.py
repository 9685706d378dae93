"""Streaming queries, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators import packets
from millrace.plans.base import query
from millrace.sources.tables import table
from millrace.streaming import events, keyed


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = events.drained(events.tumbling(events.event_stream(spark, sf_dir), "1 day", "1 hour"), "complete")
    return got.select(F.col("start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT DISTINCT event_id FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.drained(events.deduplicated(events.event_stream(spark, sf_dir), "event_id", "3650 days").select("event_id"), "append")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS i FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, i")
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of half an hour, as one batch over what is there; in a stream the last ones stay open."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.sessions(e, "30 minutes", "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT user_id, event_type, count(*) FILTER (n <= 12) AS recent, count(*) FILTER (n > 12) AS compacted FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) GROUP BY ALL")
def working_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.working_memory(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", 12)


@query("SELECT event_type, count(*) AS unread FROM events WHERE event_id > (SELECT max(event_id) * 0.9 FROM events) GROUP BY event_type")
def cursor_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine tenths were read before."""
    e = table(spark, sf_dir, "events")
    return events.reviewed(e, e.agg((F.max("event_id") * 0.9).alias("at")), "event_id").groupBy("event_type").agg(F.count("*").alias("unread"))


@query("SELECT event_id, coalesce(count(*) OVER w, 0) AS earlier, round(max(value) OVER w, 6) AS best_before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def replay_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was known of a user strictly before each event."""
    got = packets.known_before(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), "user_id", "event_id", "value")
    return got.select("event_id", "earlier", F.round("best_before", 6).alias("best_before"))


@query("SELECT user_id, event_type, count(*) FILTER (n <= 12) AS recent, count(*) FILTER (n > 12) AS compacted FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) GROUP BY ALL")
def stream_working_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """working_memory with its windows and counts in state."""
    base = keyed.new_base(spark)
    stream = keyed.working_memory(events.event_stream(spark, sf_dir), "user_id", "event_id", "event_type", 12)
    keyed.run_into(stream, base, "update")
    return keyed.latest(keyed.gathered(spark, base, stream.schema), ["user_id", "event_type"])


@query("SELECT event_id, coalesce(count(*) OVER w, 0) AS earlier, round(max(value) OVER w, 6) AS best_before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """replay_before with a count and a maximum in state."""
    base = keyed.new_base(spark)
    stream = keyed.replay(events.event_stream(spark, sf_dir), "user_id", "event_id", "value")
    keyed.run_into(stream, base, "append")
    return keyed.gathered(spark, base, stream.schema).select("event_id", "earlier", F.round("best_before", 6).alias("best_before"))


@query("SELECT event_type, count(*) AS unread FROM events WHERE event_id > (SELECT max(event_id) * 0.9 FROM events) GROUP BY event_type")
def stream_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cursor_review with its mark in the sink."""
    base = keyed.new_base(spark)
    mark = table(spark, sf_dir, "events").agg(F.max("event_id") * 0.9).first()[0]
    keyed.review_into(events.event_stream(spark, sf_dir), base, "event_id", "event_type", mark)
    return keyed.reviewed(spark, base).select(F.col("kind").alias("event_type"), "unread")
