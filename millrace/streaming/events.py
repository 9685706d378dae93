"""Structured Streaming over event files: windows, sessions and de-duplication. Extensions beyond batch retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from millrace.sources.tables import shared_dir


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """The files of a folder by that name as a stream. Times without zone are read as the session's zone."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str, late: str) -> DataFrame:
    """Counts and sums by window and type; append mode gives a window once the watermark passed it."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return windows.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def deduplicated(events: DataFrame, key: str, late: str) -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Runs the stream over what is there now, into a table in the shared folder.

    In complete mode each trigger replaces the table; with foreachBatch the last one stands.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    return out.drop("batch") if mode != "complete" else out


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Counts of each user's sessions, which end after `gap` without an event."""
    per = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return per.select("user_id", F.col("w.start").alias("start"), "n")


def reviewed(events: DataFrame, cursor: DataFrame, key: str) -> DataFrame:
    """Events past the cursor (one row, at): what a review that keeps its place still has to read."""
    return events.join(F.broadcast(cursor), F.lit(True)).filter(F.col(key) > F.col("at")).drop("at")


def working_memory(events: DataFrame, group: str, order: str, kind: str, window: int) -> DataFrame:
    """(group, kind, recent, compacted): the last `window` events of a group stay as they are, older ones become counts
    by kind. How many came after an event is needed only up to the window, so each task keeps the last few first."""
    last = Window.partitionBy(group).orderBy(F.desc(order))
    held = events.select(group, order).withColumn("n", F.row_number().over(last)).filter(F.col("n") <= window)
    floor = held.groupBy(group).agg(F.min(order).alias("floor"))
    is_recent = F.col(order) >= F.col("floor")
    return events.join(floor, group).groupBy(group, kind).agg(F.count(F.when(is_recent, 1)).alias("recent"), F.count(F.when(~is_recent, 1)).alias("compacted"))
