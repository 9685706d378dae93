"""Table reading and the shared scratch area."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named parquet table below sf_dir, which may be any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Only a session on one machine gets a temporary one where none
    is set: on a cluster each executor would write to its own disk, and rows would be lost."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(frame: DataFrame, label: str) -> DataFrame:
    """The frame as a parquet table in the shared folder: read many times, computed once, and safe when executors are lost."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


#: Rows that a task of a shuffle should get, about.
ROWS_EACH = 500_000


@contextmanager
def _set(spark: SparkSession, name: str, value: int | str) -> Iterator[None]:
    was = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, was)


def wide(spark: SparkSession, rows: int) -> AbstractContextManager:
    """What is written within is shuffled to so many partitions that the memory of a task doesn't grow with the rows. The
    session's number is the least, and holds again afterwards."""
    name = "spark.sql.shuffle.partitions"
    return _set(spark, name, max(int(spark.conf.get(name)), -(-rows // ROWS_EACH)))


def shuffled(spark: SparkSession) -> AbstractContextManager:
    """Tables that are written within are joined by shuffles, and none goes through the driver unless it is told to. For
    rounds, of which each would broadcast what it found."""
    return _set(spark, "spark.sql.autoBroadcastJoinThreshold", "-1")


#: A key with more than this share of the rows is hot; so there are fewer hot keys than 1 / HOT_SHARE.
HOT_SHARE = 1 / 1000


def join_hot(rows: DataFrame, facts: DataFrame, key: str, held: str, least: int = 1000) -> DataFrame:
    """Inner join of rows with facts, which has one row for each key and in `held` how many rows have the key.

    Keys with a thousandth of all rows or more, a thousand at most, are broadcast, so that no task gets all rows of one.
    The others are shuffled. Give written tables: rows and facts are read twice.
    """
    total = facts.agg(F.sum(held)).first()[0] or 0
    bound = max(least, total * HOT_SHARE)
    hot, cold = facts.filter(F.col(held) >= bound), facts.filter(F.col(held) < bound)
    if total < least or not hot.limit(1).count():
        return rows.join(facts, key)
    few = F.broadcast(hot)  # 1 / HOT_SHARE rows at most
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(few, key).unionByName(rest.join(cold, key))


def look_up(rows: DataFrame, facts: DataFrame, key: str, least: int = 1000) -> DataFrame:
    """Inner join of rows with facts, which has one row for each key, or few. As `join_hot`, but only the hot keys are looked for, so
    that facts need not meet counts of all keys first. Give written tables: rows and facts are read twice."""
    bound = max(least, rows.count() * HOT_SHARE)
    hot = written(rows.groupBy(key).count().filter(F.col("count") >= bound).select(key), "hot")
    if not hot.limit(1).count():
        return rows.join(facts, key)
    few = F.broadcast(facts.join(F.broadcast(hot), key))  # 1 / HOT_SHARE rows at most
    rest = rows.join(F.broadcast(hot), key, "left_anti")
    return rows.join(few, key).unionByName(rest.join(facts, key))
