"""Suppliers as tasks over a graph of parts that are ordered together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators import taskviews
from millrace.plans.base import query
from millrace.sources.tables import table


def task_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(hits, edges): how often a supplier delivers a part, and from an order's first part to those of its large lines."""
    lines = table(spark, sf_dir, "lineitem")
    hits = lines.groupBy(F.col("l_suppkey").alias("task_id"), F.col("l_partkey").alias("node")).agg(F.count("*").alias("score"))
    first = lines.filter("l_linenumber = 1").select("l_orderkey", F.col("l_partkey").alias("a"))
    kind = F.when(F.col("l_returnflag") == "A", "calls").when(F.col("l_returnflag") == "N", "imports").otherwise("references")
    large = lines.filter("l_linenumber > 1 and l_quantity >= 49").join(first, "l_orderkey")
    return hits, large.select("a", F.col("l_partkey").alias("b"), kind.alias("kind"), (F.col("l_linestatus") == "F").alias("resolved"))


@query()
def task_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taskviews.task_views(*task_graph(spark, sf_dir))
