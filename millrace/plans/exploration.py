"""Customers as tasks whose rankings of parts make requests, over two rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from millrace.operators import inspection
from millrace.plans.base import query
from millrace.sources.tables import table, written


def given(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A customer's twenty most ordered parts, sizes they want, parts of a size, sizes that parts are ordered with, and parts ordered together."""
    orders, lines, parts = (table(spark, sf_dir, n) for n in ("orders", "lineitem", "part"))
    met = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("query_id"), F.col("l_partkey").alias("path"))
    bought = met.repartition("query_id").groupBy("query_id", "path").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "path"))
    first = lines.filter("l_linenumber = 1").select("l_orderkey", F.col("l_partkey").alias("path"))
    near = written(lines.filter("l_linenumber > 1").join(first, "l_orderkey").select("path", F.col("l_partkey").alias("other")).distinct(), "near")
    return {
        "ranked": bought.withColumn("rank", rank).filter("rank <= 20").drop("n"),
        "wanted": orders.select(F.col("o_custkey").alias("query_id"), (F.col("o_orderkey") % 60).alias("name")).distinct(),
        "defined": parts.select(F.col("p_size").cast("long").alias("name"), F.col("p_partkey").alias("path")),
        "uses": near.join(parts, F.col("other") == F.col("p_partkey")).groupBy(F.col("p_size").cast("long").alias("name"), "path").agg(F.count("*").alias("n")),
        "near": near,
        "tests": parts.filter("p_partkey % 11 = 0").select(F.col("p_partkey").alias("path")),
    }


@query()
def explorer_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds, in which a ranking makes the next requests."""
    return inspection.explored(**given(spark, sf_dir))
