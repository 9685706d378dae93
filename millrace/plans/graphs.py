"""Queries on graphs: degrees, expansion, reach, PageRank. Parts and suppliers are joined by line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from millrace.operators import graph
from millrace.plans.base import query
from millrace.sources.tables import table

_EDGES = "edges AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b")).distinct()


@query(f"WITH {_EDGES} SELECT b AS node, count(DISTINCT a) AS in_degree FROM edges GROUP BY b")
def in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).groupBy(F.col("b").alias("node")).agg(F.count_distinct("a").alias("in_degree"))


@query(f"WITH {_EDGES}, both_ways AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges), deg AS (SELECT b AS node, count(*) AS d FROM both_ways GROUP BY b) SELECT e.b AS node, round(sum(0.5::DOUBLE / ln(2 + d)), 6) AS strength, count(*) AS origins FROM both_ways e JOIN deg ON deg.node = e.b WHERE e.a IN (SELECT 'p' || p_partkey FROM part WHERE p_size = 1) GROUP BY e.b")
def edge_expand_1hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "part").filter("p_size = 1").select(F.concat(F.lit("p"), "p_partkey").alias("node"), F.lit(1.0).alias("strength"))
    return graph.expand(seeds, _edges(spark, sf_dir), 0.5).withColumn("strength", F.round("strength", 6))


@query(f"WITH {_EDGES}, both_ways AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges), s AS (SELECT 'p' || p_partkey AS node FROM part WHERE p_size = 1), h1 AS (SELECT DISTINCT b AS node FROM both_ways WHERE a IN (SELECT node FROM s)), h2 AS (SELECT DISTINCT b AS node FROM both_ways WHERE a IN (SELECT node FROM h1)), u AS (SELECT node, 0 AS d FROM s UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2) SELECT node, CAST(min(d) AS INTEGER) AS distance FROM u GROUP BY node")
def bfs_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "part").filter("p_size = 1").select(F.concat(F.lit("p"), "p_partkey").alias("node"))
    return graph.reach(seeds, _edges(spark, sf_dir), 2)


@query()
def ppr_16_iterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "part").filter("p_size = 1").select(F.concat(F.lit("p"), "p_partkey").alias("node"))
    return graph.personalised_pagerank(seeds, _edges(spark, sf_dir)).withColumn("score", F.round("score", 9))


@query("WITH RECURSIVE n AS (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM (SELECT DISTINCT conv_id, turn FROM conversations)), w AS (SELECT conv_id, turn AS origin, turn AS here, 0 AS hops FROM n UNION ALL SELECT w.conv_id, origin, n.nxt, hops + 1 FROM w JOIN n ON n.conv_id = w.conv_id AND n.turn = w.here WHERE n.nxt IS NOT NULL AND hops < 8) SELECT conv_id, origin, max(here) AS current_turn, CAST(max(hops) AS INTEGER) AS hops FROM w GROUP BY conv_id, origin")
def rename_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each name is followed through its renames, eight at most; here a turn of a conversation leads to the next."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    links = turns.withColumn("nxt", F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn")))
    return graph.follow(links, "conv_id", "turn", "nxt", 8).select("conv_id", F.col("turn").alias("origin"), F.col("at").alias("current_turn"), "hops")
