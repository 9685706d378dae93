"""Queries on outcomes with unknown values and on paired experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators import statistics as st
from millrace.plans.base import query
from millrace.sources.tables import table

_PAIRS = "x AS (SELECT o_custkey AS family, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END) FILTER (o_orderkey % 2 = 0) AS a, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END) FILTER (o_orderkey % 2 = 1) AS b FROM orders GROUP BY o_custkey), pairs AS (SELECT * FROM x WHERE a IS NOT NULL AND b IS NOT NULL)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of even and odd keys are the two arms, a customer is a family, status F is a success."""
    return st.family_pairs(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("family"), (F.col("o_orderkey") % 2 == 0).alias("first_arm"), (F.col("o_orderstatus") == "F").alias("success")))


@query("SELECT d.lang, count(*) FILTER (toxic = 1) AS numerator, count(toxic) AS denominator, count(*) - count(toxic) AS missing, round(count(*) FILTER (toxic = 1)::DOUBLE / nullif(count(toxic), 0), 6) AS rate FROM documents d LEFT JOIN labels USING (doc_id) GROUP BY d.lang")
def nullable_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return st.rate(met, ["lang"], F.col("toxic") == 1).withColumn("rate", F.round("rate", 6))


@query("SELECT event_type, count(value) AS observed, count(*) - count(value) AS missing, round(median(value), 6) AS median, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def nullable_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    per = e.groupBy("event_type").agg(F.count("value").alias("observed"), (F.count("*") - F.count("value")).alias("missing"), F.round(F.sum("value"), 4).alias("total"))
    return per.join(st.median(e, "event_type", "value"), "event_type", "left").select("event_type", "observed", "missing", F.round("median", 6).alias("median"), "total")


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority")
def arm_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    arms = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return arms.select("o_orderpriority", *[F.coalesce(s, F.lit(0)).alias(s.lower()) for s in "FOP"])


@query(f"WITH {_PAIRS} SELECT count(*) AS families, count(*) FILTER (a > b) AS wins, count(*) FILTER (a < b) AS losses, count(*) FILTER (a = b) AS ties, round(avg(a - b), 6) AS difference FROM pairs")
def paired_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.tally(_pairs(spark, sf_dir)).withColumn("difference", F.round("difference", 6))


@query(f"WITH {_PAIRS} SELECT family, round(a, 6) AS a, round(b, 6) AS b FROM pairs")
def family_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("family", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query(f"WITH {_PAIRS} SELECT n, round(greatest(-1, d - h), 6) AS low, round(least(1, d + h), 6) AS high FROM (SELECT count(*) AS n, avg(a - b) AS d, 2 * sqrt(ln(2 / (1 - 0.95::DOUBLE)) / (2 * count(*))) AS h FROM pairs)")
def hoeffding_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = st.hoeffding(_pairs(spark, sf_dir), 0.95)
    return got.select("n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(f"WITH {_PAIRS}, r AS (SELECT unnest(range(200)) AS round_no), n AS (SELECT count(*) AS n FROM pairs), k AS (SELECT row_number() OVER (ORDER BY family) - 1 AS i, a - b AS d FROM pairs), s AS (SELECT round_no, ('0x' || substr(md5(round_no::VARCHAR || ':' || k.i::VARCHAR), 1, 8))::BIGINT % n AS pick FROM r, k, n), m AS (SELECT round_no, avg(d) AS mean FROM s JOIN k ON k.i = s.pick GROUP BY round_no) SELECT round_no, round(mean, 6) AS mean FROM m")
def bootstrap_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of 200 resamples whose picks come from md5, so that every engine draws the same."""
    return st.bootstrap(_pairs(spark, sf_dir), 200).withColumn("mean", F.round("mean", 6))


@query("SELECT CASE WHEN value < 25 THEN 'low' WHEN value < 75 THEN 'middle' ELSE 'high' END AS band, count(*) AS n, round(avg(CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0 END), 6) AS rate FROM events WHERE value IS NOT NULL GROUP BY 1")
def calibration_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.when(F.col("value") < 25, "low").when(F.col("value") < 75, "middle").otherwise("high")
    hit = F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0)
    return table(spark, sf_dir, "events").filter("value is not null").groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.avg(hit), 6).alias("rate"))


@query("WITH c AS (SELECT lang, count(quality) AS gold, count(*) FILTER (quality = 1) AS good FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang) SELECT round(avg(good::DOUBLE / nullif(gold, 0)), 6) AS macro, round(sum(good)::DOUBLE / sum(gold), 6) AS micro, count(*) FILTER (gold = 0) AS undefined FROM c")
def macro_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    c = met.groupBy("lang").agg(F.count("quality").alias("gold"), F.count(F.when(F.col("quality") == 1, 1)).alias("good"))
    return c.agg(F.round(F.avg(F.try_divide(F.col("good"), F.col("gold"))), 6).alias("macro"), F.round(F.sum("good") / F.sum("gold"), 6).alias("micro"), F.count(F.when(F.col("gold") == 0, 1)).alias("undefined"))


@query("SELECT event_type, value AS p90 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) WHERE i = greatest(1, CAST(ceil(0.9 * n) AS BIGINT))")
def p90_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.nearest_rank(table(spark, sf_dir, "events").filter("value is not null"), "event_type", "value", 0.9).withColumnRenamed("at", "p90")


@query("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice) FILTER (o_orderstatus <> 'P'), 2) AS known, count(*) = count(*) FILTER (o_orderstatus <> 'P') AS complete FROM orders GROUP BY o_orderpriority")
def cost_lower_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of pending orders are unknown: where there are any, the sum is a lower bound."""
    known = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum(known), 2).alias("known"), (F.count("*") == F.count(known)).alias("complete"))


@query("WITH g AS (SELECT conv_id, count(*) AS n, count(DISTINCT role) AS roles FROM conversations GROUP BY conv_id HAVING count(*) >= 2) SELECT roles, count(*) AS conversations FROM g GROUP BY roles")
def route_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_distinct("role").alias("roles")).filter("n >= 2")
    return g.groupBy("roles").agg(F.count("*").alias("conversations"))
