"""Queries that roll records up by folder, arm, family and status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators import statistics as st
from millrace.plans.base import query
from millrace.sources.tables import table


@query("SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang NOT IN ('en', 'de') OR lang IS NULL) AS other FROM documents GROUP BY source")
def coverage_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("lang").isin("en", "de"), F.col("lang")).otherwise("other")
    got = table(spark, sf_dir, "documents").withColumn("kind", kind).groupBy("source").pivot("kind", ["en", "de", "other"]).count()
    return got.select("source", *[F.coalesce(k, F.lit(0)).alias(k) for k in ("en", "de", "other")])


@query("SELECT coalesce(source, '*') AS module, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS size, CAST(max(n_chars) AS BIGINT) AS largest, count(DISTINCT lang) AS languages FROM documents WHERE source IS NOT NULL GROUP BY ROLLUP (source)")
def module_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each source and one for all."""
    d = table(spark, sf_dir, "documents").filter("source is not null")
    return d.rollup("source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("size"), F.max("n_chars").alias("largest"), F.count_distinct("lang").alias("languages")).select(F.coalesce("source", F.lit("*")).alias("module"), "files", "size", "largest", "languages")


@query("WITH s AS (SELECT l_partkey AS pattern, l_suppkey AS source, count(*) AS n FROM lineitem GROUP BY ALL) SELECT pattern, CAST(sum(n) AS BIGINT) AS support, round(max(n) / sum(n)::DOUBLE, 6) AS top_share, max(n) / sum(n)::DOUBLE > 0.6 AS dominated FROM s GROUP BY pattern")
def dominance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether one supplier gives over 60 per cent of a part's support."""
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("pattern"), "l_suppkey").agg(F.count("*").alias("n"))
    share = F.max("n") / F.sum("n")
    return s.groupBy("pattern").agg(F.sum("n").alias("support"), F.round(share, 6).alias("top_share"), (share > 0.6).alias("dominated"))


@query("WITH e AS (SELECT user_id AS family, event_type AS path, count(*) FILTER (value > 90) AS n FROM events GROUP BY ALL), c AS (SELECT family, string_agg(path, ',' ORDER BY path) AS core FROM e WHERE n >= 3 GROUP BY family) SELECT core, count(*) AS families FROM c GROUP BY core HAVING count(*) >= 2")
def core_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of kinds that users have often, as keys; a set counts from two users on."""
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("family"), F.col("event_type").alias("path")).agg(F.count(F.when(F.col("value") > 90, 1)).alias("n")).filter("n >= 3")
    cores = e.groupBy("family").agg(F.array_join(F.array_sort(F.collect_set("path")), ",").alias("core"))
    return cores.groupBy("core").agg(F.count("*").alias("families")).filter("families >= 2")


@query("WITH x AS (SELECT o_custkey AS family, sum(o_totalprice) FILTER (o_orderkey % 2 = 0) AS a, sum(o_totalprice) FILTER (o_orderkey % 2 = 1) AS b FROM orders GROUP BY 1) SELECT count(*) AS families, round(sum(a) / sum(b), 6) AS ratio, round(median(b - a), 4) AS median_difference FROM x WHERE a IS NOT NULL AND b IS NOT NULL")
def ratio_of_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of both arms over families that have both, and the median difference."""
    arm = lambda p: F.sum(F.when(F.col("o_orderkey") % 2 == p, F.col("o_totalprice")))
    x = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(arm(0).alias("a"), arm(1).alias("b")).dropna(subset=["a", "b"])
    middle = st.median(x.select(F.lit(0).alias("g"), (F.col("b") - F.col("a")).alias("d")), "g", "d").select(F.round("median", 4).alias("median_difference"))
    return x.agg(F.count("*").alias("families"), F.round(F.sum("a") / F.sum("b"), 6).alias("ratio")).join(middle, F.lit(True), "left")


@query("WITH f AS (SELECT conv_id, min(turn) FILTER (role = 'assistant') AS first FROM conversations GROUP BY conv_id) SELECT conv_id, count(*) FILTER (role = 'user') AS user_before, count(*) FILTER (role = 'system') AS system_before FROM conversations JOIN f USING (conv_id) WHERE first IS NULL OR turn < first GROUP BY conv_id")
def before_first_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What came before the first answer of a conversation; all of it where none came."""
    c = table(spark, sf_dir, "conversations")
    first = c.groupBy("conv_id").agg(F.min(F.when(F.col("role") == "assistant", F.col("turn"))).alias("first"))
    n = lambda r: F.count(F.when(F.col("role") == r, 1)).alias(f"{r}_before")
    return c.join(first, "conv_id").filter("first is null or turn < first").groupBy("conv_id").agg(n("user"), n("system"))


@query("WITH l AS (SELECT o_orderpriority AS arm, unnest(['all', o_orderstatus]) AS label, o_totalprice AS v FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY arm, label ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY arm, label) AS n FROM l) SELECT arm, label, count(*) AS n, min(v) AS low, max(v) FILTER (i = n // 2) AS upper_median, max(v) AS high FROM r GROUP BY arm, label")
def arm_label_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By arm and label, and a label for all. The median is the upper of the middle two, found by counts of equal values."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("arm"), F.explode(F.array(F.lit("all"), "o_orderstatus")).alias("label"), F.col("o_totalprice").alias("v"))
    got = o.groupBy("arm", "label").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    middle = st.upper_median(o.select(F.struct("arm", "label").alias("g"), "v"), "g", "v").select("g.arm", "g.label", "upper_median")
    return got.join(middle, ["arm", "label"])


@query("SELECT l_suppkey AS target, count(DISTINCT l_partkey) AS incoming FROM lineitem GROUP BY l_suppkey ORDER BY incoming DESC, target LIMIT 15")
def brief_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen most referred-to, as a report has them."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("target")).agg(F.count_distinct("l_partkey").alias("incoming"))
    return n.orderBy(F.desc("incoming"), "target").limit(15)


@query("SELECT CASE WHEN quality > toxic THEN 'quality' WHEN quality < toxic THEN 'toxic' WHEN quality IS NULL OR toxic IS NULL THEN 'unknown' ELSE 'tie' END AS choice, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def preference_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = F.col("quality"), F.col("toxic")
    met = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return met.groupBy(F.when(q > t, "quality").when(q < t, "toxic").when(q.isNull() | t.isNull(), "unknown").otherwise("tie").alias("choice")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey // 4096 AS r, md5(string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey)) AS d, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_custkey, md5(string_agg(r || ':' || d, ',' ORDER BY r)) AS tree_digest, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY o_custkey""")
def tree_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest over the sorted entries of a customer: ranges of 4096 keys first, then the ranges, so that no task has all
    entries of a customer."""
    joined = lambda *c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*c))), lambda x: F.concat_ws(":", *[x[i] for i in c])), ",")
    ranges = table(spark, sf_dir, "orders").groupBy("o_custkey", F.floor(F.col("o_orderkey") / 4096).alias("r")).agg(F.md5(joined("o_orderkey", "o_orderstatus")).alias("d"), F.count("*").alias("n"))
    return ranges.groupBy("o_custkey").agg(F.md5(joined("r", "d")).alias("tree_digest"), F.sum("n").alias("n"))
