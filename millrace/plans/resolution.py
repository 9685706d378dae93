"""Queries that resolve names, paths and claims by joins, and spans by windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators import resolve
from millrace.plans.base import query
from millrace.sources.tables import table

_FILES = "f AS (SELECT p_partkey AS path, lower(p_type) || '.' || replace(p_name, ' ', '.') || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '.m' || (p_partkey % 40) END AS module FROM part)"


@query(f"WITH {_FILES}, s AS (SELECT DISTINCT unnest([module, regexp_replace(module, '^[^.]*\\.', ''), 'm' || (path % 40), regexp_extract(module, '[^.]*\\.[^.]*$')]) AS spec FROM f), e AS (SELECT spec, min(path) AS path FROM s JOIN f ON module = spec GROUP BY spec), x AS (SELECT spec, min(path) AS path FROM s JOIN f ON module = spec OR ends_with(module, '.' || spec) WHERE spec NOT IN (SELECT spec FROM e) GROUP BY spec HAVING count(*) = 1) SELECT spec, path, 'exact' AS how FROM e UNION ALL SELECT spec, path, 'suffix' FROM x")
def module_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit(".m"), F.col("p_partkey") % 40))
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.concat(F.lower("p_type"), F.lit("."), F.translate("p_name", " ", "."), tail).alias("module"))
    asked = F.array("module", F.regexp_replace("module", r"^[^.]*\.", ""), F.concat(F.lit("m"), F.col("path") % 40), F.regexp_extract("module", r"[^.]*\.[^.]*$", 0))
    return resolve.modules(files.select(F.explode(asked).alias("spec")), files)


@query("WITH w AS (SELECT DISTINCT conv_id, role, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS name FROM conversations), d AS (SELECT DISTINCT conv_id AS target, name FROM w WHERE role = 'assistant' AND length(name) >= 6), n AS (SELECT name, count(*) AS n FROM d GROUP BY name HAVING count(*) <= 3), u AS (SELECT DISTINCT conv_id AS source, name FROM w WHERE role = 'user') SELECT source, target, name, CASE WHEN n = 1 THEN 'resolved' ELSE 'candidate' END AS status FROM u JOIN d USING (name) JOIN n USING (name) WHERE NOT EXISTS (SELECT 1 FROM d o WHERE o.target = u.source AND o.name = u.name)")
def name_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's answers define words, its questions use them."""
    w = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("path"), "role", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("name"))
    return resolve.name_edges(w.filter("role = 'user'"), w.filter("role = 'assistant'"), 3, 6)


_WORDS = "w AS (SELECT DISTINCT conv_id, role, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS name FROM conversations)"


@query(f"WITH {_WORDS}, d AS (SELECT DISTINCT conv_id AS target, name FROM w WHERE role = 'assistant' AND length(name) >= 6), u AS (SELECT DISTINCT conv_id, name FROM w WHERE role = 'user' AND length(name) >= 6), n AS (SELECT name, count(*) AS n FROM d GROUP BY name) SELECT CASE WHEN n IS NULL THEN 'unresolved' WHEN n <= 3 THEN 'resolved' ELSE 'ambiguous' END AS coverage, count(*) AS uses FROM u LEFT JOIN n USING (name) GROUP BY 1")
def relationship_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "conversations").select("conv_id", "role", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("name")).filter(F.length("name") >= 6).distinct()
    n = w.filter("role = 'assistant'").groupBy("name").agg(F.count_distinct("conv_id").alias("n"))
    met = w.filter("role = 'user'").select("conv_id", "name").distinct().join(n, "name", "left")
    return met.groupBy(F.when(F.col("n").isNull(), "unresolved").when(F.col("n") <= 3, "resolved").otherwise("ambiguous").alias("coverage")).agg(F.count("*").alias("uses"))


@query("SELECT p_partkey AS old_path, p_partkey + 100000 AS new_path, w AS name, CASE WHEN p_size % 4 = 0 THEN 'uncertain' ELSE 'supported' END AS state FROM (SELECT p_partkey, p_size, unnest(string_split(p_name, ' ')) AS w FROM part) WHERE p_partkey % 2 = 0 AND NOT (p_size % 6 = 0 AND w = 'bolt')")
def rename_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even parts were renamed; some symbols have other content since, and some bolts are gone."""
    s = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), "p_size", F.explode(F.split("p_name", " ")).alias("name"), F.lit("word").alias("kind"))
    before = s.withColumn("fingerprint", F.md5("name"))
    after = s.filter("not (p_size % 6 = 0 and name = 'bolt')").withColumn("fingerprint", F.md5(F.when(F.col("p_size") % 4 == 0, F.upper("name")).otherwise(F.col("name")))).withColumn("path", F.col("path") + 100000)
    renames = s.select("path").distinct().filter("path % 2 = 0").select(F.col("path").alias("old_path"), (F.col("path") + 100000).alias("new_path"))
    return resolve.aliases(before, after, renames)


@query("SELECT c_custkey AS operation, x.s_suppkey AS instance, x.health AS health FROM customer LEFT JOIN LATERAL (SELECT s_suppkey, CAST(s_suppkey % 4 AS INTEGER) AS health FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal >= c_acctbal ORDER BY s_suppkey % 4, s_suppkey LIMIT 1) x ON true")
def capability_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as operations and suppliers of their nation as instances; the balance is the level of access."""
    ops = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("operation"), F.col("c_acctbal").alias("needs"), F.col("c_nationkey").alias("nation"))
    held = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("instance"), (F.col("s_suppkey") % 4).cast("int").alias("health"), F.col("s_acctbal").alias("access"), F.col("s_nationkey").alias("nation"))
    return resolve.bound(ops, held, ["nation"])


@query("WITH c AS (SELECT DISTINCT l_orderkey AS claim_id, l_partkey AS path FROM lineitem) SELECT claim_id, bool_or(coalesce(p_size % 10 IN (0, 1), true)) AS stale FROM c LEFT JOIN part ON p_partkey = path GROUP BY claim_id")
def stale_inferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order cites its parts; parts of some sizes changed, those of others went."""
    part = table(spark, sf_dir, "part")
    cited = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_partkey").alias("path")).distinct().join(part.select(F.col("p_partkey").alias("path"), F.md5("p_name").alias("sha")), "path", "left")
    now = part.filter("p_size % 10 <> 1").select(F.col("p_partkey").alias("path"), F.md5(F.when(F.col("p_size") % 10 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name"))).alias("sha"))
    return resolve.stale_claims(cited, now)


@query("SELECT a.doc_id AS path, b.doc_id AS other FROM documents a JOIN documents b ON a.source = b.source AND a.doc_id <> b.doc_id WHERE a.doc_id % 50 = 0 AND b.doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def same_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth document is a seed; those labelled low are the known files."""
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("source").alias("folder"))
    known = table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("path"))
    return resolve.siblings(files, files.filter("path % 50 = 0"), known)


_SPANS = "s AS (SELECT l_orderkey AS file, l_partkey % 60 AS lo, l_partkey % 60 + CAST(l_quantity AS INTEGER) AS hi FROM lineitem)"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo = F.col("l_partkey") % 60
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), lo.alias("lo"), (lo + F.col("l_quantity").cast("int")).alias("hi"))


@query(f"WITH {_SPANS}, d AS (SELECT DISTINCT * FROM s) SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM d o WHERE o.file = d.file AND o.lo <= d.lo AND o.hi >= d.hi AND (o.lo <> d.lo OR o.hi <> d.hi))")
def excerpt_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.contained(_spans(spark, sf_dir), "file")


@query(f"WITH {_SPANS}, n AS (SELECT *, max(hi) OVER (PARTITION BY file ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR reach < lo THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM n) SELECT file, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM i GROUP BY file, island")
def span_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.merged(_spans(spark, sf_dir), "file")
