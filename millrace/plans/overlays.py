"""Parts as revisions that a customer's orders match."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators import overlays
from millrace.plans.base import query
from millrace.sources.tables import table

_KIND = "element_at(array('retrieval_profile', 'skill_overlay', 'role_method_overlay', 'recipe_overlay', 'verification_hint'), cast(p_size % 5 as int) + 1)"
_REVISION = ["p_partkey AS revision_id", "{kind} AS kind", "p_partkey % 4 AS artifact_id", "CASE WHEN p_partkey % 2 = 0 THEN 'global' ELSE 'repo' END AS scope", "p_partkey % 3 AS slot", "p_partkey % 17 <> 0 AS live", "CASE WHEN p_partkey % 13 = 0 THEN 'old' ELSE 'p1' END AS policy", "CASE WHEN p_partkey % 19 = 0 THEN 'old' ELSE 'k1' END AS package", "CASE WHEN p_partkey % 29 = 0 THEN 'old' ELSE 'b1' END AS base", "p_partkey % 31 <> 0 AS supported", "p_size AS families"]
KINDS = ["retrieval_profile", "skill_overlay", "role_method_overlay", "recipe_overlay"]


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Some revisions need the one before them; some of the repo were made upon the global one before them. One artifact has no base."""
    parts = table(spark, sf_dir, "part")
    before = F.array(F.col("p_partkey") - 1)
    none = F.array().cast("array<bigint>")
    revisions = parts.select(*(F.expr(e.format(kind=_KIND)) for e in _REVISION), F.when(F.col("p_partkey") % 7 == 0, before).otherwise(none).alias("dependencies"), F.when(F.col("p_partkey") % 6 == 5, before).otherwise(none).alias("parents"))
    bought = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    matches = bought.select(F.col("o_custkey").alias("request_id"), F.col("l_partkey").alias("revision_id"), (F.col("l_quantity") > 5).alias("applies"))
    return matches, revisions, parts.filter("p_partkey % 4 <> 3 or p_size % 5 <> 1").select(F.expr(_KIND).alias("kind"), (F.col("p_partkey") % 4).alias("artifact_id"), F.lit("b1").alias("digest")).distinct()


_SQL_KIND = "['retrieval_profile', 'skill_overlay', 'role_method_overlay', 'recipe_overlay', 'verification_hint'][p_size % 5 + 1]"
_TEXT = "kind IN ('skill_overlay', 'role_method_overlay', 'recipe_overlay')"


@query(f"""WITH rev AS (SELECT {', '.join(e.format(kind=_SQL_KIND) for e in _REVISION)}, CASE WHEN p_partkey % 7 = 0 THEN p_partkey - 1 END AS needs, CASE WHEN p_partkey % 6 = 5 THEN p_partkey - 1 END AS parent FROM part),
bases AS (SELECT DISTINCT {_SQL_KIND} AS kind, p_partkey % 4 AS artifact_id FROM part WHERE p_partkey % 4 <> 3 OR p_size % 5 <> 1),
m AS (SELECT o_custkey AS request_id, l_partkey AS revision_id, bool_or(coalesce(l_quantity > 5, false)) AS applies FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
a AS (SELECT *, CASE WHEN NOT live THEN 'not_approved' WHEN kind = 'verification_hint' THEN 'capability_unavailable' WHEN policy <> 'p1' OR package <> 'k1' THEN 'stale_base' WHEN NOT applies THEN 'not_applicable' WHEN NOT supported THEN 'insufficient_evidence' ELSE 'active' END AS s FROM m JOIN rev USING (revision_id)),
b AS (SELECT a.*, CASE WHEN a.s <> 'active' THEN a.s WHEN needs IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a n WHERE n.request_id = a.request_id AND n.revision_id = a.needs AND n.s = 'active') THEN 'insufficient_evidence' WHEN d.kind IS NULL THEN 'capability_unavailable' WHEN base <> 'b1' THEN 'stale_base' ELSE 'active' END AS t FROM a LEFT JOIN bases d ON d.kind = a.kind AND d.artifact_id = a.artifact_id),
c AS (SELECT *, CASE WHEN t = 'active' AND count(*) FILTER (t = 'active') OVER (PARTITION BY request_id, kind, artifact_id, slot, scope) > 1 THEN 'conflict' ELSE t END AS u FROM b),
g AS (SELECT c.*, EXISTS (SELECT 1 FROM c p WHERE p.request_id = c.request_id AND p.revision_id = c.parent AND p.scope = 'global') AS declared, EXISTS (SELECT 1 FROM c p WHERE p.request_id = c.request_id AND p.revision_id = c.parent AND p.u = 'active' AND p.scope = 'global' AND p.kind = c.kind AND p.artifact_id = c.artifact_id AND p.slot = c.slot) AS met,
  count(*) FILTER (u = 'active' AND scope = 'global') OVER (PARTITION BY request_id, kind, artifact_id, slot) AS globals FROM c),
e AS (SELECT *, CASE WHEN u = 'active' AND scope = 'repo' AND declared AND NOT (met AND globals = 1) THEN 'stale_base' ELSE u END AS v FROM g),
f AS (SELECT *, CASE WHEN v = 'active' AND {_TEXT} AND row_number() OVER (PARTITION BY request_id, v = 'active' AND {_TEXT} ORDER BY scope <> 'repo', families DESC, revision_id) > 3 THEN 'budget_omitted' ELSE v END AS w FROM e)
SELECT request_id, revision_id, CASE WHEN w = 'active' AND kind = 'retrieval_profile' AND count(*) FILTER (w = 'active' AND kind = 'retrieval_profile') OVER (PARTITION BY request_id) > 1 THEN 'conflict' ELSE w END AS state FROM f""")
def overlay_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlays.resolved(*tables(spark, sf_dir), KINDS, "p1", "k1", 3)


@query("""WITH l AS (SELECT o_custkey AS request_id, l_linenumber AS layer, l_shipdate_key AS key, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS value FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 'max_files' WHEN 'N' THEN 'strategy' ELSE 'hops' END AS l_shipdate_key FROM lineitem) JOIN orders ON o_orderkey = l_orderkey)
SELECT request_id, key, CASE WHEN key <> 'strategy' THEN min(value::DOUBLE)::BIGINT::VARCHAR ELSE arg_min(value, (-layer, value)) END AS value, CASE WHEN key <> 'strategy' THEN arg_min(layer, (value::DOUBLE, layer)) ELSE max(layer) END AS layer FROM l GROUP BY request_id, key""")
def layered_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's lines as layers of settings, two of which are limits."""
    bought = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    key = F.when(F.col("l_returnflag") == "A", "max_files").when(F.col("l_returnflag") == "N", "strategy").otherwise("hops")
    layers = bought.select(F.col("o_custkey").alias("request_id"), F.col("l_linenumber").alias("layer"), key.alias("key"), F.col("l_quantity").cast("long").cast("string").alias("value"))
    return overlays.merged_settings(layers, ["max_files", "hops"])
