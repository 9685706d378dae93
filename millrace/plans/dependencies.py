"""Dependencies of four kinds between parts, from what is ordered together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators import dependencies
from millrace.plans.base import query
from millrace.sources.tables import table

_RELATION = "CASE WHEN l_quantity <= 2 OR l_quantity = 50 AND l_linenumber = 7 THEN 'all_of' WHEN l_quantity <= 12 THEN 'any_of' WHEN l_quantity <= 14 THEN 'conditional' WHEN l_quantity <= 24 THEN 'optional' END"
_OF_LINES = _RELATION.replace("l_quantity", "l.l_quantity").replace("l_linenumber", "l.l_linenumber")
_NEEDS = f"""SELECT DISTINCT f.l_partkey AS name, l.l_partkey AS dep, {_OF_LINES} AS relation, l.l_orderkey AS grp, CASE WHEN l.l_linestatus = 'O' THEN 'open' ELSE 'close' END AS operation
FROM lineitem l JOIN lineitem f ON f.l_orderkey = l.l_orderkey AND f.l_linenumber = 1 WHERE l.l_linenumber > 1 AND (l.l_partkey < f.l_partkey OR l.l_quantity = 50 AND l.l_linenumber = 7) AND {_OF_LINES} IS NOT NULL"""
_STATE = "CASE WHEN p_size % 10 = 0 THEN 'missing' WHEN p_size % 10 < 3 THEN 'unknown' ELSE 'available' END"
_NAMES = "SELECT p_partkey AS name FROM part WHERE p_brand <> 'Brand#11'"
_STATES = f"SELECT p_partkey AS name, {_STATE} AS state FROM part WHERE p_brand <> 'Brand#12'"


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Needs of an order's first part are its other lines. Parts of one brand have no name, those of another no state."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_linestatus")
    first = lines.filter("l_linenumber = 1").select("l_orderkey", F.col("l_partkey").alias("name"))
    met = lines.filter("l_linenumber > 1").join(first, "l_orderkey").filter("l_partkey < name or (l_quantity = 50 and l_linenumber = 7)")
    needs = met.select("name", F.col("l_partkey").alias("dep"), F.expr(_RELATION).alias("relation"), F.col("l_orderkey").alias("grp"), F.when(F.col("l_linestatus") == "O", "open").otherwise("close").alias("operation"))
    parts = table(spark, sf_dir, "part")
    return needs.filter("relation is not null").distinct(), parts.filter("p_brand <> 'Brand#11'").select(F.col("p_partkey").alias("name")), parts.filter("p_brand <> 'Brand#12'").select(F.col("p_partkey").alias("name"), F.expr(_STATE).alias("state"))


_OWN = f"""needs AS ({_NEEDS}), names AS ({_NAMES}), states AS ({_STATES}),
looked AS (SELECT n.*, coalesce(s.state, CASE WHEN k.name IS NOT NULL THEN 'unknown' ELSE 'missing' END) AS state, k.name IS NOT NULL AS named,
  relation = 'all_of' OR relation = 'conditional' AND operation = 'open' AS required FROM needs n JOIN names o ON o.name = n.name LEFT JOIN names k ON k.name = n.dep LEFT JOIN states s ON s.name = n.dep),
own AS (SELECT name, state AS kind, CAST(dep AS VARCHAR) AS item FROM looked WHERE required AND state <> 'available'
  UNION SELECT name, CASE WHEN bool_and(state = 'missing') THEN 'missing' ELSE 'unknown' END, 'any_of:' || grp FROM looked WHERE relation = 'any_of' GROUP BY name, grp HAVING NOT bool_or(state = 'available')
  UNION SELECT name, 'optional', CAST(dep AS VARCHAR) FROM looked WHERE relation = 'optional' AND state = 'missing'),
edges AS (SELECT DISTINCT name, dep FROM looked WHERE required AND named),
below AS (SELECT name AS root, dep AS place FROM edges UNION SELECT b.root, e.dep FROM below b JOIN edges e ON e.name = b.place)"""


@query(f"""WITH RECURSIVE {_OWN},
reached AS (SELECT name AS root, name AS place FROM names UNION SELECT root, place FROM below),
items AS (SELECT r.root AS name, o.kind, o.item FROM reached r JOIN own o ON o.name = r.place),
cyclic AS (SELECT DISTINCT r.root AS name FROM reached r JOIN below b ON b.root = r.place AND b.place = r.place)
SELECT n.name, CASE WHEN any_value(c.name) IS NOT NULL THEN 'cycle' WHEN bool_or(kind = 'missing') THEN 'missing' WHEN bool_or(kind = 'unknown') THEN 'unknown' WHEN bool_or(kind = 'optional') THEN 'degraded' ELSE 'satisfied' END AS status,
min(item) FILTER (kind = 'missing' AND c.name IS NULL) AS first_missing, min(item) FILTER (kind = 'unknown' AND c.name IS NULL) AS first_unknown, min(item) FILTER (kind = 'optional' AND c.name IS NULL) AS first_optional
FROM names n LEFT JOIN cyclic c USING (name) LEFT JOIN items USING (name) GROUP BY n.name""")
def dependency_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each part when opened."""
    return dependencies.dependency_states(*_tables(spark, sf_dir), "open")


@query(f"""WITH RECURSIVE {_OWN},
roots AS (SELECT name FROM names SEMI JOIN part ON p_partkey = name AND p_brand = 'Brand#13' AND p_size = 7),
reached AS (SELECT name AS root, name AS place FROM roots UNION SELECT root, place FROM below SEMI JOIN roots ON roots.name = root)
SELECT DISTINCT r.root AS name, kind, item FROM reached r JOIN own o ON o.name = r.place""")
def dependency_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that the parts of one brand and size lack: the asked roots."""
    needs, names, states = _tables(spark, sf_dir)
    roots = table(spark, sf_dir, "part").filter("p_brand = 'Brand#13' and p_size = 7").select(F.col("p_partkey").alias("name"))
    return dependencies.dependency_items(roots, needs, names, states, "open")
