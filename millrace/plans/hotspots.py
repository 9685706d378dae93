"""Queries on hotspots: an order is a commit that touches the paths of its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators import hotspots
from millrace.operators.statistics import numbered
from millrace.plans.base import query
from millrace.sources.tables import table

_PATH = "'d' || {0} % 7 || '/e' || {0} % 5 || '/p' || {0}"
_TOUCH = ("l_orderkey AS commit", f"{_PATH.format('l_partkey')} AS path")
_FLAGS = ("o_orderkey AS commit", "o_orderstatus = 'F' AS fix", "o_custkey % 11 = 0 AS release", "o_orderkey % 23 = 0 AS bulk", "o_orderkey % 29 = 0 AS merge")
_REF = ("o_orderkey AS commit", "'c' || o_custkey % 40 AS ref")
_SYMBOL = (*_TOUCH, "'s' || l_suppkey AS symbol")

_LOGS = {c: f"CASE WHEN max(ln(1 + {c})) OVER () > 0 THEN ln(1 + {c}) / max(ln(1 + {c})) OVER () ELSE 0 END" for c in ("edits", "fixes", "incidents", "symbols", "partners")}
_SCALED = ", ".join(f"round({_LOGS.get(c, c)}, 4) AS {c}" for c in hotspots.WEIGHTS)
_SUM = " + ".join(f"{w}::DOUBLE * {c}" for c, w in hotspots.WEIGHTS.items())
_REASONS = ", ".join(f"{{'w': -({w}::DOUBLE * {c}), 'i': {i}, 'name': '{c}'}}" for i, (c, w) in enumerate(hotspots.WEIGHTS.items()))
_FEATURES = f"""touch AS (SELECT DISTINCT {", ".join(_TOUCH)} FROM lineitem WHERE l_partkey % 10 <> 0),
commits AS (SELECT {", ".join(_FLAGS)}, 1 - (count(*) OVER () - row_number() OVER (ORDER BY o_orderkey))::DOUBLE / count(*) OVER () AS age FROM orders),
sized AS (SELECT commit, count(*) AS held FROM touch GROUP BY commit),
met AS (SELECT t.commit, t.path, c.age, c.fix, c.release, c.bulk OR s.held > 30 AS bulk FROM touch t JOIN commits c USING (commit) JOIN sized s USING (commit) WHERE NOT c.merge),
base AS (SELECT path, count(*) FILTER (NOT bulk) AS edits, max(age) FILTER (NOT bulk) AS recency, count(*) FILTER (NOT bulk AND fix) AS fixes, count(*) FILTER (bulk OR release) AS releases FROM met GROUP BY path),
inc AS (SELECT path, count(DISTINCT ref) AS incidents FROM met JOIN (SELECT {", ".join(_REF)} FROM orders WHERE o_custkey % 3 = 0) USING (commit) WHERE NOT bulk GROUP BY path),
sym AS (SELECT path, count(DISTINCT symbol) AS symbols FROM (SELECT {", ".join(_SYMBOL)} FROM lineitem) JOIN met USING (commit, path) GROUP BY path),
pr AS (SELECT x.path AS a, y.path AS b FROM met x JOIN met y ON x.commit = y.commit AND x.path < y.path WHERE NOT x.bulk AND NOT y.bulk GROUP BY x.path, y.path HAVING count(*) >= 2),
par AS (SELECT path, count(*) AS partners FROM (SELECT a AS path FROM pr UNION ALL SELECT b FROM pr) GROUP BY path),
raw AS (SELECT path, edits, recency, fixes, releases, coalesce(incidents, 0) AS incidents, coalesce(symbols, 0) AS symbols, coalesce(partners, 0) AS partners FROM base LEFT JOIN inc USING (path) LEFT JOIN sym USING (path) LEFT JOIN par USING (path) WHERE edits > 0),
scaled AS (SELECT path, {_SCALED}, releases::DOUBLE / (edits + releases) AS penalty FROM (SELECT * FROM raw)),
scored AS (SELECT path, round(({_SUM}) / {sum(hotspots.WEIGHTS.values())}::DOUBLE - {hotspots.PENALTY}::DOUBLE * penalty * 0.5::DOUBLE + {hotspots.TIE}::DOUBLE, 4) AS score, round(penalty + {hotspots.TIE}::DOUBLE, 4) AS penalty,
array_to_string(list_transform(list_sort([{_REASONS}])[1:2], lambda x: x.name), ',') AS reasons, {", ".join(hotspots.WEIGHTS)} FROM scaled)"""


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    places = numbered(orders.select("o_orderkey"), "o_orderkey").select(F.col("o_orderkey").alias("commit"), (F.lit(orders.count() - 1) - F.col("i")).alias("place"))
    commits = orders.selectExpr(*_FLAGS).join(places, "commit")
    refs = orders.filter("o_custkey % 3 = 0").selectExpr(*_REF)
    return hotspots.features(lines.filter("l_partkey % 10 <> 0").selectExpr(*_TOUCH), commits, refs, lines.selectExpr(*_SYMBOL))


@query(f"WITH {_FEATURES} SELECT * FROM scored")
def hotspot_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose number ends in 0 are no current paths."""
    return _features(spark, sf_dir)


@query(f"""WITH {_FEATURES}, cur AS (SELECT DISTINCT {_PATH.format('p_partkey')} AS path FROM part WHERE p_partkey % 10 <> 0),
t AS (SELECT least(200, greatest(1, CAST(ceil(count(*) * 15 / 100.0) AS BIGINT))) AS target FROM cur),
sizes AS (SELECT target, greatest(2, CAST(ceil(target * 3 / 10.0) AS BIGINT)) AS cap, greatest(1, CAST(ceil(target / 10.0) AS BIGINT)) AS reserve FROM t),
nth AS (SELECT path, score, row_number() OVER (PARTITION BY regexp_replace(path, '/?[^/]*$', '') ORDER BY score DESC, path) AS nth FROM scored),
ranked AS (SELECT path, score FROM (SELECT path, score, row_number() OVER (ORDER BY score DESC, path) AS r FROM nth, sizes WHERE nth <= cap), sizes WHERE r <= target),
deg AS (SELECT {_PATH.format('l_partkey')} AS path, count(DISTINCT l_suppkey) AS degree FROM lineitem GROUP BY 1),
linked AS (SELECT path FROM (SELECT path, row_number() OVER (ORDER BY degree DESC, path) AS r FROM cur JOIN deg USING (path) WHERE path NOT IN (SELECT path FROM ranked)), sizes WHERE r <= reserve),
held AS (SELECT path, score, 'ranked' AS why FROM ranked UNION ALL SELECT path, 0.0, 'in_degree' FROM linked),
module AS (SELECT path, score, 'module' AS why FROM scored WHERE split_part(path, '/', 1) NOT IN (SELECT split_part(path, '/', 1) FROM held) QUALIFY row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY score DESC, path) = 1)
SELECT * FROM held UNION ALL SELECT * FROM module""")
def hotspot_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path's degree is the number of suppliers of its part."""
    current = table(spark, sf_dir, "part").filter("p_partkey % 10 <> 0").selectExpr(f"{_PATH.format('p_partkey')} AS path").distinct()
    degrees = table(spark, sf_dir, "lineitem").groupBy(F.expr(_PATH.format("l_partkey")).alias("path")).agg(F.count_distinct("l_suppkey").alias("degree"))
    return hotspots.chosen(_features(spark, sf_dir), current, degrees)
