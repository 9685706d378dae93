"""Queries on the paths of the past."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.operators.lineage import lineage
from millrace.plans.base import query
from millrace.sources.tables import table

# A line of an order is a path that leads to the next line, some lead back to the first one or to their supplier.
_OWN = "'o' || l_orderkey || '/' || l_linenumber"
_NEXT = f"CASE WHEN l_partkey % 13 = 0 THEN 'o' || l_orderkey || '/1' WHEN l_partkey % 11 = 0 THEN 's' || l_suppkey ELSE 'o' || l_orderkey || '/' || (l_linenumber + 1) END"
_KIND = "CASE WHEN l_partkey % 17 = 0 THEN 'C' WHEN l_partkey % 19 = 0 THEN 'M' ELSE 'R' END"
_SCORE = "CASE WHEN l_partkey % 7 <> 0 THEN 45 + CAST(l_quantity AS INTEGER) END"
_CHANGES = (f"{_NEXT} AS path", f"{_OWN} AS source", f"{_KIND} AS kind", f"{_SCORE} AS score")


@query(f"""WITH RECURSIVE changes AS (SELECT {", ".join(_CHANGES)} FROM lineitem UNION ALL SELECT 's' || l_suppkey, {_OWN}, 'R', 90 FROM lineitem WHERE l_suppkey % 23 = 0),
now AS (SELECT DISTINCT {_OWN} AS path FROM lineitem WHERE l_partkey % 4 = 0),
moves AS (SELECT * FROM changes WHERE kind IN ('R', 'C')),
step AS (SELECT source AS here, min(path) AS target, count(DISTINCT path) > 1 OR bool_or(kind = 'C') OR min(coalesce(score, 100)) < 50 AS doubted FROM moves GROUP BY source),
past AS (SELECT path FROM changes UNION SELECT source FROM moves EXCEPT SELECT path FROM now),
walk AS (SELECT path, path AS here, [path] AS seen, CAST(NULL AS VARCHAR) AS label, 0 AS n FROM past UNION ALL
SELECT w.path, s.target, list_append(w.seen, s.target), CASE WHEN s.target IS NULL THEN 'unresolved' WHEN s.doubted OR list_contains(w.seen, s.target) THEN 'ambiguous' WHEN c.path IS NOT NULL THEN 'supported_rename' END, n + 1
FROM walk w LEFT JOIN step s ON s.here = w.here LEFT JOIN now c ON c.path = s.target WHERE w.label IS NULL AND w.n < 8)
SELECT path, CASE WHEN label = 'supported_rename' THEN here END AS current, coalesce(label, 'unresolved') AS label FROM walk WHERE label IS NOT NULL OR n = 8""")
def path_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    changes = lines.selectExpr(*_CHANGES).union(lines.filter("l_suppkey % 23 = 0").selectExpr("'s' || l_suppkey", _OWN, "'R'", "90"))
    return lineage(changes, lines.filter("l_partkey % 4 = 0").selectExpr(f"{_OWN} AS path"))
