"""Queries that choose under caps, shares and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators import packets
from millrace.plans.base import query
from millrace.plans.retrieval import _BM25, _MET, _bm25, _rank
from millrace.sources.tables import table

_BM = f"{_MET}, {_BM25}, {_rank('bm')}"


@query("SELECT source, doc_id, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM documents")
def prefix_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sums by source, whose rows are shared among tasks however many there are."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return packets.prefix_sums(d, "source", "doc_id", "n_chars").select("source", "doc_id", "used")


@query()
def packet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents a passage, of which four may be in French; copies wait their turn."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("lang") == "fr").alias("limited"), F.md5("text").alias("content"))
    return packets.chosen_files(_bm25(spark, sf_dir).join(d, "doc_id").select("query_id", "doc_id", "rank", F.coalesce("limited", F.lit(False)).alias("limited"), "content"), "doc_id", 10, 4)


@query("WITH e AS (SELECT l_partkey AS path, l_suppkey AS other, CASE l_returnflag WHEN 'A' THEN 'calls' WHEN 'N' THEN 'imports' ELSE 'references' END AS kind FROM lineitem), b AS (SELECT path, other, arg_min(kind, CASE kind WHEN 'calls' THEN 1 WHEN 'references' THEN 2 ELSE 3 END) AS kind FROM e GROUP BY path, other) SELECT path, other, kind, CAST(row_number() OVER (PARTITION BY path ORDER BY other % 7, other) AS INTEGER) AS place FROM b QUALIFY row_number() OVER (PARTITION BY path ORDER BY other % 7, other) <= 4")
def relationship_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as neighbours of parts: four lines a part, the strongest kind for each neighbour."""
    kind = F.when(F.col("l_returnflag") == "A", "calls").when(F.col("l_returnflag") == "N", "imports").otherwise("references")
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("path"), F.col("l_suppkey").alias("other"), kind.alias("kind"))
    near = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("other"), (F.col("s_suppkey") % 7).alias("rank"))
    return packets.strongest_relations(edges, near, ["calls", "references", "imports"])


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM conversations) WHERE rest <= 400")
def packet_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest turns of a conversation go until 400 characters are left."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    return packets.trimmed(c, "conv_id", "turn", "size", 400).select("conv_id", "turn")


@query(f"{_BM}, f AS (SELECT query_id, doc_id, rank, source, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS i FROM bm_r JOIN documents USING (doc_id)), n AS (SELECT *, sum(CASE WHEN i <= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS nth FROM f), m AS (SELECT *, i <= 2 AND nth <= 8 AS main FROM n), c AS (SELECT *, bool_or(main) OVER (PARTITION BY query_id, source) AS covered FROM m) SELECT query_id, doc_id, source, CASE WHEN main THEN 'rank' ELSE 'uncovered folder' END AS reason FROM c WHERE main OR (NOT covered AND i = 1)")
def diversified_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight documents a passage, two of a source, and the best of sources that have none."""
    held = _bm25(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return packets.diversified(held, "doc_id", "source", 8, 2)


_CLASSES = [("N", 0.25, 2), ("A", 0.5, 1), ("R", 0.25, 0)]


def _delivery_sql() -> str:
    steps = []
    for i, (name, share, least) in enumerate(_CLASSES):
        was = f"s{i - 1}" if i else "(SELECT id, room, 0.0::DOUBLE AS reserved, 0.0::DOUBLE AS spent FROM rooms WHERE room >= 0)"
        steps.append(f"""f{i} AS (SELECT o.id, o.kind, max(o.upto) AS used, max(o.place) AS last FROM o JOIN {was} s ON o.id = s.id WHERE o.kind = '{name}' AND (o.upto <= s.reserved + floor({share} * s.room) - s.spent OR o.place <= {least} AND o.upto <= s.room - s.spent) GROUP BY ALL),
s{i} AS (SELECT s.id, s.room, s.reserved + floor({share} * s.room) AS reserved, s.spent + coalesce(f.used, 0) AS spent FROM {was} s LEFT JOIN f{i} f ON f.id = s.id)""")
    ends = " UNION ALL ".join(f"SELECT id, kind, last FROM f{i}" for i in range(len(_CLASSES)))
    return f"""WITH p AS (SELECT o_custkey AS id, l_orderkey * 10 + l_linenumber AS part, max(l_returnflag) AS kind, sum(l_quantity) AS size, bool_and(l_linestatus = 'F' AND l_linenumber = 1) AS kept FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
rooms AS (SELECT id, 300 - coalesce(sum(size) FILTER (kept), 0) AS room FROM p GROUP BY id),
o AS (SELECT *, sum(size) OVER w AS upto, row_number() OVER w AS place FROM p WHERE NOT kept WINDOW w AS (PARTITION BY id, kind ORDER BY part)),
{", ".join(steps)}, ends AS ({ends})
SELECT o.id AS packet_id, o.part, CASE WHEN o.place <= e.last THEN 'delivered' ELSE 'omitted' END AS state FROM o LEFT JOIN ends e ON e.id = o.id AND e.kind = o.kind
UNION ALL SELECT p.id, p.part, CASE WHEN r.room < 0 THEN 'minimum' ELSE 'protected' END FROM p JOIN rooms r ON r.id = p.id WHERE p.kept"""


@query(_delivery_sql())
def packet_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's numbered lines as parts of a packet; the first line of a settled order is protected."""
    bought = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    part = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("part")
    kept = F.bool_and((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 1))
    parts = bought.groupBy(F.col("o_custkey").alias("packet_id"), part).agg(F.max("l_returnflag").alias("kind"), F.sum("l_quantity").alias("size"), kept.alias("kept"))
    return packets.delivered(parts, "packet_id", "kind", "part", "size", "kept", 300, _CLASSES).select("packet_id", "part", "state")
