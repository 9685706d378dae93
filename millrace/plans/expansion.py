"""Queries on expansion from seeds, reranking, confidence, status and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from millrace.operators import cochange, expansion
from millrace.plans.base import query
from millrace.plans.retrieval import _LISTS, _lists
from millrace.sources.tables import table

_KIND = "CASE l_returnflag WHEN 'A' THEN 'calls' WHEN 'N' THEN 'imports' ELSE 'references' END"
_TYPED = f"typed AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b, {_KIND} AS kind FROM lineitem)"
_BOTH = (
    "both_ways AS (SELECT a, b, kind FROM typed UNION SELECT b, a, CASE kind WHEN 'calls' THEN 'called_by' WHEN 'imports' THEN 'imported_by' ELSE 'referenced_by' END FROM typed), "
    "degrees AS (SELECT b AS node, count(DISTINCT a) AS in_degree FROM typed GROUP BY b)"
)
_SEEDS = "seeds AS (SELECT 'p' || p_partkey AS node, row_number() OVER (ORDER BY p_partkey) AS rank FROM part WHERE p_size = 1 QUALIFY row_number() OVER (ORDER BY p_partkey) <= 20)"
_PRIOR = "CASE WHEN kind IN ('calls', 'called_by') THEN 1.0::DOUBLE WHEN kind IN ('references', 'referenced_by') THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END"


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "calls").when(F.col("l_returnflag") == "N", "imports").otherwise("references")
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b"), kind.alias("kind")).distinct()


def _hop(n: int, front: str, decay: float) -> str:
    value = f"round(strength * {decay}::DOUBLE * {_PRIOR} / ln(2 + coalesce(in_degree, 0)), 9)"
    return f"""m{n} AS (SELECT f.node AS a, f.strength, e.b, {value} AS value, e.kind FROM {front} f JOIN both_ways e ON e.a = f.node LEFT JOIN degrees d ON d.node = e.b),
h{n} AS (SELECT a, b AS node, max(value) AS value, max_by(kind, struct_pack(v := value, k := kind)) AS kind FROM m{n} WHERE value > 0 GROUP BY a, strength, b
QUALIFY row_number() OVER (PARTITION BY a, strength ORDER BY max(value) DESC, b) <= 8)"""


@query(f"""WITH {_TYPED}, {_BOTH}, {_SEEDS}, f0 AS (SELECT node, 1.0::DOUBLE / rank AS strength FROM seeds), {_hop(1, "f0", 0.5)},
f1 AS (SELECT node, value AS strength FROM h1 ORDER BY value DESC, node, a LIMIT 20), {_hop(2, "f1", 0.25)},
found AS (SELECT node, round(sum(value), 6) AS score, count(*) AS origins, max_by(kind, struct_pack(v := value, k := kind)) AS kind FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY node)
SELECT node, score, origins, kind, CAST(row_number() OVER (ORDER BY score DESC, node) AS INTEGER) AS rank FROM found QUALIFY rank <= 20""")
def graph_expand_2hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hops from the first twenty parts of size 1, by kinds of edges."""
    seeds = table(spark, sf_dir, "part").filter("p_size = 1").orderBy("p_partkey").limit(20)
    ranked = seeds.select(F.concat(F.lit("p"), "p_partkey").alias("node"), F.row_number().over(Window.orderBy("p_partkey")).alias("rank"))  # twenty rows
    return expansion.expand_graph(ranked, _typed(spark, sf_dir))


@query(f"WITH {_TYPED}, {_BOTH} SELECT a AS node, kind, count(*) AS edges FROM both_ways GROUP BY a, kind")
def neighbour_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of each node by kind, the other direction under its own name."""
    return expansion.neighbours(_typed(spark, sf_dir)).distinct().groupBy(F.col("a").alias("node"), "kind").agg(F.count("*").alias("edges"))


@query("""WITH baskets AS (SELECT DISTINCT l_orderkey AS basket, l_suppkey AS item FROM lineitem),
n AS (SELECT item, count(*) AS n FROM baskets GROUP BY item),
p AS (SELECT x.item AS a, y.item AS b, count(*) AS support FROM baskets x JOIN baskets y ON x.basket = y.basket AND x.item <> y.item GROUP BY x.item, y.item),
s AS (SELECT a, b, support, round(support / (na.n + nb.n - support), 4) AS score FROM p JOIN n na ON na.item = a JOIN n nb ON nb.item = b)
SELECT b, round(sum(score / a), 6) AS score, count(*) AS seeds FROM s WHERE a BETWEEN 1 AND 10 AND support >= 2 AND score >= 0.005 GROUP BY b ORDER BY score DESC, b LIMIT 10""")
def cochange_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that are ordered together with the first ten, which are the seeds in the order of their keys."""
    baskets = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("basket"), F.col("l_suppkey").alias("item"), F.lit(0).alias("at")).distinct()
    pairs = cochange.scored(baskets, "jaccard")
    either = pairs.select("a", "b", "support", "score").union(pairs.select("b", "a", "support", "score"))
    seeds = table(spark, sf_dir, "supplier").filter("s_suppkey between 1 and 10").select(F.col("s_suppkey").alias("a"), F.col("s_suppkey").alias("rank"))
    return expansion.expand_cochange(seeds, either, floor=0.005)


_SOURCES = "list_filter(['path', 'symbol_definitions', 'graph', 'bm25'], lambda x, i: (doc_id // power(2, i)::BIGINT) % 2 = 1)"


@query(f"""WITH c AS (SELECT lang, doc_id, ['test', 'doc', 'config', 'source', 'manifest', 'schema', 'migration', 'workflow', 'other', 'binary'][doc_id % 10 + 1] AS kind, round(n_chars % 97 / 10.0::DOUBLE, 3) AS score,
doc_id % 50 = 0 AS named, n_chars % 7 AS in_degree, {_SOURCES} AS sources FROM documents),
v AS (SELECT *, round(score * CASE WHEN named OR kind = 'config' THEN 1.0 WHEN kind IN ('test', 'doc', 'workflow', 'other') THEN 0.5 WHEN kind = 'manifest' THEN 0.7 WHEN kind IN ('schema', 'migration') THEN 0.8 ELSE 1.0 END::DOUBLE, 9) AS value FROM c)
SELECT lang, doc_id, value, CAST(row_number() OVER (PARTITION BY lang ORDER BY named DESC, value DESC, list_contains(sources, 'symbol_definitions') DESC, list_contains(sources, 'path') DESC,
len(list_intersect(sources, ['path', 'symbol_definitions', 'symbol_references', 'phrases', 'explorer'])) DESC, len(list_intersect(sources, ['graph', 'git'])) DESC, in_degree, doc_id) AS INTEGER) AS place FROM v""")
def rerank_pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("test", "doc", "config", "source", "manifest", "schema", "migration", "workflow", "other", "binary"))), (F.col("doc_id") % 10 + 1).cast("int"))
    names = F.array(*map(F.lit, ("path", "symbol_definitions", "graph", "bm25")))
    # The bits of the number say which sources found a document; DuckDB's positions begin at 1.
    sources = F.filter(names, lambda x, i: F.floor(F.col("doc_id") / F.pow(F.lit(2), i + 1)) % 2 == 1)
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", kind.alias("kind"), F.round(F.col("n_chars") % 97 / 10.0, 3).alias("score"), (F.col("doc_id") % 50 == 0).alias("named"), (F.col("n_chars") % 7).alias("in_degree"), sources.alias("sources"))
    return expansion.reranked(docs, "lang", "doc_id", ("config",)).select("lang", "doc_id", "value", "place")


_FUSED = "fused AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (20 + rank)), 9) AS score FROM lists GROUP BY query_id, doc_id), fused_r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused)"


def _fused(lists: DataFrame) -> DataFrame:
    held = lists.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (20 + F.col("rank"))), 9).alias("score"))
    return held.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))


@query(f"""{_LISTS}, {_FUSED}, top AS (SELECT query_id, max(doc_id) FILTER (rank = 1) AS leader, max(score) FILTER (rank = 1) AS s1, max(score) FILTER (rank = 2) AS s2 FROM fused_r WHERE rank <= 2 GROUP BY query_id)
SELECT t.query_id, (SELECT count(*) FROM lists l WHERE l.query_id = t.query_id AND l.rank = 1 AND l.doc_id = t.leader) AS agreement,
CASE WHEN s2 IS NULL OR s1 = 0 THEN 1.0 ELSE round((s1 - s2) / s1, 4) END::DOUBLE AS gap, t.query_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS pinned FROM top t""")
def confidence_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each benchmark passage; the ones numbered like a toxic document count as naming a file."""
    lists = _lists(spark, sf_dir)
    named = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("query_id"))
    return expansion.confidence(_fused(lists), lists, named, "query_id", "doc_id")


@query(f"""{_LISTS}, {_FUSED}, top AS (SELECT f.query_id, f.rank, EXISTS (SELECT 1 FROM lists l WHERE l.source = 'rare' AND l.rank <= 5 AND l.query_id = f.query_id AND l.doc_id = f.doc_id) AS anchor FROM fused_r f WHERE f.rank <= 8),
facts AS (SELECT query_id, bool_or(anchor) AS anchored, bool_or(anchor AND rank = 1) AS leads FROM top GROUP BY query_id)
SELECT item_id AS query_id, CASE WHEN f.query_id IS NULL THEN 'abstained_no_sufficient_local_evidence' ELSE 'ok' END AS status, CASE WHEN anchored THEN 'anchored' WHEN f.query_id IS NOT NULL THEN 'lexical' ELSE 'none' END AS evidence,
CASE WHEN leads THEN 'anchored' WHEN f.query_id IS NOT NULL THEN 'lexical' ELSE 'none' END AS leader, (SELECT count(*) FROM documents WHERE text IS NULL OR text = '') AS unread FROM benchmark LEFT JOIN facts f ON f.query_id = item_id""")
def result_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands behind the eight best of each passage, and how many documents have no text to find."""
    lists = _lists(spark, sf_dir)
    anchors = lists.filter("source = 'rare' and rank <= 5").select("query_id", "doc_id", F.lit(True).alias("anchor"))
    top = _fused(lists).filter("rank <= 8").join(anchors, ["query_id", "doc_id"], "left").withColumn("anchor", F.coalesce("anchor", F.lit(False)))
    facts = top.groupBy("query_id").agg(F.bool_or("anchor").alias("anchored"), F.bool_or(F.col("anchor") & (F.col("rank") == 1)).alias("leads"))
    unread = table(spark, sf_dir, "documents").filter("text is null or text = ''").agg(F.count("*").alias("unread"))
    met = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id")).join(facts, "query_id", "left").join(F.broadcast(unread), F.lit(True))  # one row
    known = F.col("anchored").isNotNull()
    how = lambda c: F.when(F.col(c), "anchored").when(known, "lexical").otherwise("none")
    status = F.when(known, "ok").otherwise("abstained_no_sufficient_local_evidence")
    return met.select("query_id", status.alias("status"), how("anchored").alias("evidence"), how("leads").alias("leader"), "unread")


@query(f"""{_LISTS}, top AS (SELECT query_id, max(score) FILTER (rank = 1) AS s1, max(score) FILTER (rank = 2) AS s2, max(doc_id) FILTER (rank = 1) AS doc_id FROM bm_r GROUP BY query_id),
f AS (SELECT item_id AS query_id, s1, s2, (SELECT count(*) FROM rare_r r WHERE r.query_id = t.query_id AND r.doc_id = t.doc_id AND r.rank <= 3) AS identifiers, (SELECT count(*) FROM bm_r b WHERE b.query_id = t.query_id) AS concepts,
(SELECT count(*) FROM labels l WHERE l.doc_id = t.doc_id) AS resolved, item_id % 11 = 0 AS stale FROM benchmark LEFT JOIN top t ON t.query_id = item_id)
SELECT query_id, CASE WHEN stale THEN 'ignore_stale' WHEN s1 IS NULL OR s1 < 5 OR coalesce((s1 - s2) / s1 < 0.02, false) OR (identifiers = 0 AND concepts < 3) THEN 'ignore_weak'
WHEN resolved = 0 THEN 'ignore_unresolved' WHEN identifiers = 0 THEN 'use_limited' ELSE 'use' END AS state FROM f""")
def memory_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = _lists(spark, sf_dir)
    bm, rare = lists.filter("source = 'bm25'"), lists.filter("source = 'rare' and rank <= 3")
    at = lambda n, c: F.max(F.when(F.col("rank") == n, F.col(c)))
    top = bm.groupBy("query_id").agg(at(1, "score").alias("first"), at(2, "score").alias("second"), at(1, "doc_id").alias("doc_id"), F.count("*").alias("concepts"))
    known = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count("*").alias("resolved"))
    named = rare.select("query_id", "doc_id", F.lit(1).alias("identifiers"))
    met = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id")).join(top, "query_id", "left").join(named, ["query_id", "doc_id"], "left").join(known, "doc_id", "left")
    facts = met.fillna(0, ["identifiers", "concepts", "resolved"]).withColumn("stale", F.col("query_id") % 11 == 0).withColumn("second", F.coalesce("second", F.lit(0.0)))
    return facts.select("query_id", expansion.gate(facts, 5, 0.02, 3).alias("state"))


@query("""WITH n AS (SELECT source, lang || (doc_id % 9) AS name, count(*) FILTER (doc_id % 3 > 0) AS defines, count(DISTINCT doc_id % 4) AS files, sum(n_chars % 5)::BIGINT AS mentions FROM documents GROUP BY 1, 2),
amb AS (SELECT source, name, mentions, count(*) OVER (PARTITION BY source) AS k, max(mentions) OVER (PARTITION BY source) AS most FROM n WHERE defines > 0 AND files > 1),
lead_names AS (SELECT source, max(name) AS name FROM amb WHERE mentions = most AND k > 1 GROUP BY source HAVING count(*) = 1)
SELECT n.source, n.name, CASE WHEN defines = 0 THEN 1.0 WHEN files = 1 THEN 3.0 WHEN l.name IS NOT NULL THEN 3.0 ELSE round(1.0 + 2.0 / sqrt(files), 6) END::DOUBLE AS weight FROM n LEFT JOIN lead_names l ON l.source = n.source AND l.name = n.name""")
def name_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("lang", (F.col("doc_id") % 9).cast("string")).alias("name")
    names = table(spark, sf_dir, "documents").groupBy("source", name).agg(F.count(F.when(F.col("doc_id") % 3 > 0, 1)).alias("defines"), F.count_distinct(F.col("doc_id") % 4).alias("files"), F.sum(F.col("n_chars") % 5).alias("mentions"))
    return expansion.calibrated(names, "source").select("source", "name", "weight")


@query("""WITH best AS (SELECT l_partkey, l_suppkey, max(l_extendedprice * CASE l_returnflag WHEN 'R' THEN 0.7::DOUBLE WHEN 'A' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END / (1 + l_linenumber)) AS g FROM lineitem GROUP BY 1, 2)
SELECT l_partkey AS path, round(sum(g), 2) AS score FROM best GROUP BY 1""")
def file_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes for a part by line items; a supplier's items are one provenance group."""
    label = F.when(F.col("l_returnflag") == "R", 0.7).when(F.col("l_returnflag") == "A", 1.0).otherwise(0.0)
    votes = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "path")
    return expansion.grouped_votes(votes, "path", "l_suppkey", F.col("l_extendedprice") * label / (1 + F.col("l_linenumber"))).withColumn("score", F.round("score", 2))


@query("""WITH m AS (SELECT c_mktsegment, c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal DESC, c_custkey) - 1 AS pos, dense_rank() OVER (ORDER BY c_nationkey) AS rank FROM customer)
SELECT c_custkey AS path, round(max(10.0::DOUBLE / (1 + rank) / (1 + 0.25::DOUBLE * pos)), 6) AS gain FROM m WHERE pos < 6 GROUP BY c_custkey""")
def module_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six best members of each module; a nation's number is the module's rank, its segments are its parts."""
    ranks = table(spark, sf_dir, "customer").select("c_nationkey").distinct().withColumn("rank", F.row_number().over(Window.orderBy("c_nationkey")))  # a row for each nation
    order = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    held = table(spark, sf_dir, "customer").withColumn("pos", F.row_number().over(order) - 1).filter("pos < 6").join(F.broadcast(ranks), "c_nationkey")
    return held.groupBy(F.col("c_custkey").alias("path")).agg(F.round(F.max(10.0 / (1 + F.col("rank")) / (1 + 0.25 * F.col("pos"))), 6).alias("gain"))


@query("""WITH d AS (SELECT DISTINCT p_type || p_size AS base, 'f' || p_partkey AS target FROM part WHERE p_partkey % 3 = 0), few AS (SELECT base FROM d GROUP BY base HAVING count(*) <= 3),
b AS (SELECT DISTINCT 'f' || l_partkey AS path, p_type || p_size AS base FROM lineitem JOIN part ON p_partkey = l_suppkey)
SELECT path, target, base FROM b JOIN d USING (base) JOIN few USING (base) WHERE path <> target""")
def inherits_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are definitions, a third of them classes; a line item's part derives from the part with its supplier's number."""
    part = table(spark, sf_dir, "part").withColumn("name", F.concat("p_type", F.col("p_size").cast("string")))
    kind = F.when(F.col("p_partkey") % 3 == 0, "class").otherwise("function").alias("kind")
    definitions = part.select("name", F.concat(F.lit("f"), "p_partkey").alias("file"), kind)
    bases = table(spark, sf_dir, "lineitem").join(part, F.col("p_partkey") == F.col("l_suppkey")).select(F.concat(F.lit("f"), "l_partkey").alias("path"), F.col("name").alias("base"))
    return expansion.class_edges(bases, definitions)


@query("""WITH s AS (SELECT DISTINCT 'src/' || lang || '/mod' || (doc_id % 200) || '.py' AS source, 'mod' || (doc_id % 200) AS stem FROM documents),
t AS (SELECT DISTINCT 'tests/test_mod' || (event_id % 250) || '.py' AS test, 'mod' || (event_id % 250) AS stem FROM events),
i AS (SELECT DISTINCT 'tests/test_mod' || (event_id % 250) || '.py' AS test, 'src/en/mod' || (user_id % 200) || '.py' AS source FROM events WHERE value > 20),
u AS (SELECT source, test, 'test name' AS how FROM t JOIN s USING (stem) UNION ALL SELECT source, test, 'test import' FROM i WHERE source IN (SELECT source FROM s))
SELECT source, test, max(how) AS how FROM u GROUP BY source, test""")
def test_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = lambda c, n: F.concat(F.lit("mod"), (F.col(c) % n).cast("string"))
    events, docs = table(spark, sf_dir, "events"), table(spark, sf_dir, "documents")
    sources = docs.select(F.concat(F.lit("src/"), "lang", F.lit("/"), stem("doc_id", 200), F.lit(".py")).alias("source"), stem("doc_id", 200).alias("stem")).distinct()
    test = F.concat(F.lit("tests/test_"), stem("event_id", 250), F.lit(".py")).alias("test")
    imports = events.filter("value > 20").select(test, F.concat(F.lit("src/en/"), stem("user_id", 200), F.lit(".py")).alias("source")).distinct()
    return expansion.tested_by(events.select(test, stem("event_id", 250).alias("stem")).distinct(), sources, imports)


@query("SELECT l_orderkey AS file, round(sum(l_extendedprice), 2) AS score, arg_max(l_partkey, (l_extendedprice, -l_linenumber)) AS strongest FROM lineitem GROUP BY l_orderkey")
def strongest_explanation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of gains and what gave most; of equals the first."""
    best = F.max_by("l_partkey", F.struct("l_extendedprice", -F.col("l_linenumber")))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("file")).agg(F.round(F.sum("l_extendedprice"), 2).alias("score"), best.alias("strongest"))
