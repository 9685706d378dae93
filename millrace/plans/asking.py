"""Queries from requests to answers: terms weighed by spelling, scorers on expanded identifiers, answers under a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions import requests
from millrace.operators import asking, index, scorers
from millrace.plans.base import query
from millrace.plans.retrieval import _EXPANDED, _IDF, _NORMAL, _PIECES, _rank
from millrace.sources.tables import table, written

_ID = "[A-Za-z_][A-Za-z0-9_]{1,79}"
#: Prose as code: some words are joined to the one before, by a capital or an underscore.
_CODE = "replace(replace(text, ' th', 'Th'), ' er', '_er')"
_DULL = ", ".join(f"'{w}'" for w in requests.GENERIC)
_COMPOUND = f"(len(list_filter({_PIECES}, lambda x: length(x) > 1)) > 1 OR regexp_matches(w, '[A-Z]'))"
_SPELLED = "(regexp_matches(w, '[^_]_+[^_]') OR (regexp_matches(w, '^.[A-Za-z0-9_]*[A-Z]') AND regexp_matches(w, '[a-z]')) OR (regexp_matches(w, '[A-Z]') AND regexp_matches(w, '[0-9]') AND NOT regexp_matches(w, '[a-z]')))"
_WEIGHED = f"""r AS (SELECT item_id AS query_id, {_CODE} || ' See d' || length(text) || '.md' AS x, length(text)::VARCHAR AS l FROM benchmark),
sp AS (SELECT query_id, w, {_SPELLED} AS named, {_COMPOUND} AS compound FROM (SELECT DISTINCT query_id, unnest(regexp_extract_all(x, '{_ID}')) AS w FROM r)),
wt AS (SELECT query_id, term, max(w)::DOUBLE AS w FROM (SELECT query_id, w AS term, 3.0 AS w FROM sp WHERE named AND compound
UNION ALL SELECT query_id, term, CASE WHEN compound THEN 1.5 ELSE 3.0 END FROM (SELECT query_id, compound, {_NORMAL} AS term FROM (SELECT query_id, compound, unnest({_PIECES}) AS w FROM sp WHERE named) WHERE length(w) > 1) WHERE NOT compound OR term NOT IN ({_DULL})
UNION ALL SELECT query_id, l, 3.0 FROM r WHERE length(l) > 1
UNION ALL SELECT query_id, {_NORMAL}, 1.0 FROM (SELECT query_id, lower(w) AS w FROM sp WHERE NOT named AND length(w) > 2 AND lower(w) NOT IN ({_DULL}))) GROUP BY 1, 2)"""
_INDEXED = f"""d AS (SELECT doc_id AS key, {_CODE} AS x, lang || '/d' || doc_id || '.md' AS path FROM documents), c AS (SELECT key, w, count(*) AS n FROM (SELECT key, unnest(regexp_extract_all(x, '{_ID}')) AS w FROM d) GROUP BY 1, 2), {_EXPANDED.format('c')},
post AS (SELECT terms.key AS doc_id, t AS term, CAST(sum(c.n) AS BIGINT) AS tf FROM terms JOIN c ON c.key = terms.key AND c.w = terms.id GROUP BY 1, 2),
fa AS (SELECT key AS doc_id, len(regexp_extract_all(x, '{_ID}')) AS len, length(x) AS chars, coalesce(k, 0) AS distinct_terms FROM d LEFT JOIN (SELECT doc_id AS key, count(*) AS k FROM post GROUP BY 1) USING (key)),
co AS (SELECT count(*) AS n, avg(len) AS avg_len, avg(distinct_terms) AS avg_distinct FROM fa), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1)"""
_MET = f"{_INDEXED}, {_WEIGHED}, met AS (SELECT wt.query_id, post.doc_id, wt.w, post.tf, dfs.df, fa.len, fa.distinct_terms, co.* FROM wt JOIN post USING (term) JOIN dfs USING (term) JOIN fa ON fa.doc_id = post.doc_id, co)"
_BM25 = f"bm AS (SELECT query_id, doc_id, round(sum(w * {_IDF} * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg_len))), 9) AS score FROM met GROUP BY 1, 2)"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as requests, each of which names a document's file."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.expr(f"{_CODE} || ' See d' || length(text) || '.md'").alias("text"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_CODE).alias("text"), F.expr("lang || '/d' || doc_id || '.md'").alias("path"))


@query(f"WITH {_WEIGHED} SELECT query_id, term, w FROM wt")
def weighed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of requests with their weights. The passages have no calls, dotted or quoted names, which the SQL doesn't read;
    tests hold these against a loop."""
    return asking.weighed_terms(requests.analysed(_requests(spark, sf_dir), "text"), "query_id")


@query(f"WITH {_MET}, {_BM25}, {_rank('bm', 10)} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM bm_r")
def score_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 of weighed terms on expanded identifiers, by the texts' lengths in identifiers."""
    documents = _documents(spark, sf_dir)
    terms = written(asking.weighed_terms(requests.analysed(_requests(spark, sf_dir), "text"), "query_id"), "asked")
    postings, _, facts = index.asked_index(documents, "doc_id", "text", terms)
    got = scorers.voted(["bm25"], terms, postings, "doc_id", facts, 10)
    return got.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {_MET}, {_BM25}, rare AS (SELECT query_id, doc_id, round(sum(w * {_IDF} * {_IDF} / (1 + ln(1 + distinct_terms / avg_distinct))), 9) AS score FROM met GROUP BY 1, 2),
u AS (SELECT c.key AS doc_id, c.w, c.n FROM c JOIN d USING (key) WHERE c.w <> regexp_extract(x, '{_ID}')), h AS (SELECT w, count(*) AS holders FROM u GROUP BY 1),
refs AS (SELECT query_id, doc_id, round(sum(3.0::DOUBLE * (1 + ln(n)) / ln(2 + holders)), 9) AS score FROM sp JOIN u USING (w) JOIN h USING (w) WHERE named GROUP BY 1, 2), {_rank('bm')}, {_rank('rare')}, {_rank('refs')},
f AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (20 + rank)) AS score, count(*) AS agree FROM (SELECT * FROM bm_r UNION ALL SELECT * FROM rare_r UNION ALL SELECT * FROM refs_r) GROUP BY 1, 2),
pin AS (SELECT query_id, key AS doc_id, true AS pinned FROM r JOIN d ON d.path LIKE '%/d' || l || '.md'),
t AS (SELECT query_id, doc_id, round(coalesce(score, 0), 9) AS score, coalesce(agree, 0) AS agree, coalesce(pinned, false) AS pinned FROM f FULL JOIN pin USING (query_id, doc_id)),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pinned DESC, score DESC, doc_id) AS INTEGER) AS rank FROM t),
z AS (SELECT k.*, CAST(ceil(chars / 4) AS BIGINT) AS tokens FROM k JOIN fa USING (doc_id) WHERE rank <= 10)
SELECT query_id, doc_id, rank, round(score, 6) AS score, agree, pinned, tokens, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) <= 4000 AS delivered FROM z""")
def answered_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From requests to delivered documents in one call; a document defines the first name in it."""
    documents = _documents(spark, sf_dir)
    defining = documents.select("doc_id", F.regexp_extract("text", _ID, 0).alias("term"))
    got = asking.answered(_requests(spark, sf_dir), "query_id", documents, "doc_id", paths=documents.select("doc_id", "path"), defining=defining)
    return got.withColumn("score", F.round("score", 6))
