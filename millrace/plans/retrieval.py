"""Queries over documents, pages and the benchmark's passages: tokens, index, scores and fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions import tokens
from millrace.operators import fusion, index, scorers
from millrace.plans.base import query
from millrace.sources.tables import table, written

_TERMS = "regexp_extract_all(lower(text), '[a-z_][a-z0-9_]{2,79}')"
_POSTINGS = f"postings AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents) GROUP BY doc_id, term)"
_STATS = "stats AS (SELECT doc_id, sum(tf) AS len, count(*) AS distinct_terms FROM postings GROUP BY doc_id), corpus AS (SELECT count(*) AS n, avg(len) AS avg_len, avg(distinct_terms) AS avg_distinct FROM stats), dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term)"
_ASKED = f"asked AS (SELECT DISTINCT item_id AS query_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) WHERE length(term) >= 6)"
_MET = f"WITH {_POSTINGS}, {_STATS}, {_ASKED}, met AS (SELECT * FROM asked JOIN postings USING (term) JOIN dfs USING (term) JOIN stats USING (doc_id), corpus)"
_IDF = "ln(1 + (n - df + 0.5) / (df + 0.5))"
_BM25 = f"bm AS (SELECT query_id, doc_id, round(sum({_IDF} * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg_len))), 9) AS score FROM met GROUP BY query_id, doc_id)"
_RARE = f"rare AS (SELECT query_id, doc_id, round(sum({_IDF} * {_IDF} / (1 + ln(1 + distinct_terms / avg_distinct))), 9) AS score FROM met GROUP BY query_id, doc_id)"


def _rank(name: str, k: int = 50) -> str:
    return f"{name}_r AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM {name} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= {k})"


_LISTS = f"{_MET}, {_BM25}, {_RARE}, {_rank('bm')}, {_rank('rare')}, lists AS (SELECT 'bm25' AS source, * FROM bm_r UNION ALL SELECT 'rare' AS source, * FROM rare_r)"


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.postings(table(spark, sf_dir, "documents"), "doc_id", "text")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings as a table: scorers read them for lengths, frequencies and matches, and texts are taken apart once."""
    return written(_postings(spark, sf_dir), "postings")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = index.terms_of(table(spark, sf_dir, "benchmark"), "item_id", "text").filter(F.length("term") >= 6).distinct()
    return asked.select(F.col("item_id").alias("query_id"), "term", F.lit(1.0).alias("w"))


def _bm25(spark: SparkSession, sf_dir: str, k: int = 50) -> DataFrame:
    return scorers.ranked(scorers.bm25(_asked(spark, sf_dir), _stored(spark, sf_dir), "doc_id"), "doc_id", k)


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, asked = _stored(spark, sf_dir), _asked(spark, sf_dir)
    lists = [scorers.ranked(scorer(asked, held, "doc_id"), "doc_id", 50).withColumn("source", F.lit(name)) for name, scorer in (("bm25", scorers.bm25), ("rare", scorers.rare_terms))]
    return written(lists[0].unionByName(lists[1]), "lists")


@query("SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{1,79}') AS t FROM documents)")
def tok_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokens.identifiers(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("n_tokens"), F.size(F.array_distinct(found)).cast("long").alias("n_distinct"))


_NORMAL = "CASE WHEN lower(w) LIKE '%ies' AND length(w) > 4 THEN lower(w)[:-4] || 'y' WHEN lower(w) LIKE '%s' AND length(w) > 3 AND NOT regexp_matches(lower(w), '(ss|us|is)$') THEN lower(w)[:-2] ELSE lower(w) END"


@query(f"WITH words AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{1,79}}')) AS w FROM documents) GROUP BY w) SELECT {_NORMAL} AS term, CAST(sum(n) AS BIGINT) AS n, count(*) AS forms FROM words GROUP BY 1")
def tok_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(tokens.identifiers(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return words.groupBy(tokens.normalize(F.col("w")).alias("term")).agg(F.sum("n").alias("n"), F.count("*").alias("forms"))


_SPLIT = "regexp_extract_all(regexp_replace(p_type || ' ' || p_brand || 'XMLPart_' || p_name, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|\\d+')"


@query(f"SELECT p_partkey, array_to_string({_SPLIT}, '|') AS parts FROM part")
def tok_camel_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_type", F.lit(" "), "p_brand", F.lit("XMLPart_"), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tokens.parts(name), "|").alias("parts"))


_PIECES = "regexp_extract_all(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|\\d+')"
#: Terms of identifiers: relation {0} has (key, w), and the result (key, id, t).
_EXPANDED = (
    "p AS (SELECT key, w AS id, unnest(" + _PIECES + ") AS w FROM {0}), n AS (SELECT key, id, " + _NORMAL + " AS t FROM p WHERE length(w) > 1), "
    "many AS (SELECT id FROM (SELECT DISTINCT w AS id, " + _PIECES + " AS s FROM {0}) WHERE len(list_filter(s, lambda x: length(x) > 1)) > 1 OR regexp_matches(id, '[A-Z]')), "
    "terms AS (SELECT DISTINCT key, id, t FROM n UNION SELECT DISTINCT key, w, w FROM {0} WHERE w IN (SELECT id FROM many))"
)


@query(f"WITH w AS (SELECT DISTINCT 0 AS key, w FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{1,79}}')) AS w FROM conversations)), {_EXPANDED.format('w')} SELECT id AS identifier, string_agg(t, ' ' ORDER BY t) AS terms FROM terms GROUP BY id")
def tok_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers without a part of two characters have no terms and give no row."""
    words = table(spark, sf_dir, "conversations").select(F.explode(tokens.identifiers(F.col("text"))).alias("identifier")).distinct()
    return words.select("identifier", F.array_join(F.array_sort(tokens.expand(F.col("identifier"))), " ").alias("terms")).filter("terms <> ''")


@query(f"""WITH c AS (SELECT doc_id AS key, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{1,79}}')) AS w FROM documents) GROUP BY 1, 2), {_EXPANDED.format('c')}
SELECT t AS term, count(DISTINCT terms.key) AS df, CAST(sum(c.n) AS BIGINT) AS tf FROM terms JOIN c ON c.key = terms.key AND c.w = terms.id GROUP BY t""")
def idx_identifier_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index on expanded identifiers: a compound one is found as it is written and by each of its parts."""
    found = index.identifier_postings(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def _redacted(text: str) -> str:
    for pattern in tokens.SECRETS:
        quoted = pattern.replace("'", "''")
        text = f"regexp_replace({text}, '{quoted}', '{tokens.PLACEHOLDER}', 'g')"
    return text


@query(f"SELECT doc_id, md5(t) AS redacted_md5, t <> text AS changed FROM (SELECT doc_id, text, {_redacted('text')} AS t FROM documents)")
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokens.redact(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t).alias("redacted_md5"), (t != F.col("text")).alias("changed"))


@query("WITH p AS (SELECT page_id, string_split(regexp_extract(url, '://([^?#]*)', 1), '/') AS s FROM pages) SELECT page_id, s[1] AS root, s[-1] AS basename, regexp_replace(s[-1], '\\.[^.]*$', '') AS stem, regexp_extract(s[-1], '\\.([^.]*)$', 1) AS suffix, CAST(len(s) AS BIGINT) AS depth FROM p")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.split(F.regexp_extract("url", "://([^?#]*)", 1), "/")
    last = F.element_at(s, -1)
    return table(spark, sf_dir, "pages").select("page_id", s[0].alias("root"), last.alias("basename"), F.regexp_replace(last, r"\.[^.]*$", "").alias("stem"), F.regexp_extract(last, r"\.([^.]*)$", 1).alias("suffix"), F.size(s).cast("long").alias("depth"))


@query(f"WITH {_POSTINGS} SELECT doc_id, term, tf, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS INTEGER) AS rank FROM postings QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) <= 20")
def idx_postings_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.top_terms(_postings(spark, sf_dir), "doc_id", 20)


@query(f"WITH {_POSTINGS} SELECT term, count(*) AS df, round(ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM postings GROUP BY term")
def idx_df_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    return index.term_stats(_postings(spark, sf_dir), "doc_id", n).withColumn("idf", F.round("idf", 6))


@query(f"WITH {_POSTINGS} SELECT doc_id, CAST(sum(tf) AS BIGINT) AS len, count(*) AS distinct_terms FROM postings GROUP BY doc_id")
def idx_doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.document_stats(_postings(spark, sf_dir), "doc_id")


@query(f"WITH {_POSTINGS} SELECT term, count(*) AS df FROM postings WHERE doc_id % 3 <> 0 GROUP BY term")
def idx_incremental_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of thirds 0 and 1, after third 0 went and third 2 came: the same as counting thirds 1 and 2 afresh."""
    p = _postings(spark, sf_dir).withColumn("part", F.pmod("doc_id", F.lit(3)))
    before = p.filter("part < 2").groupBy("term").agg(F.count("*").alias("df"))
    return index.document_frequency_delta(before, p.filter("part = 2"), p.filter("part = 0"))


@query(f"{_MET}, {_BM25}, {_rank('bm', 10)} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM bm_r")
def score_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"{_MET}, {_RARE}, {_rank('rare', 10)} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM rare_r")
def score_rare_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scorers.ranked(scorers.rare_terms(_asked(spark, sf_dir), _stored(spark, sf_dir), "doc_id"), "doc_id", 10)
    return got.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_POSTINGS}, {_ASKED}, m AS (SELECT query_id, doc_id, term, tf, count(*) OVER (PARTITION BY query_id, term) AS holders FROM asked JOIN postings USING (term) WHERE length(term) >= 9), s AS (SELECT query_id, doc_id, round(sum((1 + ln(tf)) / ln(2 + holders)), 9) AS score FROM m GROUP BY query_id, doc_id), {_rank('s', 10)} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM s_r")
def score_symbol_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scorers.ranked(scorers.references(_asked(spark, sf_dir).filter(F.length("term") >= 9), _postings(spark, sf_dir), "doc_id"), "doc_id", 10)
    return got.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


_PHRASE = "regexp_extract(text, '^(\\S+ \\S+ \\S+ \\S+)', 1)"


@query(f"WITH p AS (SELECT item_id AS query_id, string_split({_PHRASE}, ' ') AS w FROM benchmark WHERE {_PHRASE} <> ''), d AS (SELECT doc_id, string_split(replace(text, chr(10), ' '), ' ') AS t FROM documents), g AS (SELECT doc_id, array_to_string(t[i : i + 3], ' ') AS g FROM (SELECT doc_id, t, unnest(range(1, len(t) - 2)) AS i FROM d)) SELECT query_id, doc_id, count(*) AS hits FROM p JOIN g ON g.g = array_to_string(w, ' ') GROUP BY query_id, doc_id")
def score_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verbatim phrases of four words, found by equal windows of words: a join by key, no product of phrases and texts."""
    phrase = F.regexp_extract("text", r"^(\S+ \S+ \S+ \S+)", 1)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), phrase.alias("g")).filter("g <> ''")
    words = table(spark, sf_dir, "documents").select("doc_id", F.split(F.translate("text", "\n", " "), " ").alias("t"))
    lead = lambda n: F.slice("t", n + 1, F.greatest(F.size("t") - n, F.lit(0)))
    zipped = F.arrays_zip(F.col("t").alias("a"), lead(1).alias("b"), lead(2).alias("c"), lead(3).alias("d"))
    grams = words.select("doc_id", F.explode(zipped).alias("z")).filter("z.d is not null").select("doc_id", F.concat_ws(" ", "z.a", "z.b", "z.c", "z.d").alias("g"))
    return grams.join(asked, "g").groupBy("query_id", "doc_id").agg(F.count("*").alias("hits"))


@query(f"{_LISTS}, f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (20 + rank)), 9) AS score FROM lists GROUP BY query_id, doc_id), {_rank('f', 10)} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM f_r")
def fuse_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scorers.ranked(fusion.rrf(_lists(spark, sf_dir), "doc_id"), "doc_id", 10)
    return got.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"{_LISTS}, f AS (SELECT query_id, doc_id, round(sum(part), 9) AS score FROM (SELECT query_id, doc_id, score / max(score) OVER (PARTITION BY query_id, source) AS part FROM lists) GROUP BY query_id, doc_id), {_rank('f', 10)} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM f_r")
def fuse_combsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scorers.ranked(fusion.combsum(_lists(spark, sf_dir), "doc_id"), "doc_id", 10)
    return got.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"{_LISTS}, i AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (20 + rank)), 9) AS score FROM lists GROUP BY query_id, doc_id), g AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM i) SELECT query_id, doc_id, round(1.0::DOUBLE / (20 + rank), 6) AS score FROM g")
def fuse_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.grouped_rrf(_lists(spark, sf_dir), "doc_id", F.lit("lexical")).withColumn("score", F.round("score", 6))


@query(f"{_MET}, {_BM25}, v AS (SELECT count(DISTINCT term) AS v FROM postings), h AS (SELECT query_id, doc_id, round(score * (1 - distinct_terms / v::DOUBLE), 9) AS score FROM bm JOIN stats USING (doc_id), v), {_rank('h', 10)} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM h_r")
def damp_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _stored(spark, sf_dir)
    vocabulary = p.agg(F.count_distinct("term").alias("v"))
    shares = index.document_stats(p, "doc_id").join(F.broadcast(vocabulary), F.lit(True)).select("doc_id", (F.col("distinct_terms") / F.col("v")).alias("share"))
    scored = scorers.bm25(_asked(spark, sf_dir), p, "doc_id").withColumn("score", F.round("score", 9))
    return scorers.ranked(fusion.damped(scored, shares, "doc_id"), "doc_id", 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"{_LISTS} SELECT query_id, doc_id, r.rank FROM rare_r r WHERE EXISTS (SELECT 1 FROM bm_r b WHERE b.query_id = r.query_id AND b.doc_id = r.doc_id AND b.rank <= 10)")
def boost_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = _lists(spark, sf_dir)
    return fusion.boosted_only(lists.filter("source = 'rare'"), lists.filter("source = 'bm25' and rank <= 10"), "doc_id").select("query_id", "doc_id", "rank")


@query(f"{_LISTS}, a AS (SELECT query_id, doc_id, rank FROM bm_r WHERE rank <= 5), b AS (SELECT query_id, doc_id, rank FROM rare_r WHERE rank <= 5), m AS (SELECT query_id, max(rank) AS l FROM a GROUP BY query_id) SELECT query_id, doc_id, rank, 'found' AS origin FROM a UNION ALL SELECT b.query_id, b.doc_id, CAST(coalesce(l, 0) + row_number() OVER (PARTITION BY b.query_id ORDER BY b.rank, b.doc_id) AS INTEGER), 'fallback' FROM b LEFT JOIN m USING (query_id) WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.query_id = b.query_id AND a.doc_id = b.doc_id)")
def fallback_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = _lists(spark, sf_dir).filter("rank <= 5")
    return fusion.with_fallback(lists.filter("source = 'bm25'"), lists.filter("source = 'rare'"), "doc_id")


@query(f"{_MET}, {_BM25}, {_rank('bm')}, g AS (SELECT query_id, doc_id, rank, (score - lead(score) OVER (PARTITION BY query_id ORDER BY rank)) / nullif(score, 0) AS gap FROM bm_r) SELECT query_id, doc_id, round(gap, 6) AS gap FROM g WHERE rank = 1")
def rank_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.confidence(_bm25(spark, sf_dir)).select("query_id", "doc_id", F.round("gap", 6).alias("gap"))


@query(f"{_LISTS}, j AS (SELECT query_id, doc_id, b.rank AS b, r.rank AS r FROM (SELECT * FROM bm_r WHERE rank <= 10) b FULL JOIN (SELECT * FROM rare_r WHERE rank <= 10) r USING (query_id, doc_id)) SELECT query_id, count(*) FILTER (b IS NULL) AS entered, count(*) FILTER (r IS NULL) AS left_out, count(*) FILTER (b <> r) AS moved FROM j GROUP BY query_id")
def rank_displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = _lists(spark, sf_dir)
    return fusion.displacement(lists.filter("source = 'bm25'"), lists.filter("source = 'rare'"), "doc_id", 10)


@query(f"{_MET}, {_BM25}, {_rank('bm')}, p AS (SELECT query_id, doc_id, round(score * CASE lang WHEN 'en' THEN 1.0 WHEN 'de' THEN 0.8 ELSE 0.6 END, 9) AS score FROM bm_r JOIN documents USING (doc_id)), {_rank('p', 10)} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM p_r")
def rerank_kind_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior = F.when(F.col("lang") == "en", 1.0).when(F.col("lang") == "de", 0.8).otherwise(0.6)
    held = _bm25(spark, sf_dir).drop("rank").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").withColumn("score", F.col("score") * prior)
    return scorers.ranked(held, "doc_id", 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"{_LISTS}, t AS (SELECT l.source, l.query_id, l.rank, coalesce(b.quality = 1, false) AS good FROM lists l LEFT JOIN labels b USING (doc_id)), g AS (SELECT source, query_id, min(rank) FILTER (good) AS first_good, count(*) FILTER (good AND rank <= 10) AS hits FROM t GROUP BY source, query_id) SELECT source, count(*) AS queries, round(avg(coalesce(1.0::DOUBLE / first_good, 0)), 6) AS mrr, round(avg(CASE WHEN hits > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_at_10 FROM g GROUP BY source")
def rank_metrics_mrr_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled quality stands for relevance; documents without a label are not relevant."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("good"))
    held = _lists(spark, sf_dir).join(labels, "doc_id", "left").withColumn("good", F.coalesce("good", F.lit(False)))
    per = held.groupBy("source", "query_id").agg(F.min(F.when(F.col("good"), F.col("rank"))).alias("first_good"), F.count(F.when(F.col("good") & (F.col("rank") <= 10), 1)).alias("hits"))
    return per.groupBy("source").agg(F.count("*").alias("queries"), F.round(F.avg(F.coalesce(1 / F.col("first_good"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(F.when(F.col("hits") > 0, 1.0).otherwise(0.0)), 6).alias("hit_at_10"))


@query(f"{_LISTS}, s AS (SELECT query_id, doc_id, count(*) AS n, min(source) AS only_by FROM lists GROUP BY query_id, doc_id) SELECT CASE WHEN n > 1 THEN 'both' ELSE only_by END AS found_by, count(*) AS n FROM s GROUP BY 1")
def unique_finders(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _lists(spark, sf_dir).groupBy("query_id", "doc_id").agg(F.count("*").alias("n"), F.min("source").alias("only_by"))
    return per.groupBy(F.when(F.col("n") > 1, "both").otherwise(F.col("only_by")).alias("found_by")).agg(F.count("*").alias("n"))
