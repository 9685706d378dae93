"""Queries of the scorers on paths, definitions, fields, past tasks, claims and candidate sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators import evidence, index, scorers
from millrace.plans.base import query
from millrace.plans.retrieval import _ASKED, _IDF, _TERMS, _asked, _rank
from millrace.sources.tables import table

_URLS = "u AS (SELECT page_id, string_split(lower(regexp_extract(url, '://([^/?#]*)', 1)), '.') AS labels, list_filter(string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS dirs FROM pages WHERE url IS NOT NULL), p AS (SELECT *, labels[1] AS stem FROM u)"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by their url: the host's first label is the stem, its labels the stem's tokens, folders the directories."""
    labels = F.split(F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)), r"\.")
    dirs = F.filter(F.split(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1), "/"), lambda x: x != "")
    return table(spark, sf_dir, "pages").filter("url is not null").select("page_id", labels[0].alias("stem"), labels.alias("stem_tokens"), dirs.alias("directory_tokens"))


@query(f"WITH {_URLS}, asked AS (SELECT DISTINCT page_id AS query_id, unnest(list_concat([stem, substr(stem, 1, 6)], dirs)) AS term FROM p WHERE page_id % 50 = 0), n AS (SELECT count(*) AS n FROM p), dfs AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT page_id, unnest(list_concat(labels, dirs)) AS term FROM p) GROUP BY term), met AS (SELECT query_id, page_id, term, CASE WHEN term = stem THEN 3.0::DOUBLE WHEN list_contains(labels, term) THEN 2.0 WHEN list_contains(dirs, term) THEN 1.0 WHEN length(term) >= 5 AND contains(stem, term) THEN 0.5 END AS gain FROM asked, p WHERE term <> ''), s AS (SELECT query_id, page_id AS doc_id, round(sum(gain * ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5))), 9) AS score FROM met LEFT JOIN dfs USING (term), n WHERE gain IS NOT NULL GROUP BY ALL), {_rank('s', 10)} SELECT query_id, doc_id AS page_id, round(score, 6) AS score, rank FROM s_r")
def score_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths of every fiftieth page, its host's first six letters among them, are looked for in all pages."""
    p = _paths(spark, sf_dir)
    terms = F.array_distinct(F.concat(F.array("stem", F.substring("stem", 1, 6)), "directory_tokens"))
    asked = p.filter("page_id % 50 = 0").select(F.col("page_id").alias("query_id"), F.explode(terms).alias("term"), F.lit(1.0).alias("w")).filter("term <> ''")
    return scorers.ranked(evidence.best_paths(asked, p, "page_id", 10), "page_id", 10).select("query_id", "page_id", F.round("score", 6).alias("score"), "rank")


_NAMES = "(VALUES (1, 'Ring', 3.0::DOUBLE), (1, 'WIDGET', 3.0::DOUBLE), (2, 'BOLT', 1.0::DOUBLE), (3, 'gear', 3.0::DOUBLE))"
_DEFINED = "d AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN upper(substr(w, 1, 1)) || substr(w, 2) ELSE w END AS name, CASE WHEN p_size < 10 THEN 'method' ELSE 'class' END AS kind, p_brand AS parent FROM (SELECT *, string_split(p_name, ' ')[-1] AS w FROM part))"


@query(f"WITH {_DEFINED}, q AS (SELECT * FROM {_NAMES} t(query_id, name, w)), f AS (SELECT query_id, q.name AS asked, d.name, min(w * CASE WHEN q.name = d.name THEN 1.0 ELSE 0.6 END) AS w FROM q JOIN d ON d.name = q.name OR (lower(d.name) = lower(q.name) AND q.name NOT IN (SELECT name FROM d)) GROUP BY ALL), sp AS (SELECT name, count(DISTINCT p_partkey) AS spread FROM d GROUP BY name), s AS (SELECT query_id, p_partkey AS doc_id, round(sum(w / sqrt(spread) * CASE kind WHEN 'method' THEN 0.8 ELSE 1 END * CASE WHEN query_id = 1 AND name = 'Ring' AND parent = 'Brand#2' THEN 2.0 ELSE 1 END), 9) AS score FROM f JOIN sp USING (name) JOIN d USING (name) GROUP BY ALL), {_rank('s', 50)} SELECT query_id, doc_id AS p_partkey, round(score, 6) AS score, rank FROM s_r")
def score_symbol_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part defines the last word of its name, below its brand; small parts are methods."""
    w = F.element_at(F.split("p_name", " "), -1)
    name = F.when(F.col("p_size") % 2 == 0, F.concat(F.upper(F.substring(w, 1, 1)), F.expr("substring(element_at(split(p_name, ' '), -1), 2)"))).otherwise(w)
    defined = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), F.when(F.col("p_size") < 10, "method").otherwise("class").alias("kind"), F.col("p_brand").alias("parent"))
    names = spark.createDataFrame([(1, "Ring", 3.0), (1, "WIDGET", 3.0), (2, "BOLT", 1.0), (3, "gear", 3.0)], "query_id int, name string, w double")
    asked = spark.createDataFrame([(1, "Brand#2", "Ring")], "query_id int, parent string, name string")
    return scorers.ranked(evidence.definitions(names, defined, asked, "p_partkey"), "p_partkey", 50).select("query_id", "p_partkey", F.round("score", 6).alias("score"), "rank")


_FIELDS = "f AS (SELECT page_id, 3.0::DOUBLE AS weight, url AS text FROM pages UNION ALL SELECT page_id, 2.0, regexp_extract(html, '<title>([^<]*)', 1) FROM pages UNION ALL SELECT page_id, 1.0, regexp_replace(html, '<[^>]*>', ' ', 'g') FROM pages)"


@query(f"WITH {_FIELDS}, postings AS (SELECT page_id AS doc_id, term, sum(weight) AS tf FROM (SELECT page_id, weight, unnest({_TERMS}) AS term FROM f) GROUP BY ALL), stats AS (SELECT doc_id, sum(tf) AS len FROM postings GROUP BY doc_id), corpus AS (SELECT count(*) AS n, avg(len) AS avg_len FROM stats), dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term), {_ASKED}, s AS (SELECT query_id, doc_id, round(sum({_IDF} * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg_len))), 9) AS score FROM asked JOIN postings USING (term) JOIN dfs USING (term) JOIN stats USING (doc_id), corpus GROUP BY ALL), {_rank('s', 10)} SELECT query_id, doc_id AS page_id, round(score, 6) AS score, rank FROM s_r")
def score_field_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls, titles and texts of pages as fields of weight 3, 2 and 1."""
    fields = F.array(F.struct(F.lit(3.0).alias("weight"), F.col("url").alias("text")), F.struct(F.lit(2.0).alias("weight"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("text")), F.struct(F.lit(1.0).alias("weight"), F.regexp_replace("html", "<[^>]*>", " ").alias("text")))
    postings = evidence.weighted_postings(table(spark, sf_dir, "pages").select("page_id", F.inline(fields)), "page_id")
    bm25 = scorers.bm25(_asked(spark, sf_dir), postings, "page_id")
    return scorers.ranked(bm25, "page_id", 10).select("query_id", "page_id", F.round("score", 6).alias("score"), "rank")


_STRONG = "q AS (SELECT query_id, term, CASE WHEN length(term) >= 9 THEN 3.0::DOUBLE ELSE 1.0 END AS w FROM asked)"


@query(f"WITH {_ASKED}, {_STRONG}, c AS (SELECT conv_id, role AS field, CASE role WHEN 'user' THEN 2.0::DOUBLE ELSE 1.0 END AS weight, count(*) OVER (PARTITION BY conv_id) > 4 AS bulk, text FROM conversations), p AS (SELECT conv_id, field, term, count(*) AS tf, max(weight) AS weight, bool_or(bulk) AS bulk FROM (SELECT * EXCLUDE (text), unnest({_TERMS}) AS term FROM c) GROUP BY conv_id, field, term), l AS (SELECT conv_id, field, sum(tf) AS len FROM p GROUP BY ALL), a AS (SELECT field, sum(len) AS total FROM l GROUP BY field), n AS (SELECT count(DISTINCT conv_id) AS n FROM c), d AS (SELECT field, term, count(*) AS df FROM p GROUP BY ALL), s AS (SELECT query_id, conv_id, round(sum(weight * w * {_IDF} * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / (total / n)))) * CASE WHEN bool_or(bulk) THEN 0.3 ELSE 1 END, 4) AS score, count(*) FILTER (w >= 3) AS support, count(DISTINCT term) FILTER (w < 3) AS concepts FROM q JOIN p USING (term) JOIN d USING (field, term) JOIN l USING (conv_id, field) JOIN a USING (field), n GROUP BY query_id, conv_id), r AS (SELECT *, CAST(row_number() OVER w AS INTEGER) AS rank, first_value(score) OVER w AS leader FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, conv_id)) SELECT query_id, conv_id, score, support, concepts, (support = 0 AND concepts < 2) OR (rank > 1 AND score < leader * 0.25) AS weak, rank FROM r WHERE rank <= 10")
def score_multi_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as records with a field for each role; those of more than four turns are bulk."""
    c = table(spark, sf_dir, "conversations")
    bulk = c.groupBy("conv_id").agg((F.count("*") > 4).alias("bulk"))
    texts = c.join(bulk, "conv_id").select("conv_id", F.col("role").alias("field"), F.when(F.col("role") == "user", 2.0).otherwise(1.0).alias("weight"), "bulk", "text")
    asked = _asked(spark, sf_dir).withColumn("w", F.when(F.length("term") >= 9, 3.0).otherwise(1.0))
    return evidence.multi_field(asked, texts, "conv_id")


@query(f"WITH {_ASKED}, {_STRONG}, t AS (SELECT conv_id, term, count(*) AS tf FROM (SELECT conv_id, unnest({_TERMS}) AS term FROM conversations) GROUP BY ALL), qn AS (SELECT query_id, sqrt(sum(w * w)) AS qn FROM q GROUP BY ALL), en AS (SELECT conv_id, sqrt(sum(tf * tf)::DOUBLE) AS en FROM t GROUP BY ALL), sim AS (SELECT query_id, conv_id, round(sum(w * tf) / (any_value(qn) * any_value(en)), 9) AS similarity FROM q JOIN t USING (term) JOIN qn USING (query_id) JOIN en USING (conv_id) GROUP BY ALL), e AS (SELECT conv_id, 'f' || (conv_id % 20) AS path, conv_id % 3 = 0 AS changed, CASE WHEN count(*) % 2 = 0 THEN 1.0::DOUBLE WHEN count(*) > 3 THEN 0.5 ELSE 0 END AS weight, (SELECT max(conv_id) FROM conversations) - conv_id AS age FROM conversations GROUP BY conv_id), v AS (SELECT query_id, path, count(*) AS support, sum(similarity * weight * pow(0.5::DOUBLE, age / 90.0::DOUBLE) * CASE WHEN changed THEN 0.5 ELSE 1 END) AS score FROM sim JOIN e USING (conv_id) WHERE similarity >= 0.01 AND weight > 0 GROUP BY ALL) SELECT query_id, path, support, round(score, 6) AS score FROM v WHERE support >= 2")
def score_cosine_experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation stands for a past task, a day older than the next; its number of turns for the outcome."""
    c = table(spark, sf_dir, "conversations")
    asked = _asked(spark, sf_dir).withColumn("w", F.when(F.length("term") >= 9, 3.0).otherwise(1.0))
    terms = index.postings(c, "conv_id", "text").withColumnRenamed("conv_id", "event_id")
    last = c.agg(F.max("conv_id").alias("last"))
    outcome = F.when(F.col("turns") % 2 == 0, 1.0).when(F.col("turns") > 3, 0.5).otherwise(0.0)
    per = c.groupBy("conv_id").agg(F.count("*").alias("turns")).join(F.broadcast(last), F.lit(True))
    events = per.select(F.col("conv_id").alias("event_id"), F.concat(F.lit("f"), F.col("conv_id") % 20).alias("path"), (F.col("conv_id") % 3 == 0).alias("changed"), outcome.alias("outcome_weight"), (F.col("last") - F.col("conv_id")).alias("age_days"))
    votes = evidence.experience_votes(evidence.similar_tasks(asked, terms, 0.01), events, 2, 90.0, 0.5)
    return votes.withColumn("score", F.round("score", 6))


@query(f"WITH {_ASKED}, t AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(lower(regexp_replace(html, '<[^>]*>', ' ', 'g')), '[a-z_][a-z0-9_]{{2,79}}')) AS term FROM pages), n AS (SELECT count(DISTINCT page_id) AS n FROM t), d AS (SELECT term, count(*) AS df FROM t GROUP BY term), g AS (SELECT query_id, page_id, sum({_IDF}) AS gain FROM asked JOIN t USING (term) JOIN d USING (term), n GROUP BY ALL), h AS (SELECT page_id, path, min(i) AS i FROM (SELECT page_id, unnest(l) AS path, unnest(range(len(l))) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1) AS l FROM pages)) GROUP BY ALL), c AS (SELECT page_id, path FROM h QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY i, path) <= 4), k AS (SELECT page_id, count(*) AS files FROM c GROUP BY page_id) SELECT query_id, path, round(sum(gain / sqrt(files)), 5) AS score FROM g JOIN c USING (page_id) JOIN k USING (page_id) GROUP BY ALL")
def score_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's text is a claim; the first four targets of its links are the files that it cites."""
    p = table(spark, sf_dir, "pages")
    terms = index.terms_of(p.select(F.col("page_id").alias("claim_id"), F.regexp_replace("html", "<[^>]*>", " ").alias("text")), "claim_id", "text").distinct()
    links = F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))
    cited = p.select(F.col("page_id").alias("claim_id"), F.posexplode(links).alias("place", "path"))
    return evidence.claims(_asked(spark, sf_dir), terms, cited, 4).withColumn("score", F.round("score", 5))


@query("WITH w AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark), l AS (SELECT DISTINCT page_id AS label, unnest(regexp_extract_all(lower(regexp_extract(html, '<title>([^<]*)', 1)), '[a-z]+')) AS token FROM pages) SELECT query_id, label, count(DISTINCT word) AS n FROM w JOIN l ON word = token OR (length(word) >= 4 AND length(token) >= 4 AND (starts_with(word, token) OR starts_with(token, word))) GROUP BY ALL")
def score_prefix_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lambda c: F.explode(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)))
    words = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), cut(F.col("text")).alias("word"))
    labels = table(spark, sf_dir, "pages").select(F.col("page_id").alias("label"), cut(F.regexp_extract("html", "<title>([^<]*)", 1)).alias("token"))
    return evidence.prefix_overlap(words, labels)


@query("WITH t AS (SELECT DISTINCT p_partkey AS query_id, unnest(list_append(string_split(p_name, ' '), lower(p_type))) AS term FROM part WHERE p_partkey % 50 = 0), c AS (SELECT DISTINCT p_brand AS candidate, unnest(string_split(p_name, ' ')) AS term, 'positive' AS side FROM part WHERE p_size <= 5 UNION SELECT p_brand, lower(p_type), 'tag' FROM part WHERE p_size <= 3 UNION SELECT p_brand, unnest(string_split(p_name, ' ')), 'negative' FROM part WHERE p_size = 50), pos AS (SELECT DISTINCT candidate, term FROM c WHERE side <> 'negative'), d AS (SELECT term, count(*) AS df FROM pos GROUP BY term), n AS (SELECT count(DISTINCT candidate) AS n FROM c), f AS (SELECT candidate, term, 1.0::DOUBLE AS f FROM pos UNION ALL SELECT candidate, term, 1.5 FROM c WHERE side = 'tag' UNION ALL SELECT candidate, term, -0.75 FROM c WHERE side = 'negative'), s AS (SELECT query_id, candidate, greatest(0.0, sum(f * ln(1 + n / df::DOUBLE))) AS score FROM t JOIN f USING (term) JOIN d USING (term), n GROUP BY ALL) SELECT query_id, candidate, round(score / sum(score) OVER (PARTITION BY query_id), 4) AS share FROM s WHERE score > 0")
def score_candidate_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands are the candidates: words of small parts speak for them, types are tags, words of the largest speak against."""
    p = table(spark, sf_dir, "part")
    words = F.explode(F.split("p_name", " ")).alias("term")
    tasks = p.filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.explode(F.array_append(F.split("p_name", " "), F.lower("p_type"))).alias("term"))
    brand = F.col("p_brand").alias("candidate")
    held = p.filter("p_size <= 5").select(brand, words, F.lit("positive").alias("side")).union(p.filter("p_size <= 3").select(brand, F.lower("p_type"), F.lit("tag"))).union(p.filter("p_size = 50").select(brand, words, F.lit("negative")))
    return evidence.candidate_shares(tasks, held)
