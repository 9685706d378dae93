"""The numbered queries: each applies its operator to its whole table and gives the columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm import decontamination, fertility, jaccard, licenses, line_dedup, packing, pii, quality, resampling, toxicity, url_filter, whitening, window_packing
from millrace.llm.folds import held_out
from millrace.sources.tables import table


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file on the machine that asks; the same on every machine of a cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), keep=["doc_id"], lasting=True)
    return packing.pack(pieces)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, lexicon, keep=["doc_id"]).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted", "n_matches")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents"), keep=["doc_id"]))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ensemble = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, ensemble, keep=["doc_id"]).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), keep=["doc_id"]).drop("detections")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return decontamination.digest(found)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id", "text"])


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.assess(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), keep=["doc_id"], language="lang")


def op11_target_distribution_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), keep=["doc_id"], lasting=True)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation beyond a long is null."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(rows)
    explained = F.array(*map(F.lit, map(float, model.explained))).cast("array<double>")
    each = whitening.whiten(rows, model, keep=["vec_id"]).select("vec_id", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_best_fit_packing, op3_toxicity, op4_pii, op5_quality_classifier, op6_license_scans, op7_benchmark_decontamination, op8_ngram_jaccard_join, op9_line_dedup, op10_quality_rules, op11_target_distribution_resampling, op12_window_packing, op13_embedding_whitening)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES = {
    "op1_url_filters": url_filter.oracle(),
    "op11_target_distribution_resampling": resampling.oracle(),
    "op7_benchmark_decontamination": f"""WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
wide AS (SELECT item, w, least(10, len(w)) AS m FROM items WHERE len(w) > 0),
grams AS (SELECT DISTINCT item, m, array_to_string(w[i : i + m - 1], ' ') AS g FROM (SELECT item, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM wide)),
widths AS (SELECT DISTINCT m FROM grams),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
slid AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs, widths)),
hit AS (SELECT s.doc_id, s.m, s.i, g.item FROM slid s JOIN grams g ON s.m = g.m AND s.g = g.g),
covered AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS place FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(n.ids), 0) AS BIGINT) AS n_items,
sha256(coalesce(array_to_string(n.ids, ','), '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c USING (doc_id) LEFT JOIN named n USING (doc_id)""",
    "op8_ngram_jaccard_join": f"""WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT m.a, m.b FROM met m JOIN sizes x ON m.a = x.doc_id JOIN sizes y ON m.b = y.doc_id WHERE 5 * m.n >= 4 * (x.n + y.n - m.n)),
reach AS (SELECT a, a AS b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
named AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a),
counted AS (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a),
keyed AS (SELECT doc_id, md5(string_agg(g, '|' ORDER BY g)) AS k FROM grams GROUP BY doc_id),
copied AS (SELECT doc_id, count(*) OVER (PARTITION BY k) AS copies FROM keyed)
SELECT d.doc_id, coalesce(n.class_id, d.doc_id) AS class_id, CAST(coalesce(c.n_links, 0) AS BIGINT) AS n_links, CAST(coalesce(k.copies, 1) AS BIGINT) AS copies
FROM documents d LEFT JOIN named n USING (doc_id) LEFT JOIN counted c USING (doc_id) LEFT JOIN copied k USING (doc_id)""",
}
