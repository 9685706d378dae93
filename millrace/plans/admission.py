"""Queries on what is read at all, and on facts that patterns find in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions import texts
from millrace.plans.base import query
from millrace.plans.retrieval import _redacted
from millrace.sources.tables import table

#: Names for the fixtures below, from the number of a document. Spark and SQL share the list.
_NAMES = (
    ".github/workflows/ci.yml", "pyproject.toml", "requirements.txt", ".venv/lib/x.py", "target/y.rs", "go/go.mod", "pnpm-lock.yaml", ".pypirc", "schema/notes.md", "app/configure.h",
    "src/core/engine.py", "tests/test_engine.py", "docs/guide.md", "config/app.toml", "node_modules/x/index.js", "web/app.min.js", ".env.local", "db/migrations/0001.sql", "api/schema.json", "lib/parse_test.go", "assets/logo.png", "poetry.lock", "src/util/io.rs")
_PATH = f"([{', '.join(repr(n) for n in _NAMES)}])[1 + doc_id % {len(_NAMES)}]"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.element_at(F.array(*map(F.lit, _NAMES)), (1 + F.col("doc_id") % len(_NAMES)).cast("int"))
    return table(spark, sf_dir, "documents").withColumn("path", path)


def _case(table: tuple[tuple[str, str], ...], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(path, '{pattern}') THEN '{name}'" for name, pattern in table) + f" ELSE {otherwise} END"


_KIND, _SKIP = _case(texts.KINDS, "'other'"), _case(texts.REASONS, "NULL")


@query(f"SELECT doc_id, path, {_KIND} AS kind, {_SKIP} AS skipped FROM (SELECT doc_id, {_PATH} AS path FROM documents)")
def path_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _named(spark, sf_dir)
    return d.select("doc_id", "path", texts.path_kind(F.col("path")).alias("kind"), texts.skip_reason(F.col("path")).alias("skipped"))


@query(f"WITH d AS (SELECT doc_id, text, n_chars, source, {_PATH} AS path FROM documents) SELECT doc_id, CASE WHEN path LIKE 'docs/%' OR path = 'docs' THEN 'excluded' WHEN {_SKIP} IS NOT NULL THEN {_SKIP} WHEN octet_length(encode(text)) > 20000 THEN 'oversized' WHEN text IS NULL OR text = '' THEN 'empty' WHEN contains(text, chr(0)) THEN 'binary' END AS reason, sha256(text) AS sha FROM d")
def admission_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that keeps a file out; null admits it."""
    p, t = F.col("path"), F.col("text")
    reason = F.when(p.startswith("docs/") | (p == "docs"), "excluded").when(texts.skip_reason(p).isNotNull(), texts.skip_reason(p)).when(F.octet_length(t) > 20000, "oversized").when(t.isNull() | (t == ""), "empty").when(F.contains(t, F.lit("\x00")), "binary")
    return _named(spark, sf_dir).select("doc_id", reason.alias("reason"), F.sha2(t, 256).alias("sha"))


@query(f"WITH d AS (SELECT DISTINCT source, {_PATH} AS path FROM documents) SELECT source, path, w AS wanted, CASE WHEN path = w THEN 'exact' ELSE 'suffix' END AS how FROM d, (VALUES ('engine.py'), ('core/engine.py'), ('src/util/io.rs'), ('guide.md')) v(w) WHERE path = w OR ends_with(path, '/' || w)")
def path_suffix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each path's suffixes at folder borders meet the wanted names by equality."""
    wanted = spark.createDataFrame([("engine.py",), ("core/engine.py",), ("src/util/io.rs",), ("guide.md",)], "wanted string")
    parts = F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    paths = _named(spark, sf_dir).select("source", "path").distinct()
    return paths.select("source", "path", F.explode(suffixes).alias("wanted")).join(F.broadcast(wanted), "wanted").select("source", "path", "wanted", F.when(F.col("path") == F.col("wanted"), "exact").otherwise("suffix").alias("how"))


_SUBJECT = "CASE doc_id % 4 WHEN 0 THEN 'Merge pull request #' || doc_id WHEN 1 THEN 'Tidy ' || source || ' (#' || doc_id || ')' ELSE 'Fix #' || doc_id || ' in ' || source END"
_LINES = "'see #' || (doc_id % 7) || ', closes #' || (doc_id % 5)", "'on https://example.org/a/b/issues/' || (doc_id % 9)", "'Signed-off-by: a b <a.b@example.org>'", "coalesce(text, '')"
_MESSAGE = f"({' || chr(10) || '.join((_SUBJECT, *_LINES))})"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts under a subject and trailers."""
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_MESSAGE).alias("message"))


def _found(text: str, pattern: str, strength: int) -> str:
    return f"SELECT doc_id, NULL AS repository, unnest(regexp_extract_all({text}, '{pattern}', 1)) AS number, {strength} AS s FROM m"


@query(f"""WITH m AS (SELECT doc_id, {_MESSAGE} AS m, {_SUBJECT} AS subject FROM documents), r AS ({_found("subject", texts.MERGES, 2)} UNION ALL {_found("subject", texts.SQUASHED, 1)} UNION ALL {_found("m", texts.FIXES, 3)}
UNION ALL {_found("m", texts.MENTION, 0)} UNION ALL SELECT doc_id, unnest(regexp_extract_all(m, '{texts.URL_REFERENCE}', 1)), unnest(regexp_extract_all(m, '{texts.URL_REFERENCE}', 2)), 0 FROM m)
SELECT doc_id, repository, number, CASE max(s) WHEN 3 THEN 'declares_fix' WHEN 2 THEN 'merges' WHEN 1 THEN 'squashed' ELSE 'mentions' END AS link FROM r GROUP BY doc_id, repository, number""")
def issue_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that a message refers to, each with the strongest link."""
    found = _messages(spark, sf_dir).select("doc_id", F.inline(texts.references(F.col("message"))))
    link = F.element_at(F.array(*map(F.lit, texts.LINKS)), F.max("strength") + 1)
    return found.groupBy("doc_id", "repository", "number").agg(link.alias("link"))


_BLANK = "' ' || chr(9) || chr(10)"


@query(f"""WITH m AS (SELECT doc_id, list_transform(string_split(regexp_replace({_MESSAGE}, '[\\x00-\\x08\\x0B-\\x1F\\x7F]', '', 'g'), chr(10)), lambda x: rtrim(x, {_BLANK})) AS l FROM documents),
k AS (SELECT doc_id, list_transform(list_filter(l, lambda x: NOT regexp_matches(trim(x, {_BLANK}), '{texts.TRAILER}')), lambda x: regexp_replace(x, '{texts.ADDRESS}', '<redacted>', 'g')) AS l FROM m),
p AS (SELECT doc_id, trim(l[1], {_BLANK}) AS s, trim(array_to_string(l[2:], chr(10)), {_BLANK}) AS b FROM k)
SELECT doc_id, substr({_redacted('s')}, 1, 200) AS subject, md5(substr({_redacted('b')}, 1, 1500)) AS body_md5 FROM p""")
def sanitize_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = texts.sanitized(F.col("message"))
    return _messages(spark, sf_dir).select("doc_id", kept.alias("m")).select("doc_id", "m.subject", F.md5("m.body").alias("body_md5"))


@query("WITH l AS (SELECT doc_id, unnest(s) AS line, unnest(range(1, len(s) + 1)) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)) SELECT doc_id, CAST(n AS INTEGER) AS line_no, regexp_extract(line, '^([A-Z]\\w+) (\\w+)', 1) AS name, sha256(line) AS fingerprint FROM l WHERE regexp_matches(line, '^[A-Z]\\w+ \\w+')")
def declared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that begin like a declaration, with their number and a fingerprint of their content."""
    l = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))  # noqa: E741
    return l.filter(F.rlike("line", F.lit(r"^[A-Z]\w+ \w+"))).select("doc_id", (F.col("n") + 1).alias("line_no"), F.regexp_extract("line", r"^([A-Z]\w+) (\w+)", 1).alias("name"), F.sha2("line", 256).alias("fingerprint"))


_RUN = "CASE o_orderstatus WHEN 'F' THEN 'collected' || chr(10) || '== ' || o_orderkey % 9 || ' passed, ' || o_custkey % 3 || ' failed in 0.5s ==' WHEN 'O' THEN o_orderkey % 9 || ' passed, 2 skipped in 1.25s' ELSE 'no summary' END"


@query(f"WITH r AS (SELECT o_orderkey, o_orderstatus AS s, string_split({_RUN}, chr(10))[-1] AS l FROM orders) SELECT o_orderkey, CASE WHEN s <> 'P' THEN coalesce(TRY_CAST(regexp_extract(l, '(\\d+) passed', 1) AS INTEGER), 0) END AS passed, CASE WHEN s <> 'P' THEN coalesce(TRY_CAST(nullif(regexp_extract(l, '(\\d+) failed', 1), '') AS INTEGER), 0) END AS failed, CASE WHEN s <> 'P' THEN coalesce(TRY_CAST(nullif(regexp_extract(l, '(\\d+) skipped', 1), '') AS INTEGER), 0) END AS skipped FROM r")
def test_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda x: F.col(x).cast("string")
    k = (F.col("o_orderkey") % 9).cast("string")
    run = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("collected\n== "), k, F.lit(" passed, "), (F.col("o_custkey") % 3).cast("string"), F.lit(" failed in 0.5s =="))).when(F.col("o_orderstatus") == "O", F.concat(k, F.lit(" passed, 2 skipped in 1.25s"))).otherwise("no summary")
    return table(spark, sf_dir, "orders").select("o_orderkey", texts.test_counts(run).alias("c")).select("o_orderkey", "c.passed", "c.failed", "c.skipped")


@query("SELECT event_id, key AS member, value AS content FROM (SELECT event_id, unnest(json_keys(props)) AS key, props FROM events), LATERAL (SELECT json_extract_string(props, '$.' || key) AS value)")
def json_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the JSON in `props`; a text that is no JSON has none."""
    return table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("member", "content"))


@query("WITH h AS (SELECT doc_id, unnest(['high', 'high', 'medium', 'low']) AS severity, unnest([len(regexp_extract_all(text, '(?i)\\b(curl|wget)\\b[^\\n]*\\|\\s*(ba)?sh')), len(regexp_extract_all(text, '(?i)\\brm\\s+-rf\\b')), len(regexp_extract_all(text, '(?i)https?://')), len(regexp_extract_all(text, '(?i)\\btoken\\b'))]) AS hits FROM documents) SELECT doc_id, severity, CAST(sum(hits) AS BIGINT) AS hits FROM h WHERE hits > 0 GROUP BY ALL")
def package_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "documents").select("doc_id", F.inline(texts.review_hits(F.col("text")))).filter("hits > 0")
    return hits.groupBy("doc_id", "severity").agg(F.sum("hits").alias("hits"))


@query("SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '(?s)<!--.*?-->', ' ', 'g'), '- \\[[ xX]\\] ', '', 'g'), '\\s+', ' ', 'g'))) AS cleaned_md5 FROM documents")
def clean_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without comments and check boxes, with single spaces."""
    t = F.regexp_replace(F.regexp_replace("text", r"(?s)<!--.*?-->", " "), r"- \[[ xX]\] ", "")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.trim(F.regexp_replace(t, r"\s+", " "))).alias("cleaned_md5"))
