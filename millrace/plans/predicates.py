"""Queries on lookups, filters with reasons, orders and comparisons of sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from millrace.operators import substrings
from millrace.plans.base import query
from millrace.sources.tables import table

# Words that name nothing.
STOP = ("a", "an", "the", "and", "or", "of", "in", "on", "at", "to", "for", "from", "with", "this", "that", "it", "its", "is", "are", "was", "be", "by", "as")


@query(f"""SELECT doc_id, CAST(count(*) AS BIGINT) AS words, CAST(count(*) FILTER (w NOT IN ({', '.join(repr(w) for w in STOP)})) AS BIGINT) AS content
FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) GROUP BY doc_id""")
def stop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    held = table(spark, sf_dir, "documents").select("doc_id", words.alias("w")).filter(F.size("w") > 0)
    content = F.filter("w", lambda w: ~w.isin(*STOP))
    return held.select("doc_id", F.size("w").cast("long").alias("words"), F.size(content).cast("long").alias("content"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT CAST(round(CAST(value * 100 AS DECIMAL(20,4))) AS BIGINT) FROM events)")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by keys that another table asks for, in one semi-join rather than in lists of keys."""
    asked = table(spark, sf_dir, "events").select((F.col("value") * 100).cast("decimal(20,4)").alias("v")).select(F.round("v").cast("long").alias("o_orderkey")).distinct()
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice").join(asked, "o_orderkey", "left_semi")


_VOCABULARY = "SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM documents"


@query(f"""WITH n AS ({_VOCABULARY}), p AS (SELECT DISTINCT lower(substr(w, 1, 4)) AS pattern FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS w FROM benchmark) UNION SELECT 'q' UNION SELECT '_x'),
m AS (SELECT pattern, name, row_number() OVER (PARTITION BY pattern ORDER BY length(name), name) AS place FROM p JOIN n ON contains(name, pattern))
SELECT pattern, name, CAST(place AS INTEGER) AS place FROM m WHERE place <= 40""")
def symbol_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forty shortest names that hold each of the asked texts; the number is the feature."""
    names = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))).alias("name")).distinct()
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))).alias("w"))
    asked = words.select(F.lower(F.substring("w", 1, 4)).alias("pattern")).union(spark.createDataFrame([("q",), ("_x",)], "pattern string"))
    return substrings.containing(names, "name", asked, "pattern", 40)


@query("WITH a AS (SELECT DISTINCT substr(p_name, 2, 4) AS asked FROM part) SELECT p.page_id, a.asked FROM pages p JOIN a ON contains(p.html, a.asked) WHERE a.asked <> ''")
def file_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that hold any of the texts that the names of parts have from their second character on."""
    asked = table(spark, sf_dir, "part").select(F.substring("p_name", 2, 4).alias("asked"))
    return substrings.containing(table(spark, sf_dir, "pages").select("page_id", "html"), "html", asked, "asked").select("page_id", "asked")


_FRAME = "lang || '/' || source || '/m' || (doc_id % 300) || '.py'"
_ASKED = "CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'src' || (user_id % 20) || '/' ELSE 'home/en/src' || (user_id % 20) || '/' END || 'm' || (event_id % 300) || '.py'"


@query(f"""WITH p AS (SELECT DISTINCT {_FRAME} AS path FROM documents), q AS (SELECT DISTINCT {_ASKED} AS asked FROM events),
s AS (SELECT path, array_to_string(list_slice(x, i, len(x)), '/') AS suffix FROM (SELECT path, string_split(path, '/') AS x, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM p)),
t AS (SELECT asked, array_to_string(list_slice(x, i, len(x)), '/') AS suffix, len(x) - i + 1 AS size FROM (SELECT asked, string_split(asked, '/') AS x, unnest(range(1, len(string_split(asked, '/')) + 1)) AS i FROM q)),
m AS (SELECT asked, size, path, count(*) OVER (PARTITION BY asked, size) AS n, max(size) OVER (PARTITION BY asked) AS longest FROM t JOIN s USING (suffix))
SELECT asked, path, CAST(size AS INTEGER) AS size FROM m WHERE size = longest AND n <= 3 AND (size > 1 OR n = 1)""")
def longest_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked paths and the files that end with their longest known suffix, three at most; a bare name must be the only one."""

    def suffixes(c: str) -> Column:
        parts = F.split(c, "/")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, i, F.size(parts)), "/").alias("suffix"), (F.size(parts) - i + 1).alias("size")))

    paths = table(spark, sf_dir, "documents").select(F.expr(_FRAME).alias("path")).distinct().select("path", F.inline(suffixes("path"))).drop("size")
    asked = table(spark, sf_dir, "events").select(F.expr(_ASKED).alias("asked")).distinct().select("asked", F.inline(suffixes("asked")))
    counts = paths.groupBy("suffix").agg(F.count("*").alias("n"))
    best = asked.join(counts, "suffix").groupBy("asked").agg(F.max(F.struct("size", "suffix", "n")).alias("best")).select("asked", "best.*")
    fits = best.filter("n <= 3 and (size > 1 or n = 1)")
    return fits.join(paths, "suffix").select("asked", "path", "size")


_REASON = "CASE WHEN l_quantity < 5 THEN 'too_small' WHEN l_discount > 0.08 THEN 'discounted' WHEN l_returnflag = 'R' THEN 'returned' END"


@query(f"SELECT l_orderkey, l_linenumber, {_REASON} IS NULL AS eligible, {_REASON} AS reason FROM lineitem")
def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with the first rule that keeps it out."""
    reason = F.when(F.col("l_quantity") < 5, "too_small").when(F.col("l_discount") > 0.08, "discounted").when(F.col("l_returnflag") == "R", "returned")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", reason.isNull().alias("eligible"), reason.alias("reason"))


@query("""WITH c AS (SELECT o_custkey, list_distinct(list(o_orderpriority)) AS have FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN list_contains(have, '1-URGENT') AND list_contains(have, '5-LOW') THEN 'excluded' WHEN len(list_intersect(have, ['2-HIGH', '3-MEDIUM'])) = 2 THEN 'applies' WHEN len(list_intersect(have, ['2-HIGH', '3-MEDIUM'])) = 1 THEN 'partly' ELSE 'not_applicable' END AS state FROM c""")
def applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negative rules first, then how many of the wanted traits there are. The set holds five priorities at most."""
    have = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("have"))
    wanted = F.size(F.array_intersect("have", F.array(F.lit("2-HIGH"), F.lit("3-MEDIUM"))))
    out = F.array_contains("have", "1-URGENT") & F.array_contains("have", "5-LOW")
    return have.select("o_custkey", F.when(out, "excluded").when(wanted == 2, "applies").when(wanted == 1, "partly").otherwise("not_applicable").alias("state"))


@query("SELECT c_custkey, least(n_nationkey * 100, c_custkey) AS most_bytes, (c_acctbal > 0 AND n_regionkey < 3) AS allowed FROM customer JOIN nation ON n_nationkey = c_nationkey")
def narrowed_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inner setting may only tighten the outer one: the lesser number, and both permissions."""
    met = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return met.select("c_custkey", F.least(F.col("n_nationkey") * 100, F.col("c_custkey")).alias("most_bytes"), ((F.col("c_acctbal") > 0) & (F.col("n_regionkey") < 3)).alias("allowed"))


@query("SELECT a.event_type AS one, b.event_type AS other, a.n - b.n AS difference FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1) a JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) b ON a.event_type < b.event_type")
def condition_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of conditions, each once; conditions are few and counted before they meet."""
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    held = counts.agg(F.array_sort(F.collect_list(F.struct("event_type", "n"))).alias("c"))  # a struct for each condition
    first = held.select(F.posexplode("c").alias("i", "a"), "c").select("a", F.explode(F.slice("c", F.col("i") + 2, F.size("c"))).alias("b"))
    return first.select(F.col("a.event_type").alias("one"), F.col("b.event_type").alias("other"), (F.col("a.n") - F.col("b.n")).alias("difference"))


@query("""WITH r AS (SELECT doc_id, sha256(CASE WHEN doc_id % 6 = 0 THEN 'older' ELSE coalesce(text, '') END || chr(31) || 'm1') AS key FROM documents WHERE doc_id % 2 = 0)
SELECT d.doc_id, CASE WHEN r.doc_id IS NULL THEN 'missing' WHEN r.key = sha256(coalesce(text, '') || chr(31) || 'm1') THEN 'attached' ELSE 'stale' END AS state FROM documents d LEFT JOIN r USING (doc_id)""")
def attached_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored records meet documents on a key of content and model, so that stale ones never match."""
    key = lambda t: F.sha2(F.concat(t, F.lit("\x1f"), F.lit("m1")), 256)
    docs, text = table(spark, sf_dir, "documents"), F.coalesce("text", F.lit(""))
    stored = docs.filter("doc_id % 2 = 0").select("doc_id", key(F.when(F.col("doc_id") % 6 == 0, "older").otherwise(text)).alias("stored"))
    state = F.when(F.col("stored").isNull(), "missing").when(F.col("stored") == key(text), "attached").otherwise("stale")
    return docs.join(stored, "doc_id", "left").select("doc_id", state.alias("state"))


@query("""WITH b AS (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_size > 25, p_retailprice DESC, p_partkey) AS r FROM part)
SELECT p_type, p_partkey AS best, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AS returned FROM b WHERE r = 1""")
def best_instance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best instance of each definition, then the state of what depends on it."""
    best = table(spark, sf_dir, "part").groupBy("p_type").agg(F.min_by("p_partkey", F.struct(F.col("p_size") > 25, -F.col("p_retailprice"), "p_partkey")).alias("best"))
    back = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("best")).distinct().withColumn("returned", F.lit(True))
    return best.join(back, "best", "left").select("p_type", "best", F.coalesce("returned", F.lit(False)).alias("returned"))


@query("SELECT o_custkey AS task, o_orderkey AS path, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY sha256(o_custkey || '|' || o_orderkey)) AS INTEGER) AS place FROM orders")
def hash_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order of a task's candidates that no rank shows through."""
    order = Window.partitionBy("o_custkey").orderBy(F.sha2(F.concat_ws("|", "o_custkey", "o_orderkey"), 256))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task"), F.col("o_orderkey").alias("path"), F.row_number().over(order).alias("place"))


@query("""WITH c AS (SELECT DISTINCT user_id, event_type FROM events) SELECT user_id, event_type AS condition, CAST(row_number() OVER (PARTITION BY user_id ORDER BY md5('7|' || user_id || '|' || event_type)) AS INTEGER) AS place,
CASE WHEN md5('7|' || user_id) < '8' THEN 'A' ELSE 'B' END AS first_label FROM c""")
def seeded_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded order of conditions for each family, and which of two blinded packets it sees first."""
    conditions = table(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    order = Window.partitionBy("user_id").orderBy(F.md5(F.concat_ws("|", F.lit("7"), "user_id", "event_type")))
    label = F.when(F.md5(F.concat_ws("|", F.lit("7"), "user_id")) < "8", "A").otherwise("B")
    return conditions.select("user_id", F.col("event_type").alias("condition"), F.row_number().over(order).alias("place"), label.alias("first_label"))


@query("SELECT l_orderkey, l_suppkey, min(l_linenumber) AS first_place, max(l_quantity) AS weight FROM lineitem GROUP BY 1, 2")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each name, where it stood first, with the greatest of its weights."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("first_place"), F.max("l_quantity").alias("weight"))


@query("""WITH s AS (SELECT l_orderkey, list_distinct(list(l_suppkey) FILTER (l_linenumber % 2 = 0)) AS a, list_distinct(list(l_suppkey) FILTER (l_linenumber % 2 = 1)) AS b FROM lineitem GROUP BY 1)
SELECT l_orderkey, CAST(len(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))) AS BIGINT) AS only_a, CAST(len(list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x))) AS BIGINT) AS only_b FROM s""")
def catalog_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What only one of two arms has; they are consistent where both are 0."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.bool_or(F.col("l_linenumber") % 2 == 0).alias("a"), F.bool_or(F.col("l_linenumber") % 2 == 1).alias("b"))
    only = lambda x, y: F.count(F.when(F.col(x) & ~F.col(y), 1))
    return rows.groupBy("l_orderkey").agg(only("a", "b").alias("only_a"), only("b", "a").alias("only_b"))


@query("""WITH n AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(value) FILTER (i = CAST(floor(0.9::DOUBLE * n) AS BIGINT)) AS p90 FROM n GROUP BY 1""")
def percentile_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value at place int(p * n), from 0: the second definition. Equal values are counted, so that the order is of
    distinct values and not of rows."""
    counts = table(spark, sf_dir, "events").groupBy("event_type", "value").agg(F.count("*").alias("n"))
    total = counts.groupBy("event_type").agg(F.sum("n").alias("total"))
    below = F.sum("n").over(Window.partitionBy("event_type").orderBy("value"))
    held = counts.withColumn("upto", below).join(total, "event_type")
    return held.filter(F.col("upto") > F.floor(F.lit(0.9) * F.col("total"))).groupBy("event_type").agg(F.min("value").alias("p90"))


@query("""WITH c AS (SELECT l_orderkey AS event FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) BETWEEN 2 AND 30)
SELECT l_partkey AS path, count(DISTINCT l_orderkey) AS changes, (SELECT count(*) FROM c) AS events FROM lineitem WHERE l_orderkey IN (SELECT event FROM c) GROUP BY 1""")
def event_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many eligible events there are, and how many of them change a path."""
    one = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    fit = one.groupBy("l_orderkey").agg(F.count("*").alias("n")).filter("n between 2 and 30").select("l_orderkey")
    counts = one.join(fit, "l_orderkey", "left_semi").groupBy(F.col("l_partkey").alias("path")).agg(F.count("*").alias("changes"))
    return counts.join(F.broadcast(fit.agg(F.count("*").alias("events"))), F.lit(True))  # one row


@query("""WITH d AS (SELECT user_id % 30 AS pattern, count(DISTINCT user_id) FILTER (value > 5) AS support, count(DISTINCT user_id) FILTER (event_type = 'error' AND value > 40) AS contradictions FROM events GROUP BY 1)
SELECT pattern, support, contradictions FROM d WHERE support >= 3 AND support > contradictions""")
def pattern_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns that three families or more support, and more than contradict them."""
    families = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 30).alias("pattern"), "user_id").agg(F.bool_or(F.col("value") > 5).alias("yes"), F.bool_or((F.col("event_type") == "error") & (F.col("value") > 40)).alias("no"))
    counted = families.groupBy("pattern").agg(F.count(F.when(F.col("yes"), 1)).alias("support"), F.count(F.when(F.col("no"), 1)).alias("contradictions"))
    return counted.filter("support >= 3 and support > contradictions")
