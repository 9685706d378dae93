"""Queries on what requests name, how answers meet rankings, and stored records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from millrace.functions.tokens import SECRETS
from millrace.operators import graph, index, inspection, records, scorers
from millrace.plans.base import query
from millrace.plans.retrieval import _EXPANDED
from millrace.sources.records import commit_changes
from millrace.sources.tables import table

_STOP = ", ".join(f"'{w}'" for w in inspection._PLAIN)


@query("""WITH p AS (SELECT item_id AS phrase_id, text AS phrase FROM benchmark UNION SELECT -1, 'e a' UNION SELECT -2, 'ing')
SELECT phrase_id, doc_id FROM p JOIN documents d ON contains(d.text, p.phrase) WHERE phrase <> ''""")
def phrase_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole benchmark passages and two short phrases, verbatim in documents."""
    short = spark.range(1).select(F.inline(F.expr("array(struct(-1L AS phrase_id, 'e a' AS phrase), struct(-2L AS phrase_id, 'ing' AS phrase))")))
    phrases = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("phrase_id"), F.col("text").alias("phrase")).union(short)
    return inspection.phrase_hits(table(spark, sf_dir, "documents"), "doc_id", phrases)


_MOD = "'src/' || lang || '/mod' || (doc_id % 200) || '.py'"
_NAMED = "'src/' || CASE user_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'fr' END || '/mod' || (event_id % 250) || '.py'"
_TASK = f"""CASE event_id % 6 WHEN 0 THEN 'see ' || {_NAMED} || ':' || (event_id % 90) || ' and ./' || {_NAMED} || '.'
WHEN 1 THEN 'in /work/app/' || {_NAMED} || '#L' || user_id WHEN 2 THEN 'lib/' || {_NAMED} || ' is another' WHEN 3 THEN {_NAMED} || 'x, ' || {_NAMED} || ':12345678901'
WHEN 4 THEN '(' || {_NAMED} || ')' || {_NAMED} || '.bak' ELSE 'no path: ' || event_type || '.' END"""


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.expr(_MOD).alias("path"), F.expr("lang || '.mod' || (doc_id % 200)").alias("module")).distinct()


@query(f"""WITH t AS (SELECT event_id AS task_id, {_TASK} AS text FROM events), p AS (SELECT DISTINCT {_MOD} AS path FROM documents),
f AS (SELECT path, unnest([path, './' || path, '/work/app/' || path]) AS form FROM p),
m AS (SELECT task_id, path, text, form, regexp_escape(form) AS q FROM t JOIN f ON contains(text, form)),
h AS (SELECT task_id, path, instr(text, regexp_extract(text, '(?:^|[^\\p{{L}}\\p{{N}}_./@~-])' || q || '(?:(?::|#L)[1-9][0-9]{{0,7}}(?:[^0-9]|$)|\\.(?:\\s|$)|[^\\p{{L}}\\p{{N}}_./@~-]|$)')) AS place,
regexp_extract(text, '(?:^|[^\\p{{L}}\\p{{N}}_./@~-])' || q || '(?:(?::|#L)([1-9][0-9]{{0,7}})(?:[^0-9]|$)|\\.(?:\\s|$)|[^\\p{{L}}\\p{{N}}_./@~-]|$)', 1) AS line,
regexp_matches(text, '(?:^|[^\\p{{L}}\\p{{N}}_./@~-])' || q || '(?:\\.(?:\\s|$)|[^\\p{{L}}\\p{{N}}_./@~-]|$)') AS ok FROM m)
SELECT task_id, path, arg_min(coalesce(TRY_CAST(line AS INTEGER), -1), place) AS line FROM h WHERE ok GROUP BY task_id, path""")
def explicit_path_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests that name files with and without lines (-1: none), below folders and within other names."""
    tasks = table(spark, sf_dir, "events").select(F.col("event_id").alias("task_id"), F.expr(_TASK).alias("text"))
    return inspection.explicit_paths(tasks, _paths(spark, sf_dir), "/work/app").fillna(-1, ["line"])


_SECRET = " OR ".join("regexp_matches(w, '{}')".format(p.replace("'", "''")) for p in SECRETS)


@query(f"""WITH w AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(lower(coalesce(text, '')), '[\\s,;]+'), lambda w: trim(w, '.:!?()[]{{}}"''`')), lambda w: w <> '') AS ws FROM documents),
j AS (SELECT doc_id, ws, list_filter(ws, lambda w: NOT regexp_full_match(w, '[a-z][a-z0-9+#.-]{{1,30}}') OR regexp_matches(w, '[0-9]{{5}}') OR {_SECRET}) AS odd FROM w),
g AS (SELECT doc_id, len(odd) AS dropped, list_filter(ws, lambda w: NOT list_contains(odd, w) AND w NOT IN ({_STOP}))[1:8] AS kept FROM j)
SELECT doc_id, dropped::INTEGER AS dropped, array_to_string(list_filter(kept, lambda x, i: list_position(kept, x) = i), ' ') AS terms FROM g""")
def public_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document the words that a public search may see."""
    return table(spark, sf_dir, "documents").select("doc_id", inspection.short_terms(F.col("text")).alias("t")).select("doc_id", "t.terms", "t.dropped")


@query("""WITH r AS (SELECT event_id, user_id AS session, CASE event_type WHEN 'click' THEN 'symbols' WHEN 'view' THEN 'files' WHEN 'purchase' THEN 'history' WHEN 'signup' THEN 'snippet' ELSE 'shell' END AS op, CASE WHEN event_id % 17 > 0 THEN (event_id % 40)::VARCHAR END AS value FROM events)
SELECT event_id, CASE WHEN op = 'shell' OR value IS NULL THEN 'rejected' WHEN row_number() OVER (PARTITION BY session, op, value ORDER BY event_id) = 1 THEN 'run' ELSE 'repeated' END AS state FROM r""")
def read_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests to read; errors ask for an operation that isn't registered."""
    op = F.expr("CASE event_type WHEN 'click' THEN 'symbols' WHEN 'view' THEN 'files' WHEN 'purchase' THEN 'history' WHEN 'signup' THEN 'snippet' ELSE 'shell' END")
    asked = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("session"), op.alias("op"), F.when(F.col("event_id") % 17 > 0, (F.col("event_id") % 40).cast("string")).alias("value"))
    return inspection.answered(asked, "event_id").select("event_id", "state")


@query("""SELECT l_partkey AS path, l_orderkey AS sha, CAST(row_number() OVER w AS INTEGER) AS place, n AS touched FROM (SELECT DISTINCT l_partkey, l_orderkey, o_orderdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
JOIN (SELECT l_orderkey AS k, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) ON k = l_orderkey WINDOW w AS (PARTITION BY l_partkey ORDER BY o_orderdate DESC, l_orderkey) QUALIFY place <= 15""")
def history_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen latest orders of each part, which are the commits that touched a file, and how many files each touched."""
    touched = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("path"), F.col("l_orderkey").alias("sha")).distinct()
    dates = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sha"), "o_orderdate")
    latest = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("o_orderdate"), "sha"))
    sizes = touched.groupBy("sha").agg(F.count("*").alias("touched"))
    return touched.join(dates, "sha").withColumn("place", latest).filter("place <= 15").join(sizes, "sha").select("path", "sha", "place", "touched")


_TARGET = f"""CASE event_id % 5 WHEN 0 THEN '`' || {_NAMED} || '`' WHEN 1 THEN './mod' || (event_id % 250) || '.py' WHEN 2 THEN 'de.mod' || (event_id % 250) WHEN 3 THEN 'Job.f' || (event_id % 250) ELSE 'f' || (event_id % 250) END"""
_RESOLVED = f"""p AS (SELECT DISTINCT {_MOD} AS path, lang || '.mod' || (doc_id % 200) AS module FROM documents), d AS (SELECT DISTINCT 'f' || (doc_id % 230) AS name, {_MOD} AS path FROM documents WHERE doc_id % 3 = 0),
t AS (SELECT DISTINCT {_TARGET} AS target, regexp_replace(trim({_TARGET}, '`''"() '), '^\\./', '') AS spec FROM events),
tails AS (SELECT spec, min(path) AS a FROM (SELECT DISTINCT path, unnest(list_transform(range(1, len(string_split(path, '/')) + 1), lambda i: array_to_string(string_split(path, '/')[i:], '/'))) AS spec FROM p) GROUP BY spec HAVING count(*) = 1),
whole AS (SELECT module AS spec, min(path) AS b FROM p GROUP BY module), ends AS (SELECT spec, min(path) AS c FROM (SELECT DISTINCT path, unnest(list_transform(range(1, len(string_split(module, '.')) + 1), lambda i: array_to_string(string_split(module, '.')[i:], '.'))) AS spec FROM p) GROUP BY spec HAVING count(*) = 1),
one AS (SELECT name, min(path) AS e FROM d GROUP BY name HAVING count(DISTINCT path) = 1),
resolved AS (SELECT target, coalesce(a, b, c, e) AS path, CASE WHEN a IS NOT NULL THEN 'path' WHEN coalesce(b, c) IS NOT NULL THEN 'module' ELSE 'definition' END AS how
FROM t LEFT JOIN tails USING (spec) LEFT JOIN whole USING (spec) LEFT JOIN ends USING (spec) LEFT JOIN one ON name = string_split(spec, '.')[-1] WHERE coalesce(a, b, c, e) IS NOT NULL)"""


def _definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("doc_id % 3 = 0").select(F.expr("'f' || (doc_id % 230)").alias("name"), F.expr(_MOD).alias("path")).distinct()


@query(f"WITH {_RESOLVED} SELECT target, path, how FROM resolved")
def interaction_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "events").select(F.expr(_TARGET).alias("target"))
    return inspection.resolved_targets(asked, _paths(spark, sf_dir), _definitions(spark, sf_dir))


_RELATION = "CASE event_type WHEN 'error' THEN ' ' ELSE event_type END"


@query(f"""WITH {_RESOLVED}, c AS (SELECT {_NAMED} AS path, event_id AS place, {_TARGET} AS target, {_RELATION} AS relationship FROM events),
e AS (SELECT DISTINCT 'src/en/mod' || (user_id % 200) || '.py' AS a, {_NAMED} AS b FROM events), two AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
g AS (SELECT c.path, r.path AS target, relationship, row_number() OVER (PARTITION BY c.path ORDER BY c.place) AS place FROM c JOIN resolved r ON r.target = c.target WHERE trim(relationship) <> '' AND r.path <> c.path)
SELECT g.path, g.target, relationship, place::INTEGER AS place, two.a IS NOT NULL AS verified FROM g LEFT JOIN two ON two.a = g.path AND two.b = g.target WHERE place <= 6""")
def interaction_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as claims that one file works with another; errors don't say how."""
    events = table(spark, sf_dir, "events")
    claims = events.select(F.expr(_NAMED).alias("path"), F.col("event_id").alias("place"), F.expr(_TARGET).alias("target"), F.expr(_RELATION).alias("relationship"))
    edges = events.select(F.expr("'src/en/mod' || (user_id % 200) || '.py'").alias("a"), F.expr(_NAMED).alias("b")).distinct()
    return inspection.checked_interactions(claims, _paths(spark, sf_dir), _definitions(spark, sf_dir), edges)


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS path, 'f' || (l_partkey % 50) AS name FROM lineitem), k AS (SELECT DISTINCT l_orderkey AS path, 'f' || (l_suppkey % 50) AS name FROM lineitem)
SELECT c.path, count(k.name) AS kept, count(*) - count(k.name) AS dropped FROM c LEFT JOIN k ON k.path = c.path AND k.name = c.name GROUP BY c.path""")
def symbol_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of an order as symbols that a text claims, suppliers as those the file has."""
    lines = table(spark, sf_dir, "lineitem")
    claims = lines.select(F.col("l_orderkey").alias("path"), F.expr("'Job.f' || (l_partkey % 50) || '()'").alias("symbol"))
    return inspection.known_symbols(claims, lines.select(F.col("l_orderkey").alias("path"), F.expr("'f' || (l_suppkey % 50)").alias("name")))


@query("""WITH f AS (SELECT user_id AS query_id, event_id AS fact_id, 'f' || (event_id % 40) AS path, event_type AS kind, event_id % 40 % 17 = 0 AS named, CASE WHEN event_id % 40 < 25 THEN event_id % 40 END AS rank, floor(value)::BIGINT % 4 AS overlap FROM events),
s AS (SELECT *, kind = 'error' AND row_number() OVER (PARTITION BY query_id ORDER BY kind = 'error' DESC, fact_id) <= 2 AS pinned FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY named DESC, pinned DESC, rank NULLS LAST, overlap DESC, fact_id) AS nth FROM s WHERE named OR pinned OR overlap > 0 OR rank < 12)
SELECT query_id, fact_id, path, CAST(row_number() OVER (PARTITION BY query_id ORDER BY named DESC, pinned DESC, rank NULLS LAST, overlap DESC, fact_id) AS INTEGER) AS place FROM o WHERE named OR nth = 1""")
def fact_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as facts of files, which a user's request sees; errors are the pinned kind."""
    file = F.col("event_id") % 40
    facts = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("fact_id"), F.concat(F.lit("f"), file.cast("string")).alias("path"), F.col("event_type").alias("kind"), (file % 17 == 0).alias("named"), F.when(file < 25, file).alias("rank"), (F.floor("value") % 4).alias("overlap"))
    return inspection.fact_view(facts, "error")


_RANKED = "ranked AS (SELECT lang AS query_id, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank, doc_id % 13 = 0 AS pinned FROM documents QUALIFY rank <= 60)"
_OUTSIDE = "said AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY first_at, doc_id) AS pos FROM (SELECT lang AS query_id, l.doc_id, min(-l.doc_id) AS first_at FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY ALL) JOIN ranked USING (query_id, doc_id))"


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n_chars"), "doc_id"))
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("query_id"), "doc_id", "n_chars")
    return docs.withColumn("rank", rank).filter("rank <= 60").withColumn("pinned", F.col("doc_id") % 13 == 0).drop("n_chars")


def _outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("query_id")), "doc_id")
    return known.select("query_id", "doc_id", (-F.col("doc_id")).alias("at"))


@query(f"""WITH {_RANKED}, {_OUTSIDE} SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pinned DESC, CASE WHEN NOT pinned THEN pos END NULLS LAST, rank) AS INTEGER) AS place FROM ranked LEFT JOIN said USING (query_id, doc_id)""")
def reranker_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixty longest documents of a language, reordered by labelled ones, the last first."""
    return inspection.integrated(_ranked(spark, sf_dir), _outside(spark, sf_dir), "doc_id", "replace")


@query(f"""WITH {_RANKED}, {_OUTSIDE} SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pinned DESC, round(1.0::DOUBLE / (20 + rank) + coalesce(0.7::DOUBLE / (20 + pos), 0), 9) DESC, rank) AS INTEGER) AS place FROM ranked LEFT JOIN said USING (query_id, doc_id)""")
def reranker_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspection.integrated(_ranked(spark, sf_dir), _outside(spark, sf_dir), "doc_id", "weighted", weight=0.7)


_FOUND = """req AS (SELECT DISTINCT o_custkey AS query_id, 1 + o_orderkey % 4 AS position, o_orderkey % 30 AS value FROM orders), src AS (SELECT DISTINCT p_size AS value, p_partkey AS path FROM part),
hit AS (SELECT query_id, position, path, row_number() OVER (PARTITION BY query_id, position ORDER BY path) AS nth FROM req JOIN src USING (value)),
tot AS (SELECT query_id, path, round(sum(1.0::DOUBLE / position), 9) AS score FROM hit WHERE nth <= 6 GROUP BY ALL),
found AS (SELECT * FROM tot QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) <= 6)"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    asked = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), (1 + key % 4).alias("position"), F.lit("symbol").alias("type"), (key % 30).alias("value")).distinct()
    return inspection.answers(asked, table(spark, sf_dir, "part").select(F.lit("symbol").alias("type"), F.col("p_size").alias("value"), F.col("p_partkey").alias("path")), 6)


@query(f"WITH {_FOUND} SELECT query_id, path, score FROM found")
def explorer_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests of a customer; parts of a size are what a request finds."""
    return _found(spark, sf_dir)


@query(f"""WITH {_FOUND}, r AS (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, path) AS rank FROM (SELECT o_custkey AS query_id, l_partkey AS path, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) QUALIFY rank <= 20),
m AS (SELECT query_id, path, rank, score, score IS NOT NULL AND coalesce(rank, 99) > 8 AS added FROM r FULL JOIN found USING (query_id, path)),
k AS (SELECT *, CASE WHEN added THEN 1 WHEN sum(CASE WHEN added THEN 0 ELSE 1 END) OVER (PARTITION BY query_id ORDER BY rank NULLS LAST, score DESC, path ROWS UNBOUNDED PRECEDING) <= 5 THEN 0 ELSE 2 END AS band FROM m)
SELECT query_id, path, CAST(row_number() OVER (PARTITION BY query_id ORDER BY band, CASE WHEN added THEN -score ELSE rank END, path) AS INTEGER) AS place, added FROM k""")
def explorer_inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the explorer finds goes below the first five of a customer's twenty most ordered parts, eight of which were shown."""
    bought = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("query_id"), F.col("l_partkey").alias("path")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "path"))
    return inspection.inserted(bought.withColumn("rank", rank).filter("rank <= 20").drop("n"), _found(spark, sf_dir), 5, 8)


_SOURCE = "CASE l_returnflag WHEN 'A' THEN 'bm25' WHEN 'N' THEN 'symbol_definitions' ELSE NULL END"


@query(f"""WITH f AS (SELECT l_orderkey AS query_id, bool_or(l_linestatus = 'F' AND l_linenumber = 1) AS named, coalesce(min(l_suppkey) FILTER (l_returnflag = 'N'), 999) AS symbol, coalesce(min(l_suppkey) FILTER (l_returnflag = 'A'), 999) AS lexical, count(DISTINCT l_partkey) AS t, count(DISTINCT l_partkey % 10) AS d FROM lineitem GROUP BY 1)
SELECT query_id, unnest(list_filter([CASE WHEN named THEN 'explicit path' END, CASE WHEN symbol <= 3 THEN 'explicit symbol' END, CASE WHEN lexical <= 10 THEN 'strong lexical' ELSE 'weak lexical' END, CASE WHEN t > 1 THEN 'cross-file' END, CASE WHEN d > 1 THEN 'multi-directory targets' END], lambda x: x IS NOT NULL)) AS trait FROM f""")
def task_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks, their parts as targets, suppliers' numbers as ranks."""
    lines = table(spark, sf_dir, "lineitem")
    named = (F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 1)
    return inspection.traits(lines.select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("target"), (F.col("l_partkey") % 10).alias("folder"), F.expr(_SOURCE).alias("source"), F.col("l_suppkey").alias("rank"), named.alias("named")))


@query("""WITH w AS (SELECT DISTINCT doc_id FROM labels UNION SELECT DISTINCT event_id + 500 FROM events WHERE event_id % 7 = 0)
SELECT w.doc_id, CASE WHEN d.n_chars IS NULL THEN 'missing' WHEN d.n_chars > 4000 THEN 'too large' ELSE 'read' END AS state, CASE WHEN d.n_chars <= 4000 THEN md5(d.text) END AS digest FROM w LEFT JOIN documents d ON d.doc_id = w.doc_id""")
def blobs_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents and some that aren't there, read where they have at most 4000 characters."""
    asked = table(spark, sf_dir, "labels").select("doc_id").union(table(spark, sf_dir, "events").filter("event_id % 7 = 0").select(F.col("event_id") + 500))
    got = records.fetched(asked, table(spark, sf_dir, "documents"), "doc_id", "n_chars", 4000)
    return got.select("doc_id", "state", F.md5("text").alias("digest"))


@query("""SELECT o_orderkey, o_orderstatus AS facts, 'scan' AS origin FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'old ' || o_orderstatus, 'stored' FROM orders WHERE o_orderkey % 3 > 0 AND o_orderkey % 2 = 0 AND o_orderkey % 7 > 0""")
def universe_of_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the orders was scanned, even ones were stored before, every seventh has changed since."""
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    signed = F.col("o_custkey") + F.when(key % 7 == 0, 1).otherwise(0)
    stored = orders.filter(key % 2 == 0).select("o_orderkey", F.concat(F.lit("old "), "o_orderstatus").alias("facts"), F.col("o_custkey").alias("signature"))
    scanned = orders.filter(key % 3 == 0).select("o_orderkey", F.col("o_orderstatus").alias("facts"), signed.alias("signature"))
    return records.universe(scanned, stored, orders.select("o_orderkey", signed.alias("signature")), "o_orderkey").drop("signature")


_ARM = "CASE event_id % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'old' ELSE 'spare' END"
_STATUS = "CASE WHEN value < 2 THEN 'infrastructure_error' WHEN value > 90 THEN 'invalid_configuration' ELSE 'done' END"
_SUCCESS = "CASE WHEN event_id % 11 > 0 THEN value > 30 END"


@query(f"""WITH t AS (SELECT *, event_id // 3 % 5 AS rep, {_ARM} AS arm, {_STATUS} AS status, {_SUCCESS} AS success FROM events),
p AS (SELECT event_type AS client, user_id AS fixture, rep AS repetition, arg_max(struct_pack(s := success, c := value), event_id) FILTER (arm = 'new') AS c, arg_max(struct_pack(s := success, c := value), event_id) FILTER (arm = 'old') AS i FROM t WHERE status = 'done' AND arm <> 'spare' GROUP BY ALL)
SELECT client, fixture, repetition, c.s AS candidate, i.s AS incumbent, c.c AS candidate_cost, i.c AS incumbent_cost FROM p WHERE c.s IS NOT NULL AND i.s IS NOT NULL""")
def batch_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trials of two arms and a third that isn't compared."""
    got = table(spark, sf_dir, "events").select(F.col("event_type").alias("client"), F.col("user_id").alias("fixture"), (F.floor(F.col("event_id") / 3) % 5).alias("repetition"), F.expr(_ARM).alias("arm"), F.expr(_STATUS).alias("status"), F.expr(_SUCCESS).alias("success"), F.col("value").alias("cost"), "event_id")
    return records.paired_trials(got, "event_id", "new", "old")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_orderkey = o_orderkey AND s_acctbal < 0)")
def forget_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that rest on no supplier in debt."""
    cited = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    debt = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return records.not_citing(table(spark, sf_dir, "orders").select("o_orderkey"), cited, "o_orderkey", debt, "l_suppkey")


@query("""WITH few AS (SELECT o_orderkey * 2 AS o_orderkey, -o_custkey AS o_custkey FROM orders WHERE o_orderkey % 3 = 0 ORDER BY 1 LIMIT 500)
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM few) UNION ALL SELECT * FROM few""")
def upkeep_after_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 500 records that a query computed are put into the stored ones."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    made = orders.filter("o_orderkey % 3 = 0").select((F.col("o_orderkey") * 2).alias("o_orderkey"), (-F.col("o_custkey")).alias("o_custkey"))
    return records.maintained(orders, made, "o_orderkey", 500)


@query(f"""WITH c AS (SELECT key, w, count(*) AS n FROM (SELECT doc_id AS key, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{1,79}}')) AS w FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)) GROUP BY 1, 2), {_EXPANDED.format('c')},
post AS (SELECT terms.key AS doc_id, t AS term, sum(c.n) AS tf FROM terms JOIN c ON c.key = terms.key AND c.w = terms.id GROUP BY 1, 2),
st AS (SELECT doc_id, sum(tf) AS len FROM post GROUP BY 1), co AS (SELECT count(*) AS nd, avg(len) AS al FROM st), df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
q AS (SELECT DISTINCT item_id AS query_id, term, CASE WHEN length(term) >= 9 THEN 3.0 ELSE 1.0 END::DOUBLE AS w FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]{{2,79}}')) AS term FROM benchmark) WHERE length(term) >= 6),
f AS (SELECT query_id, doc_id, round(sum(w * ln(1 + (nd - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / al))), 4) AS score, count(*) FILTER (w >= 3) AS identifier_support, count(*) FILTER (w < 3) AS concept_matches FROM q JOIN post USING (term) JOIN df USING (term) JOIN st USING (doc_id), co GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, max(score) OVER (PARTITION BY query_id) AS best FROM f WHERE score > 0)
SELECT query_id, doc_id, score, rank::INTEGER AS rank, identifier_support, concept_matches, (identifier_support = 0 AND concept_matches < 2) OR (rank > 1 AND score < best * 0.25) AS weak FROM r WHERE rank <= 8""")
def semantic_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as texts of modules, those of low quality withdrawn; benchmark passages ask."""
    low = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id", F.lit("withdrawn").alias("status")).distinct()
    modules = table(spark, sf_dir, "documents").select("doc_id", "text").join(low, "doc_id", "left").withColumn("status", F.coalesce("status", F.lit("current")))
    asked = index.terms_of(table(spark, sf_dir, "benchmark"), "item_id", "text").filter(F.length("term") >= 6).distinct()
    weighted = asked.select(F.col("item_id").alias("query_id"), "term", F.when(F.length("term") >= 9, 3.0).otherwise(1.0).alias("w"))
    return scorers.module_search(weighted, modules, "doc_id")


_LINK = "CASE l_returnflag WHEN 'A' THEN 'calls' WHEN 'N' THEN 'imports' ELSE 'references' END"


@query(f"""WITH RECURSIVE n AS (SELECT 'p' || p_partkey AS node, 'f' || (p_partkey % 40) AS path FROM part QUALIFY row_number() OVER (ORDER BY p_size, 'p' || p_partkey) <= 300),
e AS (SELECT DISTINCT 'p' || l_partkey AS a, 'p' || (l_suppkey * 7 % 2000 + 1) AS b, {_LINK} AS kind, l_linestatus = 'O' AS resolved, 'g' || (l_partkey % 30) AS path FROM lineitem WHERE 'p' || l_partkey IN (SELECT node FROM n) AND 'p' || (l_suppkey * 7 % 2000 + 1) IN (SELECT node FROM n)),
s AS (SELECT node FROM n WHERE substr(node, 2)::BIGINT % 10 = 1), k AS (SELECT DISTINCT a, b FROM e WHERE resolved AND kind IN ('calls', 'imports')),
dn AS (SELECT node FROM s UNION SELECT k.b FROM dn JOIN k ON k.a = dn.node), up AS (SELECT node FROM s UNION SELECT k.a FROM up JOIN k ON k.b = up.node)
SELECT 'node' AS role, node AS id FROM n UNION ALL SELECT DISTINCT 'edge', a || '>' || b FROM e UNION ALL SELECT 'seed', node FROM s UNION ALL SELECT 'downstream', node FROM dn WHERE node NOT IN (SELECT node FROM s)
UNION ALL SELECT 'upstream', node FROM up WHERE node NOT IN (SELECT node FROM s) UNION ALL SELECT DISTINCT 'source', path FROM (SELECT path FROM n UNION SELECT path FROM e)""")
def pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as nodes, of which the first 300 by size stay; line items are the edges."""
    nodes = table(spark, sf_dir, "part").select(F.expr("'p' || p_partkey").alias("node"), F.expr("'f' || (p_partkey % 40)").alias("path"), F.col("p_size").alias("place"))
    edges = table(spark, sf_dir, "lineitem").select(F.expr("'p' || l_partkey").alias("a"), F.expr("'p' || (l_suppkey * 7 % 2000 + 1)").alias("b"), F.expr(_LINK).alias("kind"), (F.col("l_linestatus") == "O").alias("resolved"), F.expr("'g' || (l_partkey % 30)").alias("path")).distinct()
    seeds = table(spark, sf_dir, "part").filter("p_partkey % 10 = 1").select(F.expr("'p' || p_partkey").alias("node"))
    return graph.pruned(nodes, edges, seeds, 300)


_OLD = """SELECT 'c' || event_id AS id, CASE event_id % 3 WHEN 0 THEN 'skills' WHEN 1 THEN 'mcps' ELSE 'tools' END AS list, CASE WHEN event_id % 2 = 0 THEN 'v' || user_id END AS server,
CASE event_type WHEN 'click' THEN 'exposed' WHEN 'view' THEN 'verified' WHEN 'purchase' THEN 'missing' WHEN 'signup' THEN 'auth_required' ELSE CASE WHEN event_id % 4 < 2 THEN 'disabled' ELSE 'blocked' END END AS status FROM events"""


def _old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_OLD.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


@query(f"""WITH o AS ({_OLD}) SELECT id, CASE WHEN list = 'skills' THEN 'skill' WHEN list = 'mcps' THEN 'mcp_server' WHEN server IS NULL THEN 'native_tool' ELSE 'mcp_tool' END AS kind, server,
CASE WHEN status IN ('exposed', 'verified') THEN 'callable' WHEN status = 'missing' THEN 'not_exposed' ELSE 'unknown' END AS exposure, CASE WHEN status IN ('disabled', 'blocked') THEN status END AS policy,
CASE status WHEN 'verified' THEN 'OK' WHEN 'auth_required' THEN 'AUTHENTICATION_REQUIRED' WHEN 'missing' THEN 'SERVICE_UNAVAILABLE' END AS reason FROM o""")
def snapshot_upgraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows of the first layout."""
    return records.upgraded(_old(spark, sf_dir)).select("*", "observation.reason").drop("observation")


@query("""WITH b AS (SELECT user_id AS id, bool_or(event_type = 'view') AS good, bool_or(event_type = 'signup' AND value > 80) AS auth, bool_or(event_type = 'error' AND value > 40) AS gone FROM events GROUP BY 1),
c AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'skill' WHEN 1 THEN 'mcp_server' WHEN 2 THEN 'mcp_tool' WHEN 3 THEN 'native_tool' ELSE 'plugin' END AS kind, CASE WHEN c_acctbal < -500 THEN 'disabled' WHEN c_acctbal < 0 THEN 'quarantined' END AS policy, c_custkey % 2 = 0 AS callable FROM customer)
SELECT CASE kind WHEN 'skill' THEN 'skills' WHEN 'mcp_server' THEN 'mcps' ELSE 'tools' END AS list, id, CASE WHEN policy = 'disabled' THEN 'disabled' WHEN policy IS NOT NULL THEN 'blocked' WHEN auth THEN 'auth_required' WHEN gone AND NOT good THEN 'missing' WHEN good THEN 'verified' WHEN callable THEN 'exposed' ELSE 'unknown' END AS status
FROM c LEFT JOIN b USING (id) WHERE kind <> 'plugin'""")
def snapshot_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as capabilities, events of the user of the same number as what was observed."""
    type_ = F.when(F.col("event_type") == "view", "tool_enumeration").when(F.col("event_type") == "error", "host_exposure").otherwise("other")
    reason = F.when((F.col("event_type") == "signup") & (F.col("value") > 80), "AUTHENTICATION_REQUIRED").when((F.col("event_type") == "error") & (F.col("value") > 40), "SERVICE_UNAVAILABLE")
    seen = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), type_.alias("type"), F.when(F.col("event_type") == "view", "success").otherwise("failure").alias("outcome"), reason.alias("reason"))
    kind = F.expr("CASE c_custkey % 5 WHEN 0 THEN 'skill' WHEN 1 THEN 'mcp_server' WHEN 2 THEN 'mcp_tool' WHEN 3 THEN 'native_tool' ELSE 'plugin' END")
    policy = F.when(F.col("c_acctbal") < -500, "disabled").when(F.col("c_acctbal") < 0, "quarantined")
    return records.projected(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), kind.alias("kind"), policy.alias("policy"), F.when(F.col("c_custkey") % 2 == 0, "callable").alias("exposure")), seen)


_BLOCK = f"""'c' || event_id || chr(2) || CASE WHEN event_id % 29 = 0 THEN 'never' ELSE CAST(1700000000 + event_id AS STRING) END || chr(2) || 'change ' || event_type || chr(10) || chr(10) || 'M' || chr(9) || {_NAMED} || chr(10) ||
CASE event_id % 4 WHEN 0 THEN 'R0' || (50 + user_id % 50) || chr(9) || 'old/' || user_id || '.py' || chr(9) || {_NAMED} WHEN 1 THEN 'A' || chr(9) || 'src/en/mod' || (user_id % 200) || '.py' WHEN 2 THEN 'D' || chr(9) || 'no/such.py' ELSE 'C100' || chr(9) || 'src/de/mod' || (user_id % 200) || '.py' || chr(9) || 'src/en/mod' || (user_id % 190) || '.py' END || chr(10) || 'M' || chr(9) || 'src/fr/mod' || (event_id % 7) || '.py'"""


@query(f"""WITH b AS (SELECT {_BLOCK} AS block FROM events), p AS (SELECT DISTINCT {_MOD} AS path FROM documents),
h AS (SELECT block, string_split(string_split(block, chr(10))[1], chr(2)) AS h FROM b), r AS (SELECT h[1] AS sha, TRY_CAST(h[2] AS BIGINT) AS stamp, h[3] AS subject, block FROM h WHERE TRY_CAST(h[2] AS BIGINT) IS NOT NULL),
f AS (SELECT sha, string_split(unnest(string_split(block, chr(10))[2:]), chr(9)) AS f FROM r), t AS (SELECT DISTINCT sha, path FROM (SELECT sha, unnest(f[2:]) AS path FROM f WHERE len(f) > 1) JOIN p USING (path)),
s AS (SELECT sha, count(*) AS touched, list(path ORDER BY path)[1:2] AS paths FROM t GROUP BY sha), m AS (SELECT sha, string_agg(f[2] || '>' || f[3] || ':' || TRY_CAST(f[1][2:] AS INTEGER), ',') AS renames FROM f JOIN p ON p.path = f[3] WHERE len(f) = 3 GROUP BY sha)
SELECT sha, stamp, subject, coalesce(touched, 0) AS touched, coalesce(touched, 0) > 2 AS capped, coalesce(array_to_string(paths, ','), '') AS paths, coalesce(renames, '') AS renames FROM r LEFT JOIN s USING (sha) LEFT JOIN m USING (sha)""")
def commit_changes_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as blocks of a log, some without a time; two paths of a commit are kept."""
    got = commit_changes(table(spark, sf_dir, "events").select(F.expr(_BLOCK).alias("block")), _paths(spark, sf_dir), 2)
    shown = F.transform("renames", lambda r: F.concat(r["old"], F.lit(">"), r["new"], F.lit(":"), r["score"].cast("string")))
    return got.select("sha", "stamp", "subject", "touched", "capped", F.array_join("paths", ",").alias("paths"), F.array_join(shown, ",").alias("renames"))
