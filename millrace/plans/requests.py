"""Queries on requests, stack frames, commit logs, lines of JSON, strategies, choices and workflows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions import requests
from millrace.operators import choices, statistics, strategies
from millrace.plans.base import query
from millrace.plans.retrieval import _LISTS, _asked, _rank, _stored
from millrace.sources import records
from millrace.sources.tables import table, written

# Wording that asks about the past, and about what else a change touches.
HISTORY = r"(?i)\b(?:before|previously|earlier|again|regress(?:ion|ed|es)?|used to|last time|we fixed|once more)\b"
IMPACT = r"(?i)\b(?:affects?|affected|impact|ripple|depends? on|dependents?|callers?|downstream|consumers?)\b"


@query()
def request_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user's turn names and asks for, and the plan's profile. Look-behinds and folds are beyond the SQL here;
    tests hold it against a loop."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")
    return requests.planned(requests.analysed(turns, "text"), "text", HISTORY, IMPACT).drop("text")


@query("""SELECT o_orderkey, 'srv/app/' || o_orderpriority || '.py' AS path, o_custkey AS line, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'run' END AS function, 'python' AS kind, true AS innermost FROM orders
UNION ALL SELECT o_orderkey, 'web/part' || o_custkey || '.ts', o_orderkey, 'go', 'script', false FROM orders WHERE o_orderkey % 2 = 0""")
def stack_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames of an error's text, which is made from each order."""
    function = F.when(F.col("o_orderkey") % 3 == 0, "<module>").otherwise("App.run")
    python = F.format_string('Error\n  File "/srv/app/%s.py", line %d, in %s\n', "o_orderpriority", "o_custkey", function)
    script = F.when(F.col("o_orderkey") % 2 == 0, F.format_string("  at Page.go (C:\\web\\.\\part%d.ts:%d:7)\n", "o_custkey", "o_orderkey")).otherwise(F.lit("done"))
    held = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(requests.frames(F.concat(script, python))).alias("f"))
    return held.select("o_orderkey", "f.*")


@query("""SELECT o_orderkey AS stamp, list_sort(list_distinct(list('part/' || l_partkey))) AS paths FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
WHERE p_size <= 25 GROUP BY o_orderkey HAVING count(DISTINCT l_partkey) BETWEEN 2 AND 4""")
def commit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the blocks of a log, their parts as paths; only parts up to size 25 are in the universe."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("part/"), "l_partkey"))), "\n").alias("lines"))  # seven lines at most
    blocks = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.concat("o_orderkey", F.lit("\n\n"), "lines").alias("block"))
    universe = table(spark, sf_dir, "part").filter("p_size <= 25").select(F.concat(F.lit("part/"), "p_partkey").alias("path"))
    return records.commit_paths(blocks, universe, 4)


_CHANGE = "l_orderkey AS id, 'p' || l_partkey || '.py' AS path, CASE l_returnflag WHEN 'N' THEN 'M' WHEN 'A' THEN 'A' ELSE 'D' END AS status, l_partkey % 10 < 8 AS is_source, l_partkey % 4 = 0 AS is_test"


@query(f"""WITH c AS (SELECT {_CHANGE} FROM lineitem), s AS (SELECT * FROM c WHERE is_source)
SELECT id, list_sort(list_distinct(coalesce(list(path) FILTER (status = 'M' AND NOT is_test), []))) AS targets, list_sort(list_distinct(coalesce(list(path) FILTER (status = 'M' AND is_test), []))) AS tests,
list_sort(list_distinct(coalesce(list(path) FILTER (status = 'A'), []))) AS added FROM s GROUP BY id HAVING len(targets) BETWEEN 1 AND 3""")
def commit_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits and their parts as changed files."""
    status = F.when(F.col("l_returnflag") == "N", "M").when(F.col("l_returnflag") == "A", "A").otherwise("D")
    part = F.col("l_partkey")
    changes = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.lit("request").alias("request"), F.concat(F.lit("p"), part, F.lit(".py")).alias("path"),
        status.alias("status"), (part % 10 < 8).alias("is_source"), (part % 4 == 0).alias("is_test"))
    return records.tasks_from_changes(changes, 3).drop("request")


@query("SELECT CASE WHEN turn % 5 <> 3 THEN conv_id END AS conv_id, CASE WHEN turn % 5 <> 3 THEN turn END AS turn, CASE WHEN turn % 5 <> 3 THEN role END AS role, turn % 5 = 3 AS partial FROM conversations")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as lines of JSON, of which every fifth is cut off: it stays as a row of its own."""
    end = F.when(F.col("turn") % 5 == 3, "").otherwise("}")
    line = F.format_string('{"conv_id": %d, "turn": %d, "role": "%s"%s', "conv_id", "turn", "role", end)
    types = dict(table(spark, sf_dir, "conversations").dtypes)
    return records.parsed_lines(table(spark, sf_dir, "conversations").select(line.alias("line")), "line", f"conv_id {types['conv_id']}, turn {types['turn']}, role string")


@query("SELECT user_id, round(1 - min(pos) / max(total)::DOUBLE, 9) AS recency FROM (SELECT user_id, row_number() OVER (ORDER BY event_id DESC) - 1 AS pos, count(*) OVER () AS total FROM events) GROUP BY user_id")
def recency_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One less the place of a user's newest event among all, newest first, as a share."""
    events = table(spark, sf_dir, "events").select("user_id", (-F.col("event_id")).alias("k"))
    total = events.agg(F.count("*").alias("total"))  # one row
    first = statistics.numbered(events, "k").groupBy("user_id").agg(F.min("i").alias("pos"))
    return first.join(F.broadcast(total), F.lit(True)).select("user_id", F.round(1 - F.col("pos") / F.col("total"), 9).alias("recency"))


_WORDS = ("license", "email", "contact", "password")
_EXACT, _NAMED = "contains(coalesce(text, ''), 'MIT License')", "source IN ('code', 'forum')"
_FOUND = "(" + " + ".join(f"regexp_matches(lower(coalesce(text, '')), '(^|[^a-z0-9_]){w}([^a-z0-9_]|$)')::INTEGER" for w in _WORDS) + ")"


@query(f"""WITH f AS (SELECT doc_id, {_EXACT} AS exact, coalesce({_NAMED}, false) AS named, {_FOUND} AS found, doc_id % 7 = 0 AS config, coalesce(lang = 'en', false) AS fits, doc_id % 11 = 0 AS rules FROM documents),
s AS (SELECT *, 3 * exact::INTEGER + 2 * named::INTEGER AS sure FROM f), b AS (SELECT *, sure + CASE WHEN found >= 2 THEN 2 WHEN found = 1 AND sure = 0 THEN 1 ELSE 0 END AS base FROM s)
SELECT * FROM (SELECT doc_id, CASE WHEN base > 0 THEN base + config::INTEGER + fits::INTEGER WHEN rules THEN 1 END AS score FROM b) WHERE score IS NOT NULL""")
def additive_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    low = F.lower(text)
    # The pattern is tried only where the word stands at all.
    found = sum((F.when(F.contains(low, F.lit(w)), low.rlike(f"(^|[^a-z0-9_]){w}([^a-z0-9_]|$)").cast("int")).otherwise(0) for w in _WORDS), F.lit(0))
    kind = F.when(F.col("doc_id") % 7 == 0, "config").otherwise("source")
    no = lambda c: F.coalesce(c, F.lit(False))
    score = choices.additive(text.contains("MIT License"), no(F.col("source").isin("code", "forum")), found, kind, no(F.col("lang") == "en"), F.col("doc_id") % 11 == 0)
    return table(spark, sf_dir, "documents").select("doc_id", score.alias("score")).filter("score is not null")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, c_nationkey % 2 AS rd, s_nationkey % 2 AS cd, c_nationkey % 3 AS renv, s_nationkey % 3 AS cenv, c_nationkey AS pres, s_nationkey AS cres, l_suppkey % 4 AS sens, l_partkey % 2 AS psens
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey)
SELECT l_orderkey, l_linenumber, CASE WHEN rd <> cd OR (renv <> 0 AND renv <> cenv) THEN 'operation' WHEN pres % 5 = 0 AND pres <> cres THEN 'resource' WHEN psens <> 0 AND psens <> sens THEN 'sensitivity' WHEN cenv = 0 THEN 'environment not established' END AS reason FROM r""")
def operation_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a line's supplier could stand in for what its customer asks for, with the first reason against it."""
    read = lambda name: table(spark, sf_dir, name)
    met = read("lineitem").join(read("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(read("customer"), F.col("c_custkey") == F.col("o_custkey")).join(read("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    place = lambda n: F.when(n % 3 == 0, "unknown").otherwise((n % 3).cast("string"))
    none = F.lit(None).cast("long")

    def side(nation, resource, sensitivity):
        return F.struct((nation % 2).alias("domain"), F.lit("read").alias("access"), place(nation).alias("environment"), resource.alias("resource"), none.alias("identity"), sensitivity.alias("sensitivity"))

    c, s = F.col("c_nationkey"), F.col("s_nationkey")
    level = F.when(F.col("l_partkey") % 2 == 0, "unknown").otherwise("1")
    named = met.select("l_orderkey", "l_linenumber", side(s, s, (F.col("l_suppkey") % 4).cast("string")).alias("candidate"), side(c, F.when(c % 5 == 0, c), level).alias("preferred"), side(c, none, level).alias("required"))
    return named.select("l_orderkey", "l_linenumber", choices.difference("candidate", "preferred", "required").alias("reason"))


@query("""WITH r AS (SELECT c_nationkey, c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 95 WHEN 'MACHINERY' THEN 80 WHEN 'HOUSEHOLD' THEN 65 END AS weight, CASE c_custkey % 4 WHEN 0 THEN 'usable' WHEN 1 THEN 'unknown' WHEN 2 THEN 'auth_required' ELSE 'needs_setup' END AS status FROM customer WHERE c_custkey % 9 <> 0)
SELECT c_nationkey, c_custkey, weight, CASE status WHEN 'unknown' THEN 'check first' WHEN 'auth_required' THEN 'reconnect' ELSE 'configure' END AS action, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY weight DESC, c_custkey) AS INTEGER) AS rank
FROM r WHERE weight IS NOT NULL AND status <> 'usable' QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY weight DESC, c_custkey) <= 8""")
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    status = F.when(key % 4 == 0, "usable").when(key % 4 == 1, "unknown").when(key % 4 == 2, "auth_required").otherwise("needs_setup")
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.col("c_mktsegment").alias("tier"), status.alias("status"), F.when(key % 9 == 0, "community").otherwise("own").alias("trust"))
    return choices.recommended(rows, "c_nationkey", "c_custkey", {"BUILDING": 95, "MACHINERY": 80, "HOUSEHOLD": 65})


_CATEGORY = "CASE l_linenumber % 6 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'promising' WHEN 2 THEN 'no_benefit' WHEN 3 THEN 'insufficient' WHEN 4 THEN 'regression' ELSE 'other' END"


@query(f"""WITH m AS (SELECT l_partkey AS p, count(*) FILTER (exact) AS matched, count(*) FILTER (NOT exact) AS transfer, bool_or(exact AND category = 'regression') AS worse, bool_or(exact AND category = 'confirmed') AS best
FROM (SELECT l_partkey, l_suppkey % 3 AS digest, l_returnflag = 'R' AS exact, {_CATEGORY} AS category FROM lineitem) WHERE digest = l_partkey % 3 GROUP BY 1)
SELECT p_partkey, CASE WHEN worse THEN 'not_recommended' WHEN best THEN 'recommended' WHEN matched > 0 THEN 'evaluate_further' ELSE 'unevaluated' END AS status, coalesce(matched, 0) AS matched, coalesce(transfer, 0) AS transfer FROM part LEFT JOIN m ON p = p_partkey""")
def candidate_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as candidates and lines as reports; a report of another digest says nothing about a part."""
    names = ("confirmed", "promising", "no_benefit", "insufficient", "regression")
    category = F.coalesce(*[F.when(F.col("l_linenumber") % 6 == i, name) for i, name in enumerate(names)], F.lit("other"))
    reports = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), (F.col("l_suppkey") % 3).alias("digest"), category.alias("category"), (F.col("l_returnflag") == "R").alias("exact"))
    parts = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 3).alias("digest"))
    return choices.candidate_status(parts, reports, "p_partkey")


_NEEDS = "CASE WHEN l_linenumber = 1 THEN [] WHEN l_suppkey % 17 = 0 THEN [l_linenumber + 1] ELSE [greatest(l_linenumber - 1 - l_partkey % 2, 1)] END"


@query(f"""WITH s AS (SELECT l_orderkey, l_linenumber, {_NEEDS} AS needs FROM lineitem), z AS (SELECT l_orderkey, count(*) AS n_steps, count(DISTINCT l_linenumber) AS n_ids, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM s GROUP BY 1),
d AS (SELECT l_orderkey, l_linenumber, unnest(needs) AS needed FROM s), b AS (SELECT l_orderkey, bool_or(needed > hi) AS unknown, bool_or(needed >= l_linenumber) AS late FROM d JOIN z USING (l_orderkey) GROUP BY 1)
SELECT l_orderkey, n_steps, CASE WHEN n_ids < n_steps THEN 'ids repeat' WHEN lo <> 1 OR hi <> n_steps THEN 'positions have gaps' WHEN unknown THEN 'requires an unknown step' WHEN late THEN 'requires a later step' END AS fault FROM z LEFT JOIN b USING (l_orderkey)""")
def workflow_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as workflows, lines as steps that require earlier ones, some wrongly."""
    n = F.col("l_linenumber")
    needs = F.when(n == 1, F.array().cast("array<bigint>")).when(F.col("l_suppkey") % 17 == 0, F.array((n + 1).cast("long"))).otherwise(F.array(F.greatest(n - 1 - F.col("l_partkey") % 2, F.lit(1)).cast("long")))
    steps = table(spark, sf_dir, "lineitem").select("l_orderkey", n.cast("long").alias("id"), n.alias("position"), needs.alias("requires"))
    return choices.workflow_faults(steps, "l_orderkey")


@query("""SELECT l_orderkey, id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY position, derived, id) AS INTEGER) AS place, derived FROM
(SELECT l_orderkey, l_linenumber AS id, l_linenumber AS position, false AS derived FROM lineitem UNION ALL SELECT l_orderkey, 100 + l_linenumber, l_linenumber, true FROM lineitem WHERE l_returnflag = 'R')""")
def composed_workflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines bring an optional step behind their own."""
    lines = table(spark, sf_dir, "lineitem")
    steps = lines.select("l_orderkey", F.col("l_linenumber").alias("id"), F.col("l_linenumber").alias("position"))
    more = lines.filter("l_returnflag = 'R'").select("l_orderkey", (F.col("l_linenumber") + 100).alias("id"), F.col("l_linenumber").alias("after"), F.lit(1).alias("nth"))
    return choices.composed(steps, more, "l_orderkey")


@query("""WITH f AS (SELECT doc_id, 'src/d' || doc_id % 9 || '/m' || doc_id AS base, ['.py', '.ts', '/index.js', '/__init__.py', '.rb'][doc_id % 5 + 1] AS ending FROM documents),
i AS (SELECT a.base || a.ending AS path, '../d' || (3 * a.doc_id + 1) % 9 || '/./m' || (3 * a.doc_id + 1) AS wanted, 3 * a.doc_id + 1 AS want FROM f a WHERE ending IN ('.py', '.ts', '.rb'))
SELECT path, wanted, base || ending AS target FROM i JOIN f ON doc_id = want WHERE ending <> '.rb'""")
def relative_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files that import one another without endings; a file with an unknown ending is never met."""
    d = F.col("doc_id")
    endings = F.array(*map(F.lit, (".py", ".ts", "/index.js", "/__init__.py", ".rb")))
    name = lambda n: F.concat(F.lit("d"), (n % 9).cast("string"))
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("src/"), name(d), F.lit("/m"), d, F.get(endings, (d % 5).cast("int"))).alias("path"))
    wanted = F.concat(F.lit("../"), name(3 * d + 1), F.lit("/./m"), 3 * d + 1)
    return choices.relative_imports(files.filter("not path like '%/index.js' and not path like '%/__init__.py'").select("path", wanted.alias("wanted")), files)


_RRF = f"f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (20 + rank)), 9) AS score FROM lists GROUP BY query_id, doc_id), {_rank('f', 5)}"
_SUM = f"c AS (SELECT query_id, doc_id, round(sum(part), 9) AS score FROM (SELECT query_id, doc_id, score / max(score) OVER (PARTITION BY query_id, source) AS part FROM lists) GROUP BY query_id, doc_id), {_rank('c', 5)}"


@query(f"""{_LISTS}, {_RRF}, {_SUM} SELECT 'bm25' AS strategy, query_id, doc_id, rank FROM bm_r WHERE rank <= 5 UNION ALL SELECT 'full-bm25', query_id, doc_id, rank FROM rare_r WHERE rank <= 5
UNION ALL SELECT 'full', query_id, doc_id, rank FROM f_r UNION ALL SELECT 'full-rrf', query_id, doc_id, rank FROM c_r""")
def strategy_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five of each strategy: one scorer, both, both without one, and another fusion."""
    full = strategies.configured("full", {"keep": 5})
    lists = written(strategies.candidates(full, _asked(spark, sf_dir), _stored(spark, sf_dir), "doc_id"), "strategy-lists")
    of = lambda name: strategies.retrieve(strategies.configured(name, {"keep": 5}), lists, "doc_id").select(F.lit(name).alias("strategy"), "query_id", "doc_id", "rank")
    return reduce(DataFrame.unionByName, map(of, ("bm25", "full-bm25", "full", "full-rrf")))
