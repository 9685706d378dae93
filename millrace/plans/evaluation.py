"""Queries that measure rankings and judge paired experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from millrace.operators import fusion, metrics, scorers
from millrace.plans.base import query
from millrace.plans.experiments import _PAIRS, _pairs
from millrace.plans.retrieval import _LISTS, _lists, _rank
from millrace.sources.tables import table, written

_GOLD = "gold AS (SELECT item_id AS query_id, doc_id FROM benchmark JOIN labels ON doc_id % 10 = item_id % 10 WHERE quality = 1)"
_PER = f"{_LISTS}, {_GOLD}, h AS (SELECT source, query_id, doc_id, rank, row_number() OVER (PARTITION BY source, query_id ORDER BY rank, doc_id) AS nth FROM lists JOIN gold USING (query_id, doc_id)), g AS (SELECT source, query_id, count(*) AS targets FROM gold, (VALUES ('bm25'), ('rare')) v(source) GROUP BY ALL), f AS (SELECT source, query_id, count(*) FILTER (rank <= 5) AS n5, count(*) FILTER (rank <= 20) AS n20, min(rank) AS best, sum(nth / rank::DOUBLE) AS ap FROM h GROUP BY ALL), per AS (SELECT source, query_id, targets, coalesce(n5, 0)::DOUBLE / targets AS recall_5, coalesce(n20, 0)::DOUBLE / targets AS recall_20, CASE WHEN n5 > 0 THEN 1.0::DOUBLE ELSE 0 END AS hit_5, CASE WHEN n20 > 0 THEN 1.0::DOUBLE ELSE 0 END AS hit_20, CASE WHEN n20 = targets THEN 1.0::DOUBLE ELSE 0 END AS all_20, coalesce(1.0::DOUBLE / best, 0) AS mrr, coalesce(ap / targets, 0) AS map FROM g LEFT JOIN f USING (source, query_id))"


def _good(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good documents with the last digit of their number. A passage's targets are those of its own last digit: a tenth of
    all pairs, which are counted by digit and met by document, never listed."""
    return table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id", (F.col("doc_id") % 10).alias("digit"))


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 10).alias("digit"))


def _per(spark: SparkSession, sf_dir: str, lists: DataFrame | None = None) -> DataFrame:
    good, lists = _good(spark, sf_dir).distinct(), _lists(spark, sf_dir) if lists is None else lists
    hits = lists.withColumn("digit", F.col("query_id") % 10).join(good, ["doc_id", "digit"], "left_semi")
    counts = _passages(spark, sf_dir).distinct().join(good.groupBy("digit").agg(F.count("*").alias("targets")), "digit")
    return metrics.measured(hits, counts, "doc_id", ["bm25", "rare"], [5, 20])


@query(f"{_PER} SELECT source, count(*) AS queries, round(avg(recall_5), 6) AS recall_5, round(avg(recall_20), 6) AS recall_20, round(avg(hit_5), 6) AS hit_5, round(avg(hit_20), 6) AS hit_20, round(avg(all_20), 6) AS all_20, round(avg(mrr), 6) AS mrr, round(avg(map), 6) AS map FROM per GROUP BY source")
def rank_metrics_rk_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("recall_5", "recall_20", "hit_5", "hit_20", "all_20", "mrr", "map")
    return _per(spark, sf_dir).groupBy("source").agg(F.count("*").alias("queries"), *[F.round(F.avg(n), 6).alias(n) for n in names])


@query(f"{_PER}, l AS (SELECT *, unnest(['all', CASE WHEN targets < 10 THEN 'few targets' ELSE 'many targets' END, CASE WHEN length(text) > 200 THEN 'long' ELSE 'short' END]) AS stratum FROM per JOIN benchmark ON item_id = query_id) SELECT source, stratum, count(*) AS queries, round(avg(mrr), 6) AS mrr, round(avg(recall_20), 6) AS recall_20 FROM l GROUP BY source, stratum")
def strata_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query belongs to several strata at once, so its labels are exploded."""
    labels = F.array(F.lit("all"), F.when(F.col("targets") < 10, "few targets").otherwise("many targets"), F.when(F.length("text") > 200, "long").otherwise("short"))
    met = _per(spark, sf_dir).join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), "query_id")
    return met.withColumn("stratum", F.explode(labels)).groupBy("source", "stratum").agg(F.count("*").alias("queries"), F.round(F.avg("mrr"), 6).alias("mrr"), F.round(F.avg("recall_20"), 6).alias("recall_20"))


@query(f"{_LISTS} SELECT x.source AS a, y.source AS b, count(*) AS shared FROM lists x JOIN lists y ON x.query_id = y.query_id AND x.doc_id = y.doc_id AND x.source <= y.source GROUP BY ALL")
def overlap_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.overlap(_lists(spark, sf_dir), "doc_id")


_FUSED = f"f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (20 + rank)), 9) AS score FROM lists GROUP BY query_id, doc_id), {_rank('f', 100)}"


@query(f"{_LISTS}, {_FUSED}, {_GOLD}, s AS (SELECT query_id, doc_id, min(rank) AS best FROM lists GROUP BY ALL) SELECT CASE WHEN f_r.rank <= 8 THEN 'found' WHEN best IS NULL THEN 'candidate generation' WHEN best <= 8 THEN 'fusion' ELSE 'weak evidence' END AS cause, count(*) AS n FROM gold LEFT JOIN f_r USING (query_id, doc_id) LEFT JOIN s USING (query_id, doc_id) GROUP BY 1")
def failure_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each target was lost: no list had it, its fused rank fell behind, or all lists ranked it low."""
    lists = _lists(spark, sf_dir)
    fused = scorers.ranked(fusion.rrf(lists, "doc_id"), "doc_id", 100).select("query_id", "doc_id", "rank")
    best = lists.groupBy("query_id", "doc_id").agg(F.min("rank").alias("best"))
    cause = F.when(F.col("rank") <= 8, "found").when(F.col("best") <= 8, "fusion").otherwise("weak evidence")
    listed = best.join(fused, ["query_id", "doc_id"], "left").withColumn("digit", F.col("query_id") % 10)
    met = listed.join(_passages(spark, sf_dir).select("query_id"), "query_id").join(_good(spark, sf_dir), ["doc_id", "digit"])
    seen = met.groupBy(cause.alias("cause")).agg(F.count("*").alias("n"))
    of = lambda f, n: f.groupBy("digit").agg(F.count("*").alias(n))
    every = of(_passages(spark, sf_dir), "p").join(of(_good(spark, sf_dir), "g"), "digit").select(F.lit("candidate generation").alias("cause"), (F.col("p") * F.col("g")).alias("n"))
    unlisted = every.unionByName(seen.select(F.lit("candidate generation").alias("cause"), (-F.col("n")).alias("n")))
    return seen.unionByName(unlisted).groupBy("cause").agg(F.sum("n").alias("n")).filter("n > 0")


@query("WITH c AS (SELECT o_custkey AS id, list_distinct(coalesce(list(o_orderpriority) FILTER (o_orderstatus = 'F'), [])) AS picked, list_distinct(coalesce(list(o_orderpriority) FILTER (o_orderkey % 3 = 0), [])) AS required, list_distinct(coalesce(list(o_orderpriority) FILTER (o_orderkey % 5 = 0), [])) AS irrelevant FROM orders GROUP BY o_custkey) SELECT id, round(CASE WHEN len(picked) > 0 THEN len(list_intersect(picked, required))::DOUBLE / len(picked) ELSE 0 END, 4) AS precision, round(CASE WHEN len(required) > 0 THEN len(list_intersect(picked, required))::DOUBLE / len(required) ELSE 1 END, 4) AS recall, round(CASE WHEN len(picked) > 0 THEN len(list_intersect(picked, irrelevant))::DOUBLE / len(picked) ELSE 0 END, 4) AS noise FROM c")
def precision_recall_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of a customer's priorities. An empty choice has precision 0, nothing required has recall 1."""
    some = lambda c: F.collect_set(F.when(c, F.col("o_orderpriority")))
    c = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(some(F.col("o_orderstatus") == "F").alias("picked"), some(F.col("o_orderkey") % 3 == 0).alias("required"), some(F.col("o_orderkey") % 5 == 0).alias("irrelevant"))
    share = lambda a, b, of, empty: F.round(F.when(F.size(of) > 0, F.size(F.array_intersect(a, b)) / F.size(of)).otherwise(empty), 4)
    return c.select("id", share("picked", "required", "picked", 0.0).alias("precision"), share("picked", "required", "required", 1.0).alias("recall"), share("picked", "irrelevant", "picked", 0.0).alias("noise"))


@query(f"WITH {_PAIRS}, t AS (SELECT count(*) AS n, count(*) FILTER (a > b) AS wins, count(*) FILTER (a < b) AS losses FROM pairs), p AS (SELECT least(1, 2 * sum(exp(lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1) - m * ln(2::DOUBLE)))) AS p FROM (SELECT (wins + losses)::DOUBLE AS m, unnest(range(least(wins, losses) + 1))::DOUBLE AS k FROM t)) SELECT n, wins, losses, round(p, 6) AS sign_p, round((wins - losses) / n - 1.959964 * se, 6) AS low, round((wins - losses) / n + 1.959964 * se, 6) AS high FROM (SELECT *, sqrt(greatest(0.0, wins + losses - pow(wins - losses, 2) / n)) / n AS se FROM t), p")
def sign_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.sign_test(_pairs(spark, sf_dir))
    return got.select("n", "wins", "losses", *[F.round(c, 6).alias(c) for c in ("sign_p", "low", "high")])


@query(f"WITH {_PAIRS}, b AS (SELECT c_nationkey AS block, sum(a - b) AS d, count(*) AS n FROM pairs JOIN customer ON c_custkey = family GROUP BY 1), k AS (SELECT row_number() OVER (ORDER BY block) - 1 AS i, d, n FROM b), s AS (SELECT round_no, ('0x' || substr(md5(round_no::VARCHAR || ':' || k.i::VARCHAR), 1, 8))::BIGINT % (SELECT count(*) FROM b) AS pick FROM (SELECT unnest(range(200)) AS round_no), k) SELECT round_no, round(sum(d) / sum(n), 6) AS mean FROM s JOIN k ON k.i = pick GROUP BY round_no")
def block_bootstrap_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation are a block."""
    blocks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("family"), F.col("c_nationkey").alias("block"))
    return metrics.block_bootstrap(_pairs(spark, sf_dir).join(blocks, "family"), 200).withColumn("mean", F.round("mean", 6))


@query(f"WITH {_PAIRS}, n AS (SELECT c_nationkey AS nation, count(*) AS n, count(DISTINCT c_mktsegment) AS blocks, avg(a - b) AS d, 1.959964 * stddev_samp(a - b) / sqrt(count(*)) AS h, count(*) FILTER (c_acctbal < -990) AS violations FROM pairs JOIN customer ON c_custkey = family GROUP BY 1) SELECT nation, n, blocks, violations, CASE WHEN violations > 0 THEN 'failed' WHEN n = 0 THEN 'not_run' WHEN n < 10 OR blocks < 3 OR h IS NULL THEN 'inconclusive' WHEN d - h > 0.01 THEN 'passed' WHEN d + h < 0 THEN 'failed' ELSE 'inconclusive' END AS verdict FROM n")
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for each nation, whose segments are the blocks; a balance under -990 stands for a violation."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("family"), F.col("c_nationkey").alias("nation"), "c_mktsegment", "c_acctbal")
    d = F.col("a") - F.col("b")
    per = _pairs(spark, sf_dir).join(c, "family").groupBy("nation").agg(F.count("*").alias("n"), F.count_distinct("c_mktsegment").alias("blocks"), F.avg(d).alias("d"), (1.959964 * F.stddev_samp(d) / F.sqrt(F.count("*"))).alias("h"), F.count(F.when(F.col("c_acctbal") < -990, 1)).alias("violations"))
    said = metrics.verdict(F.col("n"), F.col("blocks"), F.col("d") - F.col("h"), F.col("d") + F.col("h"), F.col("violations"), 10, 3, 0.01)
    return per.select("nation", "n", "blocks", "violations", said.alias("verdict"))


_TRIALS = "t AS (SELECT o_custkey AS fixture, o_orderkey % 2 AS arm, o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'invalid' WHEN '5-LOW' THEN 'timeout' ELSE 'done' END AS status, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS passed FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY fixture, arm ORDER BY o_orderkey) AS repetition, CASE WHEN status = 'invalid' THEN NULL WHEN status = 'timeout' THEN false ELSE passed END AS won FROM t)"


@query(f"WITH {_TRIALS}, p AS (SELECT x.status AS ls, x.won AS l, y.status AS rs, y.won AS r FROM (SELECT * FROM r WHERE arm = 0) x FULL JOIN (SELECT * FROM r WHERE arm = 1) y USING (fixture, repetition)) SELECT CASE WHEN ls IS NULL OR rs IS NULL THEN 'missing_attempt' WHEN ls = 'invalid' OR rs = 'invalid' THEN 'invalid' WHEN l IS NULL OR r IS NULL THEN 'pending' WHEN l AND r THEN 'both_pass' WHEN NOT l AND NOT r THEN 'both_fail' WHEN r THEN 'improved' ELSE 'regressed' END AS class, count(*) AS n FROM p GROUP BY 1")
def pair_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as trials: the customer is the fixture, the key's parity the arm, the place in the arm the repetition."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderpriority") == "1-URGENT", "invalid").when(F.col("o_orderpriority") == "5-LOW", "timeout").otherwise("done")
    passed = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    t = o.select(F.col("o_custkey").alias("fixture"), (F.col("o_orderkey") % 2).alias("arm"), "o_orderkey", status.alias("status"), passed.alias("passed"))
    t = t.withColumn("repetition", F.row_number().over(Window.partitionBy("fixture", "arm").orderBy("o_orderkey"))).withColumn("won", metrics.outcome(F.col("status"), F.col("passed")))
    side = lambda arm, p: t.filter(F.col("arm") == arm).select("fixture", "repetition", F.col("status").alias(f"{p}_status"), F.col("won").alias(f"{p}_won"))
    both = side(0, "l").join(side(1, "r"), ["fixture", "repetition"], "full_outer")
    return both.groupBy(metrics.pair_class(F.col("l_status"), F.col("l_won"), F.col("r_status"), F.col("r_won")).alias("class")).agg(F.count("*").alias("n"))


@query(f"{_PER}, conf AS (SELECT query_id, (score - lead(score) OVER (PARTITION BY query_id ORDER BY rank)) / nullif(score, 0) AS gap, rank FROM bm_r), w AS (SELECT query_id, max(mrr) FILTER (source = 'bm25') AS own, max(mrr) FILTER (source = 'rare') AS other FROM per GROUP BY query_id) SELECT count(*) AS queries, count(*) FILTER (coalesce(gap, 0) < 0.1) AS asked, round(avg(CASE WHEN coalesce(gap, 0) < 0.1 THEN other ELSE own END), 6) AS mrr FROM w LEFT JOIN (SELECT * FROM conf WHERE rank = 1) USING (query_id)")
def policy_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second ranking is asked for only where the first has no clear leader."""
    lists = written(_lists(spark, sf_dir), "lists")  # read twice
    gap = fusion.confidence(lists.filter("source = 'bm25'")).select("query_id", "gap")
    of = lambda s: F.max(F.when(F.col("source") == s, F.col("mrr")))
    w = _per(spark, sf_dir, lists).groupBy("query_id").agg(of("bm25").alias("own"), of("rare").alias("other")).join(gap, "query_id", "left")
    ask = F.coalesce("gap", F.lit(0.0)) < 0.1
    return w.agg(F.count("*").alias("queries"), F.count(F.when(ask, 1)).alias("asked"), F.round(F.avg(F.when(ask, F.col("other")).otherwise(F.col("own"))), 6).alias("mrr"))


@query(f"{_PER}, m AS (SELECT source, avg(mrr) AS mrr, avg(recall_20) AS recall_20 FROM per GROUP BY source), v AS (SELECT source, unnest(['mrr', 'recall_20']) AS metric, unnest([mrr, recall_20]) AS value FROM m), b AS (SELECT * FROM (VALUES ('bm25', 'mrr', 0.5::DOUBLE), ('bm25', 'recall_20', 0.01), ('rare', 'mrr', 0.01), ('rare', 'recall_20', 0.9)) t(source, metric, floor)) SELECT source, metric, round(value, 6) AS value, floor, value < floor - 0.03 AS regressed FROM v JOIN b USING (source, metric)")
def baseline_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured means against stated floors, with a tolerance of 0.03."""
    floors = spark.createDataFrame([("bm25", "mrr", 0.5), ("bm25", "recall_20", 0.01), ("rare", "mrr", 0.01), ("rare", "recall_20", 0.9)], "source string, metric string, floor double")
    m = _per(spark, sf_dir).groupBy("source").agg(F.avg("mrr").alias("mrr"), F.avg("recall_20").alias("recall_20")).unpivot("source", ["mrr", "recall_20"], "metric", "value")
    return m.join(F.broadcast(floors), ["source", "metric"]).select("source", "metric", F.round("value", 6).alias("value"), "floor", (F.col("value") < F.col("floor") - 0.03).alias("regressed"))


@query("WITH h AS (SELECT doc_id, sha256(doc_id::VARCHAR) AS h FROM documents) SELECT doc_id, CASE WHEN m < 6 THEN 'train' WHEN m < 8 THEN 'validation' ELSE 'test' END AS split FROM (SELECT doc_id, (6 * list_sum(list_transform(string_split(substr(h, 1, 63), ''), lambda c: ('0x' || c)::INTEGER)) + ('0x' || substr(h, 64, 1))::INTEGER) % 10 AS m FROM h)")
def stable_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of the number, as one large number, by its last decimal digit: 16 to any power ends in 6."""
    h = F.sha2(F.col("doc_id").cast("string"), 256)
    digit = lambda c: F.conv(c, 16, 10).cast("int")
    total = F.aggregate(F.split(F.substring(h, 1, 63), ""), F.lit(0), lambda a, c: a + F.when(c == "", 0).otherwise(digit(c)))
    m = (6 * total + digit(F.substring(h, 64, 1))) % 10
    return table(spark, sf_dir, "documents").select("doc_id", F.when(m < 6, "train").when(m < 8, "validation").otherwise("test").alias("split"))


_ARMS = """x AS (SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag, l_extendedprice AS a, l_quantity AS b FROM lineitem),
r AS (SELECT 'price' AS arm, l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY a DESC, l_linenumber, l_partkey) AS rank FROM x UNION ALL SELECT 'quantity', l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY b DESC, l_linenumber, l_partkey) FROM x WHERE b >= 10)"""


@query(f"""WITH {_ARMS}, b AS (SELECT arm, l_orderkey, l_partkey, min(rank) AS rank FROM r GROUP BY ALL), g AS (SELECT DISTINCT l_orderkey, l_partkey, unnest([l_returnflag, 'all']) AS grp FROM lineitem WHERE l_returnflag <> 'N'),
m AS (SELECT arms.arm, g.*, b.rank FROM g CROSS JOIN (SELECT unnest(['price', 'quantity']) AS arm) arms LEFT JOIN b ON b.arm = arms.arm AND b.l_orderkey = g.l_orderkey AND b.l_partkey = g.l_partkey),
q AS (SELECT arm, l_orderkey, grp, count(*) AS n, min(rank) AS first, count(*) FILTER (rank <= 1) AS i1, count(*) FILTER (rank <= 3) AS i3 FROM m GROUP BY ALL)
SELECT arm, grp, count(*) AS n_queries, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr, round(avg(least(i1, 1)), 6) AS hit_1, round(avg(least(i3, 1)), 6) AS hit_3, round(avg(i1 / n::DOUBLE), 6) AS recall_1, round(avg(i3 / n::DOUBLE), 6) AS recall_3 FROM q GROUP BY arm, grp""")
def arm_label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as queries, whose parts are ranked by price or, from a quantity of ten, by quantity; returned and accepted
    parts are two groups of labels."""
    x = table(spark, sf_dir, "lineitem")
    ranked = lambda arm, by, rows: rows.select(F.lit(arm).alias("arm"), "l_orderkey", "l_partkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc(by), "l_linenumber", "l_partkey")).alias("rank"))
    lists = ranked("price", "l_extendedprice", x).unionByName(ranked("quantity", "l_quantity", x.filter("l_quantity >= 10")))
    labels = x.filter("l_returnflag <> 'N'").select("l_orderkey", F.col("l_returnflag").alias("grp"), "l_partkey")
    got = metrics.arm_groups(lists, labels, ["price", "quantity"], "l_orderkey", "l_partkey", (1, 3))
    return got.select("arm", "grp", "n_queries", *[F.round(c, 6).alias(c) for c in got.columns[3:]])
