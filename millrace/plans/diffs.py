"""Two versions of each document, their differences, and what of them is worked out within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.operators import diffs
from millrace.plans.base import query
from millrace.sources.tables import table

DECLARED = r"^[A-Z]\w+ \w+"


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, old, new): each line's digest and place say whether it goes, changes, is doubled or gets a line before it."""
    turn = lambda x, i: F.substring(F.md5(F.concat_ws(":", i.cast("string"), x)), 1, 1)
    edited = lambda x, i: F.when(turn(x, i) == "0", F.array().cast("array<string>")).when(turn(x, i) == "1", F.array(F.upper(x))).when(turn(x, i) == "2", F.array(x, x)).when(turn(x, i) == "3", F.array(F.lit("Inserted line"), x)).otherwise(F.array(x))
    new = F.array_join(F.flatten(F.transform(F.split("text", "\n"), edited)), "\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("old"), new.alias("new"))


def spans_of(text: str) -> Column:
    """Each line that begins like a declaration, up to the line before the next one."""
    lines = F.split(text, "\n")
    found = F.filter(F.transform(lines, lambda x, i: F.struct(F.regexp_extract(x, r"^[A-Z]\w+ \w+", 0).alias("name"), (i + 1).alias("start"))), lambda x: x["name"] != "")
    return F.transform(found, lambda x, k: F.struct(x["name"].alias("name"), F.lit("section").alias("kind"), x["start"].alias("start"), F.coalesce(F.get(found, k + 1)["start"] - 1, F.size(lines)).alias("end")))


@query()
def line_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.line_changes(versions(spark, sf_dir), "old", "new")


@query()
def line_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = diffs.hunks(versions(spark, sf_dir), ["doc_id"], "old", "new")
    return got.select("doc_id", "hunk_no", "old_from", "old_to", "new_from", "new_to", F.size("lines").alias("n_lines"), F.sha2(F.array_join("lines", "\n"), 256).alias("lines_sha256"))


def _changed(pairs: DataFrame) -> DataFrame:
    return diffs.changed_definitions(pairs.withColumn("old_spans", spans_of("old")).withColumn("new_spans", spans_of("new")), "old", "new", "old_spans", "new_spans")


@query()
def changed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changed(versions(spark, sf_dir)).select("doc_id", "name", "change")


MOST, MOST_BYTES = 600, 1_000_000


def _budgeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest documents come first; those over 20,000 characters are bulk."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (-F.col("doc_id")).alias("turn"), F.octet_length("text").alias("size"), (F.length("text") <= 20_000).alias("able"))
    return diffs.within_budget(docs, "turn", "size", F.col("able"), MOST, MOST_BYTES).select("doc_id", "state")


@query(f"""WITH d AS (SELECT doc_id, strlen(text) AS size, coalesce(length(text) <= 20000, false) AS able FROM documents),
n AS (SELECT *, count(*) FILTER (able) OVER (ORDER BY doc_id DESC) AS i FROM d),
s AS (SELECT *, sum(CASE WHEN able AND i <= {MOST} THEN coalesce(size, 0) ELSE 0 END) OVER (ORDER BY doc_id DESC) AS used FROM n)
SELECT doc_id, CASE WHEN NOT able THEN 'ineligible' WHEN i > {MOST} THEN 'commit limit' WHEN used > {MOST_BYTES} THEN 'byte limit' ELSE 'in' END AS state FROM s""")
def enrichment_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _budgeted(spark, sf_dir)


@query()
def symbol_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sections each document within the budget adds, removes and modifies; no difference is made for the others."""
    inside = _budgeted(spark, sf_dir).filter("state = 'in'").select("doc_id")
    count = lambda kind: F.count(F.when(F.col("change") == kind, 1)).alias(kind)
    return _changed(versions(spark, sf_dir).join(inside, "doc_id", "left_semi")).groupBy("doc_id").agg(*map(count, ("added", "removed", "modified")))
