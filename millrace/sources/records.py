"""Readers of commit logs and of lines of JSON, which keep what is damaged apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: What begins a commit in a log.
MARK = "\x01"


def read_commit_log(spark: SparkSession, path: str) -> DataFrame:
    """(block): the commits of log files, as `\\x01<seconds>`, an empty line and a path on each line."""
    return spark.read.option("lineSep", MARK).text(path).select(F.col("value").alias("block")).filter("block <> ''")


def commit_paths(blocks: DataFrame, universe: DataFrame, most: int, least: int = 2) -> DataFrame:
    """(stamp, paths): commits that touch `least` to `most` paths of the universe (path); other paths count for nothing.

    A block without a time is left out. Equal blocks stay as many rows. No list is longer than `most` and one. The blocks
    are read once, so that a source that deals or orders them anew on a second reading can't lose any.
    """
    known = universe.select("path").filter("path is not null").distinct()
    counted = blocks.groupBy("block").agg(F.count("*").alias("copies"))
    lines = F.split("block", "\n")
    read = counted.select(F.md5("block").alias("id"), "copies", F.trim(F.get(lines, F.lit(0))).try_cast("bigint").alias("stamp"), F.array_distinct(F.slice(lines, 2, 1 << 30)).alias("lines"))
    touched = read.filter("stamp is not null").select("id", "copies", "stamp", F.explode("lines").alias("path")).join(known, "path", "left_semi")
    first = touched.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("path"))).filter(F.col("n") <= most + 1)
    kept = first.groupBy("id", "copies", "stamp").agg(F.array_sort(F.collect_list("path")).alias("paths")).filter(F.size("paths").between(least, most))
    return kept.select("stamp", "paths", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy")


def commit_changes(blocks: DataFrame, universe: DataFrame, most: int) -> DataFrame:
    """(sha, stamp, subject, touched, capped, paths, renames) from blocks of a log with states and likeness of renames.

    A block is sha, seconds and subject, parted by \\x02, then a line for each change: M, A or D with a path, or R and C with
    a score and the old and new path, all parted by tabs. Paths of the universe count, each once; the first `most` by name
    stay. A rename counts if its new name is known. Blocks without three parts or a time are left out; of several with one sha the first by time and subject stays.
    """
    known = universe.select("path").filter("path is not null").distinct()
    head = F.split(F.substring_index("block", "\n", 1), "\x02")
    read = blocks.filter(F.size(head) == 3).select(F.substring(F.trim(head[0]), 1, 40).alias("sha"), F.trim(head[1]).try_cast("bigint").alias("stamp"), head[2].alias("subject"), F.slice(F.split("block", "\n"), 2, 1 << 30).alias("lines"))
    read = read.filter("stamp is not null").groupBy("sha").agg(F.min(F.struct("stamp", "subject", "lines")).alias("c")).select("sha", "c.*")
    fields = read.select("sha", F.explode("lines").alias("line")).select("sha", F.split("line", "\t").alias("f"))
    moved = F.col("f")[0].rlike("^[RC]") & (F.size("f") == 3)
    names = F.when(moved, F.slice("f", 2, 2)).when((F.size("f") == 2) & ~F.col("f")[0].rlike("^[RC ]*$"), F.slice("f", 2, 1))
    touched = fields.select("sha", F.explode(names).alias("path")).distinct().join(known, "path", "left_semi")
    sizes = touched.groupBy("sha").agg(F.count("*").alias("touched"))
    first = touched.withColumn("n", F.row_number().over(Window.partitionBy("sha").orderBy("path"))).filter(F.col("n") <= most).groupBy("sha").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    score = F.coalesce(F.substring(F.col("f")[0], F.lit(2), F.length(F.col("f")[0])).try_cast("int"), F.lit(0))
    renames = fields.filter(moved).select("sha", F.get("f", F.lit(1)).alias("old"), F.get("f", F.lit(2)).alias("path"), score.alias("score")).join(known, "path", "left_semi")
    renames = renames.groupBy("sha").agg(F.array_sort(F.collect_set(F.struct("old", F.col("path").alias("new"), "score"))).alias("renames"))
    met = read.drop("lines").join(sizes, "sha", "left").join(first, "sha", "left").join(renames, "sha", "left").fillna(0, ["touched"])
    return met.select("sha", "stamp", "subject", "touched", (F.col("touched") > most).alias("capped"), F.coalesce("paths", F.array().cast("array<string>")).alias("paths"), F.coalesce("renames", F.array().cast("array<struct<old:string,new:string,score:int>>")).alias("renames"))


def parsed_lines(frame: DataFrame, line: str, fields: str | StructType) -> DataFrame:
    """The fields of each line of JSON and `partial`: a line that is damaged or null keeps its row, with null fields."""
    stated = StructType.fromDDL(fields) if isinstance(fields, str) else fields
    schema = StructType([*stated.fields, StructField("__bad", StringType())])
    read = F.from_json(F.col(line), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    held = frame.withColumn("__j", read)
    partial = F.col("__j").isNull() | F.col("__j.__bad").isNotNull()
    return held.select(*[F.when(~partial, F.col(f"__j.`{n}`")).alias(n) for n in stated.names], partial.alias("partial"))


def read_json_lines(spark: SparkSession, path: str, fields: str) -> DataFrame:
    return parsed_lines(spark.read.text(path).filter("trim(value) <> ''"), "value", fields)


def tasks_from_changes(changes: DataFrame, most: int = 5, shortest: int = 1) -> DataFrame:
    """(id, request, targets, tests, added): commits as tasks, from (id, request, path, status, is_source, is_test).

    A task has 1 to `most` modified source files outside the tests, and a request of `shortest` characters or more. Paths
    are listed only for commits whose counts fit.
    """
    source = changes.filter("is_source and path is not null")
    target = (F.col("status") == "M") & ~F.col("is_test")
    fits = source.groupBy("id").agg(F.count_distinct(F.when(target, F.col("path"))).alias("n")).filter(F.col("n").between(1, most)).select("id")

    def listed(holds: Column) -> Column:
        return F.array_sort(F.collect_set(F.when(holds, F.col("path"))))

    held = source.join(fits, "id", "left_semi").filter(F.length("request") >= shortest)
    return held.groupBy("id", "request").agg(listed(target).alias("targets"), listed((F.col("status") == "M") & F.col("is_test")).alias("tests"), listed(F.col("status") == "A").alias("added"))
