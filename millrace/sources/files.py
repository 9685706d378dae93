"""Files as a source: an inventory without reading contents, and bounded reads that end at whole lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from millrace.sources.tables import written

# Folders that are never listed.
IGNORED = (".git", "node_modules", "__pycache__", ".venv", "dist", "build")


def inventory(spark: SparkSession, folder: str, glob: str = "*", ignored: tuple[str, ...] = IGNORED, most: int | None = None) -> DataFrame:
    """(path, name, length, listed) of the files below a folder, each once; names are relative to it.

    Contents aren't read. Files in an ignored folder, at any depth, are left out. Of the rest the first `most` by name are listed
    (all, if not told otherwise); listed is false for the others, so that a listing that was cut short shows. Spark lists no
    empty files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/") + "/"
    path = F.col("_metadata.file_path")  # as Spark's other readers give it, with %20 for a space
    name = F.substring(F.url_decode(F.replace(F.parse_url(path, F.lit("PATH")), F.lit("+"), F.lit("%2B"))), len(root) + 1, 1 << 20)
    rows = files.select(path.alias("path"), name.alias("name"), "length").dropDuplicates(["path"])
    rows = rows.filter(~F.arrays_overlap(F.slice(F.split("name", "/"), 1, F.size(F.split("name", "/")) - 1), F.array(*map(F.lit, ignored))) if ignored else F.lit(True))
    if most is None:
        return rows.withColumn("listed", F.lit(True))
    last = rows.orderBy("name").limit(most).agg(F.max("name").alias("__last"))
    return rows.join(F.broadcast(last), F.lit(True)).withColumn("listed", F.coalesce(F.col("name") <= F.col("__last"), F.lit(False))).drop("__last")


def bounded_lines(spark: SparkSession, paths: list[str] | str, limit: int) -> DataFrame:
    """(path, line_no, line, ends): the lines of each file that end, with their newline, within its first `limit` bytes.

    Files are read line by line in blocks of `limit` bytes, of which the first counts, so that no more of a file than a line is
    in memory at once and what is sorted of one is bounded. The last line counts without a newline, too. The lines are written:
    the size of blocks is the session's only while they are read.
    """
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(limit))
    try:
        text = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(paths)
        first = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("length"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
        order = Window.partitionBy("path").orderBy("at")
        own = first.filter("block = 0").withColumn("ends", F.sum(F.octet_length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("line_no", F.row_number().over(order))
        return written(own.filter(F.least("ends", "length") <= limit).select("path", "line_no", "line", F.least("ends", "length").alias("ends")), "lines")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def coverage(files: DataFrame, lines: DataFrame) -> DataFrame:
    """The files (path, length, ...) with coverage, covered_lines, covered_bytes and sha256 of the covered lines.

    complete: all bytes are covered; partial_lexical: whole lines of its head; structural_only: not even one line
    fits, so that only the name counts; unreadable: what is covered isn't UTF-8. Without coverage the other columns are null.
    """
    held = lines.groupBy("path").agg(F.max("line_no").alias("covered_lines"), F.max("ends").alias("covered_bytes"), F.bool_and(F.is_valid_utf8("line")).alias("valid"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n"), 256).alias("sha256"))
    met = files.join(held, "path", "left")
    state = F.when(F.col("covered_lines").isNull(), "structural_only").when(~F.col("valid"), "unreadable").when(F.col("covered_bytes") >= F.col("length"), "complete").otherwise("partial_lexical")
    known = met.withColumn("coverage", state)
    return known.select(*files.columns, "coverage", *(F.when(F.col("coverage").isin("complete", "partial_lexical"), F.col(c)).alias(c) for c in ("covered_lines", "covered_bytes", "sha256")))
