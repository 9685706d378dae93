"""Documents as files: what is listed, and what of each file is read within a bound."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.plans.base import query
from millrace.sources import files
from millrace.sources.tables import shared_dir, table

LIMIT = 65_536


def as_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a text file for each language and last two digits of the id, lines in order of the ids."""
    folder = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("lang", (F.col("doc_id") % 100).alias("part"), "doc_id", "text")
    docs.repartition("lang", "part").sortWithinPartitions("lang", "part", "doc_id").select("lang", "part", "text").write.option("lineSep", "\n").partitionBy("lang", "part").text(folder)
    return folder


@query(f"""WITH l AS (SELECT lang, doc_id % 100 AS part, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL),
e AS (SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY lang, part ORDER BY doc_id, n) AS ends, row_number() OVER (PARTITION BY lang, part ORDER BY doc_id, n) AS line_no FROM l),
f AS (SELECT lang, part, max(ends) AS length, max(line_no) FILTER (ends <= {LIMIT}) AS held, max(ends) FILTER (ends <= {LIMIT}) AS bytes, string_agg(line, chr(10) ORDER BY line_no) FILTER (ends <= {LIMIT}) AS text FROM e GROUP BY lang, part)
SELECT 'lang=' || lang || '/part=' || part AS file, CAST(length AS BIGINT) AS length, CASE WHEN held IS NULL THEN 'structural_only' WHEN bytes = length THEN 'complete' ELSE 'partial_lexical' END AS coverage, CAST(held AS INTEGER) AS covered_lines, CAST(bytes AS BIGINT) AS covered_bytes, sha256(text) AS sha256 FROM f""")
def file_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files, and of each the lines in its first 64 KB."""
    folder = as_files(spark, sf_dir)
    got = files.coverage(files.inventory(spark, folder, "*.txt"), files.bounded_lines(spark, folder, LIMIT))
    return got.select(F.regexp_replace("name", "/[^/]*$", "").alias("file"), "length", "coverage", "covered_lines", "covered_bytes", "sha256")
