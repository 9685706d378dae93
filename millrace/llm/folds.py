"""Which labelled rows a model may learn from, and the bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Labelled rows that a fit takes at most; chosen by hash, so the choice is even over all rows and always the same.
FIT_ROWS = 12_000


def held_out(doc_id: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves the held-out remainder. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == part


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, part: int, rows: int = FIT_ROWS, text: str = "text") -> DataFrame:
    """Text and label of at most `rows` documents outside the held-out part: ids are chosen among the labels, and of rows
    with one id the one of least text counts. Null labels teach nothing."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", parts, part)).select("doc_id", F.col(label).cast("int").alias("label"))
    chosen = known.dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    own = docs.select("doc_id", text).join(F.broadcast(chosen), "doc_id")  # `rows` ids at most are broadcast
    return own.groupBy("doc_id", "label").agg(F.min(text).alias(text))
