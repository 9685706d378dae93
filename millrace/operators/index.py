"""The inverted index and its statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.functions import tokens
from millrace.sources.tables import written

#: Lower-case terms of three characters or more.
TERM = "[a-z_][a-z0-9_]{2,79}"


def terms_of(frame: DataFrame, key: str, text: str) -> DataFrame:
    """A row (key, term) for each occurrence."""
    return frame.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))).alias("term"))


def postings(frame: DataFrame, key: str, text: str) -> DataFrame:
    return terms_of(frame, key, text).groupBy(key, "term").agg(F.count("*").alias("tf"))


def identifier_postings(frame: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf) over the terms that identifiers expand to. Identifiers are counted in a document first, so that
    each is taken apart once."""
    return expanded(identifier_counts(frame, key, text), key)


def identifier_counts(frame: DataFrame, key: str, text: str) -> DataFrame:
    """(key, id, n): identifiers as they are written."""
    return frame.select(key, F.explode(tokens.identifiers(F.col(text))).alias("id")).groupBy(key, "id").agg(F.count("*").alias("n"))


#: One word of small letters, as most identifiers are: it has one part, itself.
_ONE = r"^[a-z]{2,}\z"


def _apart(counts: DataFrame) -> DataFrame:
    """Adds terms, what the identifier expands to (`tokens.expand`), in steps, so that only compound ones are taken apart and
    each once."""
    steps = counts.withColumn("one", F.col("id").rlike(_ONE))
    steps = steps.withColumn("small", F.when(~F.col("one"), tokens.small_parts(F.col("id"))))
    return steps.withColumn("terms", F.when(F.col("one"), F.array(tokens.normalized(F.col("id")))).otherwise(tokens.terms_of(F.col("id"), F.col("small"))))


def _each(rows: DataFrame, key: str, terms: Column) -> DataFrame:
    """(key, term, tf). An outer explode has no filter inferred from it, which would take all identifiers apart twice more."""
    return rows.select(key, "n", F.explode_outer(terms).alias("term")).filter(F.col("term").isNotNull()).groupBy(key, "term").agg(F.sum("n").alias("tf"))


def expanded(counts: DataFrame, key: str) -> DataFrame:
    """(key, term, tf) from counts of identifiers (key, id, n)."""
    return _each(_apart(counts), key, F.col("terms"))


#: Identifiers that a task gets, about, where whole texts are dealt by document.
IDENTIFIERS_EACH = 1_000_000
#: Before a name as it is written, to tell it from a term. No identifier has it.
_WRITTEN = "="


def asked_index(frame: DataFrame, key: str, text: str, terms: DataFrame, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, counts, facts): (key, term, tf) of the asked terms, (key, term, tf) of the asked names as they are
    written, and (key, len, distinct_terms, chars) for every document: identifiers as they stand in the text, distinct terms
    of the whole index, characters. A text that is null or has no identifier counts with zeros.

    Texts are dealt by document once. A task counts, expands and sums what its documents have, and only what is asked is
    written, so that the whole index, which is larger than the texts, is on no disk.
    """
    spark, whole = frame.sparkSession, F.coalesce(F.col(text), F.lit(""))
    lengths = written(frame.select(key, F.size(tokens.identifiers(whole)).alias("len"), F.length(whole).alias("chars")), "lengths")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(lengths.agg(F.sum("len")).first()[0] or 0) // IDENTIFIERS_EACH))
    spelled = terms.limit(0) if names is None else names
    spelled = written(spelled.select(F.col("term").alias("id"), F.concat(F.lit(_WRITTEN), "term").alias("as_written")).distinct(), "spelled")
    wanted = written(terms.select(F.col("term").alias("asked")).union(spelled.select("as_written")).distinct(), "wanted")
    held = identifier_counts(frame.select(key, text).repartition(tasks, key), key, text).join(spelled, "id", "left")
    each = F.when(F.col("as_written").isNull(), F.col("terms")).otherwise(F.concat("terms", F.array("as_written")))
    sums = _each(_apart(held), key, each)
    met = sums.join(wanted, F.col("term") == F.col("asked"), "left")
    met = met.groupBy(key, "asked").agg(F.sum("tf").alias("tf"), F.count(F.when(~F.col("term").startswith(_WRITTEN), 1)).alias("terms"))
    met = written(met, "terms")
    distinct = met.groupBy(key).agg(F.sum("terms").alias("distinct_terms"))
    facts = written(lengths.join(distinct, key, "left").withColumn("distinct_terms", F.coalesce("distinct_terms", F.lit(0))), "facts")
    named = F.col("asked").startswith(_WRITTEN)
    counts = met.filter(named).select(key, F.substring("asked", 1 + len(_WRITTEN), 1000).alias("term"), "tf")
    return met.filter(~named).select(key, F.col("asked").alias("term"), "tf"), counts, facts


def top_terms(postings: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent terms of each document; ties by term."""
    order = Window.partitionBy(key).orderBy(F.desc("tf"), "term")
    return postings.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def idf(n, df):
    """Positive for every term."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_stats(postings: DataFrame, key: str, n_documents: DataFrame) -> DataFrame:
    """(term, df, idf); n_documents is one row with n."""
    counts = postings.groupBy("term").agg(F.count("*").alias("df"))
    return counts.join(F.broadcast(n_documents), F.lit(True)).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))


def document_stats(postings: DataFrame, key: str) -> DataFrame:
    return postings.groupBy(key).agg(F.sum("tf").alias("len"), F.count("*").alias("distinct_terms"))


def document_frequency_delta(before: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Counts (term, df) after documents came and went; terms that none has any more are dropped."""
    part = lambda p, sign: p.groupBy("term").agg((F.count("*") * sign).alias("df"))
    return before.union(part(added, 1)).union(part(removed, -1)).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
