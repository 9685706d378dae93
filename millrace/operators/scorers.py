"""Scorers: query terms and an index to scored candidates (query, document, score)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.operators.index import document_stats, identifier_postings, idf
from millrace.sources.tables import written


def _matches(queries: DataFrame, postings: DataFrame, key: str, facts: DataFrame | None = None) -> DataFrame:
    """Occurrences of query terms with their df and the corpus facts. Only the terms that are asked for are counted.

    Lengths and distinct terms are counted from the postings where no facts (key, len, distinct_terms) are given. Postings
    meet their document's facts first and the queries last, so that where the queries are few enough to be broadcast, the
    many rows for a query and document are summed where they arise and none of them is shuffled.
    """
    facts = document_stats(postings, key) if facts is None else facts.select(key, "len", "distinct_terms")
    corpus = facts.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), F.avg("distinct_terms").alias("avg_distinct"))
    asked = written(postings.join(queries.select("term").distinct(), "term"), "matches")
    weighed = written(queries.join(asked.groupBy("term").agg(F.count("*").alias("df")), "term").join(F.broadcast(corpus), F.lit(True)).withColumn("idf", idf(F.col("n"), F.col("df"))), "weighed")  # corpus: one row
    return asked.join(facts.hint("shuffle_hash"), key).join(weighed, "term")


def _bm25(k1: float = 1.2, b: float = 0.75) -> Column:
    """w idf tf (k1 + 1) / (tf + k1 (1 - b + b len / avg))."""
    return F.col("w") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))


def _rare() -> Column:
    """w idf squared, less for documents of many distinct terms. Presence counts, not frequency."""
    return F.col("w") * F.col("idf") ** 2 / (1 + F.log(1 + F.col("distinct_terms") / F.col("avg_distinct")))


def bm25(queries: DataFrame, postings: DataFrame, key: str, k1: float = 1.2, b: float = 0.75, facts: DataFrame | None = None) -> DataFrame:
    """Sum of w idf tf (k1 + 1) / (tf + k1 (1 - b + b len / avg)) over (query_id, term, w)."""
    return _matches(queries, postings, key, facts).groupBy("query_id", key).agg(F.sum(_bm25(k1, b)).alias("score"))


def rare_terms(queries: DataFrame, postings: DataFrame, key: str, facts: DataFrame | None = None) -> DataFrame:
    """Sum of w idf squared, less for documents of many distinct terms. Presence counts, not frequency."""
    return _matches(queries, postings, key, facts).groupBy("query_id", key).agg(F.sum(_rare()).alias("score"))


#: What `voted` can sum together.
GAINS = {"bm25": _bm25, "rare": _rare}
#: Meetings of a query's term with a document that a task gets, about.
MEETINGS_EACH = 2_000_000


def voted(names: Sequence[str], queries: DataFrame, postings: DataFrame, key: str, facts: DataFrame, k: int) -> DataFrame:
    """(source, query_id, key, score, rank): the k best of each query by the scorers of GAINS that are named. Give written
    tables: postings (key, term, tf) and facts (key, len, distinct_terms).

    Postings are dealt by document once, for all scorers. A task gets so many documents that the sums for them fit its
    memory, and passes on its k best of each query: where common words are terms, almost every document meets every query, and
    those rows are neither shuffled nor kept.
    """
    spark = postings.sparkSession
    corpus = facts.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), F.avg("distinct_terms").alias("avg_distinct"))
    weighed = written(queries.join(postings.groupBy("term").agg(F.count("*").alias("df")), "term").join(F.broadcast(corpus), F.lit(True)).withColumn("idf", idf(F.col("n"), F.col("df"))), "weighed")  # corpus: one row
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(weighed.agg(F.sum("df")).first()[0] or 0) // MEETINGS_EACH))
    dealt = postings.repartition(tasks, key).join(facts.select(key, "len", "distinct_terms").repartition(tasks, key).hint("shuffle_hash"), key)
    sums = dealt.join(weighed, "term").groupBy("query_id", key).agg(*[F.sum(GAINS[n]()).alias(n) for n in names])
    return ranked(sums.unpivot(["query_id", key], list(names), "source", "score"), key, k, by=("query_id", "source"))


def references(names: DataFrame, postings: DataFrame, key: str, defining: DataFrame | None = None) -> DataFrame:
    """(1 + ln tf) / ln(2 + documents with the name), over names (query_id, term, w). Documents that define a name
    (key, term) don't refer to it, where these are given."""
    if defining is not None:
        postings = postings.join(defining.select(key, "term").distinct(), [key, "term"], "left_anti")
    held = postings.join(names.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("holders"))
    found = postings.join(names.join(held, "term"), "term")
    return found.groupBy("query_id", key).agg(F.sum(F.col("w") * (1 + F.log("tf")) / F.log(2 + F.col("holders"))).alias("score"))


def ranked(candidates: DataFrame, key: str, k: int, digits: int = 9, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """The k best of each query, numbered; ties by key. Scores are rounded first so that the order of sums can't show."""
    held = candidates.withColumn("score", F.round("score", digits))
    order = Window.partitionBy(*by).orderBy(F.desc("score"), key)
    return held.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def module_search(queries: DataFrame, records: DataFrame, key: str, k: int = 8, floor: float = 0.25, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, key, score, rank, identifier_support, concept_matches, weak): BM25 on the identifiers of current records
    (key, text, status), over (query_id, term, w).

    Terms of weight 3 or more count as identifiers. A record is weak with no identifier and fewer than two other terms, or
    below the first one's score by more than the floor allows.
    """
    held = written(identifier_postings(records.filter("status = 'current'"), key, "text"), "module-postings")
    m = _matches(queries, held, key)
    strong = F.count(F.when(F.col("w") >= 3, 1))
    found = m.groupBy("query_id", key).agg(F.round(F.sum(_bm25(k1, b)), 4).alias("score"), strong.alias("identifier_support"), (F.count("*") - strong).alias("concept_matches")).filter("score > 0")
    top = ranked(found, key, k, 4)
    best = F.first("score").over(Window.partitionBy("query_id").orderBy("rank"))
    weak = ((F.col("identifier_support") == 0) & (F.col("concept_matches") < 2)) | ((F.col("rank") > 1) & (F.col("score") < best * floor))
    return top.withColumn("weak", weak)
