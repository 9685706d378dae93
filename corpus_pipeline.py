"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm import decontamination, jaccard, line_dedup, packing, toxicity
from millrace.llm.queries import vocabulary
from millrace.sources.tables import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the lexicon, learned from the labelled ones among docs, predicts to be toxic."""
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, lexicon).filter("predicted = 0").select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages stay in one place. A document of nothing else goes; n_chars follows the text."""
    cut = line_dedup.remove_repeats(docs).filter("n_removed_words = 0 or trim(translate(text, '\n\t\r', '   ')) <> ''")
    return cut.withColumn("n_chars", F.when(F.col("n_removed_words") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, also where ids are null or repeat."""
    return jaccard.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that share ten words in a row, or a whole short item, with the benchmark."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), mode="documents").select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 4096 tokens."""
    return packing.pack(packing.token_pieces(docs, vocabulary("word_bpe_49k.json"), keep=["doc_id"]))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]

#: Learned lexicons, MinHash and packing are beyond SQL; tests compare the line dedup and near-duplicate stages with loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
