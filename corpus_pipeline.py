"""Corpus pipeline: stages that each take what the one before kept, from raw documents to packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.llm import packing, quality_classifier, queries, resemblance, token_counts, toxicity
from tablewarden.session import Scratch, cut

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a toxicity score below 0.3; the model is fitted on what this stage gets. A null or empty text
    has the score of a text without words, a row without an id is scored like any other, repeated rows have equal scores
    and stay or go together; an empty table stays empty."""
    model = toxicity.train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(model.column(F.col("text")) < 0.3)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a quality score of at least 0.7; the model is fitted on what this stage gets. A null or empty
    text has the score of a text without words; null ids, repeated rows and an empty table as in ``drop_toxic``."""
    model = quality_classifier.train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(model.column(F.col("text")) >= 0.7)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document (the least doc_id) of each group of near duplicates: texts linked by a Jaccard similarity of at
    least 0.8 on their whole sets of five-word shingles. Several SimHashes find the pairs to verify. Texts without words,
    null ones too, are copies of each other; rows without an id come after all others; rows equal in id and text count
    as one; different texts under one id are different documents; an empty table stays empty."""
    return resemblance.keep_one_similar(docs, words=5, least=0.8)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every kept document, as its tokens and an end mark, in sequences of a few lengths. A null or empty text has
    the end mark alone; rows without an id and repeated rows are packed as often as they occur; documents of equal length
    are placed by id; an empty table gives no rows."""
    counts = cut(token_counts.count_tokens(docs, queries.tokenizer_path(queries.WORD_BPE)))
    return packing.pack_documents(counts, F.col("n_tokens") + 1)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with Scratch(spark) as scratch:
            docs = scratch.keep(cut(stage(spark, docs, sf_dir)))
    return STAGES[-1][1](spark, docs, sf_dir)
