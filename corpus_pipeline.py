"""Training-data pipeline: quality rules, classifier, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept. The first four return the columns of documents; the last
returns token counts and digests, one row per row of the mixture.

No stage fails on nulls in any column, empty or very long texts, repeated rows, an
empty table (it stays empty) or further columns of any name (they pass unchanged). What
becomes of such rows, and of ties, is said by the operator that each stage calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import byte_bpe, mixing, parity_join, passages, repetition
from tessera.llm.runtime import new_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the repetition rules; null, empty and blank texts fail, shares right at a limit pass."""
    return repetition.keep_passing(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the passage classifier predicts good; it learns from the labelled ones among them. Without labels of both kinds all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return passages.keep_good(docs, passages.learn_quality(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group linked by five-word shingles at a similarity of 0.8 or more.

    Repeated rows of an id leave one; documents without an id, and texts without words, stay.
    """
    return parity_join.one_of_each(docs, parity_join.ParityJoin(words=5, percent=80))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole and partial repetitions of documents, so that sources have their target words; a null source is one of its own."""
    return mixing.mixture(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row of the mixture; a null text has no tokens."""
    return byte_bpe.encode_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", source_mixing),
    ("byte-level BPE encoding and decoding", tokens),
]

#: The classifier is not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, "stage-" + name.replace(" ", "-"))
        made = stage(spark, docs, sf_dir)
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
