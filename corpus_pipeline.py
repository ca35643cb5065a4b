"""A training corpus from raw documents: filter, deduplicate, mix, encode.

Each stage takes the rows its predecessor kept and hands on the columns of ``documents``; the last
one hands on encoded texts. Every stage's result is written as Parquet and read again, so a lost
executor costs no more than a part of the stage at work.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sentrel.functions.staging import staging_dir
from sentrel.llm import bpe, minhash, mixing, quality, toxicity
from sentrel.llm.common import table

RANKS = "byte_bpe_multi_50k.tiktoken"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and the weighed votes, fitted on this stage's own input."""
    return quality.keep_good(docs)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity stays below the threshold; labels of remaining rows train the model."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near-duplicates."""
    return minhash.deduplicate(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and whether they decode to its text."""
    return bpe.encode_checked(docs.select("doc_id", "source", "text"), RANKS)


STAGES = [
    ("quality rules", good_quality),
    ("toxicity", not_toxic),
    ("near-duplicates", one_of_each),
    ("source mixing", mixed),
    ("byte-level encoding", encoded),
]

#: Trained models and near-duplicate search have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = f"{staging_dir(spark)}/sentrel-stage-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
