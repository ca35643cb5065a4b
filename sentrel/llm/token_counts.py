"""Token counts through a cache of digests."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel.llm.common import file_digest, slices, tokenizer_path, whole

#: Columns of the cache: which tokenizer, which content, how many tokens.
CACHE_SCHEMA = "tokenizer string, content binary, n_tokens long"


def tokenizer_version(name: str) -> str:
    """The vocabulary file's digest and the library's version; counts are valid for this alone."""
    if name.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    return f"{file_digest(tokenizer_path(name))}:{library.__name__}-{library.__version__}"


@cache
def _counter(name: str):
    path = tokenizer_path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


def encode_counts(texts: DataFrame, name: str) -> DataFrame:
    """(content, text) to (content, n_tokens): the library's count of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(name)
        for batch in slices(batches, "text", 1 << 22):
            yield pa.RecordBatch.from_arrays(
                [batch.column("content"), pa.array(count(batch.column("text").to_pylist()), pa.int64())],
                ["content", "n_tokens"],
            )

    return texts.select("content", "text").mapInArrow(run, "content binary, n_tokens long")


def known_counts(spark: SparkSession, name: str, cache_dir: str) -> DataFrame:
    """(content, n_tokens) of this tokenizer version, one row per content."""
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache_dir)
    return (
        rows.where(F.col("tokenizer") == tokenizer_version(name))
        .groupBy("content")
        .agg(F.max("n_tokens").alias("n_tokens"))
    )


def fill_cache(docs: DataFrame, name: str, cache_dir: str, text: str = "text") -> None:
    """Encode the distinct texts that the cache lacks, once each, and append their counts.

    Copies of a text are reduced to one in each task before the shuffle, so they never meet in one
    task. While the cache is small enough to broadcast, known texts are dropped before that
    shuffle too (Spark moves the anti-join below the aggregate), else after it.
    """
    spark = docs.sparkSession
    spark.createDataFrame([], CACHE_SCHEMA).coalesce(1).write.mode("append").parquet(cache_dir)
    contents = (
        docs.select(digest(text).alias("content"), whole(text).alias("text"))
        .groupBy("content")
        .agg(F.first("text").alias("text"))
    )
    misses = contents.join(known_counts(spark, name, cache_dir), "content", "left_anti")
    (
        encode_counts(misses, name)
        .select(F.lit(tokenizer_version(name)).alias("tokenizer"), "content", "n_tokens")
        .write.mode("append")
        .parquet(cache_dir)
    )


def digest(text: str = "text") -> Column:
    """SHA-256 of the normalised content, as bytes."""
    return F.unhex(F.sha2(whole(text), 256))


def _with_counts(rows: DataFrame, name: str, cache_dir: str, out: str) -> DataFrame:
    counts = known_counts(rows.sparkSession, name, cache_dir)
    counts = counts.select(F.col("content").alias("__known"), F.col("n_tokens").alias("__n"))
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in ("__key", out)]
    return rows.join(counts, F.col("__key") == F.col("__known"), "left").select(*kept, F.col("__n").alias(out))


def count_tokens(
    docs: DataFrame, name: str, cache_dir: str, text: str = "text", out: str = "n_tokens"
) -> DataFrame:
    """Add ``out``, the token count of every whole text, taking known counts from ``cache_dir``.

    The content is normalised no further than null to empty, since every other change could
    change a count. Its SHA-256 and the tokenizer's version are the key of the cache, a Parquet
    table in a folder that all executors share. A repeated append, from a second writer or a job
    that ran twice, does no harm: equal keys hold equal counts.

    All rows and columns stay, whatever their ids; a column named ``out`` is replaced. An empty
    table gives an empty table. Special strings inside texts count as the library counts them.
    """
    fill_cache(docs, name, cache_dir, text)
    return _with_counts(docs.withColumn("__key", digest(text)), name, cache_dir, out)


def measure(
    docs: DataFrame, name: str, cache_dir: str, limit: int = 1024, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row its key, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit``).

    As ``count_tokens``, but the join carries digests and sizes only, no texts.
    """
    fill_cache(docs, name, cache_dir, text)
    rows = docs.select(
        f"`{key}`", F.octet_length(whole(text)).cast("long").alias("n_bytes"), digest(text).alias("__key")
    )
    counted = _with_counts(rows, name, cache_dir, "n_tokens")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
