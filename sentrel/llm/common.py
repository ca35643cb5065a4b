"""Helpers that several operators of this package share."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and the control characters from tab to carriage return.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def count_words(column: Column) -> Column:
    """Number of words of a text without building them: starts of word runs."""
    return F.regexp_count(column, F.lit(WORD)).cast("long")


def tokenizer_path(name: str) -> str:
    """Where a file of the installed public tokenizers lies on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def file_digest(path: str) -> str:
    """Hex digest of a file's content, with its name in front."""
    import hashlib

    with open(path, "rb") as f:
        return f"{os.path.basename(path)}:{hashlib.sha256(f.read()).hexdigest()}"


def slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that none holds more than about ``most_bytes`` of ``column``.

    A single longer value stays whole.
    """
    for batch in batches:
        rows, size = batch.num_rows, batch.column(column).nbytes
        parts = max(1, min(rows, -(-size // most_bytes)))
        step = -(-rows // parts) if rows else 1
        for start in range(0, rows, step):
            yield batch.slice(start, step)
