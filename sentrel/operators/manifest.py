"""Dataset manifests: digests that do not depend on order, partitioning or file layout.

A row's digest is 256 bits; a set of rows has the sums of its rows' digests, piece by piece, so
digests of parts add up to the digest of the whole and repeated rows count. Sums by prefixes of the
key's digest form a tree in which two versions of a data set are compared down to the few leaves that
differ. The digest finds changes and mix-ups; it is no signature against someone who forges rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PIECES = 4


def canonical(columns: Sequence[str]) -> Column:
    """Columns as one text that tells null from empty and where each value ends."""
    parts = []
    for c in columns:
        text = F.col(f"`{c}`").cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("~")))
    return F.concat(*parts)


def _pieces(digest: Column) -> list[Column]:
    number = lambda i: F.conv(F.substring(digest, 16 * i + 1, 16), 16, 10)
    return [number(i).cast("decimal(20,0)").alias(f"p{i}") for i in range(_PIECES)]


def _sums(prefix: str = "p") -> list[Column]:
    """Sums of pieces, which fit for some 10^18 rows."""
    return [F.sum(F.col(f"{prefix}{i}")).cast("decimal(38,0)").alias(f"p{i}") for i in range(_PIECES)]


def _hex() -> Column:
    parts = [(F.col(f"p{i}") % F.lit(Decimal(1 << 64))) for i in range(_PIECES)]
    # In two halves, since conv takes no more than 64 bits and bigint has a sign.
    half = F.lit(Decimal(1 << 32))
    texts = []
    for p in parts:
        high, low = F.floor(p / half).cast("bigint"), (p % half).cast("bigint")
        texts += [F.lpad(F.lower(F.hex(x)), 8, "0") for x in (high, low)]
    return F.concat(*texts)


def manifest(rows: DataFrame, columns: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """``groups, n_rows, digest``: rows and digest of each group, such as source, class and split.

    ``columns`` say what a row is; the digest of a group of groups is the sum of theirs. Null values,
    and null groups, count as such.
    """
    digest = F.sha2(canonical(columns), 256)
    return (
        rows.select(*groups, *_pieces(digest))
        .groupBy(*groups)
        .agg(F.count("*").alias("n_rows"), *_sums())
        .select(*groups, "n_rows", _hex().alias("digest"))
    )


def digest_tree(rows: DataFrame, columns: Sequence[str], key: Sequence[str], depth: int = 3) -> DataFrame:
    """``level, prefix, n_rows, digest`` of all nodes: prefixes of 0 to ``depth`` hex digits of the key's digest.

    The rows are summed up to 16 ** ``depth`` leaves in one pass; inner nodes are sums of leaves.
    """
    leaf = F.substring(F.sha2(canonical(key), 256), 1, depth)
    leaves = (
        rows.select(leaf.alias("leaf"), *_pieces(F.sha2(canonical(columns), 256)))
        .groupBy("leaf")
        .agg(F.count("*").alias("n_rows"), *_sums())
    )
    level = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")
    nodes = leaves.select("*", level).withColumn("prefix", F.substring("leaf", F.lit(1), F.col("level")))
    return (
        nodes.groupBy("level", "prefix")
        .agg(F.sum("n_rows").alias("n_rows"), *_sums())
        .select("level", "prefix", "n_rows", _hex().alias("digest"))
    )


def differing_leaves(before: DataFrame, after: DataFrame) -> DataFrame:
    """``prefix, rows_before, rows_after`` of the leaves of two trees that differ; none if all are equal.

    Trees are small whatever the data; rows of a leaf are those whose key's digest has its prefix.
    """
    depth = before.agg(F.max("level")).union(after.agg(F.max("level"))).agg(F.max("max(level)")).first()[0]
    sides = [
        d.where(F.col("level") == depth).select("prefix", F.col("n_rows").alias(f"rows_{n}"), F.col("digest").alias(n))
        for n, d in (("before", before), ("after", after))
    ]
    changed = ~F.col("before").eqNullSafe(F.col("after"))
    zero = F.lit(0).cast("bigint")
    return sides[0].join(sides[1], "prefix", "full").where(changed).select(
        "prefix", F.coalesce("rows_before", zero).alias("rows_before"), F.coalesce("rows_after", zero).alias("rows_after")
    )
