"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel.functions.fixed import SEVERITY_WEIGHTS


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_instant(c: Column | str) -> Column:
    """ISO-8601 text (``Z``, offset or naive, read as UTC) to TIMESTAMP; bad text is null."""
    return F.try_to_timestamp(F.trim(col(c)))


def to_number(c: Column | str) -> Column:
    """Text to DOUBLE; text that is no number is null."""
    return F.expr("try_cast(x as double)") if c == "x" else col(c).try_cast("double")


def finite_or(c: Column | str, other: Column) -> Column:
    """Infinity becomes ``other``; NaN counts as missing and becomes null."""
    c = col(c)
    return F.when(F.isnan(c), F.lit(None)).when(F.abs(c) == float("inf"), other).otherwise(c)


def severity_weight(c: Column | str) -> Column:
    """CRITICAL 4 ... LOW 1, anything else 0, ignoring case."""
    upper = F.upper(col(c))
    weight = F.lit(0)
    for name, value in SEVERITY_WEIGHTS.items():
        weight = F.when(upper == name, value).otherwise(weight)
    return weight


def lookup(c: Column | str, mapping: dict[str, str], default: Column | str) -> Column:
    """Literal map lookup with a default, without a join or a UDF."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    default = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(c)), default)


def host_id(prefix: str, source: Column | str, suffix: str = "") -> Column:
    """Incident id: prefix, source with dots as dashes, suffix."""
    return F.concat(F.lit(prefix), F.translate(col(source), ".", "-"), F.lit(suffix))


def title_case(c: Column | str) -> Column:
    """``PORT_SCAN`` to ``Port Scan``."""
    return F.initcap(F.lower(F.translate(col(c), "_", " ")))


def bucket_of(us: Column | str, width_us: int) -> Column:
    """Number of the time bucket holding ``us``; floors below zero too."""
    us = col(us)
    return ((us - F.pmod(us, F.lit(width_us))) / width_us).cast("bigint")


def hex_pads(key: bytes) -> tuple[str, str]:
    """Inner and outer HMAC-SHA-256 pads of a key, as hex."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block).hex(), bytes(b ^ 0x5C for b in block).hex()


def hmac_sha256(raw: Column | str, key: bytes) -> Column:
    """HMAC-SHA-256 of BINARY data as lower-case hex, in built-in expressions."""
    inner, outer = hex_pads(key)
    digest = F.sha2(F.concat(F.unhex(F.lit(inner)), col(raw)), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(digest)), 256)


def is_hex64(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(r"\A[0-9a-fA-F]{64}\z"), F.lit(False))


def evaluated_once(df: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """``keep`` plus computed columns that later filters do not evaluate again.

    A filter on a plain projection is pushed below it with the expressions written out, which
    repeats costly parsing for every use. It is not pushed below a generator.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*keep, F.inline(F.array(row)))
