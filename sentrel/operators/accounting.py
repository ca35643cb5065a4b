"""What became of every input record: accepted, rejected, duplicate or unresolved.

Rules are versioned and tried in order; the first that a record breaks decides. Counts are taken from
what was written and must add up to the input, or the import fails.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCEPTED, REJECTED, DUPLICATE, UNRESOLVED = "ACCEPTED", "REJECTED", "DUPLICATE", "UNRESOLVED"
DISPOSITIONS = [ACCEPTED, REJECTED, DUPLICATE, UNRESOLVED]


@dataclass(frozen=True)
class Rule:
    """A record for which ``broken`` is true (not null) is disposed of as ``disposition``."""

    rule_id: str
    version: int
    reason: str
    broken: Column
    disposition: str = REJECTED


class Unreconciled(RuntimeError):
    """Dispositions do not add up to the input."""


def dispose(
    records: DataFrame, rules: Sequence[Rule], payload: str, order: str, known: DataFrame | None = None, device: str = ""
) -> DataFrame:
    """All records with ``disposition, rule_id, rule_version, reason`` and ``payload_sha256``.

    In this order: a record that breaks a rule is what the first such rule says; of those left that
    have equal payloads all but the one with the smallest ``order`` are DUPLICATE; one whose ``device``
    does not stand in ``known`` (a column of the same name) is UNRESOLVED; the others are ACCEPTED. A
    null payload equals nothing, a null device is unresolved. ``order`` should be unique: records of a
    payload that share the smallest are all kept.

    Duplicates are found by the payload's digest with a combined minimum, so a payload that makes up
    a third of the input is no group in one task.
    """
    for rule in rules:
        if rule.disposition not in DISPOSITIONS:
            raise ValueError(f"unknown disposition {rule.disposition}")
    first = F.lit(None)
    for rule in reversed(rules):
        what = F.struct(
            F.lit(rule.disposition).alias("disposition"),
            F.lit(rule.rule_id).alias("rule_id"),
            F.lit(rule.version).alias("rule_version"),
            F.lit(rule.reason).alias("reason"),
        )
        first = F.when(F.coalesce(rule.broken, F.lit(False)), what).otherwise(first)
    bytes_ = F.col(payload).cast("binary")
    judged = records.select("*", F.sha2(bytes_, 256).alias("payload_sha256"), first.alias("__rule"))
    open_ = F.col("__rule").isNull() if rules else F.lit(True)
    kept = (
        judged.where(open_ & F.col("payload_sha256").isNotNull())
        .groupBy(F.col("payload_sha256").alias("__sha"))
        .agg(F.min(order).alias("__first"))
    )
    judged = judged.join(kept, open_ & (F.col("payload_sha256") == F.col("__sha")), "left")
    repeated = F.coalesce(F.col(order) > F.col("__first"), F.lit(False))
    unresolved = F.lit(False)
    if known is not None:
        names = known.select(F.col(device).alias("__known")).where(F.col("__known").isNotNull()).distinct()
        judged = judged.join(names, F.col(device) == F.col("__known"), "left")
        unresolved = F.col("__known").isNull()
    own = (
        F.when(~open_, F.col("__rule.disposition") if rules else F.lit(None))
        .when(repeated, DUPLICATE)
        .when(unresolved, UNRESOLVED)
        .otherwise(ACCEPTED)
    )

    def field(name: str, duplicate: object, unknown: object) -> Column:
        rule = F.col(f"__rule.{name}") if rules else F.lit(None)
        return (
            F.when(~open_, rule).when(repeated, F.lit(duplicate)).when(unresolved, F.lit(unknown)).alias(name)
        )

    return judged.select(
        *[F.col(f"`{c}`") for c in records.columns],
        "payload_sha256",
        own.alias("disposition"),
        field("rule_id", "DUPLICATE_PAYLOAD", "UNKNOWN_DEVICE"),
        field("rule_version", 1, 1),
        field("reason", "equal payload received before", "device not in the inventory"),
    )


def dispositions(disposed: DataFrame, source: str) -> DataFrame:
    """``source, n_input`` and the number of records of each disposition; a null source is a source."""
    counts = [F.count_if(F.col("disposition") == d).alias(f"n_{d.lower()}") for d in DISPOSITIONS]
    return disposed.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n_input"), *counts)


def quarantine(disposed: DataFrame, record_id: str, source: str, received_at: str) -> DataFrame:
    """Rejected and unresolved records by reference and digest, never by payload, each OPEN."""
    return disposed.where(F.col("disposition").isin(REJECTED, UNRESOLVED)).select(
        F.col(record_id).alias("record_id"),
        F.col(source).alias("source"),
        "payload_sha256",
        "rule_id",
        "rule_version",
        "reason",
        F.col(received_at).alias("received_at"),
        F.lit("OPEN").alias("resolution"),
    )


def reconcile(counts: dict[str, int], expected: int) -> dict[str, int]:
    """The counts, if the dispositions add up to what was read and to ``expected``."""
    total = sum(counts[d] for d in DISPOSITIONS)
    if not total == counts["input"] == expected:
        raise Unreconciled(f"{total} dispositions of {counts['input']} written and {expected} input records")
    return counts


def write_accounted(disposed: DataFrame, path: str, expected: int, overwrite: bool = False) -> dict[str, int]:
    """Write the records under ``path`` by disposition and return the counts of what was written.

    The counts come from the files' footers, so they are of the rows that are there. Raises
    ``Unreconciled`` if they do not add up to ``expected``, the number of records of the input as its
    source counts them (an accepted batch's size, lines of a file), or if a record has no disposition
    of the four.
    """
    disposed.write.partitionBy("disposition").mode("overwrite" if overwrite else "errorifexists").parquet(path)
    written = disposed.sparkSession.read.schema(disposed.schema).parquet(path)
    found = {r["disposition"]: r["count"] for r in written.groupBy("disposition").count().collect()}
    counts = {"input": sum(found.values())} | {d: found.get(d, 0) for d in DISPOSITIONS}
    return reconcile(counts, expected)
