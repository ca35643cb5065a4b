"""Incidents in event-time windows that late evidence amends, and findings that stand close in time.

Evidence arrives in numbered batches. The watermark after a batch is the latest instant seen so far
less the allowed lateness; a window's incident is final, version 1, when the watermark reaches the
window's end. What arrives for a closed window afterwards is late: it is kept, counted and makes a
new version, so nothing vanishes and no version is ever changed.

``streaming.late`` does the same batch by batch on a stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrel.functions.scalars import bucket_of
from sentrel.functions.staging import materialise

FINAL, AMENDED, OPENED_LATE = "FINAL", "AMENDED", "OPENED_LATE"


def partial_evidence(events: DataFrame, keys: Sequence[str], ts_us: str, window_us: int) -> DataFrame:
    """What a batch adds to each key and window: ``keys, window_us, n, first_us, last_us``.

    ``window_us`` is the window's first instant. Events of a null time belong to no window.
    """
    t = F.col(ts_us).cast("bigint")
    return (
        events.where(t.isNotNull())
        .withColumns({"__t": t, "__w": bucket_of(t, window_us) * window_us})
        .groupBy(*keys, F.col("__w").alias("window_us"))
        .agg(F.count("*").alias("n"), F.min("__t").alias("first_us"), F.max("__t").alias("last_us"))
    )


def _watermarks(partial: DataFrame, lateness_us: int) -> DataFrame:
    """``batch_id, before, after``: the watermark a batch meets and the one it leaves."""
    # One row per batch.
    so_far = Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heads = partial.groupBy("batch_id").agg(F.max("last_us").alias("m"))
    after = F.max("m").over(so_far) - lateness_us
    return heads.select("batch_id", after.alias("after")).select(
        "*", F.lag("after").over(Window.orderBy("batch_id")).alias("before")
    )


def incident_versions(
    events: DataFrame,
    keys: Sequence[str],
    ts_us: str,
    batch_id: str,
    window_us: int,
    lateness_us: int,
    least: int,
) -> DataFrame:
    """All versions of all incidents: ``keys, window_us, version, batch_id, status, n_events, n_late,
    n_added, first_us, last_us``.

    A key has an incident in a window (``window_us``: its first instant) with ``least`` or more events.
    Version 1 is FINAL if the events that came in time suffice, OPENED_LATE if only late ones made
    them enough; each later batch with evidence for the window makes an AMENDED version. ``batch_id``
    is the batch that made the version, ``n_added`` what it added, ``n_late`` the late events so far.
    Windows that the last watermark has not reached have no version yet. Events of a null time or
    batch take no part; a null key is a key.
    """
    keys = list(keys)
    dated = events.where(F.col(batch_id).isNotNull()).withColumn("__batch", F.col(batch_id).cast("bigint"))
    partial = materialise(
        partial_evidence(dated, [*keys, "__batch"], ts_us, window_us).withColumnRenamed("__batch", "batch_id")
    )
    marks = materialise(_watermarks(partial, lateness_us))
    end = F.col("window_us") + window_us
    # The batch that closes a window is the first whose watermark reaches its end: looking back from
    # the latest instant, the smallest batch number so far. One row per window or batch, for all keys.
    ends = partial.select(end.alias("p")).distinct().withColumns({"b": F.lit(None).cast("bigint"), "side": F.lit(1)})
    points = marks.select(F.col("after").alias("p"), F.col("batch_id").alias("b"), F.lit(0).alias("side")).union(ends)
    back = Window.orderBy(F.col("p").desc(), "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    closed = points.withColumn("closing", F.min("b").over(back)).where("side = 1")
    closing = closed.where(F.col("closing").isNotNull()).select((F.col("p") - window_us).alias("window_us"), "closing")
    late = F.coalesce(F.col("batch_id") > F.col("closing"), F.lit(False))
    step = F.when(late, F.col("batch_id")).otherwise(F.col("closing"))
    steps = (
        partial.join(closing, "window_us")
        .withColumn("late", late)
        .groupBy(*keys, "window_us", step.alias("batch_id"))
        .agg(
            F.sum("n").alias("n_added"),
            F.sum(F.when(F.col("late"), F.col("n")).otherwise(0)).alias("late_added"),
            F.min("first_us").alias("f"),
            F.max("last_us").alias("l"),
        )
    )
    part = Window.partitionBy(*keys, "window_us").orderBy("batch_id")
    through = part.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = steps.select(
        *keys,
        "window_us",
        "batch_id",
        F.sum("n_added").over(through).alias("n_events"),
        F.sum("late_added").over(through).alias("n_late"),
        "n_added",
        F.min("f").over(through).alias("first_us"),
        F.max("l").over(through).alias("last_us"),
    )
    return (
        summed.where(F.col("n_events") >= least)
        .withColumn("version", F.row_number().over(part))
        .withColumn("status", version_status(F.col("version"), F.col("n_late")))
        .select(*keys, "window_us", "version", "batch_id", "status", "n_events", "n_late", "n_added", "first_us", "last_us")
    )


def version_status(version: Column, n_late: Column) -> Column:
    return F.when(version > 1, AMENDED).when(n_late > 0, OPENED_LATE).otherwise(FINAL)


def lateness_counts(
    events: DataFrame, ts_us: str, batch_id: str, window_us: int, lateness_us: int
) -> DataFrame:
    """``batch_id, n_events, n_late, n_undated``: every event of every batch, counted once."""
    t, b = F.col(ts_us).cast("bigint"), F.col(batch_id).cast("bigint")
    rows = events.select(b.alias("batch_id"), t.alias("last_us"))
    marks = _watermarks(rows.where("last_us IS NOT NULL AND batch_id IS NOT NULL"), lateness_us)
    counted = rows.groupBy("batch_id", (bucket_of("last_us", window_us) * window_us).alias("w")).agg(F.count("*").alias("n"))
    # A batch without a dated event meets no watermark, but has no late event either.
    late = F.coalesce(F.col("w") + window_us <= F.col("before"), F.lit(False))
    return (
        counted.join(marks, "batch_id", "left")
        .groupBy("batch_id")
        .agg(
            F.sum("n").alias("n_events"),
            F.sum(F.when(late, F.col("n")).otherwise(0)).alias("n_late"),
            F.sum(F.when(F.col("w").isNull(), F.col("n")).otherwise(0)).alias("n_undated"),
        )
    )


def nearby_findings(
    sensor: DataFrame,
    network: DataFrame,
    key: str,
    within_seconds: int,
    rule: str = "sensor-network-1",
    mark_first: bool = False,
) -> DataFrame:
    """Pairs of a sensor and a network finding of one device at most ``within_seconds`` apart.

    Both sides: ``key, ts`` (timestamp) and a ``finding_id``. The result has ``key, sensor_id,
    network_id, sensor_ts, network_ts, rule, association``; the association is possible, nothing says
    that one finding caused the other. The join is on (device, time slice), each sensor finding looking
    into the one to two slices around it, so a device with many findings is spread over tasks. The
    same code runs on streams if both sides carry a watermark; state is bounded by it. Findings of a
    null device or time are near nothing.

    Findings may come twice. ``mark_first`` (not on streams) adds ``first``, true for one of the pairs of
    the same device, sensor finding, its time and network id; null ids have none. It is known from each
    side by itself, so distinct ids are counted without bringing a finding's pairs together.
    """
    wide = 2 * within_seconds
    s = sensor.where(F.col("ts").isNotNull()).select(
        F.col(key), F.col("finding_id").alias("sensor_id"), F.col("ts").alias("sensor_ts")
    )
    n = network.where(F.col("ts").isNotNull()).select(
        F.col(key).alias("__key"), F.col("finding_id").alias("network_id"), F.col("ts").alias("network_ts")
    )
    gap = F.expr(f"INTERVAL {int(within_seconds)} SECONDS")
    marks = []
    if mark_first:
        same = Window.partitionBy(key, "sensor_id", "sensor_ts").orderBy("sensor_ts")
        s = s.withColumn("__once", F.row_number().over(same) == 1)
        # Of a network id's findings near a sensor finding, the earliest has none of its id before it there.
        anyhow = F.when(F.col("network_id").isNull(), F.col("network_ts"))  # no id, no group of them all
        seen = Window.partitionBy("__key", "network_id", anyhow).orderBy("network_ts")
        n = n.withColumn("__before", F.lag("network_ts").over(seen))
        fresh = F.col("__before").isNull() | (F.col("__before") < F.col("sensor_ts") - gap)
        marks = [(F.col("__once") & F.col("network_id").isNotNull() & fresh).alias("first")]
    us = F.unix_micros("sensor_ts")
    ends = [bucket_of(us + d * within_seconds * 1_000_000, wide * 1_000_000) for d in (-1, 1)]
    s = s.withColumn("slice", F.explode(F.array_distinct(F.array(*ends))))
    n = n.withColumn("__slice", bucket_of(F.unix_micros("network_ts"), wide * 1_000_000))
    near = (
        (F.col(key) == F.col("__key"))
        & (F.col("slice") == F.col("__slice"))
        & (F.col("network_ts") >= F.col("sensor_ts") - gap)
        & (F.col("network_ts") <= F.col("sensor_ts") + gap)
    )
    return s.join(n, near).select(
        key,
        "sensor_id",
        "network_id",
        "sensor_ts",
        "network_ts",
        F.lit(rule).alias("rule"),
        F.lit("POSSIBLE").alias("association"),
        *marks,
    )


def correlated_incidents(pairs: DataFrame, key: str) -> DataFrame:
    """One possible incident for each sensor finding that has network findings near it.

    Each network finding is counted once for an incident: ``key, sensor_id, sensor_ts, n_network,
    first_network_ts, last_network_ts, rule``. Of pairs that say which are ``first``, those are counted:
    what a task has of a finding is one row before it is shuffled, however many pairs there are.
    """
    n = F.count_if("first") if "first" in pairs.columns else F.count_distinct("network_id")
    return pairs.groupBy(key, "sensor_id", "sensor_ts", "rule").agg(
        n.alias("n_network"),
        F.min("network_ts").alias("first_network_ts"),
        F.max("network_ts").alias("last_network_ts"),
    )
