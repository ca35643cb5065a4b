"""Causal features and quality findings of sensor samples.

Both read a key's samples (a device's sensor) in the order of time without ever holding a key's
history in one task: time is cut into buckets, what a bucket adds is summed up in one row, and only
those rows are chained along a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrel.functions.scalars import bucket_of
from sentrel.functions.staging import materialise
from sentrel.operators.windows import running

HOUR_US = 3_600_000_000
#: Rows that a task sorts or puts together, some 400 bytes each: Spark deals out by compressed size.
TASK_ROWS = 500_000
#: Samples are held as whole numbers of 10^-DIGITS below 10^RANGE, so that sums are exact.
DIGITS, RANGE = 6, 9

READY = "READY"
NO_HISTORY = "INSUFFICIENT_HISTORY"


def _whole(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def _valid(value: Column) -> Column:
    """Finite and in range; comparisons with NaN and infinity fail as they should."""
    value = value.cast("double")
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < 10.0**RANGE)


def causal_features(
    readings: DataFrame,
    keys: Sequence[str],
    ts_us: str,
    value: str,
    window_us: int,
    baseline_us: int,
    least_window: int = 3,
    least_baseline: int = 10,
    bucket_us: int = HOUR_US,
) -> DataFrame:
    """What was known of a sensor at each instant: nothing later than the instant enters.

    One row per key and instant with a valid reading: ``keys, ts_us, value, n_window, mean, std,
    slope, rate, n_baseline, baseline_mean, baseline_std, deviation, status``. The window is
    [t - window_us, t], the baseline [t - baseline_us, t - window_us), so that what happens now is
    not measured by itself. ``slope`` is the least-squares slope per second over the window, ``rate``
    the change per second since the instant before, ``deviation`` the distance of the value from the
    baseline in its standard deviations (of samples, n - 1).

    ``status`` is INSUFFICIENT_HISTORY while the window or the baseline has fewer readings than
    ``least_window`` and ``least_baseline``; the figures of the side that lacks them are null then,
    as are those that do not exist (the slope of one instant, a deviation from a constant baseline).
    Readings of one instant count one by one in the figures, and their mean is the instant's value.
    Readings whose time or value is null, not finite, or 10^9 or more in size take no part; a null
    key is a key. Values are rounded to 10^-6, sums are exact whole numbers: the result depends
    neither on the partitioning nor on how long the history is (up to about 10^9 readings of a key
    over ten years).

    A window of a hot sensor is the difference of two running sums: each instant asks for the sums
    before its window's and its baseline's start as rows of their own.
    """
    if not 0 < window_us < baseline_us:
        raise ValueError("the baseline must reach back further than the window")
    keys = list(keys)
    q = F.rint(F.col(value).cast("double") * 10.0**DIGITS)
    instants = (
        readings.where(F.col(ts_us).isNotNull() & _valid(F.col(value)))
        .select(*keys, F.col(ts_us).cast("bigint").alias("t"), _whole(q).alias("q"))
        .groupBy(*keys, "t")
        .agg(F.count("*").alias("n"), F.sum("q").alias("v1"), F.sum(F.col("q") * F.col("q")).alias("v2"))
    )
    # Sums count time from the table's first instant.
    origin, n_instants = instants.agg(F.min("t"), F.count("*")).first()
    origin = origin or 0
    tasks = max(readings.sparkSession.sparkContext.defaultParallelism, -(-3 * n_instants // TASK_ROWS))
    # side 2: the instant; 1: where its window begins; 0: where its baseline does. A border comes
    # before the readings of its own instant.
    sides = [(F.col("t"), 2), (F.col("t") - window_us, 1), (F.col("t") - baseline_us, 0)]
    asked = F.explode(F.array(*[F.struct(at.alias("at"), F.lit(s).alias("side")) for at, s in sides])).alias("a")
    rows = instants.select("*", asked).select(*keys, "t", "n", "v1", "v2", "a.at", "a.side")
    own = F.col("side") == 2
    n, v1, v2 = (_whole(F.when(own, F.col(c)).otherwise(F.lit(0))) for c in ("n", "v1", "v2"))
    u = _whole(F.when(own, F.col("at") - origin).otherwise(F.lit(0)))
    parts = {"n": n, "v1": v1, "v2": v2, "s1": n * u, "s2": n * u * u, "uv": u * v1}
    named = {f"p_{c}": _whole(x) for c, x in parts.items()}
    now = F.when(own, F.struct(F.col("at").alias("t"), (F.col("v1").cast("double") / F.col("n")).alias("q")))
    along = running(rows, keys, "at", ["at", "side"], named, {"prev": now}, bucket_us, tasks)
    picks = [F.max(F.when(F.col("side") == s, F.col(f"p_{c}"))).alias(f"{c}{s}") for c in parts for s in (0, 1, 2)]
    # An instant's rows lie in different buckets: nothing to put together before they are dealt out.
    wide = along.repartition(tasks, *keys, "t").groupBy(*keys, "t").agg(
        *[F.max(F.when(own, F.col(c))).alias(c) for c in ("n", "v1")],
        *[F.max(F.when(own, F.col(f"prev.{c}"))).alias(f"prev_{c}") for c in ("t", "q")],
        *picks,
    )

    def between(side: str, late: int, early: int) -> list[Column]:
        m = {x: F.col(f"{x}{late}") - F.col(f"{x}{early}") for x in parts}

        def centre(total: Column) -> Column:
            return _whole(F.rint(F.try_divide(total.cast("double"), m["n"].cast("double"))))

        # Around their mean the sums are small, so that doubles hold them well.
        c, d = centre(m["v1"]), centre(m["s1"])
        centred = {
            "n": m["n"],
            "c": c,
            "a": m["v1"] - m["n"] * c,
            "b": m["v2"] - 2 * c * m["v1"] + m["n"] * c * c,
            "u": m["s1"] - m["n"] * d,
            "uu": m["s2"] - 2 * d * m["s1"] + m["n"] * d * d,
            "ua": m["uv"] - d * m["v1"] - c * (m["s1"] - m["n"] * d),
        }
        return [x.cast("double").alias(f"{side}_{name}") for name, x in centred.items()]

    flat = wide.select(
        *keys, "t", "prev_t", "prev_q", (F.col("v1").cast("double") / F.col("n")).alias("q"), *between("w", 2, 1), *between("b", 1, 0)
    )
    unit = F.lit(10.0**DIGITS)

    def mean(p: str) -> Column:
        return (F.col(f"{p}_c") + F.try_divide(F.col(f"{p}_a"), F.col(f"{p}_n"))) / unit

    def std(p: str) -> Column:
        n = F.col(f"{p}_n")
        left = F.col(f"{p}_b") - F.try_divide(F.col(f"{p}_a") * F.col(f"{p}_a"), n)
        return F.when(n > 1, F.sqrt(F.greatest(left, F.lit(0.0)) / (n - 1)) / unit)

    down = F.col("w_n") * F.col("w_uu") - F.col("w_u") * F.col("w_u")
    up = F.col("w_n") * F.col("w_ua") - F.col("w_u") * F.col("w_a")
    elapsed = F.col("t") - F.col("prev_t")
    window, baseline = F.col("w_n") >= least_window, F.col("b_n") >= least_baseline
    return flat.select(
        *keys,
        F.col("t").alias(ts_us),
        (F.col("q") / unit).alias("value"),
        F.col("w_n").cast("bigint").alias("n_window"),
        F.when(window, mean("w")).alias("mean"),
        F.when(window, std("w")).alias("std"),
        F.when(window & (down > 0), F.try_divide(up, down) * 1e6 / unit).alias("slope"),
        ((F.col("q") - F.col("prev_q")) * 1e6 / elapsed / unit).alias("rate"),
        F.col("b_n").cast("bigint").alias("n_baseline"),
        F.when(baseline, mean("b")).alias("baseline_mean"),
        F.when(baseline, std("b")).alias("baseline_std"),
        F.when(baseline & (std("b") > 0), F.try_divide(F.col("q") / unit - mean("b"), std("b"))).alias("deviation"),
        F.when(window & baseline, READY).otherwise(NO_HISTORY).alias("status"),
    )


#: Kinds of findings.
STUCK, GAP, SKIPPED, JUMP = "STUCK_VALUE", "SAMPLE_GAP", "SEQUENCE_GAP", "RAPID_CHANGE"


def quality_findings(
    samples: DataFrame,
    keys: Sequence[str],
    ts_us: str,
    sequence: str,
    value: str,
    cadence_us: int,
    gap_factor: float = 2.0,
    stuck_us: int = 60_000_000,
    stuck_samples: int = 3,
    most_per_second: float | None = None,
    bucket_us: int = HOUR_US,
) -> DataFrame:
    """Stuck values, gaps, missing sequence numbers and rapid changes of a key's samples.

    ``keys, kind, start_us, end_us, n_samples, missing, amount``, one row per finding:

    * STUCK_VALUE: ``stuck_samples`` or more samples in a row of one value over ``stuck_us`` or longer;
      ``amount`` is the value.
    * SAMPLE_GAP: two neighbouring samples further apart than ``gap_factor`` times ``cadence_us``;
      ``missing`` is how many samples were due between them, ``amount`` the seconds.
    * SEQUENCE_GAP: numbers left out between neighbouring samples; a number that is not higher than
      the one before is a restart and no gap.
    * RAPID_CHANGE: a change per second above ``most_per_second``, which is ``amount``. Neighbours of
      the same instant have no rate.

    Neighbours follow one another by time, then sequence number (null first), then value. Samples of
    a null time are left out. A value that is null or not finite is a sample, but of no value: it ends
    a run, is never stuck, and has no rate. A null key is a key.

    A run is summed up per time bucket and only its open ends are chained along the key, so neither a
    hot key nor a value stuck for ever is held by one task.
    """
    keys = list(keys)
    x = F.col(value).cast("double")
    fine = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sample = F.struct(
        F.col(ts_us).cast("bigint").alias("t"),
        F.col(sequence).cast("bigint").alias("s"),
        F.when(fine, x + F.lit(0.0)).alias("x"),  # minus zero is zero
    )
    part = Window.partitionBy(*keys, "b").orderBy("now")
    # Used by all that follows, hence written once.
    steps = materialise(
        samples.where(F.col(ts_us).isNotNull())
        .select(*keys, bucket_of(F.col(ts_us).cast("bigint"), bucket_us).alias("b"), sample.alias("now"))
        .withColumn("prev", F.lag("now").over(part))
        .withColumn("run", F.sum(F.when(F.col("prev.x") == F.col("now.x"), 0).otherwise(1)).over(part))
        .withColumn("last_run", F.max("run").over(Window.partitionBy(*keys, "b")))
    )
    along = Window.partitionBy(*keys).orderBy("b")
    ends = steps.groupBy(*keys, "b").agg(F.min("now").alias("now"), F.max("now").alias("last"))
    pairs = (
        steps.where(F.col("prev").isNotNull())
        .select(*keys, "prev", "now")
        .unionByName(ends.withColumn("prev", F.lag("last").over(along)).select(*keys, "prev", "now"))
        .where(F.col("prev").isNotNull())
    )
    t0, t1 = F.col("prev.t"), F.col("now.t")
    apart = t1 - t0
    none = F.lit(None)

    def finding(kind: str, when: Column, n: Column, missing: Column, amount: Column) -> Column:
        row = F.struct(
            F.lit(kind).alias("kind"),
            t0.alias("start_us"),
            t1.alias("end_us"),
            n.cast("bigint").alias("n_samples"),
            missing.cast("bigint").alias("missing"),
            amount.cast("double").alias("amount"),
        )
        return F.when(when, row)

    left_out = F.col("now.s") - F.col("prev.s") - 1
    per_second = F.try_divide((F.col("now.x") - F.col("prev.x")) * 1e6, apart.cast("double"))
    kinds = [
        # As whole numbers of the cadence, rounded up: what would have stood strictly between.
        finding(GAP, apart > gap_factor * cadence_us, F.lit(2), F.ceil(apart / cadence_us) - 1, apart / 1e6),
        finding(SKIPPED, left_out > 0, F.lit(2), left_out, none),
    ]
    if most_per_second is not None:
        kinds.append(finding(JUMP, F.abs(per_second) > most_per_second, F.lit(2), none, per_second))
    found = pairs.select(*keys, F.inline(F.array_compact(F.array(*kinds))))

    runs = steps.groupBy(*keys, "b", "run").agg(
        F.min("now.t").alias("start_us"),
        F.max("now.t").alias("end_us"),
        F.count("*").alias("n_samples"),
        F.first("now.x").alias("amount"),
        F.first("last_run").alias("last_run"),
    )
    # A bucket's first run may go on from the row before, which is the last run of the bucket before.
    edge = (F.col("run") == 1) | (F.col("run") == F.col("last_run"))
    order = Window.partitionBy(*keys).orderBy("b", "run")
    goes_on = (F.col("run") == 1) & (F.lag("amount").over(order) == F.col("amount"))
    open_ends = (
        runs.where(edge)
        .withColumn("goes_on", goes_on)
        .withColumn("id", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(order))
        .groupBy(*keys, "id")
        .agg(
            F.min("start_us").alias("start_us"),
            F.max("end_us").alias("end_us"),
            F.sum("n_samples").alias("n_samples"),
            F.first("amount").alias("amount"),
        )
    )
    columns = [*keys, "start_us", "end_us", "n_samples", "amount"]
    long_enough = (F.col("n_samples") >= stuck_samples) & (F.col("end_us") - F.col("start_us") >= stuck_us)
    stuck = (
        runs.where(~edge)
        .select(*columns)
        .unionByName(open_ends.select(*columns))
        .where(long_enough & F.col("amount").isNotNull())
        .withColumns({"kind": F.lit(STUCK), "missing": F.lit(None).cast("bigint")})
    )
    return found.unionByName(stuck)
