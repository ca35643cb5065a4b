"""Earliest qualifying sliding window per key, prefix maxima: skew-safe building blocks.

A plain RANGE frame puts every row of a key in one task and re-reads the frame for each row.
Here time is cut into slices of one window length, so a window that starts in slice ``j``
touches only ``j`` and ``j + 1``, and each (key, slice, value) group is reduced to a few
timestamps before anything is put together. Neither a hot key nor a hot slice is ever held
by one task as raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrel.functions.scalars import bucket_of
from sentrel.functions.staging import materialise


@dataclass(frozen=True)
class Criterion:
    """At least ``min_values`` distinct values, each seen ``repeats`` times or more.

    ``small_domain`` says that the values come from a closed vocabulary (behaviour classes).
    It is needed for ``repeats > 1``, where values cannot be cut to a fixed number per slice.
    """

    value: str
    min_values: int
    repeats: int = 1
    small_domain: bool = False


def _single_edges(ev: DataFrame, keys: list[str], criteria: dict[int, Criterion]) -> DataFrame:
    """Last (``l``) and first (``r``, counted to the slice before) times of values per slice;
    ``crit`` -1 stands for the slice's last event.

    One pass with map-side aggregation, then one ranking that keeps the 2T - 1 earliest values of a
    slice when T are needed. A slice with T values or more qualifies from its start, whichever of
    them are kept; one with fewer keeps them all, and T of the next slice's are not among them.
    """
    choices = [F.struct(F.lit(-1).alias("crit"), F.lit(None).cast("string").alias("val"))]
    for n, c in criteria.items():
        choices.append(F.struct(F.lit(n).alias("crit"), F.col(c.value).cast("string").alias("val")))
    most = max([c.min_values for c in criteria.values()], default=1)
    rank = F.row_number().over(Window.partitionBy(*keys, "slice", "crit").orderBy("lo", "hi", "val"))
    none = F.lit(None).cast("bigint")
    sides = F.array(
        F.struct(F.col("slice").alias("at"), F.col("hi").alias("l"), none.alias("r")),
        F.struct((F.col("slice") - 1).alias("at"), none.alias("l"), F.col("lo").alias("r")),
    )
    return (
        ev.select(*keys, "slice", "t", F.inline(F.array(*choices)))
        .where((F.col("crit") == -1) | F.col("val").isNotNull())
        .groupBy(*keys, "slice", "crit", "val")
        .agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
        .withColumn("rk", rank)
        .where(F.col("rk") <= 2 * most - 1)
        .select(*keys, "crit", "val", F.inline(sides))
        .select(*keys, F.col("at").alias("slice"), "crit", "val", F.lit(1).alias("rk"), "l", "r")
    )


def _repeat_edges(ev: DataFrame, keys: list[str], n: int, crit: Criterion):
    """Last and first ``repeats`` times of each value of a closed vocabulary per slice, as above."""
    rows = ev.where(F.col(crit.value).isNotNull()).select(
        *keys, "slice", F.lit(n).alias("crit"), F.col(crit.value).cast("string").alias("val"), "t"
    )
    part = Window.partitionBy(*keys, "slice", "val")

    def cut(order, slice_, left, right):
        rank = F.row_number().over(part.orderBy(order))
        kept = rows.withColumn("rk", rank).where(F.col("rk") <= crit.repeats)
        return kept.select(*keys, slice_.alias("slice"), "crit", "val", "rk", left.alias("l"), right.alias("r"))

    t, none = F.col("t"), F.lit(None).cast("bigint")
    return cut(t.desc(), F.col("slice"), t, none).union(cut(t, F.col("slice") - 1, none, t))


def _marks(repeats: int, width: int) -> list[tuple[Column, int]]:
    """Where the ranges of start instants for which a value is seen ``repeats`` times begin (1) and
    have ended (-1); null for ranges that do not exist or last to the end of the slice.

    Reads ``l1, l2, ...``, its latest times in the slice, and ``r1, r2, ...``, its earliest in
    the next one. The ranges are disjoint.
    """
    first = F.col("slice") * width
    final = first + (width - 1)
    marks, covered = [], F.lit(None).cast("bigint")
    for i in range(repeats + 1):  # i occurrences in the next slice, the others in this one
        own = repeats - i
        lo = F.greatest(F.col(f"r{i}") - width, first, covered + 1) if i else first
        hi = F.col(f"l{own}") if own else final
        exists = lo <= hi
        if i:
            exists = exists & F.col(f"r{i}").isNotNull()
        marks += [(F.when(exists, lo), 1), (F.when(exists & (hi < final), hi + 1), -1)]
        covered = F.greatest(covered, F.when(exists, hi))
    return marks


def _cut(events: DataFrame, ts_us: str, window_us: int) -> DataFrame:
    """Events with their instant as ``t`` and its ``slice`` of one window length."""
    rows = events.where(F.col(ts_us).isNotNull())
    return rows.withColumn("t", F.col(ts_us)).withColumn("slice", bucket_of("t", window_us))


def _points(
    events: DataFrame, keys: list[str], ts_us: str, window_us: int, criteria: Sequence[Criterion]
) -> DataFrame:
    """Per key, the first instant ``p`` from which on the next event starts a window that qualifies,
    and the ``slice`` that holds both."""
    for crit in criteria:
        if crit.repeats > 1 and not crit.small_domain:
            raise ValueError("repeated values need a closed vocabulary (small_domain=True)")
    ev = _cut(events, ts_us, window_us).select(*keys, "t", "slice", *sorted({c.value for c in criteria}))
    single = {n: c for n, c in enumerate(criteria) if c.repeats == 1}
    edges = [_single_edges(ev, keys, single)]
    edges += [_repeat_edges(ev, keys, n, c) for n, c in enumerate(criteria) if n not in single]
    # From here on a (key, slice) has a bounded number of rows, so one shuffle on it serves the
    # grouping by value and the sweep.
    values = (
        reduce(DataFrame.union, edges)
        .repartition(*keys, "slice")
        .groupBy(*keys, "slice", "crit", "val")
        .agg(
            *[
                F.max(F.when(F.col("rk") == i, F.col(side))).alias(f"{side}{i}")
                for side in ("l", "r")
                for i in range(1, max(c.repeats for c in criteria) + 1)
            ]
        )
    )
    # Most slices do not have enough values, so nothing of them is swept.
    part = Window.partitionBy(*keys, "slice")
    enough = [F.count_if(F.col("crit") == n).over(part) >= c.min_values for n, c in enumerate(criteria)]
    values = values.withColumn("enough", reduce(lambda a, b: a | b, enough)).where("enough")
    # The last event of a slice tells whether a range without an own event holds a start.
    bounds = [F.struct(F.when(F.col("crit") == -1, F.col("slice") * window_us).alias("p"), F.lit(0).alias("d"))]
    for repeats in sorted({c.repeats for c in criteria}):
        mine = F.col("crit").isin([n for n, c in enumerate(criteria) if c.repeats == repeats])
        bounds += [F.struct(F.when(mine, p).alias("p"), F.lit(d).alias("d")) for p, d in _marks(repeats, window_us)]
    sweep = values.select(
        *keys, "slice", "crit", F.when(F.col("crit") == -1, F.col("l1")).alias("last_t"), F.inline(F.array(*bounds))
    ).where(F.col("p").isNotNull())
    met = F.lit(False)
    for n, crit in enumerate(criteria):
        # Coverage counts the values that a start instant satisfies.
        cover = F.sum(F.when(F.col("crit") == n, F.col("d"))).over(part.orderBy("p"))
        met = met | (F.coalesce(cover, F.lit(0)) >= crit.min_values)
    # One row per key. Written out, its size is known, so the joins with all events broadcast it
    # while it is small and shuffle otherwise.
    return materialise(
        sweep.withColumn("met", met)
        .withColumn("last_t", F.max("last_t").over(part))
        .where(F.col("met") & (F.col("p") <= F.col("last_t")))
        .groupBy(*keys)
        .agg(F.min("p").alias("p"))
        .withColumn("slice", bucket_of("p", window_us))
    )


def _starts(rows: DataFrame, keys: list[str], window_us: int) -> DataFrame:
    """The first instant of each key in ``rows``, and the end of its window."""
    starts = rows.groupBy(*keys).agg(F.min("t").alias("start_us"))
    return starts.withColumn("end_us", F.col("start_us") + window_us)


def first_windows(
    events: DataFrame,
    keys: Sequence[str],
    ts_us: str,
    window_us: int,
    criteria: Sequence[Criterion],
) -> DataFrame:
    """Per key, the first event instant ``s`` whose window [s, s + window] meets a criterion.

    Returns ``keys, start_us, end_us``. Windows start at events; any one criterion suffices.
    """
    keys = list(keys)
    points = _points(events, keys, ts_us, window_us, criteria)
    ahead = _cut(events, ts_us, window_us).select(*keys, "slice", "t").join(points, [*keys, "slice"])
    return materialise(_starts(ahead.where(F.col("t") >= F.col("p")), keys, window_us))


def first_window_events(
    events: DataFrame,
    keys: Sequence[str],
    ts_us: str,
    window_us: int,
    criteria: Sequence[Criterion],
) -> DataFrame:
    """The events inside their key's first window (see ``first_windows``), with ``start_us, end_us``.

    One pass over the events after the search, joined on (key, slice), so a hot key is spread out:
    it leaves each key's events of two slices from the point on, whose first one is the start.
    """
    keys = list(keys)
    points = _points(events, keys, ts_us, window_us, criteria)
    spans = points.withColumn("slice", F.explode(F.array("slice", F.col("slice") + 1)))
    ahead = materialise(
        _cut(events, ts_us, window_us).join(spans, [*keys, "slice"]).where(F.col("t") >= F.col("p"))
    )
    inside = ahead.join(_starts(ahead, keys, window_us), keys).where(F.col("t") <= F.col("end_us"))
    return inside.drop("t", "slice", "p")


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where null is a key like any other; the keys of ``left`` stay."""
    named = {k: f"__key{i}" for i, k in enumerate(keys)}
    other = right.select(*[F.col(f"`{c}`").alias(named.get(c, c)) for c in right.columns])
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[n]) for k, n in named.items()])
    return left.join(other, same, how).drop(*named.values())


def prefix_max(
    rows: DataFrame,
    keys: Sequence[str],
    ts_us: str,
    order: Sequence[str],
    value: Column | str,
    out: str,
    bucket_us: int = 3_600_000_000,
) -> DataFrame:
    """``out`` = the largest value among all earlier rows of the key, null for the first.

    Two levels: maxima of time buckets are chained first (one row per key and bucket), then
    each bucket is scanned on its own, so a key's history is never in one task.
    """
    keys = list(keys)
    value = F.col(value) if isinstance(value, str) else value
    tagged = rows.withColumn("__b", bucket_of(ts_us, bucket_us)).withColumn("__v", value)
    chain = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    heads = (
        tagged.groupBy(*keys, "__b")
        .agg(F.max("__v").alias("__m"))
        .select(*keys, "__b", F.max("__m").over(chain).alias("__head"))
    )
    inside = (
        Window.partitionBy(*keys, "__b")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        join_on_keys(tagged, heads, [*keys, "__b"])
        .withColumn(out, F.greatest("__head", F.max("__v").over(inside)))
        .drop("__b", "__v", "__head")
    )


def running(
    rows: DataFrame,
    keys: Sequence[str],
    ts_us: str,
    order: Sequence[Column | str],
    sums: dict[str, Column],
    latest: dict[str, Column] | None = None,
    bucket_us: int = 3_600_000_000,
    tasks: int | None = None,
) -> DataFrame:
    """Running sums and maxima along a key: ``sums`` up to and including each row, ``latest`` before it.

    ``order`` must begin with ``ts_us`` and leave no ties that matter. Two levels, and one shuffle of
    the rows: what a time bucket adds is chained along the key (one row per key and bucket), and the
    chained value goes into its bucket as a first row, so a key's history is never in one task. Null
    keys are a key; null values add nothing. ``tasks`` is how many the rows are dealt to, by default
    Spark's number.
    """
    keys, latest = list(keys), latest or {}
    added = {f"__{out}": value for out, value in (sums | latest).items()}
    tagged = rows.withColumn("__b", bucket_of(ts_us, bucket_us)).withColumns(added)
    fold = {out: F.sum if out in sums else F.max for out in sums | latest}
    chain = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    heads = (
        tagged.groupBy(*keys, "__b")
        .agg(*[f(f"__{out}").alias(f"__{out}") for out, f in fold.items()])
        .select(*keys, "__b", *[f(f"__{out}").over(chain).alias(f"__{out}") for out, f in fold.items()])
        .withColumn("__row", F.lit(0))
    )
    part = Window.partitionBy(*keys, "__b").orderBy("__row", *order)
    through = part.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = part.rowsBetween(Window.unboundedPreceding, -1)
    led = tagged.withColumn("__row", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    if tasks:
        led = led.repartition(tasks, *keys, "__b")
    return (
        led.withColumns({out: f(f"__{out}").over(through if out in sums else before) for out, f in fold.items()})
        .where("__row = 1")
        .drop("__b", "__row", *added)
    )


def numbered(
    rows: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence, out: str, total: str
) -> DataFrame:
    """Position of each row within its key (from 1) and the key's row count.

    ``bucket`` must rise with ``order``; row counts of the buckets are chained first, so only
    one bucket at a time is sorted by a task.
    """
    keys = list(keys)
    tagged = rows.withColumn("__b", bucket)
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    heads = (
        tagged.groupBy(*keys, "__b")
        .agg(F.count("*").alias("__n"))
        .select(
            *keys,
            "__b",
            F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__head"),
            F.sum("__n").over(Window.partitionBy(*keys)).alias(total),
        )
    )
    inside = Window.partitionBy(*keys, "__b").orderBy(*order)
    return (
        join_on_keys(tagged, heads, [*keys, "__b"])
        .withColumn(out, F.col("__head") + F.row_number().over(inside))
        .drop("__b", "__head")
    )


def quantiles(
    values: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float], cuts: int = 100
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per key and probability.

    Equal values are counted first. Approximate quantiles then cut each key into buckets; the
    bucket totals tell in which bucket a position lies, so no task sorts a whole key.
    """
    keys = list(keys)
    counts = (
        values.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("v"))
        .agg(F.count("*").alias("n"))
    )
    edges = materialise(
        counts.groupBy(*keys).agg(
            F.percentile_approx("v", [i / cuts for i in range(1, cuts)], 10 * cuts).alias("e")
        )
    )
    bucketed = join_on_keys(counts, edges, keys).withColumn(
        "b", F.size(F.filter(F.array_distinct("e"), lambda x: x <= F.col("v")))
    ).drop("e")
    before = Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    heads = (
        bucketed.groupBy(*keys, "b")
        .agg(F.sum("n").alias("m"))
        .select(
            *keys,
            "b",
            F.coalesce(F.sum("m").over(before), F.lit(0)).alias("head"),
            F.sum("m").over(Window.partitionBy(*keys)).alias("total"),
        )
    )
    inside = Window.partitionBy(*keys, "b").orderBy("v")
    ranked = (
        join_on_keys(bucketed, heads, [*keys, "b"])
        .withColumn("last", F.col("head") + F.sum("n").over(inside) - 1)
        .withColumn("first", F.col("last") - F.col("n") + 1)
    )
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("p")
    spot = F.col("p") * (F.col("total") - 1)
    low, high = F.floor(spot), F.ceil(spot)
    at = ranked.select("*", wanted)
    return (
        at.where((F.col("first") <= high) & (F.col("last") >= low))
        .groupBy(*keys, "p")
        .agg(
            F.min("v").alias("lo"),
            F.max("v").alias("hi"),
            F.first(spot - low).alias("w"),
        )
        .select(*keys, "p", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("w")).alias("q"))
    )
