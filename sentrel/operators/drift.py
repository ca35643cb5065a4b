"""Drift of feature distributions from mergeable sketches and histograms.

One pass leaves a quantile sketch per group, day and feature. The sketches of any days, merged, give the
edges of bins with equal shares of these reference days; a second pass counts each day's values by
bin. Any days are then compared with any others by adding up counts, without reading rows again. The
counts are exact. A sketch of parameter k ranks a value with an error of about 2.3 / k ** 0.9 of the
rows at most (99 %) and is exact up to k values, so edges may be off by that share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
#: Sketch size; its rank error is about 0.13 %.
K = 4096
#: Shares of a bin below this count as this, so that an empty bin has a finite weight.
LEAST_SHARE = 1e-4
STABLE, MODERATE, MAJOR = "STABLE", "MODERATE", "MAJOR"
#: Index at which a distribution counts as moved, and as another one.
MODERATE_PSI, MAJOR_PSI = 0.1, 0.25


def _finite(c: Column) -> Column:
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def daily_sketches(
    rows: DataFrame, ts_us: str, features: Sequence[str], groups: Sequence[str] = (), k: int = K
) -> DataFrame:
    """``groups, day, feature, n, n_missing, sketch``: one pass, combined on the map side.

    ``day`` counts days since 1970 (UTC). Null and non-finite values are missing; a group and day
    without any value has a null sketch. Rows of a null time are left out; a null group is a group.
    """
    day = F.floor(F.col(ts_us).cast("bigint") / DAY_US).alias("day")
    values = {f"v{i}": _finite(F.col(f"`{f}`")) for i, f in enumerate(features)}
    measured = []
    for v in values:
        measured += [F.count(v).alias(f"n_{v}"), F.kll_sketch_agg_double(v, k).alias(f"s_{v}")]
    wide = (
        rows.where(F.col(ts_us).isNotNull())
        .select(*groups, day, *[x.alias(v) for v, x in values.items()])
        .groupBy(*groups, "day")
        .agg(F.count("*").alias("n_rows"), *measured)
    )
    parts = [
        F.struct(
            F.lit(f).alias("feature"),
            F.col(f"n_{v}").alias("n"),
            (F.col("n_rows") - F.col(f"n_{v}")).alias("n_missing"),
            F.when(F.col(f"n_{v}") > 0, F.col(f"s_{v}")).alias("sketch"),
        )
        for v, f in zip(values, features)
    ]
    return wide.select(*groups, "day", F.inline(F.array(*parts)))


def reference_edges(sketches: DataFrame, reference: Column, groups: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """``groups, feature, edges``: where bins end, from the sketches of the days that ``reference`` names.

    A bin holds the values above the edge before up to and including its own; the last has no edge.
    Equal edges are one. Features without a value have no row.
    """
    ranks = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    merged = (
        sketches.where(reference)
        .groupBy(*groups, "feature")
        .agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("s"))
        .where(F.col("n") > 0)
    )
    return merged.select(*groups, "feature", F.array_distinct(F.kll_sketch_get_quantile_double("s", ranks)).alias("edges"))


def daily_histograms(
    rows: DataFrame, ts_us: str, edges: DataFrame, features: Sequence[str], groups: Sequence[str] = ()
) -> DataFrame:
    """``groups, day, feature, bin, n``: exact counts; ``bin`` is null for missing values.

    The edges of a group are one row, so rows meet them in one join, or none without groups. Groups
    and features without edges are left out.
    """
    groups = list(groups)
    named = {f: f"e{i}" for i, f in enumerate(features)}
    picks = [F.first(F.when(F.col("feature") == f, F.col("edges")), True).alias(e) for f, e in named.items()]
    wide = edges.groupBy(*[F.col(g).alias(f"__{g}") for g in groups]).agg(*picks)
    day = F.floor(F.col(ts_us).cast("bigint") / DAY_US).alias("day")
    values = [_finite(F.col(f"`{f}`")).alias(f"v{i}") for i, f in enumerate(features)]
    dated = rows.where(F.col(ts_us).isNotNull()).select(*groups, day, *values)
    if groups:
        same = F.lit(True)
        for g in groups:
            same &= F.col(g).eqNullSafe(F.col(f"__{g}"))
        dated = dated.join(wide, same)
    else:
        # One row of a few numbers for each feature.
        known = wide.first().asDict()
        missing = F.lit(None).cast("array<double>")
        dated = dated.withColumns({e: F.lit(known[e]) if known[e] is not None else missing for e in named.values()})

    def place(v: Column, e: str) -> Column:
        return F.when(v.isNotNull(), F.size(F.filter(e, lambda x: x < v)))

    parts = []
    for i, (f, e) in enumerate(named.items()):
        where = F.struct(F.lit(f).alias("feature"), place(F.col(f"v{i}"), e).alias("bin"))
        parts.append(F.when(F.col(e).isNotNull(), where))
    each = dated.select(*groups, "day", F.inline(F.array_compact(F.array(*parts))))
    return each.groupBy(*groups, "day", "feature", "bin").agg(F.count("*").alias("n"))


def drift(
    histograms: DataFrame,
    reference: Column,
    current: Column,
    period: Column,
    groups: Sequence[str] = (),
    bins: int = 10,
) -> DataFrame:
    """How far each feature of the ``current`` days, by ``period``, lies from the ``reference`` days.

    ``reference`` and ``current`` are conditions and ``period`` an expression on ``day``. ``psi`` is the
    population stability index over the bins, ``shift`` the largest difference of the two distribution
    functions at their edges. ``groups, feature, period, n_reference, n_current, missing_reference,
    missing_current, psi, shift, status``; without a value on one side ``psi``, ``shift`` and ``status``
    are null. Drift is evidence to look at, no proof of an attack.
    """
    keys = [*groups, "feature"]

    def side(name: str, which: Column, by: list[str]) -> DataFrame:
        counts = [F.coalesce(F.sum(F.when(F.col("bin") == i, F.col("n"))), F.lit(0)) for i in range(bins)]
        missing = F.coalesce(F.sum(F.when(F.col("bin").isNull(), F.col("n"))), F.lit(0))
        return histograms.where(which).withColumn("period", period).groupBy(*by).agg(
            F.array(*counts).alias(f"c_{name}"), missing.alias(f"missing_{name}")
        )

    base, now = side("reference", reference, keys), side("current", current, [*keys, "period"])
    named = {k: f"__{k}" for k in keys}
    base = base.select(*[F.col(k).alias(n) for k, n in named.items()], "c_reference", "missing_reference")
    same = F.lit(True)
    for k, n in named.items():
        same &= F.col(k).eqNullSafe(F.col(n))

    def total(c: str) -> Column:
        return F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + x)

    both = now.join(base, same, "left").withColumns(
        {"n_reference": F.coalesce(total("c_reference"), F.lit(0)), "n_current": total("c_current")}
    )
    known = (F.col("n_reference") > 0) & (F.col("n_current") > 0)

    def shares(side: str) -> Column:
        return F.transform(f"c_{side}", lambda x: x / F.col(f"n_{side}"))

    def least(x: Column) -> Column:
        return F.greatest(x, F.lit(LEAST_SHARE))

    measured = both.withColumns({s[0]: F.when(known, shares(s)) for s in ("reference", "current")})
    terms = F.zip_with("r", "c", lambda p, q: (least(q) - least(p)) * F.ln(least(q) / least(p)))
    psi = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    apart = F.aggregate(
        F.zip_with("r", "c", lambda p, q: q - p),
        F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("most")),
        lambda s, x: F.struct(
            (s["sum"] + x).alias("sum"), F.greatest(s["most"], F.abs(s["sum"] + x)).alias("most")
        ),
        lambda s: s["most"],
    )
    status = (
        F.when(F.col("psi") >= MAJOR_PSI, MAJOR).when(F.col("psi") >= MODERATE_PSI, MODERATE).when(F.col("psi") >= 0, STABLE)
    )
    found = measured.select(
        *keys,
        "period",
        "n_reference",
        "n_current",
        F.coalesce("missing_reference", F.lit(0)).alias("missing_reference"),
        "missing_current",
        psi.alias("psi"),
        apart.alias("shift"),
    )
    return found.withColumn("status", status)
