"""Rows of a held-out table that also stand, exactly or nearly, in the training table.

Equal rows of both tables are put into one class first, with counts, so copies are never compared.
Classes are near one another if no feature differs by more than its tolerance. A grid over a few
features finds them: each training class stands in its own cell, each held-out class asks for the
cells that its tolerance reaches into, two in a dimension at most and mostly one, since cells are
wider than the tolerance. Every pair that meets is compared in full.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel.functions.staging import materialise

EXACT, NEAR, NONE = "EXACT", "NEAR", "NONE"
#: Features that cells are made of, and the width of a cell in tolerances.
GRID, WIDTH = 4, 8
_SLACK = 1e-9
_CALM = 1e15


def _cell(x: Column, width: float) -> Column:
    """Cell number; one cell each for null, NaN and what is too large for a number."""
    huge = F.when(F.isnan(x), -2).when(x > 0, -3).otherwise(-4) - (1 << 60)
    return F.when(F.abs(x) < _CALM * width, F.floor(x / width)).when(x.isNull(), -1 - (1 << 60)).otherwise(huge)


def _close(a: Column, b: Column, tolerance: float) -> Column:
    return a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))


def leakage_classes(
    train: DataFrame,
    held_out: DataFrame,
    tolerances: dict[str, float],
    row_id: str,
    grid: int = GRID,
) -> DataFrame:
    """One row for each distinct held-out feature row: how often it stands in both tables.

    ``first_id, <features>, n_held_out, n_train, n_near_classes, n_near_train, nearest, kind``:
    ``first_id`` the smallest row id of its held-out copies, ``n_train`` its equals in ``train``,
    ``n_near_*`` the other training classes and rows within ``tolerances`` (feature: largest
    difference), ``nearest`` the smallest difference to one of them, as the largest share of a
    tolerance. EXACT if an equal row exists, else NEAR if a near one does, else NONE.

    Null equals null and NaN equals NaN only; minus zero is zero; infinities equal themselves. Tables
    may be empty. A row that makes up much of a table is one class, so copies cost nothing.
    """
    if any(not t > 0 for t in tolerances.values()):
        raise ValueError("tolerances must be positive")
    # Inside, features are x0, x1, ..., so that their own names clash with nothing.
    own = {f"x{i}": f for i, f in enumerate(tolerances)}
    tolerances = dict(zip(own, tolerances.values()))
    names = list(own)
    values = [(F.col(f"`{f}`").cast("double") + F.lit(0.0)).alias(x) for x, f in own.items()]

    def side(rows: DataFrame, mine: int) -> DataFrame:
        number = F.when(F.lit(mine == 1), F.col(f"`{row_id}`")).alias("i")
        return rows.select(*values, F.lit(1 - mine).alias("t"), F.lit(mine).alias("h"), number)

    classes = materialise(
        side(train, 0)
        .unionByName(side(held_out, 1))
        .groupBy(*names)
        .agg(F.sum("t").alias("n_train"), F.sum("h").alias("n_held_out"), F.min("i").alias("first_id"))
    )
    width = {f: WIDTH * t for f, t in tolerances.items()}
    spread = classes.agg(*[F.approx_count_distinct(_cell(F.col(f), width[f])).alias(f) for f in names]).first()
    keys = sorted(names, key=lambda f: (-spread[f], f))[:grid]

    known = classes.where("n_train > 0").select(
        F.struct(*names).alias("b"), "n_train", *[_cell(F.col(f), width[f]).alias(f"k{i}") for i, f in enumerate(keys)]
    )
    asking = classes.where("n_held_out > 0")
    asked = asking.select(F.struct(*names).alias("a"))
    for i, f in enumerate(keys):
        x, reach = F.col(f"a.{f}"), tolerances[f]
        ends = [_cell(x + d * (reach + F.abs(x) * _SLACK), width[f]) for d in (-1, 1)]
        asked = asked.withColumn(f"k{i}", F.explode(F.array_distinct(F.array(*ends))))
    pairs = asked.join(known, [f"k{i}" for i in range(len(keys))])
    a, b = ([F.col(f"{s}.{f}") for f in names] for s in "ab")
    near = reduce(lambda p, q: p & q, [_close(x, y, t) for x, y, t in zip(a, b, tolerances.values())])
    same = reduce(lambda p, q: p & q, [x.eqNullSafe(y) for x, y in zip(a, b)])
    shares = [F.when(x.eqNullSafe(y), F.lit(0.0)).otherwise(F.abs(x - y) / t) for x, y, t in zip(a, b, tolerances.values())]
    apart = F.greatest(*shares) if len(shares) > 1 else shares[0]
    found = (
        pairs.where(near & ~same)
        .groupBy("a")
        .agg(F.count("*").alias("n_near_classes"), F.sum("n_train").alias("n_near_train"), F.min(apart).alias("nearest"))
    )
    # Null and NaN features keep their class: the struct as a whole is the key.
    out = asking.withColumn("a", F.struct(*names)).join(
        found.withColumnRenamed("a", "b"), F.col("a").eqNullSafe(F.col("b")), "left"
    )
    n_near = F.coalesce("n_near_classes", F.lit(0)).cast("bigint")
    kind = F.when(F.col("n_train") > 0, EXACT).when(n_near > 0, NEAR).otherwise(NONE)
    return out.select(
        "first_id",
        *[F.col(x).alias(f) for x, f in own.items()],
        "n_held_out",
        "n_train",
        n_near.alias("n_near_classes"),
        F.coalesce("n_near_train", F.lit(0)).cast("bigint").alias("n_near_train"),
        "nearest",
        kind.alias("kind"),
    )


def leaked_rows(held_out: DataFrame, classes: DataFrame, features: Sequence[str]) -> DataFrame:
    """All held-out rows with the ``leak_kind`` of their class."""
    key = F.struct(*[(F.col(f"`{f}`").cast("double") + F.lit(0.0)).alias(f) for f in features])
    own = F.struct(*[F.col(f"`{f}`") for f in features])
    kinds = classes.select(own.alias("__class"), F.col("kind").alias("leak_kind"))
    return held_out.withColumn("__row", key).join(kinds, F.col("__row").eqNullSafe(F.col("__class")), "left").drop("__row", "__class")


def leakage_summary(classes: DataFrame) -> DataFrame:
    """Classes and held-out rows by ``kind``."""
    return classes.groupBy("kind").agg(F.count("*").alias("n_classes"), F.sum("n_held_out").alias("n_rows"))
