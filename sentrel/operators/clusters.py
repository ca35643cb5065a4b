"""Density clustering (DBSCAN) and connected components as Spark joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel.functions import fixed
from sentrel.functions.staging import materialise
from sentrel.operators.windows import numbered


#: Cells of each side that are compared at a time, and those of one side among them that are held against the other.
BLOCK = 1024
STRIP = 64
#: Links that a task thins out at a time.
LINKS = 1 << 19


def fit_scaler(df: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per feature; one row comes back to the driver."""
    stats = df.agg(
        *[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(features)],
        *[F.stddev_pop(f"`{c}`").alias(f"s{i}") for i, c in enumerate(features)],
    ).first()
    return {c: (stats[f"m{i}"] or 0.0, stats[f"s{i}"] or 1.0) for i, c in enumerate(features)}


def scale(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    """(x - mean) / deviation; a constant feature is only centred."""
    return df.withColumns(
        {c: (F.col(f"`{c}`") - F.lit(m)) / F.lit(s) for c, (m, s) in scaler.items()}
    )


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node but the smallest of its component, and that smallest."""
    known, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(known))
    while True:
        low, high = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        apart = low != high
        if not apart.any():
            break
        u, v = u[apart], v[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(root)))
    return known[moved], known[root[moved]]


def _thinned(edges: DataFrame) -> DataFrame:
    """Links of whole numbers with the same components: no more from a task than it has nodes."""
    if any(kind not in ("tinyint", "smallint", "int", "bigint") for _, kind in edges.dtypes):
        return edges

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, held = [], 0
        for batch in batches:
            kept.append((batch["a"].to_numpy(), batch["b"].to_numpy()))
            held += len(batch)
            if held >= LINKS:
                kept, held = [_spanning(*map(np.concatenate, zip(*kept, strict=True)))], 0
        if kept:
            a, b = _spanning(*map(np.concatenate, zip(*kept, strict=True)))
            yield pd.DataFrame({"a": a, "b": b})

    return edges.mapInPandas(thin, edges.schema)


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id per node of an undirected graph (``a, b``).

    Alternates large-star and small-star (Kiveris et al. 2014) until nothing changes; every round
    is two aggregations, and the table of each round is written out, which keeps lineage short. Tasks first
    thin out their links, so that dense graphs are not shuffled.
    """
    links = materialise(_thinned(edges.select("a", "b").where("a <> b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("p"))
            .select("p.u", F.col("p.m").alias("v"))
        )
        links = materialise(small.where("u <> v").distinct())
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return links.select(F.col("u").alias("id"), F.col("v").alias("root"))
        seen = state


def _sum_over(n: int, term: Callable[[Column], Column]) -> Column:
    """Sum of ``term(i)`` over dimensions: plain arithmetic that compiles, or a fold if long."""
    if n <= 32:
        return reduce(lambda s, t: s + t, [term(F.lit(i)) for i in range(n)])
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0.0), lambda s, i: s + term(i)
    )


def _squared(c: Column) -> Column:
    return c * c


def _distance2(a: str, b: str, n: int) -> Column:
    return _sum_over(n, lambda i: _squared(F.get(a, i) - F.get(b, i)))


def _grid(dims: Sequence[int], side: float) -> tuple[Column, Column]:
    """Home grid key of a cell box centre, and the keys of all neighbouring grid cells."""
    home = [F.floor((F.get("lo", F.lit(i)) + F.get("hi", F.lit(i))) / 2 / side) for i in dims]
    keys = F.array(F.concat_ws(",", F.lit("g")))
    for h in home:
        steps = F.array(*[(h + d).cast("string") for d in (-1, 0, 1)])
        keys = F.flatten(F.transform(keys, lambda k: F.transform(steps, lambda s: F.concat(k, F.lit(","), s))))
    own = F.concat_ws(",", F.lit("g"), *[h.cast("string") for h in home])
    return own, keys


def _boxes(side: pd.DataFrame, lo: str, hi: str) -> tuple[np.ndarray, np.ndarray]:
    """Bounds with a row for each dimension; missing ones are NaN."""
    return tuple(np.stack(side[c].to_numpy()).astype(float).T.copy() for c in (lo, hi))


def _near_cells(left: DataFrame, right: DataFrame, e2: float) -> DataFrame:
    """Pairs of cells (``cell < cell2``) of one grid cell ``g`` whose boxes lie within the root of ``e2``.

    ``sure`` tells whether all their points do. Pairs of a grid cell are compared in blocks, so a full
    one is no task of its own. Boxes with missing bounds are near none.
    """

    def blocks(side: DataFrame, out: str) -> DataFrame:
        return side.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(out))

    def dealt(side: DataFrame, cell: str, own: str, n: str, other: str, m: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(cell), F.col(n)).cast("int").alias(own)
        every = F.explode(F.sequence(F.lit(0), F.col(m) - 1)).alias(other)
        return side.join(counts, "g").select(*side.columns, mine, every).groupBy("g", "i", "j")

    counts = materialise(blocks(left, "n").join(blocks(right, "m"), "g"))
    kind = left.schema["cell"].dataType.simpleString()

    def spheres(lo: np.ndarray, hi: np.ndarray, middle: np.ndarray) -> tuple[np.ndarray, ...]:
        """Centres of boxes from ``middle``, half diagonals, squares of the centres."""
        at = (lo - middle) + (hi - lo) / 2
        return at, np.sqrt(((hi - lo) ** 2).sum(0)) / 2, (at * at).sum(0)

    def compare(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        names = ["cell", "cell2", "cw", "cw2"]
        if one.empty or two.empty:
            return pd.DataFrame({c: [] for c in [*names, "sure"]})
        (lo, hi), (lo2, hi2) = _boxes(one, "lo", "hi"), _boxes(two, "lo2", "hi2")
        first, second = one["cell"].to_numpy(), two["cell2"].to_numpy()
        points = bool((lo == hi).all() and (lo2 == hi2).all())
        found = []
        with np.errstate(invalid="ignore", over="ignore"):
            middle = np.nan_to_num(lo2[:, :1], posinf=0.0, neginf=0.0)
            (at, half, square), (at2, half2, square2) = spheres(lo, hi, middle), spheres(lo2, hi2, middle)
            # Some rows at a time stay in the cache.
            for k in range(0, len(one), STRIP):
                strip = slice(k, k + STRIP)
                # One product tells which boxes are too far apart, with room for its rounding; what it cannot tell stays.
                both = square[strip, None] + square2
                apart = both - 2 * (at[:, strip].T @ at2) - 1e-9 * both
                a, b = np.nonzero(~(apart > (sqrt(e2) + half[strip, None] + half2) ** 2 * (1 + 1e-9)))
                a += k
                kept = (first[a] < second[b]).astype(bool)
                a, b = a[kept], b[kept]
                # Dimension by dimension, so sums are those of a fold.
                gap = np.zeros(len(a))
                for l, h, l2, h2 in zip(lo, hi, lo2, hi2, strict=True):
                    gap += np.maximum(np.maximum(l[a] - h2[b], l2[b] - h[a]), 0.0) ** 2
                near = gap <= e2
                a, b, gap = a[near], b[near], gap[near]
                reach = np.zeros(len(a))
                for l, h, l2, h2 in () if points else zip(lo, hi, lo2, hi2, strict=True):
                    reach += np.maximum(h[a] - l2[b], h2[b] - l[a]) ** 2
                found.append((a, b, gap if points else reach))
        a, b, reach = (np.concatenate(f) for f in zip(*found, strict=True))
        sides = (first[a], second[b], one["cw"].to_numpy()[a], two["cw2"].to_numpy()[b])
        return pd.DataFrame(dict(zip(names, sides, strict=True)) | {"sure": reach <= e2})

    with_blocks = dealt(left, "cell", "i", "n", "j", "m").cogroup(dealt(right, "cell2", "j", "m", "i", "n"))
    return with_blocks.applyInPandas(compare, f"cell {kind}, cell2 {kind}, cw bigint, cw2 bigint, sure boolean")


def dbscan(
    points: DataFrame,
    row_id: str,
    features: Sequence[str],
    eps: float = fixed.DBSCAN_EPS,
    min_samples: int = fixed.DBSCAN_MIN_SAMPLES,
    grid_dims: int = 3,
) -> DataFrame:
    """Cluster label per row: -1 for noise, else 0, 1, ... by smallest core row id.

    Equals the sequential algorithm on rows in id order. Exact copies are merged into one
    weighted point. Points are then put into cells whose diagonal is ``eps``: all members of a
    cell are neighbours, so a dense cell needs no pair at all inside it. Pairs of cells are
    decided by their bounding boxes where possible, and only the rest by points.
    """
    d = len(features)
    x = F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    rows = materialise(points.select(F.col(row_id).alias("id"), x.alias("x")))
    # Weighted distinct points; the id of a point is its smallest row id.
    distinct = rows.groupBy("x").agg(F.min("id").alias("pid"), F.count("*").alias("w"))
    fine = eps / sqrt(d) * (1 - 1e-9)
    place = F.sha2(F.concat_ws(",", F.transform("x", lambda v: F.floor(v / fine).cast("string"))), 256)
    placed = materialise(distinct.withColumn("place", place))

    bounds = [
        agg(F.get("x", F.lit(i))).alias(f"{n}{i}") for n, agg in (("l", F.min), ("h", F.max)) for i in range(d)
    ]
    cells = materialise(
        placed.groupBy("place")
        .agg(F.sum("w").alias("cw"), F.min("pid").alias("cid"), *bounds)
        .select(
            "place",
            # A number, since pairs of cells are many.
            F.monotonically_increasing_id().alias("cell"),
            "cw",
            "cid",
            F.array(*[F.col(f"l{i}") for i in range(d)]).alias("lo"),
            F.array(*[F.col(f"h{i}") for i in range(d)]).alias("hi"),
        )
    )
    pts = materialise(placed.join(cells.select("place", "cell"), "place").drop("place"))
    # The grid uses the features that spread over most grid columns.
    side = eps * (1 + 1 / sqrt(d))
    spread = cells.agg(
        *[F.approx_count_distinct(F.floor(F.get("lo", F.lit(i)) / side)).alias(str(i)) for i in range(d)]
    ).first()
    dims = sorted(range(d), key=lambda i: -spread[str(i)])[:grid_dims]
    own, near = _grid(dims, side)
    left = cells.select("cell", "cw", "lo", "hi", own.alias("g"))
    right = cells.select(
        F.col("cell").alias("cell2"), F.col("cw").alias("cw2"), F.col("lo").alias("lo2"),
        F.col("hi").alias("hi2"), F.explode(near).alias("g"),
    )

    e2 = eps * eps
    pairs = materialise(_near_cells(left, right, e2))
    # Point pairs across cells, where boxes leave the question open.
    p1 = pts.select("cell", F.col("pid").alias("a"), F.col("x").alias("xa"), F.col("w").alias("wa"))
    p2 = pts.select(
        F.col("cell").alias("cell2"), F.col("pid").alias("b"), F.col("x").alias("xb"),
        F.col("w").alias("wb"),
    )
    met = (
        pairs.where(~F.col("sure"))
        .join(p1, "cell")
        .join(p2, "cell2")
        .where(_distance2("xa", "xb", d) <= e2)
    )
    # Between two dense cells, whose points are all core, it only matters that a pair exists.
    dense = (F.col("cw") >= min_samples) & (F.col("cw2") >= min_samples)
    touching_cells = materialise(met.where(dense).select("cell", "cell2").distinct())
    close = materialise(met.where(~dense).select("cell", "cell2", "a", "b", "wa", "wb"))
    sure = pairs.where("sure")
    # Neighbour counts: own cell, cells that are near as a whole, single points.
    both_sure = sure.select("cell", F.col("cw2").alias("n")).union(
        sure.select(F.col("cell2").alias("cell"), F.col("cw").alias("n"))
    )
    cell_n = (
        cells.select("cell", F.col("cw").alias("n"))
        .union(both_sure)
        .groupBy("cell")
        .agg(F.sum("n").alias("cell_n"))
    )
    point_n = (
        close.select(F.col("a").alias("pid"), F.col("wb").alias("n"))
        .union(close.select(F.col("b").alias("pid"), F.col("wa").alias("n")))
        .groupBy("pid")
        .agg(F.sum("n").alias("point_n"))
    )
    counted = (
        pts.select("pid", "cell")
        .join(cell_n, "cell")
        .join(point_n, "pid", "left")
        .withColumn("core", F.col("cell_n") + F.coalesce("point_n", F.lit(0)) >= min_samples)
    )
    marked = materialise(counted.select("pid", "cell", "core"))
    core = marked.where("core").select("pid", "cell")
    # Core points of one cell hang together; the smallest stands for them.
    heads = core.groupBy("cell").agg(F.min("pid").alias("head"))
    core_head = core.join(heads, "cell").select("pid", "cell", "head")
    ch = core_head.select("pid", "head")
    by_point = (
        close.join(ch.toDF("a", "ha"), "a").join(ch.toDF("b", "hb"), "b").select("ha", "hb")
    )
    by_cell = (
        sure.select("cell", "cell2")
        .union(touching_cells)
        .join(heads.toDF("cell", "ha"), "cell")
        .join(heads.toDF("cell2", "hb"), "cell2")
        .select("ha", "hb")
    )
    roots = components(by_point.union(by_cell).toDF("a", "b"))
    core_root = materialise(
        core_head.join(roots, core_head["head"] == roots["id"], "left").select(
            "pid", "cell", F.coalesce("root", "head").alias("root")
        )
    )
    # Number clusters by their smallest core row.
    first = core_root.groupBy("root").agg(F.min("pid").alias("first"))
    border = marked.where(~F.col("core")).select("pid", "cell")
    cr = core_root.select("pid", "root")
    cell_root = core_root.groupBy("cell", "root").agg(F.min("pid").alias("__p")).select("cell", "root")
    touching = (
        border.join(cell_root, "cell").select("pid", "root")
        .union(
            border.join(sure.select("cell", "cell2").union(sure.select("cell2", "cell")), "cell")
            .join(cell_root.toDF("cell2", "root"), "cell2")
            .select("pid", "root")
        )
        .union(
            close.select("a", "b").union(close.select("b", "a"))
            .join(border.select(F.col("pid").alias("a")), "a")
            .join(cr.toDF("b", "root"), "b")
            .select(F.col("a").alias("pid"), "root")
        )
    )
    border_root = (
        touching.join(first, "root").groupBy("pid").agg(F.min("first").alias("first"))
    )
    labelled = core_root.join(first, "root").select("pid", "first").union(border_root)
    point_first = pts.select("x", "pid").join(labelled, "pid", "left").select("x", "first")
    found = materialise(rows.join(point_first, "x").select("id", "first"))
    numbers = _number_clusters(found.where(F.col("first").isNotNull()).select("first").distinct())
    return found.join(numbers, "first", "left").select(
        F.col("id").alias(row_id), F.coalesce("cluster", F.lit(-1)).alias("cluster")
    )


def _number_clusters(first: DataFrame, width: int = 4096) -> DataFrame:
    """0, 1, ... in order of the smallest core row, counted in two levels."""
    keyed = first.withColumn("k", F.lit(0))
    placed = numbered(keyed, ["k"], F.floor(F.col("first") / width), ["first"], "pos", "total")
    return placed.select("first", (F.col("pos") - 1).alias("cluster"))
