"""Near-duplicate vectors by a forest of random projection trees with spill.

Every tree splits the vectors again and again at the median of their projections on a random
direction; vectors near the median go to both sides. Vectors that meet in a leaf of any tree are
compared exactly, links of cosine 0.9 or more stay, and links join vectors into components.

Large groups of near copies would be cut by every split, so they never enter the trees: a vector
that is linked with a centre (a sampled vector with many links) is compared with all vectors within
twice the linking angle of that centre, which are all it can link with, in blocks spread over
tasks. Of these comparisons only counts are written, and links to centres.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrel.functions.staging import materialise
from sentrel.llm.common import slices
from sentrel.operators.clusters import components

THRESHOLD, TREES, SEED = 0.9, 8, 42
#: Vectors in a leaf; share of a node's vectors on either side of the median that go both ways.
LEAF, SPILL = 1024, 0.06
#: Vectors that the upper splits are fitted on, and the fewest of them in a leaf.
SAMPLE, LEAST = 1 << 14, 24
#: A sampled vector may be a centre if it stands for so many links, and has so many in the sample.
CROWD, LEAST_CROWD = LEAF // 4, 8


def grow(x: np.ndarray, stop: int, rng: np.random.Generator) -> dict:
    """Fit one tree: directions, the two spill borders and children of each inner node.

    A leaf is a negative child, numbered from -1.
    """
    dirs, low, high, kids = [], [], [], []
    leaves = 0

    def split(rows: np.ndarray, depth: int) -> int:
        nonlocal leaves
        if len(rows) > stop and depth < 40:
            d = rng.normal(size=x.shape[1])
            p = x[rows] @ d
            a, b = np.quantile(p, [0.5 - SPILL, 0.5 + SPILL])
            left, right = rows[p <= b], rows[p > a]
            if max(len(left), len(right)) < len(rows):
                me = len(dirs)
                dirs.append(d)
                low.append(a)
                high.append(b)
                kids.append([0, 0])
                kids[me] = [split(left, depth + 1), split(right, depth + 1)]
                return me
        leaves += 1
        return -leaves

    root = split(np.arange(len(x)), 0)
    return {"root": root, "dirs": np.array(dirs), "low": low, "high": high, "kids": kids}


def leaves(tree: dict, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, rows) for all leaves that rows of ``x`` fall into."""
    waiting = [(tree["root"], np.arange(len(x)))]
    while waiting:
        node, rows = waiting.pop()
        if not len(rows):
            continue
        if node < 0:
            yield -node, rows
            continue
        p = x[rows] @ tree["dirs"][node]
        waiting.append((tree["kids"][node][0], rows[p <= tree["high"][node]]))
        waiting.append((tree["kids"][node][1], rows[p > tree["low"][node]]))


def near(x: np.ndarray, threshold: float = THRESHOLD, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of unit vectors with cosine of at least ``threshold``, in blocks."""
    out_i, out_j = [], []
    for a in range(0, len(x), block):
        for b in range(a, len(x), block):
            i, j = np.nonzero(x[a : a + block] @ x[b : b + block].T >= threshold)
            i, j = i + a, j + b
            keep = i < j
            out_i.append(i[keep])
            out_j.append(j[keep])
    return np.concatenate(out_i) if out_i else np.zeros(0, int), np.concatenate(out_j) if out_j else np.zeros(0, int)


def pairs_within(ids: np.ndarray, x: np.ndarray, seed: int) -> np.ndarray:
    """Linked pairs of ids in one leaf of the upper splits, which is split on while it is large."""
    tree = grow(x, 4 * LEAF, np.random.default_rng(seed))
    found = []
    for _, rows in leaves(tree, x):
        i, j = near(x[rows])
        a, b = ids[rows[i]], ids[rows[j]]
        found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def _unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    # Scale first: squares of extreme components must neither vanish nor overflow.
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def centres(x: np.ndarray, least: int, block: int = 512) -> np.ndarray:
    """Rows of ``x`` that are linked with ``least`` others at least, thinned until no two of them
    are linked; every such row is linked with one that stays."""
    n_links = np.concatenate([(x[a : a + block] @ x.T >= THRESHOLD).sum(1) for a in range(0, len(x), block)]) - 1
    waiting, chosen = np.flatnonzero(n_links >= least), []
    while len(waiting):
        best = waiting[np.argmax(n_links[waiting])]
        chosen.append(best)
        waiting = waiting[(waiting != best) & (x[waiting] @ x[best] < THRESHOLD)]
    return np.array(chosen, int)


def _drawn(nodes: DataFrame, d: int, seed: int) -> pa.Table:
    drawn = nodes.where(F.size("embedding") == d).orderBy(F.xxhash64(F.lit(seed), "node")).limit(SAMPLE)
    return drawn.select("node", "embedding").toArrow()


def _sizes(nodes: DataFrame) -> list[tuple[int, int]]:
    return sorted((r["d"], r["count"]) for r in nodes.groupBy(F.size("embedding").alias("d")).count().collect())


def crowds(nodes: DataFrame, seed: int = SEED) -> DataFrame:
    """Where ``node, embedding, n`` rows meet large groups: ``dim, crowd, centre, node, n, unit, home,
    housed``.

    ``home`` rows are linked with the centre and have one crowd each, the nearest; the others of a
    crowd are all that one of its home rows can be linked with, and ``housed`` if they have a home
    elsewhere. Crowds come from a bounded sample.
    """
    known = {}
    for d, total in _sizes(nodes):
        drawn = _drawn(nodes, d, seed)
        x = _unit(drawn.column("embedding").to_pylist())
        at = centres(x, max(LEAST_CROWD, CROWD * len(x) // total))
        if len(at):
            known[d] = (drawn.column("node").to_numpy()[at], x[at])
    shared = nodes.sparkSession.sparkContext.broadcast(known)
    # A vector within the linking angle of one that is within that angle of the centre.
    reach = np.cos(2 * np.arccos(THRESHOLD)) - 1e-9

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "embedding", 1 << 21):
            ids, weights = batch.column("node").to_numpy(), batch.column("n").to_numpy()
            rows = batch.column("embedding").to_pylist()
            sizes = np.array([len(r) for r in rows])
            for d in np.unique(sizes):
                if int(d) not in shared.value:
                    continue
                names, middle = shared.value[int(d)]
                mine = np.flatnonzero(sizes == d)
                x = _unit([rows[i] for i in mine])
                cosine = x @ middle.T
                nearest = cosine.argmax(1)
                housed = cosine.max(1) >= THRESHOLD
                i, j = np.nonzero(cosine >= reach)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(i), d, np.int32)),
                        pa.array(j.astype(np.int32)),
                        pa.array(names[j]),
                        pa.array(ids[mine[i]]),
                        pa.array(weights[mine[i]]),
                        pa.array([x[k].tobytes() for k in i], pa.binary()),
                        pa.array((nearest[i] == j) & housed[i]),
                        pa.array(housed[i]),
                    ],
                    ["dim", "crowd", "centre", "node", "n", "unit", "home", "housed"],
                )

    kind = "dim int, crowd int, centre long, node long, n long, unit binary, home boolean, housed boolean"
    return nodes.select("node", "embedding", "n").mapInArrow(place, kind)


def crowd_links(placed: DataFrame) -> DataFrame:
    """(node, centre, linked) of the rows of ``crowds``, in parts: ``linked`` adds up to all rows
    that a home row is linked with, to the linked home rows of all crowds for a row without a home;
    ``centre`` is reachable from the node.

    The home rows of a crowd and all its rows are cut into blocks, and a task compares two blocks.
    Both numbers of blocks grow with the root of a crowd's size, so blocks stay small beside it.
    """
    counts = placed.groupBy("dim", "crowd").agg(
        *[F.ceil(F.sqrt(c) / 8).cast("int").alias(k) for k, c in (("r", F.count_if("home")), ("m", F.count("*")))]
    )
    rows = placed.join(F.broadcast(counts), ["dim", "crowd"])
    own = {c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int") for c in "rm"}
    every = {c: F.explode(F.sequence(F.lit(0), F.col(c) - 1)) for c in "rm"}
    left = rows.where("home").withColumns({"i": own["r"], "x": F.lit(True)}).withColumn("j", every["m"])
    right = rows.where("r > 0").withColumns({"j": own["m"], "x": F.lit(False)}).withColumn("i", every["r"])

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        def part(rows: pd.DataFrame) -> tuple:
            x = np.frombuffer(b"".join(rows["unit"]), np.float64).reshape(len(rows), -1)
            return x, rows["node"].to_numpy(), rows["n"].to_numpy()

        mine, theirs = group[group["x"]], group[~group["x"]]
        if not len(mine) or not len(theirs):
            return pd.DataFrame({"node": [], "centre": [], "linked": []}).astype("int64")
        (x, a, n), (y, b, m) = part(mine), part(theirs)
        away, housed = ~theirs["home"].to_numpy(bool), theirs["housed"].to_numpy(bool)
        for_x, for_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        for at in range(0, len(x), 512):
            near = ((x[at : at + 512] @ y.T >= THRESHOLD) & (a[at : at + 512, None] != b)).astype(np.float64)
            for_x[at : at + 512] = near @ m
            for_y += (n[at : at + 512] @ near).astype(np.int64)
        # Links of a row that is at home elsewhere are counted there.
        nodes, some = np.concatenate([a, b[away]]), np.concatenate([for_x, for_y[away]]) > 0
        linked = np.concatenate([for_x, np.where(housed, 0, for_y)[away]])
        centre = group["centre"].iloc[0]
        return pd.DataFrame({"node": nodes[some], "centre": np.full(some.sum(), centre), "linked": linked[some]})

    both = left.unionByName(right).drop("r", "m")
    return both.groupBy("dim", "crowd", "i", "j").applyInPandas(compare, "node long, centre long, linked long")


def links(nodes: DataFrame, trees: int = TREES, seed: int = SEED) -> DataFrame:
    """Linked pairs (a, b) of ``node, embedding`` rows; vectors are finite and not zero.

    The upper splits are fitted on a bounded sample (``SAMPLE`` vectors of each dimension); every
    vector is placed in every tree. Leaves that are still large are split further where they are
    compared. Vectors of different dimensions never link.
    """
    spark = nodes.sparkSession
    rng = np.random.default_rng(seed)
    forest = {}
    for d, n in _sizes(nodes):
        x = _unit(_drawn(nodes, d, seed).column("embedding").to_pylist())
        stop = max(LEAST, int(4 * LEAF * len(x) / n))
        forest[d] = [grow(x, stop, rng) for _ in range(trees)]
    shared = spark.sparkContext.broadcast(forest)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches, "embedding", 1 << 21):
            ids = batch.column("node").to_numpy()
            rows = batch.column("embedding").to_pylist()
            sizes = np.array([len(r) for r in rows])
            for d in np.unique(sizes):
                mine = np.flatnonzero(sizes == d)
                x = _unit([rows[i] for i in mine])
                raw = [v.tobytes() for v in x]
                for number, tree in enumerate(known[int(d)]):
                    for leaf, at in leaves(tree, x):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(at), d, np.int32)),
                                pa.array(np.full(len(at), number, np.int32)),
                                pa.array(np.full(len(at), leaf, np.int32)),
                                pa.array(ids[mine[at]]),
                                pa.array([raw[i] for i in at], pa.binary()),
                            ],
                            ["dim", "tree", "leaf", "node", "unit"],
                        )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(group["unit"]), np.float64).reshape(len(group), -1)
        at = int(group["tree"].iloc[0]) * 100_003 + int(group["leaf"].iloc[0])
        found = pairs_within(group["node"].to_numpy(), x, at)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    placed = nodes.mapInArrow(place, "dim int, tree int, leaf int, node long, unit binary")
    return placed.groupBy("dim", "tree", "leaf").applyInPandas(compare, "a long, b long").distinct()


def report(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per row of ``vectors``: key, ``n_links`` (other rows linked directly), ``component_id``
    (smallest key reachable by links, its own included) and ``kept`` (key = component_id).

    Equal vectors are one node of the search and link with one another. Vectors that are null,
    empty or zero, or have null or non-finite components, link with nothing. Rows with a null key
    count as links but never name a component. Labels and other columns are ignored.
    """
    e = F.col(f"`{vector}`").cast("array<double>")
    infinite = F.lit(float("inf"))
    fine = (
        F.coalesce(F.size(e) > 0, F.lit(False))
        & ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == infinite))
        & F.exists(e, lambda v: v != 0)
    )
    rows = materialise(
        vectors.select(F.col(f"`{key}`").alias("id"), F.when(fine, e).alias("embedding")).withColumn(
            "hash", F.xxhash64("embedding")
        )
    )
    nodes = materialise(
        rows.where("embedding is not null")
        .groupBy("hash", "embedding")
        .agg(F.min("id").alias("low"), F.count("*").alias("n"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    placed = materialise(crowds(nodes))
    home = placed.where("home").select("node", "centre")
    crowded = materialise(crowd_links(placed))
    # Links with home rows are counted; the trees find those between all others.
    found = materialise(links(materialise(nodes.select("node", "embedding").join(home, "node", "left_anti"))))
    sizes = nodes.select("node", "n")
    each = found.union(found.select("b", "a")).toDF("node", "other")
    within = each.join(sizes.toDF("other", "m"), "other").select("node", "m")
    counted = within.union(crowded.select("node", "linked")).groupBy("node").agg(F.sum("m").alias("linked"))
    near_centre = crowded.select("node", "centre").union(home).distinct()
    roots = components(found.union(near_centre)).select(F.col("id").alias("node"), "root")
    full = (
        nodes.join(counted, "node", "left")
        .join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
        .withColumn("n_links", F.col("n") - 1 + F.coalesce("linked", F.lit(0)))
    )
    full = materialise(full.select("hash", "embedding", "low", "root", "n_links"))
    lows = full.groupBy("root").agg(F.min("low").alias("component_id"))
    known = full.join(lows, "root").select("hash", "embedding", "n_links", "component_id")
    return (
        rows.join(known, ["hash", "embedding"], "left")
        .select(
            F.col("id").alias(key),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.when(F.col("embedding").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.col(f"`{key}`").eqNullSafe(F.col("component_id")))
    )
