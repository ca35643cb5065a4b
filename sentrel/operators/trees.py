"""Decision trees grown by tasks that hold the binned rows: one tree a task, no pass over the table a level."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bins of a feature, and rows that its cuts are taken from.
BINS = 32
CUT_ROWS = 10_000
#: MB of the trees that the driver, or a worker that scores, holds at a time.
ASK_MB = 64
#: Nodes with fewer rows are searched by sorting, others by histograms.
FEW = 96
#: Class counts (of sorted entries, or of a histogram's bins) that are held at a time.
CELLS = 1 << 18
TREE_SCHEMA = "tree int, depth int, n_nodes bigint, node binary, vote binary, votes binary"
#: A leaf's feature is 0 and its cut this, which no bin exceeds, so that a row stays where it is.
NO_CUT = 255


def feature_cuts(values: np.ndarray, weights: np.ndarray, bins: int = BINS) -> np.ndarray:
    """At most ``bins - 1`` thresholds halfway between neighbouring values, at equal weights."""
    known, at = np.unique(values, return_inverse=True)
    if len(known) <= bins:
        return (known[1:] + known[:-1]) / 2
    upto = np.cumsum(np.bincount(at, weights=weights))
    aim = upto[-1] / bins * np.arange(1, bins)
    # The value that gets nearest to the aim is the last one below the cut.
    over = np.searchsorted(upto, aim).clip(1, len(known) - 1)
    last = np.unique(np.where(aim - upto[over - 1] <= upto[over] - aim, over - 1, over).clip(0, len(known) - 2))
    return (known[last + 1] + known[last]) / 2


def binned(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Number of cuts below each value: a value on a cut belongs to its left."""
    out = np.empty(x.shape, dtype=np.uint8)
    for i, c in enumerate(cuts):
        out[:, i] = np.searchsorted(c, x[:, i], side="left")
    return out


def _parts(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive slices with at most ``most`` in all, one element at least."""
    start, upto = 0, np.cumsum(sizes)
    while start < len(sizes):
        before = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, before + most, side="right")))
        yield slice(start, stop)
        start = stop


def _quality(left: np.ndarray, total: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted Gini purity of both sides; what is larger is the better split."""
    lw = left * weights
    rw = (total - left) * weights
    return (lw * lw).sum(-1) / lw.sum(-1) + (rw * rw).sum(-1) / rw.sum(-1)


def _drawn_bins(x: np.ndarray, rows: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """Bins of rows, of the features drawn for each."""
    return x.reshape(-1)[rows.astype(np.int64)[:, None] * x.shape[1] + drawn]


def _by_histogram(x, y, bag, rows, lens, drawn, counts, weights):
    """Best split of each node: quality, which of the drawn features, cut, class counts of the left."""
    (m, k), classes, cuts = drawn.shape, len(weights), BINS - 1
    cells = np.zeros(m * k * BINS * classes)
    node, step = np.repeat(np.arange(m), lens), max(1, CELLS // k)
    for i in range(0, len(rows), step):
        mine, own = rows[i : i + step], node[i : i + step]
        key = ((own[:, None] * k + np.arange(k)) * BINS + _drawn_bins(x, mine, drawn[own])) * classes + y[mine, None]
        cells += np.bincount(key.ravel(), weights=np.repeat(bag[mine], k), minlength=len(cells))
    left = np.cumsum(cells.reshape(m, k, BINS, classes), axis=2)[:, :, :-1]
    with np.errstate(invalid="ignore", divide="ignore"):
        good = _quality(left, counts[:, None, None], weights).reshape(m, -1)
    # A side without rows makes no split.
    good = np.where(np.isnan(good), -np.inf, good)
    best = good.argmax(1)
    which, cut = np.divmod(best, cuts)
    every = np.arange(m)
    return good[every, best], which, cut, left[every, which, cut]


def _by_sorting(x, y, bag, rows, lens, drawn, counts, weights):
    """The same for nodes of few rows: nothing is counted for a bin that no row is in."""
    m, k = drawn.shape
    node = np.repeat(np.arange(m), lens)
    group = node[:, None] * k + np.arange(k)
    bins = _drawn_bins(x, rows, drawn[node]).astype(np.int64)
    entries = np.sort(((group << 32) | (bins << 24) | ((y[rows] << 8) | bag[rows])[:, None]).ravel())
    at, last = entries >> 32, entries >> 24
    kind, times = (entries >> 8) & 0xFFFF, entries & 0xFF
    upto = np.empty((len(entries), len(weights)))
    for c in range(len(weights)):
        np.cumsum(np.where(kind == c, times, 0), out=upto[:, c])
    # The last entry of a bin, with more of the same group after it.
    ends = np.flatnonzero((last[1:] != last[:-1]) & (at[1:] == at[:-1]))
    out = np.full(m, -np.inf), np.zeros(m, int), np.zeros(m, int), np.zeros((m, len(weights)))
    if not len(ends):
        return out
    g = at[ends]
    # Each feature of a node has its rows.
    first = np.cumsum(np.repeat(lens, k)) - np.repeat(lens, k)
    before = np.where((first > 0)[:, None], upto[first - 1], 0)
    left = upto[ends] - before[g]
    owner = g // k
    good = _quality(left, counts[owner], weights)
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    best = np.repeat(np.maximum.reduceat(good, starts), np.diff(np.r_[starts, len(owner)]))
    hits = np.flatnonzero(good == best)
    some, k0 = np.unique(owner[hits], return_index=True)
    one = hits[k0]
    out[0][some], out[1][some], out[2][some], out[3][some] = good[one], g[one] % k, last[ends[one]] & 0xFF, left[one]
    return out


def _search(x, y, bag, rows, lens, drawn, counts, weights):
    """Best split of every node; the rows of a node follow one another in ``rows``."""
    (m, k), classes = drawn.shape, len(weights)
    begin = np.cumsum(lens) - lens
    good, which, cut, left = np.full(m, -np.inf), np.zeros(m, int), np.zeros(m, int), np.zeros((m, classes))
    few = lens < FEW
    ways = ((few, _by_sorting, lens * k * classes), (~few, _by_histogram, np.full(m, k * BINS * classes)))
    for chosen, best_splits, cells in ways:
        ids = np.flatnonzero(chosen)
        for part in _parts(cells[ids], CELLS):
            own = ids[part]
            n = lens[own]
            mine = rows[np.arange(n.sum()) + np.repeat(begin[own] - (np.cumsum(n) - n), n)]
            found = best_splits(x, y, bag, mine, n, drawn[own], counts[own], weights)
            for target, value in zip((good, which, cut, left), found, strict=True):
                target[own] = value
    return good, drawn[np.arange(m), which], cut, left


def grow(
    x: np.ndarray, y: np.ndarray, weights: np.ndarray, seed: Sequence[int], depth: int, drawn: int, bagged: bool = True
) -> dict[str, np.ndarray]:
    """One tree on rows ``x`` of bins with classes ``y``: Gini, ``drawn`` features a node, Poisson bag.

    ``weights`` has one for each class. Grown level by level until nodes are pure, ``depth`` is
    reached or no split helps; then leaves of one parent that say the same are merged. Returns the nodes
    as one integer each (left child, feature, cut; the right child is the next one), the leaf's row of
    ``votes``, and the class shares there.
    """
    rng = np.random.default_rng(seed)
    bag = rng.poisson(1.0, len(x)).clip(0, 255) if bagged else np.ones(len(x), dtype=np.int64)
    y = y.astype(np.int64)
    rows = np.flatnonzero(bag).astype(np.int32)
    classes, d = len(weights), x.shape[1]
    lens = np.array([len(rows)])
    all_counts = np.bincount(y[rows], weights=bag[rows], minlength=classes)[None]
    # Nodes that may split, and the class counts of their level's.
    ids = np.flatnonzero(all_counts.max(1) < all_counts.sum(1))
    counts, of_level, first = all_counts, 1, 0
    # One entry for each level: class counts, and left child (-1 for leaves), feature and cut.
    levels = []
    for level in range(depth + 1):
        child, feature, cut = (np.full(of_level, v) for v in (-1, 0, NO_CUT))
        levels.append((all_counts, child, feature, cut))
        if level == depth or not len(ids):
            break
        tried = np.argpartition(rng.random((len(ids), d)), drawn - 1, axis=1)[:, :drawn]
        good, by, at, left = _search(x, y, bag, rows, lens, tried, counts, weights)
        w = counts * weights
        base = (w * w).sum(1) / w.sum(1)
        split = good - base > 1e-12 * base
        first += of_level
        child[ids[split]] = first + 2 * np.arange(split.sum())
        feature[ids[split]], cut[ids[split]] = by[split], at[split]
        # Only rows of nodes that split go on, those on the left of a node before those on its right.
        rows = rows[np.repeat(split, lens)]
        lens, by, at, left, counts = lens[split], by[split], at[split], left[split], counts[split]
        node = np.repeat(np.arange(len(lens)), lens)
        right = x[rows, by[node]] > at[node]
        upto = np.cumsum(right)
        begin = np.cumsum(lens) - lens
        before = np.where(begin > 0, upto[begin - 1], 0) if len(rows) else begin
        n_right = np.add.reduceat(right, begin, dtype=np.int64) if len(rows) else begin
        n_left = lens - n_right
        nth = upto - before[node]
        here = np.arange(len(rows))
        place = np.where(right, begin[node] + n_left[node] + nth - 1, here - nth)
        ordered = np.empty_like(rows)
        ordered[place] = rows
        all_counts = np.stack([left, counts - left], 1).reshape(-1, classes)
        lens = np.stack([n_left, n_right], 1).reshape(-1)
        of_level = len(lens)
        open_ = all_counts.max(1) < all_counts.sum(1)
        rows, ids = ordered[np.repeat(open_, lens)], np.flatnonzero(open_)
        lens, counts = lens[open_], all_counts[open_]
    return _packed(levels, weights)


def _packed(levels: list, weights: np.ndarray) -> dict[str, np.ndarray]:
    says = [(c * weights).argmax(1) for c, *_ in levels]
    base = np.cumsum([0] + [len(s) for s in says])
    # From the deepest level up, so that what was merged can be merged again.
    for i in range(len(levels) - 2, -1, -1):
        child = levels[i][1]
        inner = np.flatnonzero(child >= 0)
        to = child[inner] - base[i + 1]
        leaf = levels[i + 1][1] < 0
        same = leaf[to] & leaf[to + 1] & (says[i + 1][to] == says[i + 1][to + 1])
        child[inner[same]] = -1
    counts, child, feature, cut = (np.concatenate(v) for v in zip(*levels, strict=True))
    kept = np.zeros(len(child), dtype=bool)
    kept[0] = True
    depth = 0
    for i in range(len(levels) - 1):
        own = slice(base[i], base[i + 1])
        to = child[own][kept[own] & (child[own] >= 0)]
        kept[to] = kept[to + 1] = True
        depth = i + 1 if len(to) else depth
    number = np.cumsum(kept) - 1
    child, feature, cut, counts = child[kept], feature[kept], cut[kept], counts[kept]
    inner = child >= 0
    to = np.where(inner, number[child], np.arange(len(child)))
    node = (to << 32) | np.where(inner, (feature << 8) | cut, NO_CUT)
    # A row of shares for each class alone, then one for each mixed leaf, or the one of no rows.
    mixed = ~inner & ((counts.max(1) < counts.sum(1)) | (counts.sum(1) == 0))
    vote = np.where(inner, 0, counts.argmax(1))
    vote[mixed] = len(weights) + np.arange(mixed.sum())
    w = counts[mixed] * weights
    shares = w / np.maximum(w.sum(1, keepdims=True), np.finfo(float).tiny)
    votes = np.concatenate([np.eye(len(weights)), shares])
    return {"depth": depth, "node": node.astype(np.int64), "vote": vote.astype(np.int32), "votes": votes}


def ask(x: np.ndarray, trees: Sequence[tuple], classes: int) -> np.ndarray:
    """Sum of the trees' class shares for rows of bins."""
    n, d = x.shape
    flat, start = x.reshape(-1), np.arange(n) * d
    total = np.zeros((n, classes))
    for depth, node, vote, votes in trees:
        at = np.zeros(n, dtype=np.int64)
        for _ in range(depth):
            here = node[at]
            at = (here >> 32) + (flat[start + ((here >> 8) & 0xFFFFFF)] > (here & 0xFF))
        total += votes[vote[at]]
    return total


@dataclass
class GrownForest:
    """A folder with one row for each tree, and what is needed to ask them."""

    path: str
    labels: list[str]
    cuts: list[list[float]]

    def save(self, spark: SparkSession, path: str) -> None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        spark.read.schema(TREE_SCHEMA).parquet(f"{self.path}/trees").write.parquet(f"{path}/trees")
        about = spark.createDataFrame([(self.labels, self.cuts)], "labels array<string>, cuts array<array<double>>")
        about.coalesce(1).write.parquet(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> GrownForest:
        about = spark.read.parquet(f"{path}/about").first()
        return GrownForest(path, list(about["labels"]), [list(c) for c in about["cuts"]])

    def parts(self, spark: SparkSession, most: int | None = None) -> list[tuple[int, int]]:
        """First and last tree of each part, of at most ``most`` bytes, one tree at least."""
        most = (ASK_MB << 20) if most is None else most
        size = F.length("node") + F.length("vote") + F.length("votes")
        trees = spark.read.schema(TREE_SCHEMA).parquet(f"{self.path}/trees").select("tree", size.alias("size"))
        sizes = trees.orderBy("tree").toPandas()
        ids = sizes["tree"].to_numpy()
        return [(int(ids[p][0]), int(ids[p][-1])) for p in _parts(sizes["size"].to_numpy(), most)]

    def votes(self, spark: SparkSession, part: tuple[int, int], features: Sequence[str]) -> Column:
        """Class shares of a row, summed over the part's trees, which workers are sent."""
        trees = spark.read.schema(TREE_SCHEMA).parquet(f"{self.path}/trees").where(F.col("tree").between(*part))
        classes = len(self.labels)
        sent = [
            (
                t["depth"], np.frombuffer(t["node"], np.int64), np.frombuffer(t["vote"], np.int32),
                np.frombuffer(t["votes"], float).reshape(-1, classes),
            )
            for t in sorted(trees.collect(), key=lambda t: t["tree"])
        ]
        shared = spark.sparkContext.broadcast(sent)
        cuts = [np.array(c) for c in self.cuts]

        @F.pandas_udf("array<double>")
        def shares(x: pd.DataFrame) -> pd.Series:
            return pd.Series(list(ask(binned(x.to_numpy(dtype=float), cuts), shared.value, classes)))

        return shares(F.struct(*[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(features)]))


def grow_forest(
    rows: DataFrame,
    labels: Sequence[str],
    weights: Sequence[float],
    features: Sequence[str],
    path: str,
    trees: int,
    depth: int,
    seed: int,
) -> GrownForest:
    """Grow trees on staged ``rows`` (``row``, ``y`` the class's place, features as numbers).

    The driver collects the rows' bins, a byte for each feature, and sends them to the workers, where
    each task grows one tree. Which rows a tree takes how often follows from ``seed`` and the order of rows.
    """
    spark, d = rows.sparkSession, len(features)
    class_weights = np.array(weights, dtype=float)
    some = rows.orderBy(F.xxhash64("row", F.lit(seed)), "row").limit(CUT_ROWS).drop("row").toPandas()
    heavy = class_weights[some["y"].to_numpy()]
    cuts = [feature_cuts(some[f].to_numpy(dtype=float), heavy) for f in features]
    names = list(features)

    def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = binned(b[names].to_numpy(dtype=float), cuts)
            yield pd.DataFrame({"y": [b["y"].to_numpy(dtype=np.int32).tobytes()], "x": [x.tobytes()]})

    dealt = [(bytes(r["y"]), bytes(r["x"])) for r in rows.mapInPandas(bins, "y binary, x binary").collect()]
    y = np.concatenate([np.frombuffer(p[0], np.int32) for p in dealt])
    x = np.frombuffer(b"".join(p[1] for p in dealt), np.uint8).reshape(-1, d)
    del dealt
    shared = spark.sparkContext.broadcast((x, y))
    del x
    # As many as Spark draws: the square root if there is more than one tree.
    drawn = int(np.ceil(np.sqrt(d))) if trees > 1 else d

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t in b["id"]:
                made = grow(*shared.value, class_weights, [seed, int(t)], depth, drawn)
                blobs = {c: [made[c].tobytes()] for c in ("node", "vote", "votes")}
                yield pd.DataFrame({"tree": [t], "depth": [made["depth"]], "n_nodes": [len(made["node"])]} | blobs)

    spark.range(0, trees, 1, trees).mapInPandas(build, TREE_SCHEMA).write.mode("overwrite").parquet(f"{path}/trees")
    shared.unpersist()
    return GrownForest(path, list(labels), [c.tolist() for c in cuts])
