"""Isolation forest (Liu, Ting, Zhou 2008): bounded samples per tree, distributed scoring."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentrel.functions import fixed
from sentrel.functions.staging import materialise
from sentrel.operators.quality import model_input
from sentrel.operators.windows import quantiles

SAMPLE = 256
NODE_SCHEMA = (
    "tree int, node int, feature int, threshold double, left int, right int, n int, depth int"
)


def path_norm(n: np.ndarray) -> np.ndarray:
    """Average path length of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3)
    value = 2.0 * (np.log(big - 1.0) + np.euler_gamma) - 2.0 * (big - 1.0) / big
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, value))


def grow(tree: int, x: np.ndarray, seed: int) -> pd.DataFrame:
    """One isolation tree of at most 2 * 256 - 1 nodes."""
    rng = np.random.default_rng([seed, tree])
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes, todo = [], [(np.arange(len(x)), 0, None, None)]
    while todo:
        rows, depth, parent, side = todo.pop()
        me = len(nodes)
        if parent is not None:
            nodes[parent][side] = me
        lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(hi > lo)
        node = [tree, me, -1, 0.0, -1, -1, len(rows), depth]
        nodes.append(node)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            continue
        feature = int(rng.choice(usable))
        cut = float(rng.uniform(lo[feature], hi[feature]))
        left = x[rows, feature] <= cut
        node[2], node[3] = feature, cut
        todo.append((rows[~left], depth + 1, me, 5))
        todo.append((rows[left], depth + 1, me, 4))
    return pd.DataFrame(nodes, columns=[c.split()[0] for c in NODE_SCHEMA.split(", ")])


@dataclass
class IsolationModel:
    """Trees as a table of at most trees * 511 rows, and the score that marks an anomaly."""

    nodes: pd.DataFrame
    features: list[str]
    sample: int
    cutoff: float

    def save(self, spark: SparkSession, path: str) -> None:
        nodes = self.nodes.assign(sample=self.sample, cutoff=self.cutoff)
        df = spark.createDataFrame(nodes, NODE_SCHEMA + ", sample int, cutoff double")
        names = F.array(*[F.lit(f) for f in self.features])
        df.withColumn("features", names).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> IsolationModel:
        pdf = spark.read.parquet(path).orderBy("tree", "node").toPandas()
        return IsolationModel(
            pdf.drop(columns=["sample", "cutoff", "features"]),
            list(pdf["features"].iloc[0]),
            int(pdf["sample"].iloc[0]),
            float(pdf["cutoff"].iloc[0]),
        )


def _score(df: DataFrame, nodes: pd.DataFrame, features: Sequence[str], sample: int) -> DataFrame:
    """Add ``score`` in (0, 1]: 2 to the minus of mean path length over its norm."""
    trees = [
        (
            g["feature"].to_numpy(), g["threshold"].to_numpy(), g["left"].to_numpy(),
            g["right"].to_numpy(), (g["depth"] + path_norm(g["n"])).to_numpy(),
        )
        for _, g in nodes.sort_values(["tree", "node"]).groupby("tree")
    ]
    shared = df.sparkSession.sparkContext.broadcast(trees)
    norm = float(path_norm(sample)) or 1.0
    names = list(features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[names].to_numpy(dtype=float)
            total = np.zeros(len(x))
            every = np.arange(len(x))
            for feature, threshold, left, right, length in shared.value:
                at = np.zeros(len(x), dtype=int)
                while True:
                    inner = feature[at] >= 0
                    if not inner.any():
                        break
                    f = np.maximum(feature[at], 0)
                    nxt = np.where(x[every, f] <= threshold[at], left[at], right[at])
                    at = np.where(inner, nxt, at)
                total += length[at]
            batch["score"] = 2.0 ** (-total / len(shared.value) / norm)
            yield batch

    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInPandas(run, fields + ", score double")


def fit_isolation(
    df: DataFrame,
    row_id: str,
    features: Sequence[str] = fixed.FLOW_FEATURES,
    trees: int = fixed.TREES,
    contamination: float = fixed.CONTAMINATION,
    seed: int = fixed.SEED,
    sample: int = SAMPLE,
) -> IsolationModel:
    """Grow trees on hashed samples; the cutoff is the exact score quantile of ``df``.

    At most ``trees * sample`` rows leave the table. The cutoff needs one scoring pass.
    """
    rows = model_input(df.select(row_id, *[f"`{c}`" for c in features]), features)
    pool = materialise(
        rows.orderBy(F.xxhash64(row_id, F.lit(seed)), row_id).limit(trees * sample)
    )
    picks = pool.select(row_id, F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    order = Window.partitionBy("tree").orderBy(F.xxhash64(row_id, "tree", F.lit(seed)), row_id)
    drawn = picks.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= sample)
    names = list(features)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rk")
        return grow(int(pdf["tree"].iloc[0]), pdf[names].to_numpy(dtype=float), seed)

    nodes = drawn.join(pool, row_id).groupBy("tree").applyInPandas(build, NODE_SCHEMA).toPandas()
    if nodes.empty:
        raise ValueError("no rows to fit on")
    size = int(nodes["n"].max())
    scored = _score(rows, nodes, names, size).select(F.lit(0).alias("k"), "score")
    # Few scores tie, so the quantile is taken on buckets and not by one task.
    cutoff = quantiles(scored, ["k"], "score", [1.0 - contamination]).first()["q"]
    return IsolationModel(nodes, names, size, float(cutoff))


def flag_anomalies(df: DataFrame, model: IsolationModel) -> DataFrame:
    """Add ``decision`` (negative means anomalous) and ``anomaly`` (-1 or 1)."""
    decision = F.lit(model.cutoff) - F.col("score")
    return (
        _score(model_input(df, model.features), model.nodes, model.features, model.sample)
        .withColumn("decision", decision)
        .withColumn("anomaly", F.when(decision < 0, -1).otherwise(1))
        .drop("score")
    )
