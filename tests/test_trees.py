"""Trees grown by tasks on binned rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sentrel.operators import forest, quality, trees
from sentrel.sources import events as src

NAMES = [f"f{i}" for i in range(4)]


def brute(x, y, w, depth):
    """Nested (feature, cut, left, right) or class shares, by trying every cut of every feature."""
    c = np.bincount(y, minlength=len(w)) * w
    leaf = tuple(c / c.sum())

    def purity(p):
        p = p * w
        return (p * p).sum() / p.sum()

    best = (purity(c / w) * (1 + 1e-12), None)
    for f in range(x.shape[1]) if depth else ():
        for cut in range(x[:, f].max()):
            left = x[:, f] <= cut
            if left.any() and not left.all():
                sides = [np.bincount(y[s], minlength=len(w)) for s in (left, ~left)]
                good = purity(sides[0]) + purity(sides[1])
                if good > best[0] * (1 + 1e-12):
                    best = (good, (f, cut, left))
    if best[1] is None:
        return leaf
    f, cut, left = best[1]
    sides = [brute(x[s], y[s], w, depth - 1) for s in (left, ~left)]
    if all(len(s) == len(w) and not isinstance(s[2], tuple) for s in sides) and np.argmax(sides[0]) == np.argmax(sides[1]):
        return leaf
    return (f, cut, *sides, "inner")


def shares(tree, row):
    while tree[-1] == "inner":
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def one(made):
    return [(made["depth"], made["node"], made["vote"], made["votes"])]


@pytest.mark.parametrize("few,cells", [(0, 1 << 18), (10**9, 1 << 18), (20, 50), (0, 40)])
@pytest.mark.parametrize("depth", [1, 3])
def test_trees_are_those_of_every_cut_tried(monkeypatch, few, cells, depth):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 32, (150, 3)).astype(np.uint8)
    y = np.where(rng.random(150) < 0.7, (x[:, 0] // 11 + x[:, 1] // 16) % 3, rng.integers(0, 3, 150))
    w = np.array([1.0, 0.7, 1.9])
    monkeypatch.setattr(trees, "FEW", few)
    monkeypatch.setattr(trees, "CELLS", cells)
    made = trees.grow(x, y, w, [1], depth, 3, bagged=False)
    assert made["depth"] <= depth and len(made["node"]) == len(made["vote"])
    # Rows of the same quality of split may go either way: no two splits tie in these.
    want = brute(x, y, w, depth)
    every = rng.integers(0, 32, (500, 3)).astype(np.uint8)
    got = trees.ask(every, one(made), 3)
    assert got == pytest.approx(np.array([shares(want, r) for r in every]))
    # Grown out, all rows that differ are told apart.
    whole = trees.ask(x, one(trees.grow(x, y, w, [1], 20, 3, bagged=False)), 3)
    alike = [[set(y[(x == r).all(1)])] for r in x]
    assert all(whole[i].argmax() in alike[i][0] for i in range(len(x))) and (whole.max(1) == 1).mean() > 0.9


def test_trees_of_odd_rows():
    w = np.array([1.0, 2.0])
    same = np.zeros((6, 2), np.uint8)
    mixed = trees.grow(same, np.array([0, 0, 0, 0, 1, 1]), w, [1], 20, 2, bagged=False)
    assert len(mixed["node"]) == 1 and trees.ask(same[:1], one(mixed), 2).tolist() == [[0.5, 0.5]]
    pure = trees.grow(same, np.ones(6, int), w, [1], 20, 2, bagged=False)
    assert trees.ask(same[:1], one(pure), 2).tolist() == [[0, 1]]
    # A tree whose bag is empty, as one row's may be, says nothing.
    said = {tuple(trees.ask(same[:1], one(trees.grow(same[:1], np.array([1]), w, [s], 20, 2)), 2)[0]) for s in range(20)}
    assert said == {(0.0, 0.0), (0.0, 1.0)}


def test_cuts():
    few = np.array([3.0, 1.0, 1.0, 7.0])
    assert trees.feature_cuts(few, np.ones(4)).tolist() == [2.0, 5.0]
    assert len(trees.feature_cuts(np.full(9, 4.0), np.ones(9))) == 0
    many = np.random.default_rng(1).normal(size=5000)
    cuts = trees.feature_cuts(many, np.ones(5000))
    sizes = np.bincount(trees.binned(many[:, None], [cuts])[:, 0])
    assert len(cuts) == 31 and sizes.min() > 150 and sizes.max() < 163
    # Half of the weight on one value takes one bin.
    heavy = np.where(np.arange(5000) % 2 == 0, 0.0, many)
    cuts = trees.feature_cuts(heavy, np.ones(5000))
    bins = trees.binned(heavy[:, None], [cuts])[:, 0]
    assert len(set(cuts)) == len(cuts) <= 31 and bins.max() <= 31 and len(set(bins[::2])) == 1
    assert trees.binned(np.array([[2.0], [2.1]]), [np.array([2.0])]).tolist() == [[0], [1]]


def rows(spark, n=400):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, n)
    x = rng.normal(size=(n, 4)) + 2 * y[:, None]
    pdf = pd.DataFrame(x, columns=NAMES).assign(row_id=np.arange(n), Label=np.array(["BENIGN", "DOS", "BOT"])[y])
    df = spark.createDataFrame(pdf)
    lost = spark.createDataFrame([(None, "BOT", None, float("inf"), 1.0, 2.0)], "row_id bigint, Label string, f0 double, f1 double, f2 double, f3 double")
    return df.unionByName(lost)


def test_grown_forest(spark, tmp_path, monkeypatch):
    """A forest too large to be one model is grown by one job, saved, loaded and asked."""
    df = rows(spark)
    monkeypatch.setattr(forest, "NODES", 100)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("grown", "grown")
    model = forest.train_forest(df, NAMES, trees=9, depth=6, nodes=100)
    jobs = len(tracker.getJobIdsForGroup("grown"))
    spark.sparkContext._jsc.clearJobGroup()
    assert isinstance(model, trees.GrownForest) and model.labels == ["BENIGN", "BOT", "DOS"]
    # Not a job for each level of each part.
    assert jobs < 20
    assert len(model.parts(spark)) == 1 and len(model.parts(spark, 1)) == 9
    train = quality.model_input(df, NAMES).orderBy("row_id").toPandas()
    x = trees.binned(train[NAMES].to_numpy(float), [np.array(c) for c in model.cuts])
    made = spark.read.parquet(f"{model.path}/trees").orderBy("tree").collect()
    assert [t["tree"] for t in made] == list(range(9)) and max(t["depth"] for t in made) <= 6
    assert len({bytes(t["node"]) for t in made}) == 9
    held = [
        (t["depth"], np.frombuffer(t["node"], np.int64), np.frombuffer(t["vote"], np.int32), np.frombuffer(t["votes"], float).reshape(-1, 3))
        for t in made
    ]
    want = trees.ask(x, held, 3)
    got = forest.classify(df, model, NAMES)
    assert got.columns == [*[c for c in df.columns if c not in NAMES], *NAMES, "prediction", "confidence"]
    got = got.orderBy("row_id").toPandas()
    assert got["confidence"].to_numpy() == pytest.approx(want.max(1) / want.sum(1))
    assert got["prediction"].tolist() == [model.labels[i] for i in want.argmax(1)]
    assert len(got) == 401 and (got["prediction"] == got["Label"]).mean() > 0.95
    assert np.isnan(got["f0"].to_numpy()).sum() == 1
    src.save_model(model, str(tmp_path / "rf"))
    back = src.load_model(str(tmp_path / "rf"))
    assert isinstance(back, trees.GrownForest)
    # Asked tree by tree, as a forest that does not fit is.
    monkeypatch.setattr(trees, "ASK_MB", 0)
    again = forest.classify(df, back, NAMES).orderBy("row_id").toPandas()
    assert again["confidence"].to_numpy() == pytest.approx(got["confidence"].to_numpy())
    assert again["prediction"].tolist() == got["prediction"].tolist()
    df.coalesce(1).write.parquet(str(tmp_path / "rows"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "rows"))
    forest.classify(stream, back, NAMES).writeStream.format("memory").queryName("grown").trigger(
        availableNow=True
    ).start().awaitTermination()
    live = spark.table("grown").orderBy("row_id").toPandas()
    assert live["confidence"].to_numpy() == pytest.approx(got["confidence"].to_numpy())


def test_grown_forest_is_like_sparks(spark, monkeypatch):
    """The same method: as many nodes and as many right answers on unseen rows, within chance."""
    df = rows(spark, 1500).where("row_id IS NOT NULL")
    noisy = df.withColumn("Label", F.when(F.xxhash64("row_id") % 4 == 0, "BENIGN").otherwise(F.col("Label")))
    train, test = noisy.where("row_id % 3 > 0"), df.where("row_id % 3 = 0")
    sparks = forest.train_forest(train, NAMES, trees=20, depth=12)
    monkeypatch.setattr(forest, "NODES", 100)
    grown = forest.train_forest(train, NAMES, trees=20, depth=12, nodes=100)
    n_nodes = spark.read.parquet(f"{grown.path}/trees").agg(F.sum("n_nodes")).first()[0]
    assert n_nodes == pytest.approx(sparks.stages[1].totalNumNodes, rel=0.1)
    right = [forest.classify(test, m, NAMES).where("prediction = Label").count() / 500 for m in (sparks, grown)]
    assert right[1] > 0.8 and right[1] == pytest.approx(right[0], abs=0.04)


def test_rows_beyond_what_is_held_are_left_to_spark(spark, monkeypatch):
    monkeypatch.setattr(forest, "NODES", 100)
    monkeypatch.setattr(forest, "HELD_MB", 0)
    model = forest.train_forest(rows(spark, 60), NAMES, trees=3, depth=5, nodes=100)
    assert isinstance(model, forest.PartedForest)
    with pytest.raises(ValueError):
        forest.train_forest(rows(spark, 60).withColumn("Label", F.lit(None).cast("string")), NAMES, trees=3, depth=4)
