"""Forest, isolation forest, clustering and pattern store."""

import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from sentrel.operators import clusters, evaluation, forest, isolation, patterns, quality
from sentrel.sources import events as src

NAMES = [f"f{i}" for i in range(4)]


def table(spark, x, labels=None):
    pdf = pd.DataFrame(x, columns=[f"f{i}" for i in range(x.shape[1])])
    pdf.insert(0, "row_id", np.arange(len(x)))
    if labels is not None:
        pdf["Label"] = labels
    return spark.createDataFrame(pdf)


def brute_dbscan(x, eps, min_samples):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    near = [np.flatnonzero(r <= eps) for r in d]
    core = np.array([len(n) >= min_samples for n in near])
    label, k = np.full(len(x), -1), 0
    for i in range(len(x)):
        if label[i] != -1 or not core[i]:
            continue
        todo = [i]
        while todo:
            p = todo.pop()
            if label[p] != -1:
                continue
            label[p] = k
            if core[p]:
                todo += [q for q in near[p] if label[q] == -1]
        k += 1
    return label


def cases():
    rng = np.random.default_rng(7)
    blobs = np.concatenate([rng.normal(c, 0.4, (40, 3)) for c in (0, 2.5, 6)])
    yield "blobs", rng.permutation(np.concatenate([blobs, rng.uniform(-4, 10, (30, 3))])), 0.6, 4
    line = np.c_[np.arange(0, 30, 0.5), np.zeros(60)]
    yield "chain", rng.permutation(line), 0.5, 3
    copies = np.concatenate([np.zeros((40, 2)), [[0.9, 0], [1.8, 0], [5, 5], [5, 5], [9, 9]]])
    yield "copies", copies, 1.0, 3
    dense = np.concatenate([rng.uniform(0, 1, (80, 2)), rng.uniform(1.2, 2.2, (80, 2))])
    yield "dense", dense, 0.3, 3
    base = rng.normal(size=22)
    yield "flows", np.concatenate([base + rng.normal(0, 0.3, (30, 22)), rng.normal(0, 3, (20, 22))]), 5.0, 3
    yield "noise", rng.uniform(0, 1000, (20, 2)), 1.0, 3


@pytest.mark.parametrize("name,x,eps,m", list(cases()), ids=[c[0] for c in cases()])
def test_dbscan_equals_sequential(spark, name, x, eps, m):
    names = [f"f{i}" for i in range(x.shape[1])]
    got = clusters.dbscan(table(spark, x), "row_id", names, eps, m).toPandas()
    got = got.sort_values("row_id")["cluster"].to_numpy()
    assert got.tolist() == brute_dbscan(x, eps, m).tolist()


def test_near_cells_in_blocks(spark, monkeypatch):
    """A grid cell that holds every box is compared in blocks, with the same pairs as box by box."""
    rng = np.random.default_rng(4)
    n, d, e2 = 90, 40, 36.0
    lo = rng.normal(size=(n, d))
    hi = lo + rng.uniform(0, 0.3, (n, d)) * (np.arange(n) % 3 > 0)[:, None]
    lo[80] = hi[80] = lo[6]
    hi[81, 3], hi[82, 0] = np.nan, np.inf
    rows = [(f"{i:03d}", i + 1, lo[i].tolist(), hi[i].tolist(), "g") for i in range(n)]
    rows.append(("090", 91, [None] * d, [None] * d, "g"))
    rows.append(("091", 92, lo[0].tolist(), hi[0].tolist(), "alone"))
    left = spark.createDataFrame(rows, "cell string, cw long, lo array<double>, hi array<double>, g string")
    right = left.where("g = 'g'").toDF("cell2", "cw2", "lo2", "hi2", "g")
    monkeypatch.setattr(clusters, "BLOCK", 16)
    monkeypatch.setattr(clusters, "STRIP", 5)
    found = clusters._near_cells(left, right, e2)
    got = {r[0] + r[1]: tuple(r)[2:] for r in found.collect()}
    want = {}
    for i in (i for i in range(n) if i not in (81, 82)):
        for j in (j for j in range(i + 1, n) if j not in (81, 82)):
            gap = (np.maximum(np.maximum(lo[i] - hi[j], lo[j] - hi[i]), 0) ** 2).sum()
            reach = (np.maximum(hi[i] - lo[j], hi[j] - lo[i]) ** 2).sum()
            if gap <= e2:
                want[f"{i:03d}{j:03d}"] = (i + 1, j + 1, bool(reach <= e2))
    # A box without an upper end may still be near.
    for i in (i for i in range(n) if i not in (81, 82)):
        gap = (np.maximum(np.maximum(lo[i] - hi[82], lo[82] - hi[i]), 0) ** 2).sum()
        if gap <= e2:
            a, b = sorted((i, 82))
            want[f"{a:03d}{b:03d}"] = (a + 1, b + 1, False)
    assert got == want and {v[2] for v in want.values()} == {True, False}


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (110, 2))] + [(i, i + 1) for i in range(300, 360)]
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    want = {n: root(n) for n in parent if root(n) != n}
    got = clusters.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r["id"]: r["root"] for r in got} == want


def test_scaling(spark):
    x = np.c_[np.arange(9.0), np.full(9, 4.0)]
    df = table(spark, x)
    scaled = clusters.scale(df, clusters.fit_scaler(df, ["f0", "f1"])).orderBy("row_id").toPandas()
    assert scaled["f0"].to_numpy() == pytest.approx((x[:, 0] - 4) / x[:, 0].std())
    assert (scaled["f1"] == 0).all()


def test_isolation(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 4))
    train = table(spark, x)
    model = isolation.fit_isolation(train, "row_id", NAMES, trees=40)
    assert model.sample == 256 and model.nodes["tree"].nunique() == 40
    assert model.nodes.groupby("tree").size().max() <= 511
    flagged = isolation.flag_anomalies(train, model).toPandas()
    assert abs((flagged["anomaly"] == -1).mean() - 0.05) < 0.01
    far = table(spark, np.array([[9.0, -9, 9, -9], [0.0, 0, 0, 0]]))
    assert isolation.flag_anomalies(far, model).orderBy("row_id").toPandas()["anomaly"].tolist() == [-1, 1]
    again = isolation.fit_isolation(train.repartition(5), "row_id", NAMES, trees=40)
    assert again.cutoff == model.cutoff
    model.save(spark, str(tmp_path / "m"))
    back = isolation.IsolationModel.load(spark, str(tmp_path / "m"))
    assert isolation.flag_anomalies(train, back).toPandas().equals(flagged)


def test_path_norm():
    want = 2 * sum(1 / i for i in range(1, 256)) - 2 * 255 / 256
    assert float(isolation.path_norm(256)) == pytest.approx(want, abs=0.01)
    assert isolation.path_norm(np.array([0, 1, 2])).tolist() == [0, 0, 1]


def test_forest(spark, tmp_path):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 400)
    x = rng.normal(size=(400, 4)) + 4 * y[:, None]
    df = table(spark, x, np.array(["BENIGN", "DOS", "BOT"])[y])
    df = df.withColumn("f3", F.when(F.col("row_id") == 0, float("inf")).otherwise(F.col("f3")))
    parts = quality.stratified_split(df, "row_id")
    train, test = parts.where("part = 'train'"), parts.where("part = 'test'")
    model = forest.train_forest(train, NAMES, trees=10, depth=5)
    rated = forest.classify(test, model, NAMES)
    assert set(rated.columns) == {*test.columns, "prediction", "confidence"}
    score = evaluation.overall(rated.select(F.col("Label").alias("actual"), F.col("prediction").alias("predicted")))
    assert score.first()["accuracy"] > 0.95
    src.save_model(model, str(tmp_path / "rf"))
    back = src.load_model(str(tmp_path / "rf"))
    assert isinstance(back, PipelineModel)
    assert forest.classify(test, back, NAMES).select("prediction").collect() == rated.select("prediction").collect()
    with pytest.raises(ValueError):
        forest.classify(test.drop("f1"), model, NAMES)


def test_holdout(spark):
    rng = np.random.default_rng(6)
    n = 200
    label = np.array(["BENIGN", "DDoS"])[rng.integers(0, 2, n)]
    x = rng.normal(size=(n, 4)) + 3 * (label == "DDoS")[:, None]
    label[180:] = "Bot"
    df = table(spark, x, label).withColumn("file", F.lit("one"))
    out = forest.evaluate_holdout(df, "row_id", NAMES, trees=5, depth=4)
    assert [r["Label"] for r in out["unseen_classes"].collect()] == ["BOT"]
    assert {r["actual"] for r in out["unseen_predictions"].collect()} == {"BOT"}
    assert 0 < out["overall"].first()["accuracy"] < 1
    assert out["confusion"].agg(F.sum("n")).first()[0] == 60


def test_split_sizes(spark):
    df = spark.range(90).select("id", F.lit("f").alias("file"))
    parts = quality.temporal_split(df, "id").groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in parts} == {"train": 62, "test": 28}
    mixed = spark.range(1000).select("id", F.when(F.col("id") < 900, "a").otherwise("b").alias("Label"))
    split = quality.stratified_split(mixed, "id").where("part = 'test'")
    assert {r["Label"]: r["count"] for r in split.groupBy("Label").count().collect()} == {"a": 180, "b": 20}


def test_pattern_store(spark):
    sig = spark.createDataFrame(
        [(0, 5, {"x": 1.0}), (1, 7, {"x": 2.0}), (2, 5, {"x": 3.0}), (3, 9, {"x": 4.0})],
        "cluster int, cluster_size bigint, behavioral_signature map<string,double>",
    )
    store = spark.createDataFrame(
        [("P-OLD2", 9, "KNOWN", None, "s", {"x": 0.0}, 1), ("P-OLD1", 9, "KNOWN", None, "s", {"x": 0.0}, 0)],
        patterns.STORE_SCHEMA,
    )
    matched = {r["cluster"]: r["matched_id"] for r in patterns.match_patterns(sig, store).collect()}
    assert matched == {0: None, 1: None, 2: None, 3: "P-OLD1"}
    grown = patterns.extend_store(sig, store)
    new = grown.where("status = 'NEW'").orderBy("store_order").collect()
    assert [(r["cluster_size"], r["behavioral_signature"]) for r in new] == [(5, {"x": 1.0}), (7, {"x": 2.0})]
    assert all(r["pattern_id"].startswith("P-") and len(r["pattern_id"]) == 18 for r in new)
    # Stored columns stay, and an event of a stored pattern uses its count.
    counted = store.withColumn("observations", F.lit(99).cast("bigint")).withColumn("status", F.lit("NEW"))
    kept = patterns.extend_store(sig, counted)
    assert {e["evidence"]["observation_count"] for e in patterns.pattern_events(kept).collect()} == {99, 5, 7}
    same = F.create_map(F.lit("x"), F.lit(1.0))
    ids = spark.range(1).select(*[patterns.signature_id(same, F.lit(n)) for n in (4, 5)]).first()
    assert ids[0] != ids[1]
    again = patterns.extend_store(sig, grown)
    assert again.count() == grown.count()
    events = patterns.pattern_events(grown).collect()
    assert len(events) == 2 and {e["evidence"]["observation_count"] for e in events} == {5, 7}
    assert all(e["event_id"] == "EVT-UNKNOWN-" + e["pattern_id"][2:] for e in events)


def test_candidates(spark):
    rows = [("DOS", 0.7, -1), ("DOS", 0.69, -1), ("BENIGN", 0.9, -1), ("BENIGN", 0.9, 1)]
    df = spark.createDataFrame(rows, "prediction string, confidence double, anomaly int")
    got = patterns.unknown_candidates(df).collect()
    assert [(r["prediction"], r["confidence"]) for r in got] == [("DOS", 0.69), ("BENIGN", 0.9)]


def test_cluster_means(spark):
    x = np.array([[1.0, 10], [3, 20], [5, 60], [100, 100]])
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, -1)], "row_id bigint, cluster int")
    (m,) = patterns.cluster_means(table(spark, x), labels, "row_id", {"a": "f0", "b": "f1"}).collect()
    assert m["behavioral_signature"] == {"a": 3.0, "b": 30.0} and m["observations"] == 3
    (s,) = patterns.cluster_signatures(table(spark, x), labels, "row_id", {"a": "f0"}).collect()
    assert s["behavioral_signature"] == {"a": 1.0} and not math.isnan(s["cluster_size"])


def test_forest_in_parts(spark, tmp_path):
    """Trees with more nodes than are held at a time: grown, saved and asked part by part."""
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 300)
    x = rng.normal(size=(300, 4)) + 4 * y[:, None]
    df = table(spark, x, np.array(["BENIGN", "DOS", "BOT"])[y]).unionByName(
        table(spark, x[:1], np.array(["BOT"])).withColumns({"row_id": F.lit(None).cast("bigint"), "f0": F.lit(None).cast("double")})
    )
    whole = forest.train_forest(df, NAMES, trees=7, depth=5)
    assert isinstance(whole, PipelineModel)
    model = forest.train_forest(df, NAMES, trees=7, depth=5, nodes=130)
    assert isinstance(model, forest.PartedForest) and len(model.parts) > 1
    parts = [PipelineModel.load(p).stages[1] for p in model.parts]
    assert sum(p.getNumTrees for p in parts) == 7
    assert all(p.getNumTrees == 1 or p.totalNumNodes <= 130 for p in parts)
    assert len({t.toDebugString.split("\n", 1)[1] for p in parts for t in p.trees}) > 4
    rated = forest.classify(df, model, NAMES)
    assert rated.columns == forest.classify(df, whole, NAMES).columns
    # The parts' votes, tree by tree, make what the trees say together.
    want = 0
    for p in model.parts:
        votes = PipelineModel.load(p).transform(quality.model_input(df, NAMES).orderBy("row_id")).toPandas()
        want = want + np.stack([v.toArray() for v in votes["rawPrediction"]])
    got = rated.orderBy("row_id").toPandas()
    assert len(got) == 301 and got["confidence"].to_numpy() == pytest.approx(want.max(1) / want.sum(1))
    assert got["prediction"].tolist() == [model.labels[i] for i in want.argmax(1)]
    assert np.isnan(got["f0"].to_numpy()).sum() == 1 and (got["prediction"] == got["Label"]).mean() > 0.95
    src.save_model(model, str(tmp_path / "rf"))
    back = src.load_model(str(tmp_path / "rf"))
    assert len(back.parts) == len(model.parts) and back.labels == model.labels
    again = forest.classify(df, back, NAMES).orderBy("row_id").toPandas()
    assert again["confidence"].tolist() == got["confidence"].tolist()
    df.drop("Label").coalesce(1).write.parquet(str(tmp_path / "rows"))
    stream = spark.readStream.schema(df.drop("Label").schema).parquet(str(tmp_path / "rows"))
    forest.classify(stream, model, NAMES).writeStream.format("memory").queryName("rated").trigger(
        availableNow=True
    ).start().awaitTermination()
    live = spark.table("rated").orderBy("row_id").toPandas()
    assert live["confidence"].to_numpy() == pytest.approx(got["confidence"].to_numpy())
    assert live["prediction"].tolist() == got["prediction"].tolist()


def test_parts_leave_nothing_on_executors(spark, tmp_path):
    """What tasks were sent while one part grew, or was asked, is gone before the next ones fill the memory."""
    rng = np.random.default_rng(8)
    df = table(spark, rng.normal(size=(3000, 4)), np.array(["BENIGN", "DOS", "BOT"])[rng.integers(0, 3, 3000)])
    df.write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))

    def held():
        """Bytes that broadcasts and cached rows take up."""
        sizes = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().values().toList()
        return sum(sizes.apply(i)._1() - sizes.apply(i)._2() for i in range(sizes.size()))

    def settled(most):
        """Whether no more is held within some seconds: Spark cleans in the background."""
        for _ in range(50):
            if held() - before <= most:
                return True
            time.sleep(0.1)
        return False

    forest._let_go(spark)
    time.sleep(2)
    before = held()
    model = forest.train_forest(df, NAMES, trees=4, depth=12, nodes=2500)
    assert len(model.parts) > 1 and settled(500_000), held() - before
    assert all(PipelineModel.load(p).stages[1].getMaxMemoryInMB() == forest.PART_MB < forest.TASK_MB for p in model.parts)
    forest._let_go(spark)
    rated = forest.classify(df, model, NAMES)
    assert settled(500_000), held() - before
    assert rated.count() == 3000


def test_parts_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    """A task counts every node while trees grow, and holds the part it asks: few rows are worth few tasks."""
    rng = np.random.default_rng(9)
    df = table(spark, rng.normal(size=(900, 4)), np.array(["BENIGN", "DOS", "BOT"])[rng.integers(0, 3, 900)])
    df.repartition(8).write.parquet(str(tmp_path / "rows"))
    df = spark.read.option("maxPartitionBytes", 1000).parquet(str(tmp_path / "rows"))
    grown, asked, fit, transform = [], [], forest.RandomForestClassifier.fit, PipelineModel.transform

    def fitted(self, rows, *more):
        grown.append(rows.rdd.getNumPartitions())
        return fit(self, rows, *more)

    def voted(self, rows, *more):
        asked.append(rows.rdd.getNumPartitions())
        return transform(self, rows, *more)

    monkeypatch.setattr(forest.RandomForestClassifier, "fit", fitted)
    monkeypatch.setattr(PipelineModel, "transform", voted)
    monkeypatch.setattr(forest, "GROW_ROWS", 450)
    monkeypatch.setattr(forest, "ASK_ROWS", 900)
    monkeypatch.setattr(forest, "PART_NODES", 600)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        model = forest.train_forest(df, NAMES, trees=3, depth=8, nodes=1200)
        assert forest.classify(df, model, NAMES).count() == 900
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(model.parts) == len(grown) == len(asked) > 1
    assert set(grown) == {2} and set(asked) == {1}
    found = [PipelineModel.load(p).stages[1] for p in model.parts]
    assert all(f.getNumTrees == 1 or f.totalNumNodes <= 600 for f in found)
