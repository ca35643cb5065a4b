"""Random forest classification of flows with Spark ML."""

from __future__ import annotations

import gc
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel.functions import fixed
from sentrel.functions.staging import materialise, scratch
from sentrel.operators import evaluation, quality
from sentrel.operators.trees import GrownForest, grow_forest

#: Nodes of the trees that the driver, or a task that scores, holds at a time (about 500 bytes each).
NODES = 250_000
#: MB of binned rows, a byte for each feature, that the driver and tasks may hold to grow trees from.
HELD_MB = 128
#: The same for a forest in parts: what a part leaves behind adds to the next one's.
PART_NODES = 100_000
#: What a task counts in at a time while trees grow; an executor has one for each core.
TASK_MB = 256
#: The same for a forest in parts, which takes more passes anyway; garbage of that size is what fills an executor.
PART_MB = 32
#: Rows of a task while such a forest grows: each task counts every node, whatever rows it has.
GROW_ROWS = 20_000
#: Rows of a task that such a forest's part is asked for: each task is sent the part's trees.
ASK_ROWS = 50_000


@dataclass
class PartedForest:
    """A forest with more nodes than are held at a time: saved models of some of its trees each."""

    parts: list[str]
    labels: list[str]

    def save(self, spark: SparkSession, path: str) -> None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        for k, part in enumerate(self.parts):
            PipelineModel.load(part).write().save(f"{path}/{k:05d}")
            _let_go(spark)

    @staticmethod
    def load(spark: SparkSession, path: str) -> PartedForest:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
        parts = sorted(f.getPath().toString() for f in files)
        return PartedForest(parts, PipelineModel.load(parts[0]).stages[-1].getLabels())

    def transform(self, df: DataFrame, features: Sequence[str]) -> DataFrame:
        """Add ``prediction`` and ``probability``, an array: the parts vote one after the other.

        The rows are staged with a number, and each part's votes beside them. A stream holds all parts.
        """

        def vote(rows: DataFrame, part: str) -> DataFrame:
            voted = PipelineModel.load(part).transform(rows)
            return voted.select(*[f"`{c}`" for c in rows.columns], vector_to_array("rawPrediction").alias("v"))

        return _by_parts(df, features, df.columns, self.labels, self.parts, vote)


def _ask_grown(df: DataFrame, model: GrownForest, features: Sequence[str]) -> DataFrame:
    """The same for a grown forest, without the features; one that is small enough is asked as a whole."""
    spark, kept = df.sparkSession, [c for c in df.columns if c not in features]

    def vote(rows: DataFrame, part: tuple[int, int]) -> DataFrame:
        return rows.withColumn("v", model.votes(spark, part, features))

    return _by_parts(df, features, kept, model.labels, model.parts(spark), vote)


def _by_parts(
    df: DataFrame,
    features: Sequence[str],
    columns: Sequence[str],
    labels: Sequence[str],
    parts: Sequence,
    vote: Callable[..., DataFrame],
) -> DataFrame:
    """``columns`` with what the parts say together; ``vote(rows, part)`` adds a part's shares as ``v``."""
    if df.isStreaming or len(parts) == 1:
        rows = df.withColumn("__votes", F.array())
        for part in parts:
            more = F.array_append("__votes", F.struct("v"))
            rows = vote(rows, part).select(*[f"`{c}`" for c in df.columns], more.alias("__votes"))
        return _counted(rows.select(*[f"`{c}`" for c in columns], "__votes"), labels)
    spark = df.sparkSession
    rows = materialise(df.withColumn("__row", F.monotonically_increasing_id()))
    out = scratch(spark, "votes")
    asked = rows.select("__row", *[f"`{c}`" for c in features]).coalesce(_tasks(rows.count(), ASK_ROWS))
    for k, part in enumerate(parts):
        voted = vote(asked, part)
        voted.select("__row", "v").write.parquet(f"{out}/part={k}")
        del voted
        _let_go(spark)
    votes = spark.read.schema("__row bigint, v array<double>, part int").parquet(out)
    # One grouping and no join: each sort of a task takes pages that grow with the heap.
    kept = rows.select("__row", F.struct(*[f"`{c}`" for c in columns]).alias("__kept"), F.lit(None).alias("__vote"))
    each = kept.unionByName(votes.select("__row", F.lit(None).alias("__kept"), F.struct("part", "v").alias("__vote")))
    # In the order of the parts, so that reruns add up to the same bits.
    whole = each.groupBy("__row").agg(
        F.first("__kept", ignorenulls=True).alias("__kept"), F.sort_array(F.collect_list("__vote")).alias("__votes")
    )
    return _counted(whole.select("__kept.*", "__votes"), labels)


def _counted(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    none = F.array(*[F.lit(0.0) for _ in labels])
    total = F.aggregate("__votes", none, lambda s, p: F.zip_with(s, p["v"], lambda a, b: a + b))
    names = F.array(*[F.lit(name) for name in labels])
    most = F.array_position("total", F.array_max("total")).cast("int")
    every = F.aggregate("total", F.lit(0.0), lambda s, v: s + v)
    return (
        rows.withColumn("total", total)
        .withColumn("prediction", F.element_at(names, most))
        .withColumn("probability", F.transform("total", lambda v: v / every))
        .drop("__votes", "total")
    )


def train_forest(
    train: DataFrame,
    features: Sequence[str] = fixed.FLOW_FEATURES,
    label: str = "Label",
    trees: int = fixed.TREES,
    depth: int = fixed.TREE_DEPTH,
    seed: int = fixed.SEED,
    nodes: int = NODES,
) -> PipelineModel | PartedForest | GrownForest:
    """Forest with balanced class weights; missing and infinite features count as 0.

    A forest that may have more than ``NODES`` nodes is grown tree by tree, each by one task that is sent the
    binned rows, as long as those take no more than ``HELD_MB``. Beyond that, and where a caller
    lets fewer ``nodes`` be held, Spark's trees are grown and saved some at a time, at most
    ``PART_NODES`` nodes, each part with a seed of its own, so neither the driver nor a task holds the
    forest or the rows. The smallest part is one tree.
    """
    # One row per class; written out, so that the planner sees how small it is.
    counts = materialise(
        quality.class_weights(train, label).select(
            F.col("label").alias(label), "n", F.col("weight").alias("class_weight")
        )
    )
    # A leaf has a row at least.
    total = counts.agg(F.sum("n")).first()[0] or 0
    largest = min(2 * total, 2 ** (depth + 1))
    if not counts.where(F.col(label).isNull()).isEmpty():
        raise ValueError("rows without a label cannot be trained on")
    if trees * largest > max(nodes, NODES) and total * len(features) <= HELD_MB << 20:
        return _grow(train, counts, features, label, trees, depth, seed)
    weights = counts.drop("n")
    rows = quality.model_input(train.select(label, *[f"`{c}`" for c in features]), features)
    indexer = StringIndexer(inputCol=label, outputCol="class_index", stringOrderType="alphabetAsc")
    names = indexer.fit(rows)
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    grower = RandomForestClassifier(
        labelCol="class_index",
        featuresCol="features",
        weightCol="class_weight",
        predictionCol="class_prediction",
        numTrees=trees,
        maxDepth=depth,
        seed=seed,
        maxMemoryInMB=TASK_MB,
        # Else each task of each pass gets the trees as far as they have grown.
        cacheNodeIds=True,
    )
    named = IndexToString(inputCol="class_prediction", outputCol="prediction", labels=names.labels)
    known = rows.join(weights, label)
    if trees * largest <= nodes:
        model = Pipeline(stages=[names, assembler, grower, named]).fit(known)
        return PipelineModel(model.stages[1:])
    return _train_parts(known, names, assembler, grower, named, min(nodes, PART_NODES), largest, total)


def _grow(
    train: DataFrame, counts: DataFrame, features: Sequence[str], label: str, trees: int, depth: int, seed: int
) -> GrownForest:
    spark = train.sparkSession
    classes = counts.select(F.col(label).cast("string").alias("name"), "class_weight").orderBy("name").collect()
    names = [c["name"] for c in classes]
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(label).cast("string")) - 1
    # Features go by their places: the names of columns may be anything.
    places = [f"x{i}" for i in range(len(features))]
    rows = quality.model_input(train.select(label, *[f"`{c}`" for c in features]), features).select(
        F.monotonically_increasing_id().alias("row"),
        place.cast("int").alias("y"),
        *[F.col(f"`{c}`").alias(p) for c, p in zip(features, places, strict=True)],
    )
    weights = [c["class_weight"] for c in classes]
    return grow_forest(materialise(rows), names, weights, places, scratch(spark, "forest"), trees, depth, seed)


def _tasks(rows: int, each: int) -> int:
    return max(1, -(-rows // each))


def _let_go(spark: SparkSession) -> None:
    """Have executors drop the trees and node numbers that earlier tasks were sent.

    Spark does so once the driver has collected its garbage, which it may not do for half an hour.
    """
    gc.collect()
    spark._jvm.System.gc()


def _train_parts(
    known: DataFrame,
    names: StringIndexerModel,
    assembler: VectorAssembler,
    grower: RandomForestClassifier,
    named: IndexToString,
    nodes: int,
    largest: int,
    total: int,
) -> PartedForest:
    spark, trees = known.sparkSession, grower.getNumTrees()
    ready = materialise(
        assembler.transform(names.transform(known)).select("class_index", "class_weight", "features")
    )
    # No more partitions than the rows are worth or than run at a time.
    ready = ready.coalesce(min(_tasks(total, GROW_ROWS), spark.sparkContext.defaultParallelism))
    folder, parts, done, step = scratch(spark, "forest"), [], 0, max(1, nodes // largest)
    # What Spark takes for more than one tree, also where a part has one.
    chosen = "sqrt" if trees > 1 else "auto"
    while done < trees:
        n = min(step, trees - done)
        own = {grower.numTrees: n, grower.seed: grower.getSeed() + done, grower.maxMemoryInMB: PART_MB}
        some = grower.copy(own | {grower.featureSubsetStrategy: chosen})
        fitted = some.fit(ready)
        parts.append(f"{folder}/{len(parts):05d}")
        PipelineModel([assembler, fitted, named]).write().save(parts[-1])
        done += n
        # The trees so far tell how large the next ones will be.
        step = max(1, int(0.9 * nodes * n / fitted.totalNumNodes))
        del fitted, some
        _let_go(spark)
    return PartedForest(parts, names.labels)


def classify(
    df: DataFrame, model: PipelineModel | PartedForest | GrownForest, features: Sequence[str] = fixed.FLOW_FEATURES
) -> DataFrame:
    """Add ``prediction`` and ``confidence``, the largest class probability."""
    missing = quality.missing_features(df, features)
    if missing:
        raise ValueError(f"missing features: {missing}")
    # The model sees cleaned features under their names; the input columns stay as they were.
    kept = [c for c in df.columns if c not in features]
    packed = df.select(*[f"`{c}`" for c in kept], F.struct(*[f"`{c}`" for c in features]).alias("__raw"), *[f"`{c}`" for c in features])
    ready = quality.model_input(packed, features)
    if isinstance(model, GrownForest):
        scored, probability = _ask_grown(ready, model, features), F.col("probability")
    elif isinstance(model, PartedForest):
        scored, probability = model.transform(ready, features), F.col("probability")
    else:
        scored, probability = model.transform(ready), vector_to_array("probability")
    return scored.select(
        *[f"`{c}`" for c in kept], "__raw.*", "prediction", F.array_max(probability).alias("confidence")
    )


def evaluate_holdout(
    df: DataFrame,
    row_id: str,
    features: Sequence[str] = fixed.FLOW_FEATURES,
    label: str = "Label",
    file: str = "file",
    trees: int = fixed.TREES,
    depth: int = fixed.TREE_DEPTH,
) -> dict[str, DataFrame]:
    """Temporal hold-out: split each file, train on the first part, rate the second."""
    rows = quality.drop_other(quality.normalise_labels(df, label, evaluation=True), label)
    parts = quality.temporal_split(rows, row_id, file)
    train, test = parts.where("part = 'train'"), parts.where("part = 'test'")
    model = train_forest(train, features, label, trees, depth)
    rated = classify(test, model, features).select(
        F.col(label).alias("actual"), F.col("prediction").alias("predicted")
    )
    known = train.select(F.col(label).alias("actual"))
    return {
        "overall": evaluation.overall(rated),
        "classes": evaluation.class_report(rated),
        "confusion": evaluation.confusion(rated),
        "unseen_classes": quality.unseen_classes(train, test, label),
        "unseen_predictions": evaluation.unseen_predictions(rated, known),
    }
