"""Model queries; embeddings stand in for flow features."""

from pyspark.sql import functions as F

from sentrel.operators import clusters, evaluation, forest, isolation, patterns
from sentrel.operators import quality as q
from sentrel.plans.adapters import features
from sentrel.plans.registry import query

_fitted: dict = {}


def _once(spark, sf_dir, name, make):
    """Fit a model once per session and data set."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _fitted:
        _fitted[key] = make()
    return _fitted[key]


def _forest(spark, sf_dir):
    rows, names = features(spark, sf_dir)

    def make():
        train = q.stratified_split(rows, "row_id", "label").where("part = 'train'")
        return forest.train_forest(train, names, "label")

    return _once(spark, sf_dir, "forest", make)


def _isolation(spark, sf_dir):
    rows, names = features(spark, sf_dir)
    return _once(
        spark, sf_dir, "isolation", lambda: isolation.fit_isolation(q.benign_only(rows, "label"), "row_id", names)
    )


def _scored(spark, sf_dir):
    rows, names = features(spark, sf_dir)
    rated = forest.classify(rows, _forest(spark, sf_dir), names)
    return isolation.flag_anomalies(rated, _isolation(spark, sf_dir)), names


def _clustered(spark, sf_dir):
    def make():
        scored, names = _scored(spark, sf_dir)
        # Vectors of 64 nearly independent dimensions lie about 11 apart once scaled.
        kept = clusters.materialise(patterns.unknown_candidates(scored))
        return kept, patterns.cluster_candidates(kept, "row_id", names, eps=10.0)

    return _once(spark, sf_dir, "clusters", make)


SIGNATURE = {"first": "f00", "second": "f01", "last": "f63"}


@query("rf_predictions")
def rf_predictions(spark, sf_dir):
    rows, names = features(spark, sf_dir)
    return forest.classify(rows, _forest(spark, sf_dir), names).select(
        "row_id", "label", "prediction", F.round("confidence", 6).alias("confidence")
    )


@query("rf_evaluation")
def rf_evaluation(spark, sf_dir):
    rows, names = features(spark, sf_dir)
    test = q.stratified_split(rows, "row_id", "label").where("part = 'test'")
    rated = forest.classify(test, _forest(spark, sf_dir), names)
    return evaluation.class_report(
        rated.select(F.col("label").alias("actual"), F.col("prediction").alias("predicted"))
    )


@query("iforest_scores")
def iforest_scores(spark, sf_dir):
    rows, _ = features(spark, sf_dir)
    flagged = isolation.flag_anomalies(rows, _isolation(spark, sf_dir))
    return flagged.select("row_id", F.round("decision", 9).alias("decision"), "anomaly")


@query("anomaly_rate_by_label")
def anomaly_rate_by_label(spark, sf_dir):
    rows, _ = features(spark, sf_dir)
    return evaluation.anomaly_rates(isolation.flag_anomalies(rows, _isolation(spark, sf_dir)))


@query(
    "standard_scaled",
    """WITH l AS (SELECT vec_id AS row_id, generate_subscripts(embedding, 1) AS i,
        CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
    s AS (SELECT i, avg(v) AS m, stddev_pop(v) AS d FROM l GROUP BY i)
    SELECT row_id, i, round((v - m) / d, 6) AS v FROM l JOIN s USING (i)""",
)
def standard_scaled(spark, sf_dir):
    rows, names = features(spark, sf_dir)
    scaled = clusters.scale(rows, clusters.fit_scaler(rows, names))
    return scaled.select("row_id", F.posexplode(F.array(*names))).select(
        "row_id", (F.col("pos") + 1).cast("bigint").alias("i"), F.round("col", 6).alias("v")
    )


@query("unknown_candidates")
def unknown_candidates(spark, sf_dir):
    found = patterns.unknown_candidates(_scored(spark, sf_dir)[0])
    return found.select("row_id", "prediction", F.round("confidence", 6).alias("confidence"))


@query("dbscan_labels")
def dbscan_labels(spark, sf_dir):
    return _clustered(spark, sf_dir)[1]


@query("cluster_signatures")
def cluster_signatures(spark, sf_dir):
    found = patterns.cluster_signatures(*_clustered(spark, sf_dir), "row_id", SIGNATURE)
    means = patterns.cluster_means(*_clustered(spark, sf_dir), "row_id", SIGNATURE)
    return found.select("cluster", "cluster_size", *_flat("first_")).join(
        means.select("cluster", *_flat("mean_")), "cluster"
    )


def _flat(prefix):
    return [
        F.round(F.element_at("behavioral_signature", n), 6).alias(prefix + n) for n in SIGNATURE
    ]


def _store(spark, sf_dir):
    signatures = patterns.cluster_signatures(*_clustered(spark, sf_dir), "row_id", SIGNATURE)
    empty = spark.createDataFrame([], patterns.STORE_SCHEMA)
    seen = F.timestamp_seconds(F.lit(1_705_276_800))
    return signatures, patterns.extend_store(signatures, empty, seen)


@query("pattern_store")
def pattern_store(spark, sf_dir):
    return _store(spark, sf_dir)[1].select(
        "pattern_id", "cluster_size", "status", "source", *_flat("")
    )


@query("pattern_match")
def pattern_match(spark, sf_dir):
    signatures, store = _store(spark, sf_dir)
    return patterns.match_patterns(signatures, store).select(
        "cluster", "cluster_size", "matched_id"
    )


@query("pattern_events")
def pattern_events(spark, sf_dir):
    events = patterns.pattern_events(
        _store(spark, sf_dir)[1], F.timestamp_seconds(F.lit(1_705_276_800))
    )
    return events.select(
        "event_id", "src", "type", "severity", "pattern_id",
        F.col("evidence.observation_count").alias("observations"),
    )


