"""Unknown behaviour after the models: scores and clusters come from arithmetic on ``embeddings``,
so that plain SQL can repeat what the operators make of them."""

from pyspark.sql import functions as F

from sentrel.operators import evaluation, forest, isolation, patterns
from sentrel.plans.adapters import features, table
from sentrel.plans.model_queries import _forest, _isolation
from sentrel.plans.registry import query

SIGNATURE = {"first": "a", "second": "b", "last": "c"}

SCORED = """s AS (SELECT vec_id AS row_id,
    CASE vec_id % 4 WHEN 0 THEN 'BENIGN' WHEN 1 THEN 'DOS' WHEN 2 THEN 'BOT' END AS prediction,
    (vec_id * 37 % 100) / 100.0::DOUBLE AS confidence,
    CASE WHEN vec_id % 5 = 0 THEN 1 ELSE -1 END AS anomaly,
    CASE WHEN label IS NULL THEN NULL ELSE 'L' || label END AS label,
    CASE WHEN vec_id % 6 = 0 THEN -1 WHEN vec_id < 9 THEN 4 ELSE (vec_id * vec_id) % 11 % 4 END AS cluster,
    CAST(CAST(floor(embedding[1] * 1000) AS BIGINT) AS DOUBLE) AS a,
    CAST(CAST(floor(embedding[2] * 1000) AS BIGINT) AS DOUBLE) AS b,
    CAST(CAST(floor(embedding[64] * 1000) AS BIGINT) AS DOUBLE) AS c
  FROM embeddings)"""
CANDIDATES = """c AS (SELECT * FROM s WHERE anomaly = -1
    AND NOT coalesce(prediction <> 'BENIGN' AND confidence >= 0.7, confidence >= 0.7 AND NULL))"""
FOUND = """g AS (SELECT cluster, count(*) AS cluster_size, arg_min(a, row_id) AS a, arg_min(b, row_id) AS b,
    arg_min(c, row_id) AS c, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc FROM s
    WHERE cluster <> -1 GROUP BY cluster HAVING count(*) >= 3)"""
STORE = """old AS (SELECT 'P-OLD' AS pattern_id, max(cluster_size) AS cluster_size, 'KNOWN' AS status, 7 AS observations,
    0 AS store_order, 1.0::DOUBLE AS a, 2.0::DOUBLE AS b, 3.0::DOUBLE AS c FROM g UNION ALL
  SELECT 'P-SEEN', count(*) + 1000, 'NEW', 99, 1, 4.0, 5.0, 6.0 FROM s)"""
GROWN = """fresh AS (SELECT cluster_size, min(cluster) AS cluster FROM g
    WHERE cluster_size NOT IN (SELECT cluster_size FROM old) GROUP BY 1),
  grown AS (SELECT pattern_id, cluster_size, status, observations, store_order, a, b, c FROM old UNION ALL
    SELECT 'P-' || upper(left(sha256(cluster_size || '|{"first":' || a || ',"last":' || c || ',"second":' || b || '}'), 16)),
      cluster_size, 'NEW', NULL, 2 + cluster, a, b, c FROM fresh JOIN g USING (cluster_size, cluster))"""


def _scored(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    i = F.col("vec_id")
    part = lambda n: F.floor(F.col("embedding")[n] * 1000).cast("bigint").cast("double")
    return e.select(
        i.alias("row_id"),
        F.when(i % 4 == 0, "BENIGN").when(i % 4 == 1, "DOS").when(i % 4 == 2, "BOT").alias("prediction"),
        ((i * 37 % 100) / 100.0).alias("confidence"),
        F.when(i % 5 == 0, 1).otherwise(-1).alias("anomaly"),
        F.concat(F.lit("L"), F.col("label").cast("string")).alias("label"),
        F.when(i % 6 == 0, -1).when(i < 9, 4).otherwise(i * i % 11 % 4).cast("int").alias("cluster"),
        part(0).alias("a"), part(1).alias("b"), part(63).alias("c"),
    )


def _signatures(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    labels, points = rows.select("row_id", "cluster"), rows.drop("cluster")
    return (
        patterns.cluster_signatures(points, labels, "row_id", SIGNATURE),
        patterns.cluster_means(points, labels, "row_id", SIGNATURE),
    )


def _store(spark, sf_dir):
    """A stored table with one pattern as large as the largest cluster, and one of its own size."""
    found, _ = _signatures(spark, sf_dir)
    when = F.timestamp_seconds(F.lit(1_705_276_800))

    def stored(size, name, status, seen, order, values):
        signature = F.create_map(*[F.lit(x) for pair in zip(SIGNATURE, values, strict=True) for x in pair])
        return size.select(
            F.lit(name).alias("pattern_id"), F.col("n").alias("cluster_size"), F.lit(status).alias("status"),
            when.alias("first_detected"), F.lit("stored").alias("source"), signature.alias("behavioral_signature"),
            F.lit(order).cast("bigint").alias("store_order"), F.lit(seen).cast("bigint").alias("observations"),
        )

    largest = found.agg(F.max("cluster_size").alias("n"))
    other = _scored(spark, sf_dir).agg((F.count("*") + 1000).alias("n"))
    old = stored(largest, "P-OLD", "KNOWN", 7, 0, [1.0, 2.0, 3.0]).union(
        stored(other, "P-SEEN", "NEW", 99, 1, [4.0, 5.0, 6.0])
    )
    return found, old, patterns.extend_store(found, old, when)


def _flat(prefix=""):
    return [F.element_at("behavioral_signature", n).alias(prefix + n) for n in SIGNATURE]


@query("candidates_by_scores", f"WITH {SCORED}, {CANDIDATES} SELECT row_id, prediction, confidence FROM c")
def candidates_by_scores(spark, sf_dir):
    return patterns.unknown_candidates(_scored(spark, sf_dir)).select("row_id", "prediction", "confidence")


@query(
    "anomaly_rates_by_scores",
    f"""WITH {SCORED} SELECT label, count(*) FILTER (anomaly = -1) AS flagged, count(*) AS n,
    count(*) FILTER (anomaly = -1) * 100.0::DOUBLE / count(*) AS percent FROM s GROUP BY label""",
)
def anomaly_rates_by_scores(spark, sf_dir):
    return evaluation.anomaly_rates(_scored(spark, sf_dir))


@query(
    "signatures_by_clusters",
    f"""WITH {SCORED}, {FOUND} SELECT cluster, cluster_size, a AS first, b AS second, c AS last,
    round(ma, 6) AS mean_first, round(mb, 6) AS mean_second, round(mc, 6) AS mean_last FROM g""",
)
def signatures_by_clusters(spark, sf_dir):
    heads, means = _signatures(spark, sf_dir)
    rounded = [F.round(c, 6).alias(f"mean_{n}") for n, c in zip(SIGNATURE, _flat(), strict=True)]
    return heads.select("cluster", "cluster_size", *_flat()).join(means.select("cluster", *rounded), "cluster")


@query(
    "patterns_matched",
    f"""WITH {SCORED}, {FOUND}, {STORE} SELECT cluster, g.cluster_size, pattern_id AS matched_id
    FROM g LEFT JOIN old USING (cluster_size)""",
)
def patterns_matched(spark, sf_dir):
    found, old, _ = _store(spark, sf_dir)
    return patterns.match_patterns(found, old).select("cluster", "cluster_size", "matched_id")


@query(
    "patterns_stored",
    f"""WITH {SCORED}, {FOUND}, {STORE}, {GROWN} SELECT pattern_id, cluster_size, status, observations, store_order,
    a AS first, b AS second, c AS last FROM grown""",
)
def patterns_stored(spark, sf_dir):
    return _store(spark, sf_dir)[2].select(
        "pattern_id", "cluster_size", "status", "observations", "store_order", *_flat()
    )


@query(
    "patterns_reported",
    f"""WITH {SCORED}, {FOUND}, {STORE}, {GROWN}
    SELECT 'EVT-UNKNOWN-' || replace(pattern_id, 'P-', '') AS event_id, 'UNKNOWN' AS src, 'UNKNOWN_BEHAVIOR' AS type,
    'MEDIUM' AS severity, pattern_id, coalesce(observations, cluster_size) AS observations, status, a AS first
    FROM grown WHERE status = 'NEW'""",
)
def patterns_reported(spark, sf_dir):
    at = F.timestamp_seconds(F.lit(1_705_276_800))
    return patterns.pattern_events(_store(spark, sf_dir)[2], at).select(
        "event_id", "src", "type", "severity", "pattern_id",
        F.col("evidence.observation_count").alias("observations"),
        F.col("evidence.pattern_status").alias("status"),
        F.element_at("evidence.behavioral_signature", "first").alias("first"),
    )


@query(
    "forest_rows",
    """SELECT vec_id AS row_id, true AS known_class, true AS confident FROM embeddings""",
)
def forest_rows(spark, sf_dir):
    """Every row is classified once, as a class that training knew, with a probability."""
    rows, names = features(spark, sf_dir)
    rated = forest.classify(rows, _forest(spark, sf_dir), names)
    classes = ["BENIGN", "DOS", "DDOS", "PORT_SCAN", "BRUTE_FORCE", "BOT"]
    return rated.select(
        "row_id",
        F.col("prediction").isin(classes).alias("known_class"),
        ((F.col("confidence") >= 1 / len(classes)) & (F.col("confidence") <= 1)).alias("confident"),
    )


@query("isolation_rows", "SELECT vec_id AS row_id, true AS consistent FROM embeddings")
def isolation_rows(spark, sf_dir):
    """Every row is scored once, and flagged exactly if its decision is negative."""
    rows, _ = features(spark, sf_dir)
    flagged = isolation.flag_anomalies(rows, _isolation(spark, sf_dir))
    return flagged.select("row_id", ((F.col("decision") < 0) == (F.col("anomaly") == -1)).alias("consistent"))
