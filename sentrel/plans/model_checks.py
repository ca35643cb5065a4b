"""Models, bundles and routing on cases whose results plain SQL can state.

Classes that a forest must tell apart, isolation trees written down by hand, clusters on a small grid:
each row turns wrong if the operator is.
"""

import pandas as pd
from pyspark.sql import functions as F

from sentrel.functions.staging import scratch as _folder
from sentrel.operators import clusters, evaluation, forest, isolation, reports
from sentrel.operators import quality as q
from sentrel.plans import view_queries  # noqa: F401  (its SQL is part of the bundle's)
from sentrel.plans.adapters import EVENT_WINDOW_SECONDS, sec_events, table
from sentrel.plans.end_to_end import events_to_dashboard, write_dashboard
from sentrel.plans.registry import ORACLES, query
from sentrel.plans.sql_parts import INCIDENTS
from sentrel.sources import events as src

# Points of a grid with gaps; the same point may come several times.
POINTS = """pt AS (SELECT c_custkey AS id, floor(c_acctbal / 90)::BIGINT AS x, c_nationkey * 2 AS y FROM customer)"""
EPS, MIN_SAMPLES = 1.5, 4


@query(
    "dbscan_grid",
    f"""WITH RECURSIVE {POINTS},
nb AS (SELECT a.id, b.id AS other FROM pt a JOIN pt b
  ON a.x BETWEEN b.x - 1 AND b.x + 1 AND a.y BETWEEN b.y - 1 AND b.y + 1
    AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= {EPS * EPS}),
core AS (SELECT id FROM nb GROUP BY id HAVING count(*) >= {MIN_SAMPLES}),
link AS (SELECT nb.id, other FROM nb JOIN core ON nb.id = core.id WHERE other IN (SELECT id FROM core)),
r(id, reached) AS (SELECT id, id FROM core UNION SELECT r.id, link.other FROM r JOIN link ON r.reached = link.id),
cl AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS label
  FROM (SELECT id, min(reached) AS root FROM r GROUP BY id)),
bo AS (SELECT nb.id, min(label) AS label FROM nb JOIN cl ON nb.other = cl.id
  WHERE nb.id NOT IN (SELECT id FROM core) GROUP BY nb.id)
SELECT pt.id AS row_id, coalesce(cl.label, bo.label, -1)::BIGINT AS cluster
FROM pt LEFT JOIN cl ON pt.id = cl.id LEFT JOIN bo ON pt.id = bo.id""",
)
def dbscan_grid(spark, sf_dir):
    points = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("row_id"), F.floor(F.col("c_acctbal") / 90).alias("x"), (F.col("c_nationkey") * 2).alias("y")
    )
    return clusters.dbscan(points, "row_id", ["x", "y"], EPS, MIN_SAMPLES).withColumn("cluster", F.col("cluster").cast("bigint"))


# Two trees over 16 rows each: node, feature, threshold, left, right, rows, depth.
TREES = [
    (0, 0, 0, 20_000.0, 1, 2, 16, 0), (0, 1, -1, 0.0, -1, -1, 2, 1), (0, 2, 1, 300.0, 3, 4, 14, 1),
    (0, 3, -1, 0.0, -1, -1, 9, 2), (0, 4, -1, 0.0, -1, -1, 5, 2),
    (1, 0, 1, 900.0, 1, 2, 16, 0), (1, 1, 0, 150_000.0, 3, 4, 15, 1), (1, 2, -1, 0.0, -1, -1, 1, 1),
    (1, 3, -1, 0.0, -1, -1, 12, 2), (1, 4, -1, 0.0, -1, -1, 3, 2),
]
CUTOFF = 0.52


def _norm(n):
    """SQL: average path length among n points."""
    return f"(2.0 * (ln({n} - 1.0) + 0.5772156649015329::DOUBLE) - 2.0 * ({n} - 1.0) / {n})"


@query(
    "isolation_given_trees",
    f"""WITH p AS (SELECT o_orderkey AS row_id,
    CASE WHEN o_totalprice <= 20000 THEN 1 + 1.0 WHEN o_custkey <= 300 THEN 2 + {_norm(9)} ELSE 2 + {_norm(5)} END AS a,
    CASE WHEN o_custkey > 900 THEN 1 + 0.0 WHEN o_totalprice <= 150000 THEN 2 + {_norm(12)} ELSE 2 + {_norm(3)} END AS b
  FROM orders),
s AS (SELECT row_id, 2.0::DOUBLE ** (-(a + b) / 2 / {_norm(16)}) AS score FROM p)
SELECT row_id, round({CUTOFF} - score, 9) AS decision, CASE WHEN score > {CUTOFF} THEN -1 ELSE 1 END AS anomaly FROM s""",
)
def isolation_given_trees(spark, sf_dir):
    """A model written to a file and read back scores every row."""
    names = ["tree", "node", "feature", "threshold", "left", "right", "n", "depth"]
    features = ["o_totalprice", "o_custkey"]
    path = _folder(spark, "model")
    isolation.IsolationModel(pd.DataFrame(TREES, columns=names), features, 16, CUTOFF).save(spark, path)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), *features)
    flagged = isolation.flag_anomalies(rows, isolation.IsolationModel.load(spark, path))
    return flagged.select("row_id", F.round("decision", 9).alias("decision"), "anomaly")


# Five kinds of event are five classes whose features do not overlap.
KINDS = ["view", "click", "error", "purchase", "signup"]
RAW_CLASSES = ["BENIGN", "PortScan", "SSH-Patator", "DoS Hulk", "Bot"]
CLASSES = ["BENIGN", "PORT_SCAN", "BRUTE_FORCE", "DOS", "BOT"]
KIND_LIST, RAW_LIST, CLASS_LIST = (str(x) for x in (KINDS, RAW_CLASSES, CLASSES))
SEPARATE = f"""k AS (SELECT event_id AS row_id, 'f' || (user_id % 3) AS file,
    list_position({KIND_LIST}, event_type) AS c, (SELECT count(*) FROM events) AS n FROM events)"""
FEATURES = ["level", "square", "falling"]


def _separate(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    c = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("event_type")).cast("int")
    return e.select(
        F.col("event_id").alias("row_id"),
        F.concat(F.lit("f"), (F.col("user_id") % 3).cast("string")).alias("file"),
        c.alias("c"),
        (c * 10 + F.col("event_id") % 7).cast("double").alias("level"),
        (c * c * 100.0).alias("square"),
        (-c * 1.5).alias("falling"),
    )


@query("forest_separate_classes", f"WITH {SEPARATE} SELECT row_id, {CLASS_LIST}[c] AS prediction, 1.0::DOUBLE AS confidence FROM k")
def forest_separate_classes(spark, sf_dir):
    """Trained on half of the rows, saved, loaded, and sure of every row."""
    rows = _separate(spark, sf_dir).withColumn("Label", F.get(F.array(*[F.lit(x) for x in CLASSES]), F.col("c") - 1))
    model = forest.train_forest(rows.where(F.col("row_id") % 2 == 0), FEATURES, "Label", trees=8, depth=6)
    path = _folder(spark, "forest")
    src.save_model(model, path)
    rated = forest.classify(rows, src.load_model(path), FEATURES)
    return rated.select("row_id", "prediction", F.round("confidence", 9).alias("confidence"))


# In each file's last part every seventh row carries the next class's label.
HELD_OUT = f"""{SEPARATE},
s AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY row_id) > floor(count(*) OVER (PARTITION BY file) * 0.7::DOUBLE) AS test,
    {CLASS_LIST}[CASE WHEN row_id % 7 = 0 AND row_id >= n * 85 // 100 THEN c % 5 + 1 ELSE c END] AS actual,
    {CLASS_LIST}[c] AS predicted FROM k)"""


@query(
    "holdout_confusion",
    f"WITH {HELD_OUT} SELECT actual, predicted, count(*) AS n FROM s WHERE test GROUP BY ALL",
)
def holdout_confusion(spark, sf_dir):
    """The evaluation of a temporal hold-out, down to its confusion table."""
    rows = _separate(spark, sf_dir)
    n = table(spark, sf_dir, "events").count()
    c = F.col("c")
    c = F.when((F.col("row_id") % 7 == 0) & (F.col("row_id") >= n * 85 // 100), c % 5 + 1).otherwise(c)
    raw = rows.withColumn("Label", F.get(F.array(*[F.lit(x) for x in RAW_CLASSES]), c - 1))
    return forest.evaluate_holdout(raw, "row_id", FEATURES, trees=8, depth=6)["confusion"]


@query(
    "holdout_overall",
    f"WITH {HELD_OUT} SELECT round(count(*) FILTER (actual = predicted) / count(*)::DOUBLE, 9) AS accuracy FROM s WHERE test",
)
def holdout_overall(spark, sf_dir):
    confusion = holdout_confusion(spark, sf_dir)
    rated = confusion.select("actual", "predicted", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    return evaluation.overall(rated.drop("i")).select(F.round("accuracy", 9).alias("accuracy"))


BUNDLE = {
    "summary": "dashboard_summary",
    "threat_types": "threat_counts",
    "severity": "severity_counts",
    "timeline": "dashboard_timeline",
    "nodes": "graph_nodes",
    "edges": "graph_edges",
}
_OWN = {"incidents": "inc", "incident_events": "mem", "incident_timeline": "tl", "reports": "inc"}


def _bundle_sql():
    parts = [f"SELECT '{t}' AS name, count(*) AS n_rows FROM ({ORACLES[name]})" for t, name in BUNDLE.items()]
    parts += [f"SELECT '{t}', count(*) FROM (WITH {INCIDENTS} SELECT * FROM {rel})" for t, rel in _OWN.items()]
    return " UNION ALL ".join(parts)


@query("dashboard_bundle", _bundle_sql())
def dashboard_bundle(spark, sf_dir):
    """All dashboard tables written as JSON folders and read back."""
    folder = _folder(spark, "dashboard")
    tables = events_to_dashboard(sec_events(spark, sf_dir), EVENT_WINDOW_SECONDS)
    write_dashboard(tables, folder)
    parts = [
        spark.read.text(f"{folder}/{name}").agg(F.lit(name).alias("name"), F.count("*").alias("n_rows")) for name in tables
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


@query(
    "file_contract",
    """WITH d AS (SELECT source AS file, CASE WHEN source = 'src1' THEN NULL ELSE n_chars END AS a,
    CASE WHEN doc_id % 2 = 0 THEN NULL ELSE doc_id END AS b, CASE WHEN source IN ('src1', 'src2') THEN NULL ELSE lang END AS c
  FROM documents),
m AS (SELECT file, count(*) AS n_rows, concat_ws(',', CASE WHEN count(a) = 0 THEN 'a' END,
    CASE WHEN count(b) = 0 THEN 'b' END, CASE WHEN count(c) = 0 THEN 'c' END) AS missing FROM d GROUP BY file)
SELECT *, missing = '' AS usable FROM m""",
)
def file_contract(spark, sf_dir):
    """Files that lack a feature of the contract are named with what they lack."""
    s = F.col("source")
    rows = table(spark, sf_dir, "documents").select(
        s.alias("file"),
        F.when(F.coalesce(s != "src1", F.lit(True)), F.col("n_chars")).alias("a"),
        F.when(F.col("doc_id") % 2 != 0, F.col("doc_id")).alias("b"),
        F.when(F.coalesce(~s.isin("src1", "src2"), F.lit(True)), F.col("lang")).alias("c"),
    )
    return q.route_files(rows, ["a", "b", "c"], "file").withColumn("missing", F.array_join("missing", ","))


@query(
    "reports_other_types",
    """WITH i AS (SELECT user_id, count(*) AS n, CASE user_id % 3 WHEN 0 THEN 'DATA_LEAK' WHEN 1 THEN NULL
    ELSE 'FIRMWARE_CHANGE' END AS type FROM events GROUP BY user_id)
SELECT user_id, coalesce(type, 'UNKNOWN') AS classification,
  'Incident classified as ' || coalesce(type, 'UNKNOWN') || ' based on correlated network evidence.' AS summary,
  n || ' event(s) associated with the incident.' AS observation,
  'The observed network behavior is considered suspicious based on the detection and correlation pipeline.' AS inference,
  'Network metadata alone may not establish attacker intent.' AS limitation FROM i""",
)
def reports_other_types(spark, sf_dir):
    """Incidents of a type that has no text of its own get the general narrative."""
    user = F.col("user_id")
    found = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("timeline_length")).select(
        "user_id",
        "timeline_length",
        F.when(user % 3 == 0, "DATA_LEAK").when(user % 3 == 2, "FIRMWARE_CHANGE").alias("type"),
        F.concat(F.lit("10.0.0."), user.cast("string")).alias("source"),
        *[F.lit(None).cast("bigint").alias(c) for c in ("event_count", "unique_ports", "unique_destinations", "observations")],
        *[F.lit(None).cast("string").alias(c) for c in ("pattern_id", "status")],
        F.lit(None).cast("array<string>").alias("behaviors"),
    )
    told = reports.narratives(found)
    return told.select(
        "user_id", "classification", "summary", F.get("observation_texts", F.lit(0)).alias("observation"), "inference", "limitation"
    )


@query(
    "benign_sample_limited",
    """SELECT least(count(*) FILTER (doc_id % 3 <> 0), 25) AS n_rows, least(count(*) FILTER (doc_id % 3 <> 0), 25) AS n_benign,
  least(count(*) FILTER (doc_id % 3 <> 0), 25) AS n_ids FROM documents""",
)
def benign_sample_limited(spark, sf_dir):
    """A sample that its limit cuts: as many rows as allowed, each benign and once, the same twice."""
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"), F.when(F.col("doc_id") % 3 != 0, "BENIGN").otherwise("DOS").alias("Label")
    )
    first, again = q.benign_sample(rows, "row_id", 25), q.benign_sample(rows.repartition(5), "row_id", 25)
    same = again.select(F.col("row_id").alias("other"))
    return first.join(same, F.col("row_id") == F.col("other")).agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("Label") == "BENIGN").alias("n_benign"), F.count_distinct("row_id").alias("n_ids")
    )


@query(
    "alert_rates",
    f"""WITH k AS (SELECT {CLASS_LIST}[list_position({KIND_LIST}, event_type)] AS actual,
    {CLASS_LIST}[CASE WHEN event_id % 9 = 0 THEN 1 + event_id % 5 ELSE list_position({KIND_LIST}, event_type) END] AS predicted,
    user_id % 12 AS device, epoch_us(ts) // 3600000000 AS hour FROM events),
h AS (SELECT count(*) AS n FROM (SELECT DISTINCT device, hour FROM k)),
c AS (SELECT unnest({CLASS_LIST}[2:]) AS class)
SELECT class, count(*) FILTER (predicted = class) AS n_alerts,
  count(*) FILTER (predicted = class AND actual <> class) AS n_false,
  count(*) FILTER (actual = class AND predicted <> class) AS n_missed, any_value(h.n) AS device_hours,
  round(count(*) FILTER (predicted = class AND actual <> class) / any_value(h.n)::DOUBLE, 9) AS false_per_device_hour
FROM c, k, h GROUP BY class""",
)
def alert_rates(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    names = F.array(*[F.lit(x) for x in CLASSES])
    c = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("event_type"))
    guess = F.when(F.col("event_id") % 9 == 0, 1 + F.col("event_id") % 5).otherwise(c)
    rated = e.select(
        F.get(names, (c - 1).cast("int")).alias("actual"),
        F.get(names, (guess - 1).cast("int")).alias("predicted"),
        (F.col("user_id") % 12).alias("device"),
        F.unix_micros("ts").alias("ts_us"),
    )
    rates = evaluation.alert_rates(rated, "device", "ts_us")
    return rates.withColumn("false_per_device_hour", F.round("false_per_device_hour", 9))
