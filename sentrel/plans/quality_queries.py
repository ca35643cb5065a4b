"""Dataset cleaning, profiling, splitting and evaluation queries."""

from pyspark.sql import functions as F

from sentrel.functions import fixed
from sentrel.operators import evaluation as ev
from sentrel.operators import quality as q
from sentrel.plans.adapters import labelled_pairs, table
from sentrel.plans.registry import query

RAW_LABELS = [
    "BENIGN", "DoS Hulk", "DoS GoldenEye", "DoS slowloris", "DoS Slowhttptest", "DDoS",
    "PortScan", "FTP-Patator", "SSH-Patator", "Bot", "Heartbleed", "Infiltration",
]
LABEL_LIST = "[" + ", ".join(f"'{x}'" for x in RAW_LABELS) + "]"
FEATURES = ["f0", "f1", "f2"]

# Documents stand in for labelled flow rows: the source is the file, three numeric texts are
# the features, every row also comes a second time when its id divides by five.
RAW = f"""doc AS (SELECT doc_id, source, n_chars, lang FROM documents),
two AS (SELECT *, 0 AS copy FROM doc UNION ALL SELECT *, 1 FROM doc WHERE doc_id % 5 = 0),
raw AS (SELECT source AS file, doc_id AS row_id,
    CASE WHEN doc_id % 19 = 0 THEN 'n/a' ELSE CAST(n_chars AS VARCHAR) END AS f0,
    CASE WHEN doc_id % 23 = 0 THEN 'Infinity' ELSE CAST(doc_id % 97 AS VARCHAR) END AS f1,
    CASE WHEN source = 'src3' THEN NULL ELSE ' ' || CAST(n_chars % 13 AS VARCHAR) END AS f2,
    CASE WHEN doc_id % 29 = 0 THEN NULL
      ELSE ' ' || ({LABEL_LIST})[CAST(doc_id % 12 AS BIGINT) + 1] || ' ' END AS "Label" FROM two),
cl AS (SELECT file, row_id, CAST(f0 AS DOUBLE) AS f0, CAST(f1 AS DOUBLE) AS f1,
    CAST(f2 AS DOUBLE) AS f2, coalesce(trim("Label"), 'nan') AS "Label"
  FROM (SELECT DISTINCT * FROM raw) WHERE file <> 'src3' AND f0 <> 'n/a' AND f1 <> 'Infinity')"""


def _raw(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    copies = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0))
    )
    i = F.col("doc_id")
    label = F.element_at(F.array(*[F.lit(x) for x in RAW_LABELS]), (i % 12 + 1).cast("int"))
    return d.select("*", F.explode(copies)).select(
        F.col("source").alias("file"),
        i.alias("row_id"),
        F.when(i % 19 == 0, "n/a").otherwise(F.col("n_chars").cast("string")).alias("f0"),
        F.when(i % 23 == 0, "Infinity").otherwise((i % 97).cast("string")).alias("f1"),
        F.when(
            F.col("source") != "src3",
            F.concat(F.lit(" "), (F.col("n_chars") % 13).cast("string")),
        ).alias("f2"),
        F.when(i % 29 != 0, F.concat(F.lit(" "), label, F.lit(" "))).alias("Label"),
    )


def _clean(spark, sf_dir):
    return q.clean(_raw(spark, sf_dir), FEATURES, keep=["row_id"])


@query("clean_flows", f"WITH {RAW} SELECT * FROM cl")
def clean_flows(spark, sf_dir):
    return _clean(spark, sf_dir)


@query(
    "model_input",
    f"""WITH {RAW} SELECT DISTINCT row_id, coalesce(TRY_CAST(f0 AS DOUBLE), 0) AS f0,
      CASE WHEN f1 = 'Infinity' THEN 0 ELSE CAST(f1 AS DOUBLE) END AS f1,
      coalesce(CAST(f2 AS DOUBLE), 0) AS f2 FROM raw""",
)
def model_input(spark, sf_dir):
    rows = q.model_input(_raw(spark, sf_dir), FEATURES)
    return rows.select("row_id", *FEATURES).distinct()


def _case(mapping):
    parts = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"""CASE trim("Label") {parts} ELSE 'OTHER' END"""


@query(
    "label_normalize",
    f"""WITH {RAW} SELECT row_id, {_case(fixed.LABEL_CLASSES)} AS train_class,
      {_case(fixed.EVALUATION_LABEL_CLASSES)} AS eval_class FROM raw""",
)
def label_normalize(spark, sf_dir):
    rows = q.normalise_labels(_raw(spark, sf_dir), out="train_class")
    rows = q.normalise_labels(rows, evaluation=True, out="eval_class")
    return rows.select("row_id", "train_class", "eval_class")


@query(
    "known_classes",
    f"""WITH {RAW} SELECT c AS label, count(*) AS n
    FROM (SELECT {_case(fixed.LABEL_CLASSES)} AS c FROM cl) WHERE c <> 'OTHER' GROUP BY ALL""",
)
def known_classes(spark, sf_dir):
    return q.label_counts(q.drop_other(q.normalise_labels(_clean(spark, sf_dir))))


@query("label_counts", f"""WITH {RAW} SELECT "Label" AS label, count(*) AS n FROM raw GROUP BY 1""")
def label_counts(spark, sf_dir):
    return q.label_counts(_raw(spark, sf_dir))


@query(
    "null_profile",
    f"""WITH {RAW}, c AS (SELECT count(*) FILTER (f2 IS NULL) AS a,
      count(*) FILTER ("Label" IS NULL) AS b FROM raw)
    SELECT CAST(a > 0 AS BIGINT) + CAST(b > 0 AS BIGINT) AS columns_with_nulls,
      a + b AS total_nulls FROM c""",
)
def null_profile(spark, sf_dir):
    return q.null_profile(_raw(spark, sf_dir))


@query(
    "duplicate_count",
    f"""WITH {RAW} SELECT (SELECT count(*) FROM raw)
      - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw)) AS duplicates""",
)
def duplicate_count(spark, sf_dir):
    return q.duplicate_count(_raw(spark, sf_dir))


@query(
    "table_shape",
    f"WITH {RAW} SELECT count(*) AS n_rows, 6 AS n_columns, 5 AS n_features FROM raw",
)
def table_shape(spark, sf_dir):
    return q.table_shape(_raw(spark, sf_dir))


@query(
    "describe_by_label",
    f"""WITH {RAW}, lg AS (SELECT "Label" AS label, unnest(['f0', 'f1', 'f2']) AS feature,
      unnest([f0, f1, f2]) AS v FROM cl)
    SELECT label, feature, count(v) AS count, round(avg(v), 6) AS mean,
      round(stddev_samp(v), 6) AS std, min(v) AS min, max(v) AS max,
      round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50,
      round(quantile_cont(v, 0.75), 6) AS q75
    FROM lg GROUP BY ALL""",
)
def describe_by_label(spark, sf_dir):
    stats = q.describe_by_label(_clean(spark, sf_dir), FEATURES, "Label")
    return stats.withColumns({c: F.round(c, 6) for c in ("mean", "std", "q25", "q50", "q75")})


@query("head_rows", f"WITH {RAW} SELECT * FROM cl ORDER BY row_id LIMIT 100")
def head_rows(spark, sf_dir):
    return q.head_rows(_clean(spark, sf_dir), "row_id", fixed.HEAD_ROWS)


# The sample takes every benign row while there are no more than 1948 of them.
@query("benign_sample", f"""WITH {RAW} SELECT * FROM cl WHERE "Label" = 'BENIGN'""")
def benign_sample(spark, sf_dir):
    return q.benign_sample(_clean(spark, sf_dir), "row_id", n=1948)


SPLIT = f"""{RAW}, sp AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY file ORDER BY row_id)
    <= floor(count(*) OVER (PARTITION BY file) * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS part
  FROM cl)"""


@query("temporal_split", f"WITH {SPLIT} SELECT file, row_id, part FROM sp")
def temporal_split(spark, sf_dir):
    return q.temporal_split(_clean(spark, sf_dir), "row_id", chunk=100).select(
        "file", "row_id", "part"
    )


@query(
    "unseen_classes",
    f"""WITH {SPLIT}, h AS (SELECT *, "Label" || '-' || (row_id // 250) AS c FROM sp)
    SELECT DISTINCT c FROM h WHERE part = 'test'
      AND c NOT IN (SELECT c FROM h WHERE part = 'train')""",
)
def unseen_classes(spark, sf_dir):
    """Labels are told apart by row range, so that some are missing from training."""
    rows = q.temporal_split(_clean(spark, sf_dir), "row_id")
    tag = F.concat("Label", F.lit("-"), F.expr("row_id div 250").cast("string"))
    rows = rows.withColumn("c", tag)
    return q.unseen_classes(rows.where("part = 'train'"), rows.where("part = 'test'"), "c")


@query(
    "stratified_split",
    """WITH p AS (SELECT CASE WHEN quality = 1 THEN 'BENIGN' ELSE 'DOS' END AS actual FROM labels)
    SELECT actual, CAST(round(count(*) * 0.2::DOUBLE) AS BIGINT) AS test_rows,
      count(*) - CAST(round(count(*) * 0.2::DOUBLE) AS BIGINT) AS train_rows
    FROM p GROUP BY actual""",
)
def stratified_split(spark, sf_dir):
    parts = q.stratified_split(labelled_pairs(spark, sf_dir), "row_id", "actual")
    return parts.groupBy("actual").agg(
        F.count_if(F.col("part") == "test").alias("test_rows"),
        F.count_if(F.col("part") == "train").alias("train_rows"),
    )


PAIRS = """p AS (SELECT doc_id AS row_id,
    CASE WHEN quality = 1 THEN 'BENIGN' ELSE 'DOS' END AS actual,
    CASE WHEN toxic = 0 THEN 'BENIGN' ELSE 'DOS' END AS predicted FROM labels)"""
PER_CLASS = f"""{PAIRS}, l AS (SELECT actual AS label FROM p UNION SELECT predicted FROM p),
s AS (SELECT label, (SELECT count(*) FROM p WHERE actual = label) AS support,
    (SELECT count(*) FROM p WHERE predicted = label) AS found,
    (SELECT count(*) FROM p WHERE actual = label AND predicted = label) AS hits FROM l),
c AS (SELECT *, coalesce(hits / nullif(found, 0), 0) AS precision,
    coalesce(hits / nullif(support, 0), 0) AS recall FROM s),
e AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM c)"""


@query(
    "class_weights",
    f"""WITH {PAIRS} SELECT actual AS label, count(*) AS n,
      round((SELECT count(*) FROM p) / ((SELECT count(DISTINCT actual) FROM p) * count(*)), 9)
      AS weight FROM p GROUP BY actual""",
)
def class_weights(spark, sf_dir):
    weights = q.class_weights(labelled_pairs(spark, sf_dir), "actual")
    return weights.withColumn("weight", F.round("weight", 9))


def _rounded(df):
    return df.withColumns({m: F.round(m, 9) for m in ev.METRICS})


@query(
    "eval_overall",
    f"""WITH {PER_CLASS} SELECT round(sum(hits) / sum(support), 9) AS accuracy,
      round(sum(precision * support) / sum(support), 9) AS precision,
      round(sum(recall * support) / sum(support), 9) AS recall,
      round(sum(f1 * support) / sum(support), 9) AS f1 FROM e""",
)
def eval_overall(spark, sf_dir):
    found = _rounded(ev.overall(labelled_pairs(spark, sf_dir)))
    return found.withColumn("accuracy", F.round("accuracy", 9))


@query(
    "eval_per_class",
    f"""WITH {PER_CLASS}
    SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall,
      round(f1, 9) AS f1, support FROM e
    UNION ALL SELECT 'macro avg', round(avg(precision), 9), round(avg(recall), 9),
      round(avg(f1), 9), CAST(sum(support) AS BIGINT) FROM e
    UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 9),
      round(sum(recall * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9),
      CAST(sum(support) AS BIGINT) FROM e""",
)
def eval_per_class(spark, sf_dir):
    return _rounded(ev.class_report(labelled_pairs(spark, sf_dir)))


@query(
    "confusion_matrix",
    f"""WITH {PAIRS} SELECT actual, count(*) FILTER (predicted = 'BENIGN') AS "BENIGN",
      count(*) FILTER (predicted = 'DOS') AS "DOS", count(*) FILTER (predicted = 'BOT') AS "BOT"
    FROM p GROUP BY actual""",
)
def confusion_matrix(spark, sf_dir):
    return ev.confusion_matrix(labelled_pairs(spark, sf_dir), ["BENIGN", "DOS", "BOT"])


@query(
    "unseen_predictions",
    f"""WITH {PAIRS}, n AS (SELECT actual, predicted, count(*) AS n FROM p
      WHERE actual <> 'BENIGN' GROUP BY ALL)
    SELECT *, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY actual), 6) AS percent
    FROM n""",
)
def unseen_predictions(spark, sf_dir):
    pairs = labelled_pairs(spark, sf_dir)
    known = pairs.where(F.col("actual") == "BENIGN")
    return ev.unseen_predictions(pairs, known).withColumn("percent", F.round("percent", 6))
