"""Null keys are keys like any other, and no message without a body disappears."""

from pyspark.sql import functions as F

from sentrel.functions import fixed
from sentrel.operators import clusters, quality, telemetry
from sentrel.operators.windows import prefix_max


def rows(spark):
    return spark.range(20).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 2 == 0, "A").alias("Label"),
        F.when(F.col("id") % 2 == 1, "f").alias("file"),
        F.col("id").cast("double").alias("x"),
    )


def test_splits_keep_rows_without_class_or_file(spark):
    df = rows(spark)
    split = quality.stratified_split(df, "row_id", test=0.3)
    assert split.groupBy("Label", "part").count().count() == 4 and split.count() == 20
    split = quality.temporal_split(df, "row_id", train=0.5)
    assert {(r["file"], r["part"], r["count"]) for r in split.groupBy("file", "part").count().collect()} == {
        (None, "train", 5), (None, "test", 5), ("f", "train", 5), ("f", "test", 5)
    }


def test_quartiles_of_the_missing_label(spark):
    got = {r["label"]: (r["q25"], r["q50"], r["q75"]) for r in quality.describe_by_label(rows(spark), ["x"], "Label").collect()}
    assert got == {"A": (4.5, 9.0, 13.5), None: (5.5, 10.0, 14.5)}


def test_prefix_max_of_a_missing_key(spark):
    df = rows(spark).withColumn("us", F.col("row_id") * 1_000_000)
    got = {r["row_id"]: r["m"] for r in prefix_max(df, ["Label"], "us", ["us"], "x", "m", 4_000_000).collect()}
    assert got == {i: (None if i < 2 else float(i - 2)) for i in range(20)}


def test_message_without_body_is_decided(spark):
    messages = spark.sql("SELECT 1L AS message_id, timestamp'2024-01-01' AS received_at, CAST(NULL AS BINARY) AS raw, CAST(NULL AS STRING) AS signature")
    devices = spark.createDataFrame([("d",)], "device_id string")
    checked = telemetry.check_messages(messages, devices, b"k").collect()
    assert len(checked) == 1 and checked[0]["reason"] is not None
    assert telemetry.oversized(messages).count() == 0


def test_long_chain_settles(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = clusters.components(edges).collect()
    assert len(got) == 300 and {r["root"] for r in got} == {0}


def test_limits_are_asked_for(spark):
    assert quality.head_rows(rows(spark), "row_id", 3).count() == 3
    assert fixed.HEAD_ROWS == 100
