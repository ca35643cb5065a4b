"""Versioned incidents and correlated findings on streams.

A micro-batch's evidence, its late rows and the versions it makes are each written to the batch's own
folder. A batch that is run again after a failure replaces its folders with the same rows, so every
event is counted exactly once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from sentrel.functions.scalars import bucket_of
from sentrel.operators.lateness import nearby_findings, partial_evidence, version_status

_TABLES = ("evidence", "late", "versions", "progress")


def _read(spark: SparkSession, folder: str, name: str, before: int, schema: T.StructType) -> DataFrame:
    """Rows that batches before this one wrote; a batch that failed half-way left rows of its own number."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/{name}").where(F.col("batch_id") < before)


def _write(rows: DataFrame, folder: str, name: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch_id={batch}")


def version_incidents(
    events: DataFrame,
    folder: str,
    keys: Sequence[str],
    ts_us: str,
    window_us: int,
    lateness_us: int,
    least: int,
) -> DataStreamWriter:
    """A stream's incidents in versions, as ``operators.lateness.incident_versions`` defines them.

    Start the writer that is returned (with a checkpoint of its own). ``folder`` gets the tables
    ``versions``, ``late`` (all late events, whole), ``evidence`` (sums by key, window and batch) and
    ``progress`` (latest instant and counts of each batch), each partitioned by ``batch_id``. The batch
    form makes the same versions from the same micro-batches.
    """
    keys = list(keys)
    fields = [events.schema[k] for k in keys]
    long = lambda name: T.StructField(name, T.LongType())
    evidence_schema = T.StructType(
        [*fields, *map(long, ("window_us", "n", "first_us", "last_us")), T.StructField("late", T.BooleanType()), long("batch_id")]
    )
    version_schema = T.StructType([*fields, long("window_us"), T.StructField("version", T.IntegerType()), long("batch_id")])
    progress_schema = T.StructType([*map(long, ("latest_us", "n_events", "n_late", "n_undated", "batch_id"))])

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = _read(spark, folder, "progress", number, progress_schema).agg(F.max("latest_us")).first()[0]
        t = F.col(ts_us).cast("bigint")
        end = bucket_of(t, window_us) * window_us + window_us
        is_late = F.lit(False) if known is None else F.coalesce(end <= known - lateness_us, F.lit(False))
        batch = batch.withColumn("__late", is_late).persist()
        seen = batch.agg(
            F.max(t), F.count("*"), F.count_if("__late"), F.count_if(t.isNull())
        ).first()
        latest = max((x for x in (known, seen[0]) if x is not None), default=None)
        _write(batch.where("__late").drop("__late"), folder, "late", number)
        added = partial_evidence(batch, [*keys, "__late"], ts_us, window_us).withColumnRenamed("__late", "late")
        _write(added, folder, "evidence", number)
        batch.unpersist()
        if latest is not None:
            _versions(spark, known, latest, number)
        counts = [(latest, seen[1], seen[2], seen[3])]
        _write(spark.createDataFrame(counts, T.StructType(progress_schema.fields[:-1])), folder, "progress", number)

    def _versions(spark: SparkSession, known: int | None, latest: int, number: int) -> None:
        evidence = _read(spark, folder, "evidence", number + 1, evidence_schema)
        end = F.col("window_us") + window_us
        # Windows that this batch closes, and closed ones that it brings late evidence for.
        closing = end <= latest - lateness_us
        if known is not None:
            closing &= end > known - lateness_us
        own = F.col("batch_id") == number
        part = Window.partitionBy(*keys, "window_us")
        touched = F.max(closing | (own & F.col("late"))).over(part)
        sums = (
            evidence.withColumn("touched", touched)
            .where("touched")
            .withColumn("closing", closing)
            .groupBy(*keys, "window_us")
            .agg(
                F.sum("n").alias("n_events"),
                F.sum(F.when(F.col("late"), F.col("n")).otherwise(0)).alias("n_late"),
                F.sum(F.when(F.col("closing") | own, F.col("n")).otherwise(0)).alias("n_added"),
                F.min("first_us").alias("first_us"),
                F.max("last_us").alias("last_us"),
            )
            .where(F.col("n_events") >= least)
        )
        earlier = _read(spark, folder, "versions", number, version_schema).groupBy(
            *[F.col(k).alias(f"__{k}") for k in keys], F.col("window_us").alias("__w")
        ).agg(F.max("version").alias("last"))
        same = F.col("window_us") == F.col("__w")
        for k in keys:
            same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
        version = (F.coalesce("last", F.lit(0)) + 1).cast("int")
        made = sums.join(earlier, same, "left").select(
            *keys,
            "window_us",
            version.alias("version"),
            version_status(version, F.col("n_late")).alias("status"),
            "n_events",
            "n_late",
            "n_added",
            "first_us",
            "last_us",
        )
        _write(made, folder, "versions", number)

    return events.writeStream.foreachBatch(handle)


def stream_correlation(
    sensor: DataFrame, network: DataFrame, key: str, within_seconds: int, lateness: str = "10 minutes"
) -> DataFrame:
    """``nearby_findings`` of two streams; rows are kept in state as long as the watermarks require."""
    return nearby_findings(
        sensor.withWatermark("ts", lateness), network.withWatermark("ts", lateness), key, within_seconds
    )
