"""Classifier metrics from a confusion table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame) -> DataFrame:
    """Rows per (actual, predicted); everything below works on this small table."""
    return df.groupBy("actual", "predicted").agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One row per actual class, one column per predicted class in label order."""
    wide = confusion(df).groupBy("actual").pivot("predicted", list(labels)).agg(F.sum("n"))
    return wide.na.fill(0, list(labels))


def _ratio(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def per_class(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every class; 0 where undefined."""
    sides = F.array(
        F.struct(
            F.col("actual").alias("label"),
            F.col("n").alias("support"),
            F.lit(0).cast("bigint").alias("found"),
            F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hits"),
        ),
        F.struct(
            F.col("predicted").alias("label"),
            F.lit(0).cast("bigint").alias("support"),
            F.col("n").alias("found"),
            F.lit(0).cast("bigint").alias("hits"),
        ),
    )
    sums = (
        confusion(df)
        .select(F.explode(sides).alias("s"))
        .groupBy("s.label")
        .agg(*[F.sum(f"s.{c}").alias(c) for c in ("support", "found", "hits")])
    )
    rated = sums.select(
        "label",
        _ratio(F.col("hits"), F.col("found")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
        "support",
        "hits",
    )
    both = F.col("precision") + F.col("recall")
    return rated.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), both))


METRICS = ["precision", "recall", "f1"]


def overall(df: DataFrame) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1."""
    rows = F.sum("support")
    return per_class(df).agg(
        _ratio(F.sum("hits"), rows).alias("accuracy"),
        *[_ratio(F.sum(F.col(m) * F.col("support")), rows).alias(m) for m in METRICS],
    )


def class_report(df: DataFrame) -> DataFrame:
    """Per-class rows, then the macro and the weighted average."""
    rows = per_class(df)
    cols = ["label", *METRICS, "support"]
    macro = rows.agg(
        F.lit("macro avg").alias("label"),
        *[F.avg(m).alias(m) for m in METRICS],
        F.sum("support").alias("support"),
    )
    weighted = rows.agg(
        F.lit("weighted avg").alias("label"),
        *[_ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m) for m in METRICS],
        F.sum("support").alias("support"),
    )
    return rows.select(*cols).union(macro.select(*cols)).union(weighted.select(*cols))


def unseen_predictions(df: DataFrame, known: DataFrame) -> DataFrame:
    """What classes absent from training (``known``: ``actual``) are taken for, in percent."""
    counts = confusion(df).join(known.select("actual").distinct(), "actual", "left_anti")
    share = F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("actual"))
    return counts.withColumn("percent", share)


def anomaly_rates(df: DataFrame, label: str = "label") -> DataFrame:
    """Share of rows flagged -1 per class."""
    flagged = F.count_if(F.col("anomaly") == -1)
    return df.groupBy(F.col(label).alias("label")).agg(
        flagged.alias("flagged"),
        F.count("*").alias("n"),
        (flagged * 100.0 / F.count("*")).alias("percent"),
    )


def alert_rates(rated: DataFrame, device: str, ts_us: str, benign: str = "BENIGN") -> DataFrame:
    """False alerts per device-hour of every class that was predicted or occurred.

    ``rated`` has ``actual``, ``predicted``, a device and an instant. ``class, n_alerts, n_false,
    n_missed, device_hours, false_per_device_hour``; device-hours are the distinct pairs of device and
    hour with any row, alerts are predictions other than ``benign``. Rows without a device or an
    instant count as alerts but make no device-hour. All but the distinct pairs is summed on the map
    side.
    """
    hours = (
        rated.where(F.col(device).isNotNull() & F.col(ts_us).isNotNull())
        .select(device, F.floor(F.col(ts_us) / 3_600_000_000).alias("hour"))
        .distinct()
        .agg(F.count("*"))
        .scalar()
    )
    sides = F.array(
        F.struct(F.col("predicted").alias("class"), F.lit(True).alias("alert")),
        F.struct(F.col("actual").alias("class"), F.lit(False).alias("alert")),
    )
    wrong = ~F.col("actual").eqNullSafe(F.col("predicted"))
    counted = (
        rated.select("actual", "predicted", F.inline(sides))
        .where(F.col("class") != benign)
        .groupBy("class")
        .agg(
            F.count_if("alert").alias("n_alerts"),
            F.count_if(F.col("alert") & wrong).alias("n_false"),
            F.count_if(~F.col("alert") & wrong).alias("n_missed"),
        )
    )
    return counted.withColumn("device_hours", hours).withColumn(
        "false_per_device_hour", F.try_divide(F.col("n_false").cast("double"), F.col("device_hours"))
    )
