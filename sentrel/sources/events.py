"""Security events, JSON documents and labelled CSV files; sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrel.functions.scalars import evaluated_once, parse_instant
from sentrel.functions.staging import materialise
from sentrel.operators.forest import PartedForest
from sentrel.operators.trees import GrownForest

EVIDENCE_SCHEMA = (
    "struct<packet_count:bigint,total_bytes:bigint,flow_duration:double,packet_rate:double,"
    "byte_rate:double,packet_size_mean:double,packet_size_std:double,syn_count:bigint,"
    "ack_count:bigint,dst_port:string,classification:string,pattern_status:string,"
    "observation_count:bigint,detection_method:string,behavioral_signature:map<string,double>>"
)
EVENT_SCHEMA = (
    "event_id string, timestamp string, src string, dst string, src_port string, dst_port string,"
    " protocol string, type string, confidence string, severity string, pattern_id string,"
    f" evidence {EVIDENCE_SCHEMA}, _corrupt_record string"
)


def parse_events(lines: DataFrame) -> DataFrame:
    """JSON text per line (column ``value``) to events; works on streams.

    Adds ``malformed``. Blank lines are dropped. Times that do not parse are null and the
    windows leave such rows out.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    text = lines.where(F.trim("value") != "")
    parsed = text.withColumn("e", F.from_json("value", EVENT_SCHEMA, options))
    rest = [c for c in lines.columns if c != "value"]
    event = F.col("e")
    instant = parse_instant(event["timestamp"])
    columns = {
        "malformed": event["_corrupt_record"].isNotNull() | event.isNull(),
        "event_id": event["event_id"],
        "ts": instant,
        "ts_us": F.unix_micros(instant),
        **{c: event[c] for c in ("src", "dst", "src_port", "dst_port", "protocol", "type")},
        "confidence": event["confidence"].try_cast("double"),
        "severity": event["severity"],
        "pattern_id": event["pattern_id"],
        "observations": event["evidence"]["observation_count"],
        "pattern_status": event["evidence"]["pattern_status"],
        "evidence": event["evidence"],
    }
    return evaluated_once(parsed, [*rest, "value"], columns)


def good_events(parsed: DataFrame) -> DataFrame:
    return parsed.where(~F.col("malformed")).drop("malformed", "value")


def malformed_events(parsed: DataFrame) -> DataFrame:
    """Lines that are no event, with the reason; the rest of each line's columns stays."""
    return parsed.where("malformed").select(
        *[c for c in parsed.columns if c == "line_no"], "value", F.lit("MALFORMED_JSON").alias("reason")
    )


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON-lines files, with ``seq`` as their ingest order.

    The numbers depend on file splits, so they are written out with the rows once.
    """
    parsed = good_events(parse_events(spark.read.text(path)))
    return materialise(parsed.withColumn("seq", F.monotonically_increasing_id()))


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_documents(spark: SparkSession, path: str, schema: str, per_line: bool = False) -> DataFrame:
    """Elements of JSON array documents; no file, no array or bad JSON gives no rows.

    A document is a file, or a line with ``per_line``, so that files of many documents are split.
    """
    try:
        text = spark.read.text(path, wholetext=not per_line)
    except AnalysisException:
        return _empty(spark, schema)
    arrays = text.where(F.ltrim(F.col("value")).startswith("["))
    parsed = arrays.select(F.explode(F.from_json("value", f"array<struct<{_colons(schema)}>>")).alias("d"))
    return parsed.where(F.col("d").isNotNull()).select("d.*")


def _colons(schema: str) -> str:
    """DDL column list to struct field list."""
    struct = T.StructType.fromDDL(schema)
    return ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in struct.fields)


def read_labelled_csv(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Latin-1 CSV files with their own headers; names trimmed, all text, file name added.

    Files may differ in columns. Ingest order is not known to CSV; files that need it carry a
    row number of their own.
    """
    parts = []
    for path in paths:
        df = spark.read.option("encoding", "ISO-8859-1").csv(path, header=True)
        names = [c.strip() for c in df.columns]
        parts.append(
            df.select(F.col("_metadata.file_name").alias("file"), "*").toDF("file", *names)
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def write_documents(df: DataFrame, path: str) -> None:
    """Replace a folder of JSON rows."""
    df.write.mode("overwrite").json(path)


def append_events(df: DataFrame, path: str) -> None:
    """Add events to a folder of JSON lines, times as ISO text."""
    if "ts" in df.columns:
        stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        df = df.withColumn("timestamp", stamp).drop("ts", "ts_us")
    df.write.mode("append").json(path)


def write_dataset(df: DataFrame, path: str, csv: bool = False) -> None:
    """Replace a processed dataset; Parquet, or CSV with a header."""
    writer = df.write.mode("overwrite")
    if csv:
        writer.csv(path, header=True)
    else:
        writer.parquet(path)


def save_model(model: PipelineModel | PartedForest | GrownForest, path: str) -> None:
    if isinstance(model, PartedForest | GrownForest):
        model.save(SparkSession.active(), path)
    else:
        model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel | PartedForest | GrownForest:
    """The model in a folder; a forest in parts has no metadata of its own, its parts have."""
    spark = SparkSession.active()

    def has(name: str) -> bool:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)

    if has("metadata"):
        return PipelineModel.load(path)
    return GrownForest.load(spark, path) if has("about") else PartedForest.load(spark, path)
