"""Driver tables read as packets, security events, telemetry and labelled features.

Each adapter is arithmetic on columns, so plain SQL can repeat it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel.functions.scalars import hmac_sha256

TEST_KEY = b"test-only-key"
EVENT_WINDOW_SECONDS = 21_600
FLOW_WINDOW_SECONDS = 86_400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for field in df.schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def sec_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = (
        F.when(F.col("event_type") == "view", "BENIGN")
        .when(F.col("event_type") == "click", "PORT_SCAN")
        .when(F.col("event_type") == "error", "BRUTE_FORCE")
        .when(F.col("event_type") == "purchase", "DOS")
        .otherwise("UNKNOWN_BEHAVIOR")
    )
    known = kind != "UNKNOWN_BEHAVIOR"
    confidence = F.when(known, (F.col("event_id") % 1000) / 1000.0)
    return e.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("EVT-"), F.col("event_id").cast("string")).alias("event_id"),
        F.col("ts"),
        F.unix_micros("ts").alias("ts_us"),
        F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")).alias("src"),
        F.concat(F.lit("10.1.0."), (F.col("event_id") % 7).cast("string")).alias("dst"),
        (50000 + F.col("event_id") % 1000).cast("string").alias("src_port"),
        F.get_json_object("props", "$.k").alias("dst_port"),
        F.when(F.col("event_id") % 3 == 0, "UDP").otherwise("TCP").alias("protocol"),
        kind.alias("type"),
        confidence.alias("confidence"),
        F.when(confidence >= 0.9, "HIGH").otherwise("MEDIUM").alias("severity"),
        F.when(~known, F.concat(F.lit("P-"), (F.col("event_id") % 20).cast("string"))).alias(
            "pattern_id"
        ),
        F.when(~known, F.col("event_id") % 50).alias("observations"),
        F.lit(None).cast("string").alias("pattern_status"),
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    src = F.col("user_id") % 5
    dst = (src + 1 + F.col("event_id") % 4) % 5

    def host(n):
        return F.concat(F.lit("10.0.0."), n.cast("string"))

    return e.select(
        F.col("event_id").alias("frame_no"),
        F.col("ts"),
        F.unix_micros("ts").alias("ts_us"),
        host(src).alias("src"),
        host(dst).alias("dst"),
        (40000 + src).cast("string").alias("src_port"),
        (40000 + dst).cast("string").alias("dst_port"),
        F.lit("TCP").alias("protocol"),
        (60 + F.floor("value")).cast("bigint").alias("size"),
        (F.col("event_id") % 10 == 0).cast("int").alias("syn"),
        F.lit(1).alias("ack"),
        (F.col("event_id") % 4 == 0).cast("int").alias("push"),
        F.lit(40).alias("header_length"),
    )


def packet_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets as pipe-delimited text, some of it broken."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    us = F.unix_micros("ts")
    tcp = i % 3 != 0
    n = i.cast("string")
    seconds = F.concat(
        F.expr("ts_us div 1000000").cast("string"),
        F.lit("."),
        F.lpad((F.col("ts_us") % 1000000).cast("string"), 6, "0"),
    )
    port_a = (40000 + i % 100).cast("string")
    port_b = (i % 1024).cast("string")
    proto = F.when(i % 23 == 0, "1").when(tcp, "6").otherwise("17")
    parts = [
        F.when(i % 29 == 0, "bad").otherwise(seconds),
        F.when(i % 31 == 0, "").otherwise(F.concat(F.lit("10.0.0."), (i % 50).cast("string"))),
        F.concat(F.lit("10.1.0."), (i % 7).cast("string")),
        F.when(tcp, port_a).otherwise(""),
        F.when(tcp, port_b).otherwise(""),
        F.when(tcp, "").otherwise(port_a),
        F.when(tcp, "").otherwise(port_b),
        proto,
        (60 + F.floor("value")).cast("bigint").cast("string"),
        F.when(~tcp, "").when(i % 10 == 0, "True").otherwise("False"),
        F.when(~tcp, "").when(i % 2 == 0, "1").otherwise("0"),
        F.when(~tcp, "").when(i % 4 == 0, "true").otherwise("0"),
        F.when(i % 13 == 0, "").otherwise("20"),
        F.when(tcp, F.when(i % 17 == 0, "x").otherwise("32")).otherwise(""),
    ]
    line = F.concat_ws("|", *parts)
    return e.withColumn("ts_us", us).select(
        i.alias("frame_no"),
        F.when(i % 37 == 0, F.concat(line, F.lit("|"), n)).otherwise(line).alias("value"),
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed sensor messages: arrival instant, exact bytes, signature header."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    seconds = F.expr("unix_micros(ts) div 1000000")
    age = F.when(i % 13 == 0, 45).when(i % 17 == 0, -20).otherwise(5)
    body = F.format_string(
        '{"device_id":"sensor-%d","timestamp":%d,"sequence":%d,'
        '"sensors":{"temperature_c":%s,"turbidity_raw":%d}}',
        F.col("user_id") % 10,
        seconds - age,
        i - F.when(i % 11 == 0, 500).otherwise(0),
        (F.col("value").cast("decimal(10,2)") - 20).cast("string"),
        (i * 37) % 4200,
    )
    # The signature covers the body as sent; every nineteenth body is changed afterwards.
    return e.select(
        i.alias("message_id"),
        F.col("ts").alias("received_at"),
        body.cast("binary").alias("sent"),
    ).select(
        "message_id",
        "received_at",
        F.when(F.col("message_id") % 19 == 0, F.concat("sent", F.lit(" ").cast("binary")))
        .otherwise(F.col("sent"))
        .alias("raw"),
        hmac_sha256("sent", TEST_KEY).alias("signature"),
    )


REGISTERED_DEVICES = [f"sensor-{n}" for n in range(9)]


def features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Embeddings as one DOUBLE column per dimension, with a class label."""
    e = table(spark, sf_dir, "embeddings")
    names = [f"f{i:02d}" for i in range(64)]
    classes = ["BENIGN", "DOS", "DDOS", "PORT_SCAN", "BRUTE_FORCE", "BOT"]
    label = F.element_at(
        F.array(*[F.lit(c) for c in classes]), F.least(F.col("label"), F.lit(9)) % 6 + 1
    )
    cols = [F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)]
    return e.select(F.col("vec_id").alias("row_id"), label.alias("label"), *cols), names


def labelled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rated documents as (row id, actual class, predicted class)."""
    t = table(spark, sf_dir, "labels")
    return t.select(
        F.col("doc_id").alias("row_id"),
        F.when(F.col("quality") == 1, "BENIGN").otherwise("DOS").alias("actual"),
        F.when(F.col("toxic") == 0, "BENIGN").otherwise("DOS").alias("predicted"),
    )

COMMAND_GAP_SECONDS = 900
COMMAND_LIFETIME_SECONDS = 600
CONTROLLERS = ["motor-0", "motor-1"]


def _signed(body):
    return hmac_sha256(body, TEST_KEY)


def samples_of(decisions: DataFrame) -> DataFrame:
    """Accepted samples by controller; two controllers share the sensors."""
    number = F.element_at(F.split("device_id", "-"), -1).cast("int")
    return decisions.where(F.col("decision") == "ACCEPTED").select(
        F.concat(F.lit("motor-"), (number % 2).cast("string")).alias("controller"),
        F.unix_micros("received_at").alias("us"),
        F.col("message_id").alias("decision_id"),
    )


def controller_requests(commands: DataFrame) -> DataFrame:
    """Seven requests around every command: early ACK, poll, repeat, ACKs, poll, late ACK."""
    # (number, seconds after issue, kind, outcome)
    plan = [
        (0, 1, "motor_ack", "COMPLETED_OFF"),
        (1, 2, "motor_poll", ""),
        (2, 3, "motor_poll", ""),
        (3, 4, "motor_ack", "COMPLETED_OFF"),
        (4, 5, "motor_ack", "FAILED_OFF"),
        (5, 6, "motor_poll", ""),
        (6, 700, "motor_ack", "COMPLETED_OFF"),
    ]
    steps = F.array(
        *[
            F.struct(
                F.lit(k).alias("k"), F.lit(s).alias("s"), F.lit(t).alias("kind"),
                F.lit(o).alias("outcome"),
            )
            for k, s, t, o in plan
        ]
    )
    group = F.col("sensor_decision_id") % 4
    poll = F.col("k").isin(1, 2)
    us = F.col("issued_us") + F.col("s") * 1_000_000
    # The repeated poll reuses the number of the first.
    sequence = us - F.when(F.col("k") == 2, 1_000_000).otherwise(0)
    stamp = F.expr("us div 1000000") - F.when((group == 3) & (F.col("k") == 1), 60).otherwise(1)
    device = F.when((group == 2) & poll, "motor-x").otherwise(F.col("controller"))
    extra = F.when(
        F.col("kind") == "motor_ack",
        F.concat(
            F.lit(',"command_id":"'), "command_id", F.lit('","outcome":"'), "outcome", F.lit('"')
        ),
    ).otherwise("")
    body = F.format_string(
        '{"device_id":"%s","message_type":"%s","sequence":%d,"timestamp":%d%s}',
        device, F.col("kind"), sequence, stamp, extra,
    )
    rows = (
        commands.select("*", F.explode(steps).alias("p"))
        .select("*", "p.*")
        .withColumn("us", us)
        .withColumn("raw", body.cast("binary"))
    )
    return rows.select(
        (F.col("sensor_decision_id") * 10 + F.col("k")).alias("request_id"),
        F.timestamp_micros("us").alias("received_at"),
        "kind",
        "raw",
        F.when((group == 1) & (F.col("k") == 1), F.lit("00")).otherwise(_signed("raw")).alias(
            "signature"
        ),
    )


def envelopes(commands: DataFrame, controller: str) -> DataFrame:
    """Signed command envelopes as one controller receives them, with repeats and faults."""
    n = F.col("sensor_decision_id")
    mine = commands.where(F.col("controller") == controller)
    body = F.format_string(
        '{"action":"%s","command_id":"%s","device_id":"%s","duration_seconds":%s,'
        '"expires_at":%d,"issued_at":%d,"message_type":"motor_command","schema_version":%d,'
        '"sequence":%d}',
        F.when(n % 5 == 1, "OFF").otherwise("ON"),
        F.col("command_id"),
        F.col("controller"),
        F.when(n % 7 == 1, "9").otherwise("3"),
        F.expr("expires_us div 1000000"),
        F.expr("issued_us div 1000000"),
        F.when(n % 11 == 1, 2).otherwise(1),
        F.col("sequence"),
    )
    copies = F.explode(F.array(*[F.lit(i) for i in (0, 1)])).alias("copy")
    rows = mine.select("*", copies).withColumn("payload", body.cast("binary"))
    return rows.select(
        (n * 10 + F.col("copy")).alias("envelope_id"),
        F.timestamp_micros(F.col("issued_us") + (F.col("copy") + 1) * 2_000_000).alias(
            "received_at"
        ),
        "payload",
        F.when(n % 13 == 1, "00").otherwise(_signed("payload")).alias("signature"),
    )
