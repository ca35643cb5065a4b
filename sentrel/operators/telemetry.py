"""Signed sensor messages to decisions: integrity, schema, device, range, freshness, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel.functions import fixed
from sentrel.functions.scalars import evaluated_once, hmac_sha256, is_hex64
from sentrel.functions.staging import materialise
from sentrel.operators.windows import prefix_max

# Reasons that say a message got as far as the freshness check; only then is its body stored.
BODY_KEPT = ["INVALID_TIMESTAMP", "REPLAY_OR_SEQUENCE_RESET", "VERIFIED_INTEGRITY_ONLY"]


def json_type(v: Column, path: str) -> Column:
    """Type name of a JSON value, null when it is missing."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def is_integer(kind: Column) -> Column:
    """JSON integers; those beyond 64 bits show as decimals without a fraction."""
    return (kind == "BIGINT") | kind.rlike(r"\ADECIMAL\((19|[23]\d),0\)\z")


def is_number(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def strict_json(raw: Column | str) -> Column:
    """Parsed JSON, null for bad UTF-8, bad syntax, duplicate keys, NaN and Infinity."""
    text = F.col(raw).cast("string") if isinstance(raw, str) else raw.cast("string")
    return F.when(F.is_valid_utf8(text), F.try_parse_json(text))


def fresh(received_at: Column | str, stamp: Column) -> Column:
    """-10 s <= arrival - measured <= 30 s."""
    now = F.unix_micros(received_at) / 1e6
    return (now - stamp).between(-fixed.MAX_AHEAD_SECONDS, fixed.MAX_AGE_SECONDS)


def _size() -> Column:
    """Bytes of the body; a missing body has none, and is decided like an empty one."""
    return F.coalesce(F.octet_length("raw"), F.lit(0))


def oversized(messages: DataFrame, limit: int = fixed.MAX_BODY_BYTES) -> DataFrame:
    """Messages refused for their size; they get no decision row."""
    return messages.where(_size() > limit).select(
        "message_id", "received_at", F.lit("PAYLOAD_TOO_LARGE").alias("reason")
    )


def check_messages(
    messages: DataFrame, devices: DataFrame, key: bytes, limit: int = fixed.MAX_BODY_BYTES
) -> DataFrame:
    """All checks but replay; ``reason`` is null for messages that pass them.

    ``messages``: ``message_id, received_at, raw BINARY, signature``; ``devices``:
    ``device_id``. Stateless, so it runs on streams too.
    """
    doc = "__doc"
    sane = messages.where(_size() <= limit)
    parsed = sane.withColumn(doc, strict_json("raw"))
    kinds = {
        name: json_type(F.col(doc), path)
        for name, path in {
            "device": "$.device_id",
            "stamp": "$.timestamp",
            "seq": "$.sequence",
            "turbidity": "$.sensors.turbidity_raw",
            "temperature": "$.sensors.temperature_c",
        }.items()
    }

    def value(path, kind):
        return F.try_variant_get(F.col(doc), path, kind)

    parsed = parsed.withColumns(
        {
            "device_id": value("$.device_id", "string"),
            "measured_at": value("$.timestamp", "bigint"),
            "sequence": value("$.sequence", "bigint"),
            "temperature_c": value("$.sensors.temperature_c", "double"),
            "__turbidity": value("$.sensors.turbidity_raw", "decimal(38,0)"),
        }
    )
    # A path into something that is no object finds nothing, so objects need no own test.
    schema_ok = (
        (kinds["device"] == "STRING")
        & (F.length("device_id") <= 128)
        & (kinds["stamp"] == "BIGINT")
        & (F.col("measured_at") >= 0)
        & (kinds["seq"] == "BIGINT")
        & F.col("sequence").between(1, 0xFFFFFFFF)
        & is_integer(kinds["turbidity"])
        & is_number(kinds["temperature"])
        & (F.abs("temperature_c") < float("inf"))
    )
    in_range = F.col("__turbidity").between(0, 4095) & F.col("temperature_c").between(-55, 125)
    signed = is_hex64("signature") & (F.lower("signature") == hmac_sha256("raw", key))

    def fails(c):
        return ~F.coalesce(c, F.lit(False))

    # Everything but the device is decided on the message alone, so bodies are not shuffled.
    early = F.when(fails(signed), "INVALID_HMAC").when(fails(schema_ok), "INVALID_JSON_OR_SCHEMA")
    late = F.when(fails(in_range), "SENSOR_VALUES_OUT_OF_RANGE").when(
        fails(fresh("received_at", F.col("measured_at"))), "INVALID_TIMESTAMP"
    )
    rated = evaluated_once(
        parsed,
        ["message_id", "received_at"],
        {
            "payload_sha256": F.sha2("raw", 256),
            **{c: F.col(c) for c in ("device_id", "sequence", "measured_at", "temperature_c")},
            "turbidity_raw": F.col("__turbidity").try_cast("bigint"),
            "early": early,
            "late": late,
        },
    )
    known = devices.select(F.concat(F.lit("="), "device_id").alias("__k")).distinct()
    known = known.withColumn("__known", F.lit(True))
    # Messages that fail early need no device; a key of their own spreads them in a shuffle.
    own = F.concat(F.lit("#"), F.col("message_id").cast("string"))
    keyed = rated.withColumn(
        "__k",
        F.when(F.col("early").isNull(), F.concat(F.lit("="), "device_id")).otherwise(own),
    )
    unknown = F.when(F.col("__known").isNull(), "UNREGISTERED_DEVICE")
    joined = keyed.join(known, "__k", "left")
    return joined.withColumn("reason", F.coalesce("early", unknown, "late")).drop(
        "__k", "__known", "early", "late"
    )


def shape_decisions(checked: DataFrame) -> DataFrame:
    """Decision log rows; body fields only where the checks got far enough."""
    kept = F.col("reason").isin(*BODY_KEPT)
    body = ["device_id", "sequence", "measured_at", "temperature_c", "turbidity_raw"]
    return checked.select(
        "message_id",
        "received_at",
        "payload_sha256",
        *[F.when(kept, F.col(c)).alias(c) for c in body],
        F.when(F.col("reason") == "VERIFIED_INTEGRITY_ONLY", "ACCEPTED")
        .otherwise("REJECTED")
        .alias("decision"),
        "reason",
    )


def decide(
    messages: DataFrame,
    devices: DataFrame,
    key: bytes,
    limit: int = fixed.MAX_BODY_BYTES,
    bucket_seconds: int = 3600,
) -> DataFrame:
    """Decision per message in arrival order (``received_at, message_id``).

    A message that reaches the replay check is accepted if its sequence exceeds those of all
    earlier messages of its device that reached it; refused ones never raise that maximum.
    """
    # Checked rows are needed twice below; they are narrow, and digests are dear.
    checked = materialise(check_messages(messages, devices, key, limit))
    open_ = F.col("reason").isNull()
    ranked = prefix_max(
        checked.where(open_).withColumn("us", F.unix_micros("received_at")),
        ["device_id"],
        "us",
        ["us", "message_id"],
        "sequence",
        "__last",
        bucket_seconds * 1_000_000,
    )
    replay = F.col("sequence") <= F.col("__last")
    judged = ranked.withColumn(
        "reason",
        F.when(replay, "REPLAY_OR_SEQUENCE_RESET").otherwise("VERIFIED_INTEGRITY_ONLY"),
    )
    failed = checked.where(~open_)
    return shape_decisions(judged.select(*checked.columns).unionByName(failed))


def accepted_samples(decisions: DataFrame) -> DataFrame:
    return decisions.where(F.col("decision") == "ACCEPTED")


def decision_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("decision", "reason").agg(F.count("*").alias("n"))


def replay_state(decisions: DataFrame) -> DataFrame:
    """Last accepted sequence per device."""
    return (
        accepted_samples(decisions)
        .groupBy("device_id")
        .agg(F.max("sequence").alias("last_sequence"))
    )
