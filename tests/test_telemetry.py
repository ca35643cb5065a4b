"""Decision ladder cases, batch and stream."""

import hashlib
import hmac
import json

import pytest

from sentrel.operators import telemetry as tel
from sentrel.streaming import jobs

KEY = b"unit-test-key"
NOW = 1_700_000_000


def body(**changes):
    data = {
        "device_id": "dev", "timestamp": NOW, "sequence": 1,
        "sensors": {"temperature_c": 20.5, "turbidity_raw": 100},
    }
    sensors = changes.pop("sensors", {})
    data.update(changes)
    if isinstance(data["sensors"], dict) and isinstance(sensors, dict):
        data["sensors"] = {**data["sensors"], **sensors}
    else:
        data["sensors"] = sensors
    return json.dumps(data).encode()


def sign(raw):
    return hmac.new(KEY, raw, hashlib.sha256).hexdigest()


def frame(spark, rows):
    """rows: (id, seconds after NOW, raw, signature)"""
    df = spark.createDataFrame(
        [(i, int((NOW + s) * 1_000_000), bytearray(raw), sig) for i, s, raw, sig in rows],
        "message_id bigint, us bigint, raw binary, signature string",
    )
    return df.selectExpr("message_id", "timestamp_micros(us) AS received_at", "raw", "signature")


def reasons(spark, rows):
    devices = spark.createDataFrame([("dev",), ("dev2",)], "device_id string")
    found = tel.decide(frame(spark, rows), devices, KEY).collect()
    return {r["message_id"]: r["reason"] for r in found}


def one(spark, raw, signature=None, at=0):
    return reasons(spark, [(1, at, raw, sign(raw) if signature is None else signature)])[1]


CASES = {
    "INVALID_JSON_OR_SCHEMA": [
        body(sequence=True), body(sequence="1"), body(sequence=0), body(sequence=2**32),
        body(sequence=1.0), body(timestamp=-1), body(timestamp=float(NOW)), b"[]", b"null", b"{",
        b"\xff\xfe", b"", body(device_id=5), body(device_id="x" * 129), body(sensors=[]),
        body(sensors={"temperature_c": float("nan")}), body(sensors={"temperature_c": True}),
        body(sensors={"temperature_c": "20"}), body(sensors={"turbidity_raw": 1.5}),
        body(sensors={"turbidity_raw": 1.0}), body(sensors={"turbidity_raw": False}),
        body().replace(b'"sequence": 1', b'"sequence": 1, "sequence": 1'),
        body().replace(b'"sequence": 1, ', b""),
    ],
    "SENSOR_VALUES_OUT_OF_RANGE": [
        body(sensors={"turbidity_raw": 4096}), body(sensors={"turbidity_raw": -1}),
        body(sensors={"temperature_c": -127}), body(sensors={"temperature_c": 125.01}),
        body(sensors={"turbidity_raw": 10**25}),
    ],
    "UNREGISTERED_DEVICE": [body(device_id="other")],
    "INVALID_TIMESTAMP": [body(timestamp=NOW - 60), body(timestamp=NOW + 60), body(timestamp=2**63 - 1)],
    "VERIFIED_INTEGRITY_ONLY": [
        body(), body(timestamp=NOW - 30), body(timestamp=NOW + 10), body(sensors={"temperature_c": 1e1}),
        body(sensors={"temperature_c": -55}), body(device_id="dev2"), body(extra=[1, {"a": None}]),
    ],
}


def test_ladder(spark):
    rows, want = [], {}
    for reason, bodies in CASES.items():
        for raw in bodies:
            i = len(rows)
            # Hours apart, so that the accepted ones do not block each other by sequence.
            rows.append((i, 0, raw, sign(raw)))
            want[i] = reason
    devices = spark.createDataFrame([("dev",), ("dev2",)], "device_id string")
    got = tel.check_messages(frame(spark, rows), devices, KEY).collect()
    got = {r["message_id"]: r["reason"] or "VERIFIED_INTEGRITY_ONLY" for r in got}
    bad = {i: (rows[i][2], got[i], want[i]) for i in want if got[i] != want[i]}
    assert not bad


def test_signature(spark):
    raw = body()
    assert one(spark, raw, sign(raw).upper()) == "VERIFIED_INTEGRITY_ONLY"
    for signature in ("", "zz", sign(raw) + "\n", sign(raw)[:-1], sign(b"x")):
        assert one(spark, raw, signature) == "INVALID_HMAC"
    assert one(spark, raw + b" ", sign(raw)) == "INVALID_HMAC"


def test_replay(spark):
    rows = [(i, i, body(sequence=s), None) for i, s in enumerate([10, 1, 11, 11, 5, 12])]
    rows = [(i, s, raw, sign(raw)) for i, s, raw, _ in rows]
    got = reasons(spark, rows)
    ok = [r == "VERIFIED_INTEGRITY_ONLY" for _, r in sorted(got.items())]
    assert ok == [True, False, True, False, False, True]


def test_stale_messages_leave_no_trace(spark):
    bodies = [body(sequence=7, timestamp=NOW - 60), body(sequence=7, timestamp=NOW + 60), body(sequence=7)]
    got = reasons(spark, [(i, 0, raw, sign(raw)) for i, raw in enumerate(bodies)])
    assert [got[i] for i in range(3)] == ["INVALID_TIMESTAMP"] * 2 + ["VERIFIED_INTEGRITY_ONLY"]


def test_size_and_stored_fields(spark):
    big = body(pad="x" * 5000)
    small = body(sensors={"turbidity_raw": 9999})
    df = frame(spark, [(1, 0, big, sign(big)), (2, 0, small, sign(small)), (3, 0, body(), sign(body()))])
    devices = spark.createDataFrame([("dev",)], "device_id string")
    rows = {r["message_id"]: r for r in tel.decide(df, devices, KEY).collect()}
    assert set(rows) == {2, 3} and rows[2]["device_id"] is None and rows[3]["sequence"] == 1
    assert rows[3]["payload_sha256"] == hashlib.sha256(body()).hexdigest()
    assert [r["message_id"] for r in tel.oversized(df).collect()] == [1]


@pytest.mark.parametrize("files", [1, 3])
def test_stream_equals_batch(spark, tmp_path, files):
    jobs.use_rocksdb(spark)
    bodies = [body(sequence=s, device_id=d) for s, d in zip([5, 5, 9, 2, 10, 7, 8, 8], ["dev", "dev2"] * 4)]
    rows = [(i, i, raw, sign(raw) if i != 4 else "") for i, raw in enumerate(bodies)]
    devices = spark.createDataFrame([("dev",), ("dev2",)], "device_id string")
    src = str(tmp_path / "in")
    size = -(-len(rows) // files)
    for n in range(files):
        part = frame(spark, rows[n * size : (n + 1) * size]).coalesce(1)
        part.write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = str(tmp_path / "out")
    jobs.append_to(jobs.stream_decisions(stream, devices, KEY), out, str(tmp_path / "cp")).awaitTermination()
    got = {r["message_id"]: r["reason"] for r in spark.read.parquet(out).collect()}
    assert got == reasons(spark, rows)
