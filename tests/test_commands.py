"""Throttle, request ladder and lifecycle against plain loops."""

import hashlib
import hmac
import json
import random

import pandas as pd
import pytest

from sentrel.operators import commands as cmd
from sentrel.streaming import jobs

KEY = b"unit-test-key"
S = 1_000_000
NOW = 1_700_000_000


def samples(spark, times, controller="m"):
    rows = [(controller, round(t * S), i) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "controller string, us bigint, decision_id bigint")


def greedy(times, gap=15):
    out, last = [], None
    for t in sorted(times):
        if last is None or t - last >= gap:
            out.append(t)
            last = t
    return out


def test_throttle_case(spark):
    got = cmd.authorise(samples(spark, [0, 5, 14, 15, 20, 31])).orderBy("sequence").collect()
    assert [(r["issued_us"] // S, r["expires_us"] // S) for r in got] == [(0, 10), (15, 25), (31, 41)]
    assert [r["sensor_decision_id"] for r in got] == [0, 3, 5]
    assert len({r["command_id"] for r in got}) == 3 and all(len(r["command_id"]) == 32 for r in got)


@pytest.mark.parametrize("seed", range(3))
def test_throttle_equals_loop(spark, seed):
    rng = random.Random(seed)
    times = [rng.randrange(40_000) / 10 for _ in range(600)] + [9000, 9001, 9016]
    got = cmd.authorise(samples(spark, times), bucket_seconds=rng.choice([15, 60, 600])).collect()
    want = greedy([round(t * S) for t in times], 15 * S)
    assert sorted((r["sequence"], r["issued_us"]) for r in got) == list(enumerate(want, 1))


@pytest.mark.parametrize("seed", range(3))
def test_throttle_over_spans(spark, seed):
    """Spans of few buckets, empty buckets, samples just before and after a bucket's start, two controllers."""
    rng = random.Random(seed)
    times = {}
    for name in ("a", "b"):
        borders = [15 * rng.randrange(200) + rng.choice([-1, -0.5, 0, 0.5, 1, 7, 14]) for _ in range(150)]
        times[name] = [round(t * S) for t in borders + [rng.randrange(-300, 3000) for _ in range(rng.choice([20, 600]))]]
    rows = [(name, t, i) for name, ts in times.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "controller string, us bigint, decision_id bigint")
    got = cmd.authorise(df, bucket_seconds=15, span=rng.choice([2, 3, 16])).collect()
    for name, ts in times.items():
        mine = sorted((r["sequence"], r["issued_us"]) for r in got if r["controller"] == name)
        assert mine == list(enumerate(greedy(ts, 15 * S), 1))


def request(kind, seq, at, device="m", stamp=None, **extra):
    data = {"message_type": kind, "device_id": device, "sequence": seq,
            "timestamp": NOW + at if stamp is None else stamp, **extra}
    return json.dumps(data).encode()


def requests_frame(spark, rows):
    """rows: (id, seconds, kind, raw, signature or None)"""
    data = []
    for i, at, kind, raw, sig in rows:
        sig = hmac.new(KEY, raw, hashlib.sha256).hexdigest() if sig is None else sig
        data.append((i, int((NOW + at) * S), kind, bytearray(raw), sig))
    df = spark.createDataFrame(
        data, "request_id bigint, us bigint, kind string, raw binary, signature string"
    )
    return df.selectExpr("request_id", "timestamp_micros(us) AS received_at", "kind", "raw", "signature")


def commands_frame(spark, rows):
    return spark.createDataFrame(
        rows, "controller string, command_id string, sequence bigint, sensor_decision_id bigint, "
        "issued_us bigint, expires_us bigint"
    )


def issue(n, at, life=10, controller="m"):
    return (controller, f"{n:032d}", n, n, int((NOW + at) * S), int((NOW + at + life) * S))


def decide(spark, rows, commands, ticks=None):
    controllers = spark.createDataFrame([("m",)], "controller string")
    found = cmd.decide_requests(
        requests_frame(spark, rows), commands_frame(spark, commands), controllers, KEY, ticks
    )
    return {r["request_id"]: (r["reason"], r["delivered"]) for r in found.collect()}


def ack(seq, at, n=1, outcome="COMPLETED_OFF"):
    return request("motor_ack", seq, at, command_id=f"{n:032d}", outcome=outcome)


def test_lifecycle(spark):
    one = f"{1:032d}"
    rows = [
        (1, 1, "motor_ack", ack(1, 1), None),
        (2, 2, "motor_poll", request("motor_poll", 1, 2), None),
        (3, 3, "motor_poll", request("motor_poll", 2, 3), None),
        (4, 4, "motor_poll", request("motor_poll", 2, 4), None),
        (5, 5, "motor_ack", ack(3, 5), None),
        (6, 6, "motor_ack", ack(4, 6, outcome="FAILED_OFF"), None),
        (7, 7, "motor_ack", ack(4, 7), None),
        (8, 8, "motor_poll", request("motor_poll", 5, 8), None),
        (9, 9, "motor_ack", ack(6, 9, n=7), None),
    ]
    got = decide(spark, rows, [issue(1, 0)])
    assert got == {
        1: ("COMMAND_NOT_DELIVERED", None),
        2: ("MOTOR_POLL_ACCEPTED", one),
        3: ("MOTOR_POLL_ACCEPTED", one),
        4: ("REPLAY_OR_SEQUENCE_RESET", None),
        5: ("MOTOR_ACK_ACCEPTED", None),
        6: ("CONFLICTING_ACK", None),
        7: ("MOTOR_ACK_ACCEPTED", None),
        8: ("MOTOR_POLL_ACCEPTED", None),
        9: ("COMMAND_NOT_DELIVERED", None),
    }


def test_expired_command(spark):
    rows = [
        (1, 11, "motor_ack", ack(1, 11), None),
        (2, 12, "motor_poll", request("motor_poll", 2, 12), None),
        (3, 13, "motor_ack", ack(3, 13), None),
    ]
    got = decide(spark, rows, [issue(1, 0)])
    assert [got[i][0] for i in (1, 2, 3)] == [
        "COMMAND_NOT_DELIVERED", "MOTOR_POLL_ACCEPTED", "MOTOR_ACK_ACCEPTED",
    ]
    assert got[2][1] is None
    # An accepted sample marks the expiry too, so the first ACK is taken then.
    tick = samples(spark, [NOW + 10.5])
    assert decide(spark, rows, [issue(1, 0)], tick)[1][0] == "MOTOR_ACK_ACCEPTED"


def test_request_checks(spark):
    poll = "motor_poll"
    cases = [
        (poll, request(poll, 1, 0), "", "INVALID_HMAC"),
        (poll, request("motor_ack", 1, 0), None, "INVALID_SCHEMA"),
        (poll, b"[]", None, "INVALID_SCHEMA"),
        (poll, request(poll, 1, 0, device="x"), None, "WRONG_DEVICE"),
        (poll, request(poll, "1", 0, device="x"), None, "WRONG_DEVICE"),
        (poll, request(poll, 1, 0, device=4), None, "WRONG_DEVICE"),
        (poll, request(poll, True, 0), None, "INVALID_SCHEMA"),
        (poll, request(poll, 0, 0), None, "INVALID_SCHEMA"),
        (poll, request(poll, 1, 0, stamp="now"), None, "INVALID_SCHEMA"),
        (poll, request(poll, 1, 0, stamp=NOW - 31), None, "INVALID_TIMESTAMP"),
        (poll, request(poll, 1, 0, stamp=NOW + 11.5), None, "INVALID_TIMESTAMP"),
        ("motor_ack", request("motor_ack", 1, 0, command_id="x", outcome="REJECTED"), None, "INVALID_SCHEMA"),
        ("motor_ack", ack(1, 0, outcome="DONE"), None, "INVALID_SCHEMA"),
        (poll, request(poll, 1, 0, stamp=NOW - 29.5), None, "MOTOR_POLL_ACCEPTED"),
    ]
    rows = [(i, 0, kind, raw, sig) for i, (kind, raw, sig, _) in enumerate(cases)]
    got = decide(spark, rows, [])
    assert [got[i][0] for i in range(len(cases))] == [c[3] for c in cases]
    controllers = spark.createDataFrame([("m",)], "controller string")
    none = cmd.check_requests(requests_frame(spark, rows), controllers, b"").collect()
    assert {r["reason"] for r in none} == {"MOTOR_NOT_CONFIGURED"}


def test_status(spark):
    commands = commands_frame(spark, [issue(1, 0), issue(2, 20), issue(3, 40), issue(4, 60)])
    log = spark.createDataFrame(
        [(1, (NOW + 1) * S, "MOTOR_POLL_ACCEPTED", None, None, f"{1:032d}"),
         (2, (NOW + 2) * S, "MOTOR_ACK_ACCEPTED", f"{1:032d}", "REJECTED", None),
         (3, (NOW + 41) * S, "MOTOR_POLL_ACCEPTED", None, None, f"{3:032d}")],
        "request_id bigint, us bigint, reason string, command_id string, outcome string, delivered string",
    )
    got = cmd.command_status(commands, (NOW + 45) * S, log).orderBy("sequence").collect()
    assert [(r["status"], r["outcome"]) for r in got] == [
        ("ACKNOWLEDGED", "REJECTED"), ("EXPIRED", "UNKNOWN"), ("DELIVERED", None),
    ]


def test_streams_equal_batch(spark, tmp_path):
    jobs.use_rocksdb(spark)
    rng = random.Random(5)
    times = sorted({rng.randrange(600) for _ in range(120)})
    src = str(tmp_path / "in")
    for n in range(2):
        half = samples(spark, times).where(f"us {'<' if n == 0 else '>='} {300 * S}")
        half.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(samples(spark, [0]).schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = str(tmp_path / "out")
    jobs.append_to(jobs.stream_commands(stream), out, str(tmp_path / "cp")).awaitTermination()
    cols = ["controller", "sequence", "issued_us", "expires_us", "command_id"]
    want = cmd.authorise(samples(spark, times)).select(*cols).collect()
    assert sorted(spark.read.parquet(out).select(*cols).collect()) == sorted(want)


def test_request_stream_equals_fold(spark, tmp_path):
    jobs.use_rocksdb(spark)
    rng = random.Random(8)
    rows, seq = [], 0
    for i in range(80):
        at = i * 3
        kind = rng.choice(["motor_poll", "motor_ack"])
        seq += rng.choice([0, 1, 1, 2])
        n = max(1, at // 20)
        rows.append(("m", at * S, 1, i, kind, seq, f"{n:032d}" if kind == "motor_ack" else None,
                     rng.choice(["REJECTED", "FAILED_OFF"]) if kind == "motor_ack" else None, None))
    for n in range(1, 12):
        rows.append(("m", n * 20 * S, 0, None, "issue", n, f"{n:032d}", None, (n * 20 + 10) * S))
    schema = (
        "controller string, us bigint, rank int, request_id bigint, kind string, sequence bigint, "
        "command_id string, outcome string, expires_us bigint"
    )
    log = spark.createDataFrame(rows, schema)
    want = dict(
        (r[0], (r[1], r[2])) for r in jobs.fold_rows(
            jobs.ControllerState(),
            pd.DataFrame(sorted(rows, key=lambda r: (r[1], r[2], r[3] or 0)), columns=jobs.FOLD_COLUMNS),
        )
    )
    src = str(tmp_path / "in")
    for n in range(2):
        log.where(f"us {'<' if n == 0 else '>='} {120 * S}").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = str(tmp_path / "out")
    jobs.append_to(jobs.stream_requests(stream), out, str(tmp_path / "cp")).awaitTermination()
    got = {r["request_id"]: (r["reason"], r["delivered"]) for r in spark.read.parquet(out).collect()}
    assert got == want and len({v[0] for v in want.values()}) >= 4


@pytest.mark.parametrize("seed,gap,life", [(0, 20, 10), (1, 6, 15), (2, 20, 10), (3, 4, 9)])
def test_requests_equal_fold(spark, seed, gap, life):
    """Random logs with repeats, early and late ACKs; commands overlap in two of the cases."""
    rng = random.Random(seed)
    commands = [issue(n, n * gap, life) for n in range(1, 15)]
    ticks = [n * 7 for n in range(20)] if seed % 2 else []
    rows, log, seq = [], [], 1
    for i in range(150):
        at = i * 2 + rng.choice([0, 1])
        seq = max(1, seq + rng.choice([-2, 0, 1, 1, 1, 2, 4]))
        if rng.random() < 0.5:
            rows.append((i, at, "motor_poll", request("motor_poll", seq, at), None))
            log.append(("m", (NOW + at) * S, 1, i, "motor_poll", seq, None, None, None))
        else:
            n = max(1, min(15, at // gap + rng.choice([-2, -1, 0, 0, 1])))
            outcome = rng.choice(["REJECTED", "REJECTED", "FAILED_OFF"])
            rows.append((i, at, "motor_ack", ack(seq, at, n, outcome), None))
            log.append(("m", (NOW + at) * S, 1, i, "motor_ack", seq, f"{n:032d}", outcome, None))
    for c in commands:
        log.append(("m", c[4], 0, None, "issue", c[2], c[1], None, c[5]))
    log += [("m", (NOW + t) * S, 0, None, "sample", None, None, None, None) for t in ticks]
    log.sort(key=lambda r: (r[1], r[2], -1 if r[3] is None else r[3]))
    frame = pd.DataFrame(log, columns=jobs.FOLD_COLUMNS)
    want = {i: (reason, sent) for i, reason, sent in jobs.fold_rows(jobs.ControllerState(), frame)}
    tick = samples(spark, [NOW + t for t in ticks]) if ticks else None
    assert decide(spark, rows, commands, tick) == want
    assert len({v[0] for v in want.values()}) >= 3
