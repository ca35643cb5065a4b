"""Flow features against a plain per-flow computation; stream against batch."""

import random

import numpy as np
import pytest

from sentrel.functions.fixed import FLOW_FEATURES
from sentrel.operators.flows import flow_features
from sentrel.streaming import jobs

SCHEMA = (
    "frame_no bigint, us bigint, src string, dst string, src_port string, dst_port string, "
    "protocol string, size bigint, syn int, ack int, push int, header_length int"
)


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", "timestamp_micros(us) AS ts").drop("us")


def packet(n, us, src="a", dst="b", sp="1", dp="2", size=100, syn=0, ack=1, push=0, header=40):
    return (n, us, src, dst, sp, dp, "TCP", size, syn, ack, push, header)


def plain(rows):
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    first = rows[0]
    ahead = [r for r in rows if (r[2], r[3]) == (first[2], first[3])]
    back = [r for r in rows if (r[2], r[3]) != (first[2], first[3])]
    t = np.array([r[1] / 1e6 for r in rows])
    duration = t[-1] - t[0] if t[-1] > t[0] else 0.001
    size = np.array([r[7] for r in rows], float)

    def mean(v):
        return float(np.mean(v)) if len(v) else 0.0

    def gaps(part):
        return mean(np.diff([r[1] / 1e6 for r in part]))

    return [
        duration, len(ahead), len(back), sum(r[7] for r in ahead), sum(r[7] for r in back),
        mean([r[7] for r in ahead]), mean([r[7] for r in back]), size.sum() / duration,
        len(rows) / duration, mean(np.diff(t)), float(np.std(np.diff(t))) if len(t) > 1 else 0.0,
        gaps(ahead), gaps(back), sum(r[10] for r in ahead), sum(r[10] for r in back),
        sum(r[11] for r in ahead), sum(r[11] for r in back), size.mean(), size.std(),
        sum(r[8] for r in rows), sum(r[9] for r in rows), len(back) / len(ahead),
    ]


@pytest.mark.parametrize("slices", [1, 8, 256])
def test_features_equal_loop(spark, slices):
    rng = random.Random(slices)
    rows = []
    for n in range(400):
        a, b = rng.sample(["10.0.0.1", "10.0.0.2", "9.0.0.1"], 2)
        ports = {"10.0.0.1": "80", "10.0.0.2": "443", "9.0.0.1": "9"}
        # A third of all packets belongs to one flow, many at the same instant.
        if rng.random() < 0.4:
            a, b = rng.choice([("10.0.0.1", "9.0.0.1"), ("9.0.0.1", "10.0.0.1")])
        us = rng.choice([rng.randrange(20_000_000), rng.randrange(20) * 1_000_000])
        rows.append(
            packet(n, us, a, b, ports[a], ports[b], rng.randrange(60, 1500), rng.randrange(2),
                   rng.randrange(2), rng.randrange(2), rng.choice([20, 40]))
        )
    groups = {}
    for r in rows:
        groups.setdefault((r[1] // 5_000_000, frozenset([r[2], r[3]])), []).append(r)
    want = {k: plain(v) for k, v in groups.items() if len(v) >= 2}
    got = {}
    for r in flow_features(frame(spark, rows), slices=slices).collect():
        got[r["window_us"] // 5_000_000, frozenset([r["src"], r["dst"]])] = [r[f] for f in FLOW_FEATURES]
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-9, abs=1e-9), k


def test_small_cases(spark):
    rows = [packet(0, 7), packet(1, 7)]  # one instant
    (r,) = flow_features(frame(spark, rows)).collect()
    assert (r["Flow Duration"], r["Flow IAT Mean"], r["Down/Up Ratio"]) == (0.001, 0, 0)
    rows = [packet(i, i * 1000) for i in range(3)]  # one way
    (r,) = flow_features(frame(spark, rows)).collect()
    assert (r["Total Fwd Packets"], r["Total Backward Packets"], r["Bwd Packet Length Mean"]) == (3, 0, 0)
    rows = [packet(0, 0), packet(1, 5, "b", "a", "2", "1")]  # both ways
    (r,) = flow_features(frame(spark, rows)).collect()
    assert (r["Total Fwd Packets"], r["Total Backward Packets"]) == (1, 1)
    assert flow_features(frame(spark, [packet(0, 0)])).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    jobs.use_rocksdb(spark)
    rng = random.Random(3)
    rows = [
        packet(n, rng.randrange(30_000_000), *rng.choice([("a", "b", "1", "2"), ("b", "a", "2", "1")]))
        for n in range(200)
    ]
    # A late record moves the watermark past all windows.
    closing = packet(999, 90_000_000, "z", "y")
    src = str(tmp_path / "in")
    frame(spark, rows).coalesce(1).write.parquet(src)
    schema = spark.read.parquet(src).schema
    frame(spark, [closing]).coalesce(1).write.mode("append").parquet(src)
    out, mark = str(tmp_path / "out"), str(tmp_path / "cp")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).parquet(src)
    flows = jobs.stream_flows(stream).drop("w")
    jobs.append_to(flows, out, mark).awaitTermination()
    want = flow_features(frame(spark, rows)).drop("w")
    got = spark.read.parquet(out)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


