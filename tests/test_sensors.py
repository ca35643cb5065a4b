"""Causal features and quality findings against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sentrel.operators import sensors
from sentrel.operators.windows import running

SCHEMA = "device string, us long, seq long, value double"
SECOND = 1_000_000


def features(rows, window, baseline, least_window=3, least_baseline=10):
    """(device, us) to the figures, from the definition."""
    fine = [r for r in rows if r[1] is not None and r[3] is not None and abs(r[3]) < 1e9]
    out = {}
    for device in {r[0] for r in fine}:
        mine = [(us, v) for d, us, _, v in fine if d == device]
        instants = sorted({us for us, _ in mine})
        at = {t: [v for us, v in mine if us == t] for t in instants}
        for i, t in enumerate(instants):
            w = [(us, v) for us, v in mine if t - window <= us <= t]
            b = [v for us, v in mine if t - baseline <= us < t - window]
            value = sum(at[t]) / len(at[t])

            def stats(x):
                m = sum(x) / len(x)
                return m, math.sqrt(sum((y - m) ** 2 for y in x) / (len(x) - 1)) if len(x) > 1 else None

            mean, std = stats([v for _, v in w]) if len(w) >= least_window else (None, None)
            slope = None
            if len(w) >= least_window and len({us for us, _ in w}) > 1:
                mt, mv = sum(us for us, _ in w) / len(w), sum(v for _, v in w) / len(w)
                slope = sum((us - mt) * (v - mv) for us, v in w) / sum((us - mt) ** 2 for us, _ in w) * SECOND
            before = instants[i - 1] if i else None
            rate = None if before is None else (value - sum(at[before]) / len(at[before])) * SECOND / (t - before)
            b_mean, b_std = stats(b) if len(b) >= least_baseline else (None, None)
            deviation = (value - b_mean) / b_std if b_std else None
            ready = len(w) >= least_window and len(b) >= least_baseline
            out[device, t] = (
                value, len(w), mean, std, slope, rate, len(b), b_mean, b_std, deviation,
                sensors.READY if ready else sensors.NO_HISTORY,
            )
    return out


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6)
    return a == b


def readings(seed, n=400):
    rnd = random.Random(seed)
    rows, us = [], {d: -3_600 * SECOND for d in ("a", "b", None)}
    for i in range(n):
        # Most rows belong to one device; some stand at the same instant, some are far apart.
        device = rnd.choice(["a", "a", "a", "b", None])
        us[device] += rnd.choice([0, 1, SECOND, 7 * SECOND, 400 * SECOND])
        value = rnd.choice([None, float("nan"), float("inf"), 1e12, 2.5, 2.5, -0.0, 0.0, rnd.uniform(-50, 50)])
        rows.append((device, us[device], rnd.choice([None, i, i, i + 3]), value))
    return rows + [("a", None, 1, 1.0), ("c", None, None, None)]


@pytest.mark.parametrize("bucket", [3 * SECOND, 3_600 * SECOND])
def test_features_equal_their_definition(spark, bucket):
    rows = readings(bucket)
    df = spark.createDataFrame(rows, SCHEMA)
    window, baseline = 60 * SECOND, 900 * SECOND
    got = sensors.causal_features(df, ["device"], "us", "value", window, baseline, bucket_us=bucket).collect()
    want = features(rows, window, baseline)
    assert len(got) == len(want)
    for row in got:
        assert all(close(a, b) for a, b in zip(tuple(row)[2:], want[row.device, row.us])), (row, want[row.device, row.us])
    assert {r.status for r in got} == {sensors.READY, sensors.NO_HISTORY}


def test_later_readings_change_nothing(spark):
    rows = [r for r in readings(5) if r[1] is not None]
    cut = sorted(r[1] for r in rows)[len(rows) // 2]

    def run(part):
        df = spark.createDataFrame(part, SCHEMA)
        found = sensors.causal_features(df, ["device"], "us", "value", 30 * SECOND, 300 * SECOND)
        return {tuple(r) for r in found.where(F.col("us") <= cut).collect()}

    assert run(rows) == run([r for r in rows if r[1] <= cut])


def test_features_of_no_rows_and_of_constants(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert sensors.causal_features(empty, ["device"], "us", "value", 1, 2).count() == 0
    flat = [("a", i * SECOND, i, 0.1) for i in range(40)]
    found = sensors.causal_features(spark.createDataFrame(flat, SCHEMA), ["device"], "us", "value", 5 * SECOND, 30 * SECOND)
    last = found.orderBy("us").collect()[-1]
    assert (last["mean"], last["std"], last["slope"], last["baseline_std"], last["deviation"]) == (0.1, 0.0, 0.0, 0.0, None)
    with pytest.raises(ValueError):
        sensors.causal_features(empty, ["device"], "us", "value", 2, 2)


def test_running_sums_start_anew_for_each_key(spark):
    rows = [("a", 1, 1), ("a", 5, None), ("a", 5_000, 4), (None, 2, 8), (None, 9_999, 1), ("b", -7, 2)]
    df = spark.createDataFrame(rows, "k string, t long, v long")
    got = running(df, ["k"], "t", ["t"], {"s": F.col("v")}, {"before": F.col("v")}, bucket_us=10).collect()
    assert {(r.k, r.t, r.s, r.before) for r in got} == {
        ("a", 1, 1, None), ("a", 5, 1, 1), ("a", 5_000, 5, 1), (None, 2, 8, None), (None, 9_999, 9, 8), ("b", -7, 2, None),
    }


def findings(rows, cadence, factor, stuck_us, stuck_samples, most):
    out = []
    for device in {r[0] for r in rows}:
        mine = []
        for d, us, seq, v in rows:
            if d == device and us is not None:
                fine = v is not None and math.isfinite(v)
                mine.append((us, seq, v + 0.0 if fine else None))
        low = float("-inf")
        mine.sort(key=lambda r: (r[0], low if r[1] is None else r[1], low if r[2] is None else r[2]))
        for (t0, s0, x0), (t1, s1, x1) in zip(mine, mine[1:]):
            if t1 - t0 > factor * cadence:
                out.append((device, "SAMPLE_GAP", t0, t1, 2, -(-(t1 - t0) // cadence) - 1, (t1 - t0) / 1e6))
            if s0 is not None and s1 is not None and s1 - s0 > 1:
                out.append((device, "SEQUENCE_GAP", t0, t1, 2, s1 - s0 - 1, None))
            if x0 is not None and x1 is not None and t1 > t0 and abs((x1 - x0) * 1e6 / (t1 - t0)) > most:
                out.append((device, "RAPID_CHANGE", t0, t1, 2, None, (x1 - x0) * 1e6 / (t1 - t0)))
        i = 0
        while i < len(mine):
            j = i
            while mine[i][2] is not None and j + 1 < len(mine) and mine[j + 1][2] == mine[i][2]:
                j += 1
            if mine[i][2] is not None and j - i + 1 >= stuck_samples and mine[j][0] - mine[i][0] >= stuck_us:
                out.append((device, "STUCK_VALUE", mine[i][0], mine[j][0], j - i + 1, None, mine[i][2]))
            i = j + 1
    return sorted(out, key=repr)


@pytest.mark.parametrize("bucket", [2 * SECOND, 50 * SECOND, 10**12])
def test_findings_equal_their_definition(spark, bucket):
    rnd = random.Random(bucket)
    rows, us = [], 0
    for i in range(500):
        us += rnd.choice([0, SECOND, SECOND, SECOND, 9 * SECOND])
        value = rnd.choice([None, float("nan"), 1.0, 2.0]) if rnd.random() < 0.15 else float(i // 60 % 2)
        rows.append((rnd.choice(["a", "a", None]), us, i if rnd.random() < 0.9 else None, value))
    rows += [("a", None, 1, 1.0), ("b", 5, 5, 5.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sensors.quality_findings(
        df, ["device"], "us", "seq", "value", 2 * SECOND, 2.0, 5 * SECOND, 3, 0.4, bucket_us=bucket
    )
    got = sorted((tuple(r) for r in got.collect()), key=repr)
    assert got == findings(rows, 2 * SECOND, 2.0, 5 * SECOND, 3, 0.4)
    assert {r[1] for r in got} == {sensors.STUCK, sensors.GAP, sensors.SKIPPED, sensors.JUMP}


def test_a_value_stuck_over_many_buckets_is_one_finding(spark):
    rows = [("hot", i * SECOND, i, 7.0) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    (row,) = sensors.quality_findings(df, ["device"], "us", "seq", "value", SECOND, bucket_us=10 * SECOND).collect()
    assert (row.kind, row.start_us, row.end_us, row.n_samples) == (sensors.STUCK, 0, 2999 * SECOND, 3000)
    none = sensors.quality_findings(df.limit(0), ["device"], "us", "seq", "value", SECOND)
    assert none.count() == 0


def test_rows_of_a_task_are_bounded(spark, monkeypatch):
    """More rows make more tasks, whatever Spark takes their size for, and the same result."""
    rows = readings(5, 300)
    df = spark.createDataFrame(rows, SCHEMA)
    args = (df, ["device"], "us", "value", 600 * SECOND, 3_600 * SECOND)
    few = sensors.causal_features(*args)
    monkeypatch.setattr(sensors, "TASK_ROWS", 30)
    many = sensors.causal_features(*args)
    assert many.rdd.getNumPartitions() >= few.count() * 3 // 30 > few.rdd.getNumPartitions()
    assert sorted(map(str, many.collect())) == sorted(map(str, few.collect()))
