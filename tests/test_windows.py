"""Window search, prefix maxima, positions and quantiles against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrel.operators import incidents as inc
from sentrel.operators.windows import Criterion, first_window_events, first_windows, numbered, prefix_max, quantiles

SECOND = 1_000_000


def make_events(spark, rows):
    """rows: (seq, seconds, src, dst, port, type)"""
    data = [
        (s, f"EVT-{s}", int(t * SECOND), src, dst, None if port is None else str(port), kind)
        for s, t, src, dst, port, kind in rows
    ]
    schema = (
        "seq bigint, event_id string, ts_us bigint, src string, dst string, dst_port string, "
        "type string"
    )
    return spark.createDataFrame(data, schema)


def brute_recon(rows, window=60, ports=5, hosts=3):
    found = {}
    for src in {r[2] for r in rows}:
        mine = sorted((r for r in rows if r[2] == src), key=lambda r: r[1])
        for i, start in enumerate(mine):
            inside = [r for r in mine[i:] if r[1] - start[1] <= window]
            p = {r[4] for r in inside if r[4] is not None}
            d = {r[3] for r in inside}
            if len(inside) >= 3 and (len(p) >= ports or len(d) >= hosts):
                found[src] = (start[1], len(inside), len(p), len(d))
                break
    return found


@pytest.mark.parametrize("seed", range(4))
def test_recon_equals_loop(spark, seed):
    rng = random.Random(seed)
    kinds = ["PORT_SCAN", "DOS", "BENIGN", "UNKNOWN_BEHAVIOR"]
    rows = []
    for s in range(500):
        src = "hot" if rng.random() < 0.33 else f"s{rng.randrange(12)}"
        port = rng.choice([None, *range(7)])
        rows.append(
            (s, rng.randrange(3000) if src == "hot" else rng.randrange(1500), src,
             f"d{rng.choice([0, 0, 0, 1, 1, 2])}", port, rng.choice(kinds))
        )
    kept = [r for r in rows if r[5] in ("PORT_SCAN", "DOS")]
    got = {
        r["source"]: (
            r["first_us"] / SECOND, r["event_count"], r["unique_ports"], r["unique_destinations"],
        )
        for r in inc.recon_incidents(make_events(spark, rows)).collect()
    }
    assert got == brute_recon(kept)


def test_many_values_in_a_slice(spark):
    """More values than are kept of a slice, in bursts around slice borders; ties in time."""
    rng = random.Random(7)
    rows = []
    for k in range(60):
        for _ in range(rng.randrange(1, 5)):
            middle, spread = rng.randrange(60), rng.choice([0, 1, 4, 9])
            rows += [
                (f"k{k}", middle + rng.randint(-spread, spread), rng.choice([None, *map(str, range(30))]))
                for _ in range(rng.randrange(1, 25))
            ]
    want = {}
    for k in {r[0] for r in rows}:
        mine = [(t, v) for key, t, v in rows if key == k]
        for t in sorted({t for t, _ in mine}):
            inside = [v for u, v in mine if t <= u <= t + 10]
            if len({v for v in inside if v is not None}) >= 4:
                want[k] = (t, len(inside))
                break
    df = spark.createDataFrame(rows, "k string, t bigint, v string")
    starts = {r["k"]: r["start_us"] for r in first_windows(df, ["k"], "t", 10, [Criterion("v", 4)]).collect()}
    members = first_window_events(df, ["k"], "t", 10, [Criterion("v", 4)])
    got = {r["k"]: (r["start_us"], r["count"]) for r in members.groupBy("k", "start_us").count().collect()}
    assert got == want and starts == {k: t for k, (t, _) in want.items()}
    assert 5 < len(want) < 60


def brute_chain(rows, window=60, repeats=2, behaviours=2):
    found = {}
    for src in {r[2] for r in rows}:
        mine = sorted((r for r in rows if r[2] == src), key=lambda r: (r[1], r[0]))
        for i, start in enumerate(mine):
            inside = [r for r in mine[i:] if r[1] - start[1] <= window]
            counts = {}
            for r in inside:
                counts[r[5]] = counts.get(r[5], 0) + 1
            good = [k for k, n in counts.items() if n >= repeats]
            if len(good) >= behaviours:
                found[src] = (start[1], good, counts)
                break
    return found


@pytest.mark.parametrize("seed,repeats", [(0, 2), (1, 2), (2, 3), (3, 1)])
def test_chain_equals_loop(spark, seed, repeats):
    rng = random.Random(seed)
    rows = [
        (s, rng.randrange(2500), f"s{min(rng.randrange(12), 8)}", "d", 1,
         rng.choice(["PORT_SCAN", "DOS", "BOT", "UNKNOWN_BEHAVIOR"]))
        for s in range(300)
    ]
    found = inc.chain_incidents(make_events(spark, rows), min_repeats=repeats).collect()
    got = {
        r["source"]: (r["first_us"] / SECOND, r["attack_chain"], r["behavior_counts"])
        for r in found
    }
    assert got == brute_chain(rows, repeats=repeats)


def test_start_may_lack_the_value(spark):
    """A start without a port counts when five ports follow."""
    rows = [(0, 50, "a", "d", None, "DOS")]
    rows += [(i, 100 + i, "a", "d", i, "DOS") for i in range(1, 6)]
    found = inc.recon_incidents(make_events(spark, rows)).collect()
    assert [(r["first_us"], r["event_count"]) for r in found] == [(50 * SECOND, 6)]


def test_boundary_is_inclusive(spark):
    rows = [(i, t, "a", f"d{i}", 1, "DOS") for i, t in enumerate((0, 30, 60))]
    assert inc.recon_incidents(make_events(spark, rows)).count() == 1
    rows[2] = (2, 60.001, "a", "d2", 1, "DOS")
    assert inc.recon_incidents(make_events(spark, rows)).count() == 0


def test_port_scan_case(spark):
    ports = [21, 22, 23, 25, 80, 443, 8080]
    rows = [(i, i, "a.b.c", "d", p, "PORT_SCAN") for i, p in enumerate(ports)]
    (r,) = inc.recon_incidents(make_events(spark, rows)).collect()
    assert (r["incident_id"], r["event_count"], r["unique_ports"]) == ("INC-RECON-a-b-c", 7, 7)
    assert (r["unique_destinations"], r["severity"]) == (1, "HIGH")
    four = [(i, i, "a", f"d{i % 2}", p, "DOS") for i, p in enumerate(ports[:4])]
    assert inc.recon_incidents(make_events(spark, four)).count() == 0


def test_stages_days_apart(spark):
    kinds = ["PORT_SCAN", "PORT_SCAN", "BRUTE_FORCE", "BRUTE_FORCE"]
    rows = [(i, i * 86_400, "a", "d", 1, k) for i, k in enumerate(kinds)]
    events = make_events(spark, rows)
    (r,) = inc.history_incidents(events).collect()
    assert (r["severity"], r["behaviors"]) == ("HIGH", ["BRUTE_FORCE", "PORT_SCAN"])
    assert inc.chain_incidents(events).count() == 0


def test_missing_values(spark):
    rows = [(i, i, "a", f"d{i}", 1, None) for i in range(3)]
    rows += [(9, 1, None, "d", 1, "DOS"), (10, 1, "UNKNOWN", "d", 1, "DOS")]
    found = inc.recon_incidents(make_events(spark, rows)).collect()
    assert [r["source"] for r in found] == ["a"]


def test_dedup_keeps_last(spark):
    data = [
        ("UNKNOWN_BEHAVIOR", "a", "P-1", 1, "first"),
        ("UNKNOWN_BEHAVIOR", "a", "P-1", 2, "last"),
        ("UNKNOWN_BEHAVIOR", "b", "P-1", 3, "other"),
    ]
    df = spark.createDataFrame(
        data, "type string, source string, pattern_id string, emit_seq bigint, status string"
    )
    got = inc.deduplicate(inc.combine(df)).orderBy("source").collect()
    assert [(r["source"], r["status"], r["position"]["emit_seq"]) for r in got] == [
        ("a", "last", 1), ("b", "other", 3),
    ]


def test_repeats_need_a_vocabulary(spark):
    df = spark.createDataFrame([("a", 1, "x")], "k string, t bigint, v string")
    with pytest.raises(ValueError):
        first_windows(df, ["k"], "t", 10, [Criterion("v", 2, 2)])


def test_prefix_max_equals_loop(spark):
    rng = random.Random(1)
    rows = [(f"k{min(rng.randrange(6), 3)}", rng.randrange(400), i, rng.randrange(100)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t bigint, id bigint, v bigint")
    got = {r["id"]: r["m"] for r in prefix_max(df, ["k"], "t", ["t", "id"], "v", "m", 50).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        best = None
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            want[r[2]] = best
            best = r[3] if best is None else max(best, r[3])
    assert got == want


def test_numbered(spark):
    df = spark.range(95).select((F.col("id") % 2).alias("k"), "id")
    got = numbered(df, ["k"], F.floor(F.col("id") / 10), ["id"], "pos", "n").collect()
    assert all(r["pos"] == r["id"] // 2 + 1 and r["n"] == (48 if r["k"] == 0 else 47) for r in got)


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(0)
    data = [("a", float(v)) for v in rng.normal(size=777)]
    data += [("b", float(v)) for v in rng.integers(0, 4, 500)] + [("c", 5.0), ("c", None)]
    df = spark.createDataFrame(data, "k string, v double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = {(r["k"], r["p"]): r["q"] for r in quantiles(df, ["k"], "v", probs, cuts=20).collect()}
    for k in "abc":
        v = [x for key, x in data if key == k and x is not None]
        for p in probs:
            assert got[k, p] == pytest.approx(np.quantile(v, p))
