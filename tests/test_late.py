"""Versions of incidents with late evidence, and correlated findings, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from sentrel.operators import lateness
from sentrel.streaming import late

SCHEMA = "src string, us long, batch long, note string"
WINDOW, LATENESS, LEAST = 100, 30, 2


def arrivals(seed, n=250, batches=9):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        b = rnd.randrange(batches)
        us = b * 60 + rnd.choice([rnd.randint(-50, 60), rnd.randint(-400, 60), 0])
        rows.append((rnd.choice(["a", "a", "b", None]), None if rnd.random() < 0.03 else us, b, str(i)))
    return rows


def versions_of(rows):
    """(key, window, version) rows and late counts, batch by batch."""
    latest, out, held, count, n_late = None, [], {}, {}, {}
    for b in sorted({r[2] for r in rows}):
        mine = [r for r in rows if r[2] == b and r[1] is not None]
        before = None if latest is None else latest - LATENESS
        changed = {}
        for src, us, _, _ in mine:
            w = us // WINDOW * WINDOW
            is_late = before is not None and w + WINDOW <= before
            n_late[b] = n_late.get(b, 0) + is_late
            held.setdefault((src, w), []).append((us, is_late))
            if is_late:
                changed[src, w] = changed.get((src, w), 0) + 1
        latest = max([r[1] for r in mine] + ([] if latest is None else [latest]), default=None)
        after = None if latest is None else latest - LATENESS
        for (src, w), events in held.items():
            closes = after is not None and w + WINDOW <= after and (before is None or w + WINDOW > before)
            added = len(events) if closes else changed.get((src, w), 0)
            if added and len(events) >= LEAST:
                v = count[src, w] = count.get((src, w), 0) + 1
                late_ones = sum(x for _, x in events)
                status = "AMENDED" if v > 1 else "OPENED_LATE" if late_ones else "FINAL"
                times = [us for us, _ in events]
                out.append((src, w, v, b, status, len(events), late_ones, added, min(times), max(times)))
    return sorted(out, key=repr), n_late


@pytest.mark.parametrize("seed", [1, 2])
def test_versions_equal_their_definition(spark, seed):
    rows = arrivals(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    got = lateness.incident_versions(df, ["src"], "us", "batch", WINDOW, LATENESS, LEAST).collect()
    want, n_late = versions_of(rows)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert {r[4] for r in want} >= {"FINAL", "AMENDED"}
    counts = {r.batch_id: r for r in lateness.lateness_counts(df, "us", "batch", WINDOW, LATENESS).collect()}
    for b, r in counts.items():
        mine = [x for x in rows if x[2] == b]
        assert (r.n_events, r.n_late) == (len(mine), n_late[b])
        assert r.n_undated == sum(x[1] is None for x in mine)
    assert sum(r.n_events for r in counts.values()) == len(rows)


def test_no_events(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert lateness.incident_versions(df, ["src"], "us", "batch", WINDOW, LATENESS, LEAST).count() == 0
    assert lateness.lateness_counts(df, "us", "batch", WINDOW, LATENESS).count() == 0


def test_stream_makes_the_same_versions_and_keeps_late_rows(spark, tmp_path):
    rows = arrivals(3, 90, 5)
    source = str(tmp_path / "in")
    for b in range(5):
        part = spark.createDataFrame([r for r in rows if r[2] == b], SCHEMA)
        part.coalesce(1).write.mode("append").parquet(source)

    def run(checkpoint):
        events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        writer = late.version_incidents(events, str(tmp_path / "out"), ["src"], "us", WINDOW, LATENESS, LEAST)
        writer.option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination()
        return {t: spark.read.parquet(str(tmp_path / "out" / t)) for t in ("versions", "late", "progress")}

    tables = run("one")
    want, n_late = versions_of(rows)
    names = ["src", "window_us", "version", "batch_id", "status", "n_events", "n_late", "n_added", "first_us", "last_us"]
    assert sorted((tuple(r) for r in tables["versions"].select(*names).collect()), key=repr) == want
    assert {r.note for r in tables["late"].collect()} <= {r[3] for r in rows}
    assert tables["late"].count() == sum(n_late.values())
    assert tables["progress"].agg(F.sum("n_events")).first()[0] == len(rows)
    # Run again from the start, as after a lost checkpoint: the folders hold the same rows, once.
    again = run("two")
    assert sorted((tuple(r) for r in again["versions"].select(*names).collect()), key=repr) == want
    assert again["late"].count() == sum(n_late.values())


def test_findings_near_one_another(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice(["hot", "hot", "x", None]), i, rnd.choice([None, *range(-40, 400)])) for i in range(300)]
    df = spark.createDataFrame(rows, "device string, finding_id long, s long")
    df = df.withColumn("ts", F.timestamp_seconds("s"))
    sensor, network = df.where("finding_id % 2 = 0"), df.where("finding_id % 2 = 1")
    pairs = lateness.nearby_findings(sensor, network, "device", 7)
    got = sorted((r.sensor_id, r.network_id) for r in pairs.collect())
    want = sorted(
        (a[1], b[1])
        for a in rows
        for b in rows
        if a[1] % 2 == 0 and b[1] % 2 and a[0] == b[0] is not None and None not in (a[2], b[2]) and abs(a[2] - b[2]) <= 7
    )
    assert got == want and len(want) > 20
    for r in lateness.correlated_incidents(pairs, "device").collect():
        assert r.n_network == sum(s == r.sensor_id for s, _ in want)
    assert lateness.nearby_findings(sensor.limit(0), network, "device", 7).count() == 0


def test_marked_pairs_count_distinct_ids(spark):
    """Findings that come twice, at one time or several, and without ids; the pairs are never shuffled."""
    rnd = random.Random(3)
    ids = [None, 1, 1, 2, 3, 4, 5, 6]
    rows = [
        (rnd.choice(["a", "b", None]), rnd.choice(ids), rnd.choice([None, *range(40)]), rnd.random() < 0.4) for _ in range(250)
    ]
    df = spark.createDataFrame(rows + rows[:40], "device string, finding_id long, s long, sensor boolean")
    df = df.withColumn("ts", F.timestamp_seconds("s"))
    sensor, network = df.where("sensor"), df.where("not sensor")
    marked = lateness.nearby_findings(sensor, network, "device", 4, mark_first=True)
    plain = lateness.nearby_findings(sensor, network, "device", 4)
    assert sorted(map(str, marked.drop("first").collect())) == sorted(map(str, plain.collect()))
    found = lateness.correlated_incidents(marked, "device")
    assert sorted(map(str, found.collect())) == sorted(map(str, lateness.correlated_incidents(plain, "device").collect()))
    # Two rows of one finding, two slices: a pair's network id is in no shuffle after the join.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "distinct" not in plan.split("Join")[0]
