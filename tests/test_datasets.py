"""Drift, manifests and accounting: edges and plain-loop comparisons."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sentrel.operators import accounting, drift, manifest
from sentrel.operators.accounting import Rule

DAY = 86_400_000_000


def psi_of(base, now, bins=10):
    base, now = sorted(base), sorted(now)
    edges = sorted({base[math.ceil(i * len(base) / bins) - 1] for i in range(1, bins)})

    def shares(x):
        ends = [0.0] + [sum(v <= e for v in x) / len(x) for e in edges] + [1.0]
        return [max(b - a, drift.LEAST_SHARE) for a, b in zip(ends, ends[1:])]

    return sum((q - p) * math.log(q / p) for p, q in zip(shares(base), shares(now)))


@pytest.mark.parametrize("grouped", [True, False])
def test_drift_equals_its_definition(spark, grouped):
    rnd = random.Random(grouped)
    nan, inf = float("nan"), float("inf")
    rows = []
    for i in range(3000):
        day = rnd.randrange(10)
        group = rnd.choice(["hot", "hot", "hot", None]) if grouped else "one"
        x = rnd.choice([None, nan, inf]) if rnd.random() < 0.1 else float(rnd.randint(0, 30) + (day > 6) * 4)
        rows.append((group, day * DAY + i, x, 5.0, None))
    rows.append(("hot", None, 1.0, 1.0, 1.0))
    df = spark.createDataFrame(rows, "g string, us long, `x y` double, same double, never double")
    groups = ["g"] if grouped else []
    names = ["x y", "same", "never"]
    day = F.col("day")
    sketches = drift.daily_sketches(df, "us", names, groups)
    edges = drift.reference_edges(sketches, day < 5, groups)
    counts = drift.daily_histograms(df, "us", edges, names, groups)
    got = drift.drift(counts, day < 5, day >= 5, F.when(day > 6, "late").otherwise("early"), groups).collect()
    assert {r.feature for r in got} == {"x y", "same"}
    for r in got:
        mine = [x for x in rows if x[1] is not None and (not grouped or x[0] == r.g)]
        late = {"late": lambda d: d > 6, "early": lambda d: 5 <= d <= 6}[r.period]
        at = {"x y": 2, "same": 3}[r.feature]
        base = [x[at] for x in mine if x[1] // DAY < 5]
        now = [x[at] for x in mine if late(x[1] // DAY)]
        fine = [[v for v in side if v is not None and math.isfinite(v)] for side in (base, now)]
        assert (r.n_reference, r.n_current) == tuple(map(len, fine))
        assert r.missing_current == len(now) - len(fine[1])
        assert math.isclose(r.psi, psi_of(*fine), rel_tol=1e-9, abs_tol=1e-9)
    moved = {r.period: r.status for r in got if r.feature == "x y"}
    assert moved["late"] != "STABLE" and {r.status for r in got if r.feature == "same"} == {"STABLE"}


def test_sketches_of_days_merge_to_those_of_all(spark):
    df = spark.range(40_000).select((F.col("id") * DAY / 4000).cast("long").alias("us"), F.rand(3).alias("x"))
    sketches = drift.daily_sketches(df, "us", ["x"], k=4096)
    (row,) = drift.reference_edges(sketches, F.lit(True)).collect()
    assert all(abs(e - i / 10) < 0.02 for i, e in enumerate(row.edges, 1))


def test_drift_of_nothing(spark):
    df = spark.createDataFrame([], "us long, x double")
    sketches = drift.daily_sketches(df, "us", ["x"])
    edges = drift.reference_edges(sketches, F.lit(True))
    counts = drift.daily_histograms(df, "us", edges, ["x"])
    assert drift.drift(counts, F.lit(True), F.lit(True), F.lit(0)).count() == 0


def digest(spark, rows, schema="a string, b string"):
    return [tuple(r) for r in manifest.manifest(spark.createDataFrame(rows, schema), ["a", "b"], []).collect()]


def test_digest_depends_on_rows_alone(spark):
    rows = [("x", "1"), ("y", None), (None, None), ("x", "1")] * 5
    one = digest(spark, rows)
    df = spark.createDataFrame(rows[::-1], "a string, b string").repartition(7)
    assert [tuple(r) for r in manifest.manifest(df, ["a", "b"], []).collect()] == one
    assert digest(spark, rows[1:]) != one
    for other in ([("x1", "")], [("x", "")], [("", "x1")], [(None, "x1")], [("x1", None)], [("~", "x")]):
        assert digest(spark, [("x", "1")])[0][1] != digest(spark, other)[0][1]


def test_trees_name_the_leaves_that_changed(spark):
    df = spark.range(3000).select("id", (F.col("id") % 7).alias("v"))
    changed = df.where("id <> 5").withColumn("v", F.when(F.col("id").isin(10, 2000), -1).otherwise(F.col("v")))
    changed = changed.union(spark.createDataFrame([(9999, 1), (9999, 1)], df.schema))
    before, after = (manifest.digest_tree(d, ["id", "v"], ["id"]) for d in (df, changed))
    found = {r.prefix: (r.rows_before, r.rows_after) for r in manifest.differing_leaves(before, after).collect()}
    want = spark.createDataFrame([(i,) for i in (5, 10, 2000, 9999)], "id long")
    prefixes = {r[0] for r in want.select(F.substring(F.sha2(manifest.canonical(["id"]), 256), 1, 3)).collect()}
    assert set(found) == prefixes and sum(b - a for a, b in found.values()) == 1
    assert manifest.differing_leaves(before, before).count() == 0
    assert manifest.differing_leaves(before, after.limit(0)).count() > 0
    roots = {r.level: r.n_rows for r in before.where("level = 0").collect()}
    assert roots == {0: 3000}


def rules():
    return [
        Rule("NULL", 1, "no payload", F.col("payload").isNull()),
        Rule("SHORT", 3, "too short", F.length("payload") < 2),
        Rule("LATER", 1, "to be looked at", F.col("payload").startswith("?"), accounting.UNRESOLVED),
    ]


def test_every_record_has_one_disposition(spark, tmp_path):
    rows = [
        (1, "s", "d1", "good"), (2, "s", "d1", "good"), (3, None, "d1", None), (4, "s", "d1", "x"),
        (5, "s", "d9", "other"), (6, "s", None, "third"), (7, "t", "d1", "?x"), (8, "t", "d9", "good"),
        (9, "t", "d1", "x"),
    ]
    plain = spark.createDataFrame(rows, "id long, source string, device string, payload string")
    known = spark.createDataFrame([("d1",), ("d1",), (None,)], "device string")
    df = accounting.dispose(plain, rules(), "payload", "id", known, "device")
    got = {r.id: (r.disposition, r.rule_id, r.rule_version) for r in df.collect()}
    assert got == {
        1: ("ACCEPTED", None, None), 2: ("DUPLICATE", "DUPLICATE_PAYLOAD", 1), 3: ("REJECTED", "NULL", 1),
        4: ("REJECTED", "SHORT", 3), 5: ("UNRESOLVED", "UNKNOWN_DEVICE", 1), 6: ("UNRESOLVED", "UNKNOWN_DEVICE", 1),
        7: ("UNRESOLVED", "LATER", 1), 8: ("DUPLICATE", "DUPLICATE_PAYLOAD", 1), 9: ("REJECTED", "SHORT", 3),
    }
    sums = {r.source: r for r in accounting.dispositions(df, "source").collect()}
    assert sums["s"].n_input == 5 and sums[None].n_rejected == 1 and sums["t"].n_duplicate == 1
    held = accounting.quarantine(df.withColumn("at", F.lit(1)), "id", "source", "at")
    assert held.count() == 6 and "payload" not in held.columns
    counts = accounting.write_accounted(df, str(tmp_path / "out"), 9)
    assert counts == {"input": 9, "ACCEPTED": 1, "REJECTED": 3, "DUPLICATE": 2, "UNRESOLVED": 3}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 9


def test_a_mismatch_fails_the_import(spark, tmp_path):
    plain = spark.createDataFrame([(1, "p")], "id long, payload string")
    df = accounting.dispose(plain, [], "payload", "id")
    assert df.first().disposition == "ACCEPTED"
    with pytest.raises(accounting.Unreconciled):
        accounting.write_accounted(df, str(tmp_path / "a"), 2)
    lost = df.withColumn("disposition", F.lit("FORGOTTEN"))
    with pytest.raises(accounting.Unreconciled):
        accounting.write_accounted(lost, str(tmp_path / "b"), 1)
    assert accounting.write_accounted(df.limit(0), str(tmp_path / "c"), 0)["input"] == 0
    with pytest.raises(ValueError):
        accounting.dispose(plain, [Rule("R", 1, "r", F.lit(True), "GONE")], "payload", "id")


def test_a_payload_of_most_records_is_one_accepted_record(spark):
    plain = spark.range(5000).select("id", F.when(F.col("id") % 50 > 0, "same").otherwise(F.col("id").cast("string")).alias("payload"))
    (row,) = accounting.dispositions(accounting.dispose(plain, [], "payload", "id").withColumn("s", F.lit(1)), "s").collect()
    assert (row.n_input, row.n_accepted, row.n_duplicate) == (5000, 101, 4899)


def test_alert_rates_count_wrong_alerts_per_device_hour(spark):
    from sentrel.operators.evaluation import alert_rates

    hour = 3_600_000_000
    rows = [
        ("BENIGN", "DOS", "a", 0), ("DOS", "DOS", "a", 1), ("DOS", "BENIGN", "a", hour), (None, "BOT", "b", 0),
        ("BOT", None, None, 5), ("BENIGN", "DOS", "b", None),
    ]
    df = spark.createDataFrame(rows, "actual string, predicted string, device string, us long")
    got = {r["class"]: (r.n_alerts, r.n_false, r.n_missed, r.device_hours) for r in alert_rates(df, "device", "us").collect()}
    assert got == {"DOS": (3, 2, 1, 3), "BOT": (1, 1, 1, 3)}
    assert alert_rates(df.limit(0), "device", "us").count() == 0


def test_files_without_a_feature_are_reported(spark):
    from sentrel.operators.quality import route_files

    rows = [("x", 1, None), ("x", None, None), ("y", 1, 2), (None, None, 3)]
    df = spark.createDataFrame(rows, "file string, a int, b int")
    got = {r.file: (r.n_rows, r.missing, r.usable) for r in route_files(df, ["a", "b"]).collect()}
    assert got == {"x": (2, ["b"], False), "y": (1, [], True), None: (1, ["a"], False)}
    assert all(r.missing[-1] == "gone" for r in route_files(df, ["a", "gone"]).collect())
    assert route_files(df.limit(0), ["a"]).count() == 0
