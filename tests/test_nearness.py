"""Nearest stored patterns and leakage between splits against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sentrel.operators import leakage, nearest, patterns


@pytest.mark.parametrize("pivots,threshold", [(1, 0.5), (5, 0.5), (24, 0.03), (24, 3.0)])
def test_pairs_within_a_distance_equal_all_pairs(spark, pivots, threshold):
    rnd = random.Random(pivots)
    spots = [[rnd.uniform(-3, 3) for _ in range(3)] for _ in range(4)]

    def rows(n, first):
        out = []
        for i in range(n):
            at = rnd.choice(spots)
            out.append((first + i, [x + rnd.gauss(0, rnd.choice([0, 0.01, 0.4])) for x in at]))
        return out

    asked, stored = rows(90, 0), rows(120, 1000)
    odd = [(-1, None), (-2, [1.0, None, 2.0]), (-3, [float("nan"), 0.0, 0.0]), (-4, [float("inf"), 0.0, 0.0])]
    schema = "id long, v array<double>"
    a, b = spark.createDataFrame(asked + odd, schema), spark.createDataFrame(stored + odd, schema)
    got = {(r.query_id, r.stored_id) for r in nearest.within(a, b, threshold, pivots).collect()}
    want = {(i, j): math.dist(v, w) for i, v in asked for j, w in stored if math.dist(v, w) <= threshold}
    assert got == set(want)
    best = {r.query_id: (r.matched_id, r.n_within) for r in nearest.nearest_within(a, b, threshold, pivots).collect()}
    for i in {i for i, _ in want}:
        mine = sorted((round(d, 12), j) for (q, j), d in want.items() if q == i)
        assert best[i] == (mine[0][1], len(mine))
    assert len(best) == len({i for i, _ in want})


def test_search_in_empty_and_equal_rows(spark):
    schema = "id long, v array<double>"
    some = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0])], schema)
    assert nearest.within(some, some.limit(0), 1.0).count() == 0
    assert nearest.within(some.limit(0), some, 1.0).count() == 0
    assert nearest.nearest_within(some, some.toDF("id", "v"), 1.0).select("matched_id").distinct().collect()[0][0] == 1
    with pytest.raises(ValueError):
        nearest.within(some, some, 0.0)


def signature(spark, rows):
    df = spark.createDataFrame(rows, "cluster int, cluster_size long, a double, b double")
    m = F.map_filter(F.create_map(F.lit("a"), "a", F.lit("b"), "b"), lambda k, v: v.isNotNull())
    return df.select("cluster", "cluster_size", m.alias("behavioral_signature"))


def test_new_signatures_near_one_another_make_one_pattern(spark):
    scales = {"a": (0.0, 1.0), "b": (0.0, 2.0)}
    old = signature(spark, [(0, 5, 0.0, 0.0), (1, 5, 0.0, 0.0)]).select(
        F.concat(F.lit("P-"), F.col("cluster").cast("string")).alias("pattern_id"),
        "cluster_size", "behavioral_signature", F.lit("kept").alias("note"), F.col("cluster").cast("long").alias("store_order"),
    )
    new = signature(
        spark,
        [(0, 5, 9.0, 0.0), (1, 7, 0.5, 0.0), (2, 3, 20.0, 0.0), (3, 3, 20.9, 0.0), (4, 4, 21.7, 0.0), (5, 4, None, 1.0)],
    )
    found = {r.cluster: r for r in patterns.match_by_distance(new, old, scales, 1.0).collect()}
    assert found[1].matched_id == "P-0" and found[1].n_within == 2 and found[1].match_distance == 0.5
    # Of equal size with both stored patterns, yet another behaviour.
    assert found[0].matched_id is None and found[0].n_within == 0
    grown = patterns.extend_store_by_distance(new, old, scales, 1.0).collect()
    made = [r for r in grown if r.status == "NEW"]
    assert len(grown) == 5 and sorted(r.store_order for r in made) == [2, 4, 7]
    assert {r.note for r in grown if r.status is None} == {"kept"}
    assert len({r.pattern_id for r in grown}) == 5


NAN, INF = float("nan"), float("inf")


def close(x, y, t):
    if x is None or y is None:
        return x is None and y is None
    if math.isnan(x) or math.isnan(y):
        return math.isnan(x) and math.isnan(y)
    return x == y or abs(x - y) <= t


@pytest.mark.parametrize("grid", [1, 2, 3])
def test_leakage_equals_all_pairs(spark, grid):
    rnd = random.Random(grid)
    tolerances = {"f 1": 0.5, "b": 0.25, "c": 2.0}

    def rows(n, first):
        out = []
        for i in range(n):
            f = rnd.choice([None, NAN, INF, -INF, 1e300, 0.0, -0.0, *[rnd.uniform(-9, 9)] * 6])
            out.append((first + i, f, rnd.choice([0.0, 0.25, 0.5, 4.0]), float(rnd.randint(-9, 9))))
        return out + out[:10]

    train, held = rows(150, 0), rows(80, 500)
    held += [(900 + i, *r[1:]) for i, r in enumerate(train[:30])]
    schema = "id long, `f 1` double, b double, c double"
    a, b = spark.createDataFrame(train, schema), spark.createDataFrame(held, schema)
    classes = leakage.leakage_classes(a, b, tolerances, "id", grid)
    got = {r.first_id: r for r in classes.collect()}
    t = list(tolerances.values())

    def same(x, y):
        return all(close(p, q, 0.0) for p, q in zip(x[1:], y[1:]))

    def near(x, y):
        return all(close(p, q, w) for p, q, w in zip(x[1:], y[1:], t))

    firsts = {}
    for h in held:
        key = min(g[0] for g in held if same(g, h))
        firsts.setdefault(key, h)
    assert set(got) == set(firsts)
    for first, h in firsts.items():
        r = got[first]
        exact = [x for x in train if same(x, h)]
        others = [x for x in train if near(x, h) and not same(x, h)]
        assert (r.n_held_out, r.n_train, r.n_near_train) == (sum(same(g, h) for g in held), len(exact), len(others))
        assert r.kind == ("EXACT" if exact else "NEAR" if others else "NONE")
    assert {r.kind for r in got.values()} == {"EXACT", "NEAR", "NONE"}
    kinds = {r.id: r.leak_kind for r in leakage.leaked_rows(b, classes, list(tolerances)).collect()}
    assert len(kinds) == len({h[0] for h in held}) and None not in kinds.values()
    assert sum(r.n_rows for r in leakage.leakage_summary(classes).collect()) == len(held)


def test_leakage_of_empty_tables_and_of_one_hot_row(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(500)], "id long, x double")
    none = df.limit(0)
    (row,) = leakage.leakage_classes(df, df, {"x": 0.1}, "id").collect()
    assert (row.n_held_out, row.n_train, row.kind) == (500, 500, "EXACT")
    (row,) = leakage.leakage_classes(none, df, {"x": 0.1}, "id").collect()
    assert row.kind == "NONE"
    assert leakage.leakage_classes(df, none, {"x": 0.1}, "id").count() == 0
    with pytest.raises(ValueError):
        leakage.leakage_classes(df, df, {"x": 0.0}, "id")
