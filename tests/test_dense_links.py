"""Many pairs of cells, and many links between few nodes."""

import numpy as np
import pytest

from sentrel.operators import clusters


@pytest.mark.parametrize("offset", [0.0, 1e8])
def test_near_cells_by_number(spark, offset):
    """Cells may be numbers; far from the origin no pair on the edge of reach is lost or won."""
    rng = np.random.default_rng(2)
    # Whole numbers, so that distances of exactly the reach occur and are exact.
    lo = rng.integers(-3, 4, (70, 6)).astype(float) + offset
    hi = lo + rng.integers(0, 2, (70, 6)) * (np.arange(70) % 2)[:, None]
    rows = [(i, 1, lo[i].tolist(), hi[i].tolist(), "g") for i in range(70)]
    left = spark.createDataFrame(rows, "cell bigint, cw bigint, lo array<double>, hi array<double>, g string")
    found = clusters._near_cells(left, left.toDF("cell2", "cw2", "lo2", "hi2", "g"), 25.0)
    assert dict(found.dtypes)["cell"] == dict(found.dtypes)["cell2"] == "bigint"
    want = {}
    for i in range(70):
        for j in range(i + 1, 70):
            gap = (np.maximum(np.maximum(lo[i] - hi[j], lo[j] - hi[i]), 0) ** 2).sum()
            if gap <= 25:
                want[i, j] = bool((np.maximum(hi[i] - lo[j], hi[j] - lo[i]) ** 2).sum() <= 25)
    assert {(r["cell"], r["cell2"]): r["sure"] for r in found.collect()} == want
    assert set(want.values()) == {True, False} and any(
        (np.maximum(np.maximum(lo[i] - hi[j], lo[j] - hi[i]), 0) ** 2).sum() == 25 for i, j in want
    )


def test_links_are_thinned_before_they_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(clusters, "LINKS", 300)
    rng = np.random.default_rng(6)
    # Two groups with thousands of links, a pair, and a node with a link to itself.
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 40, (3000, 2))]
    edges += [(int(a), int(b)) for a, b in rng.integers(100, 140, (3000, 2))] + [(7000, 900), (5, None), (3, 3)]
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(3)
    left = clusters._thinned(df.where("a <> b"))
    assert left.count() <= 3 * 82
    got = {r["id"]: r["root"] for r in clusters.components(df).collect()}
    want = {i: 0 for i in range(1, 40)} | {i: 100 for i in range(101, 140)} | {7000: 900}
    assert got == want
    named = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "a string, b string")
    assert {r["id"]: r["root"] for r in clusters.components(named).collect()} == {"b": "a", "c": "a", "y": "x"}


def test_spanning():
    a, b = clusters._spanning(np.array([5, 9, 2, 8, 7]), np.array([9, 2, 5, 7, 8]))
    assert dict(zip(a.tolist(), b.tolist())) == {5: 2, 9: 2, 8: 7}
