"""Every registered query against DuckDB; those without SQL must run and return rows."""

import os

import pytest
from oracle import compare

from sentrel.plans.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
MAY_BE_EMPTY = {"cluster_signatures", "pattern_store", "pattern_match", "pattern_events"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    _, count, verdict = compare(spark, name, QUERIES[name], ORACLES.get(name), SF_DIR)
    assert verdict in ("ok", "rows only"), verdict
    if name not in ORACLES and name not in MAY_BE_EMPTY:
        assert count > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 8
