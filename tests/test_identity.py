"""Devices behind addresses against plain loops."""

import random

import pytest

from sentrel.operators import identity

CLAIM = "address string, device_id string, valid_from_us long, valid_to_us long"


def holds(claim, address, at):
    _, device, start, end = claim
    if claim[0] is None or device is None or address is None or at is None or claim[0] != address:
        return False
    if start is not None and end is not None and start >= end:
        return False
    return (start is None or start <= at) and (end is None or at < end)


def cases(seed):
    rnd = random.Random(seed)
    claims = []
    for _ in range(60):
        a = rnd.choice([None, *range(0, 100, 5)])
        b = rnd.choice([None, *range(0, 100, 5)])
        claims.append((rnd.choice(["hot", "hot", "cold", None]), rnd.choice(["x", "y", "z", None]), a, b))
    claims = [c for c in claims if not (c[2] is None and c[3] is None)] + [claims[0]] * 2
    seen = [(i, rnd.choice(["hot", "cold", "new", None]), rnd.choice([None, *range(-20, 120)])) for i in range(300)]
    return claims, seen


@pytest.mark.parametrize("bucket", [7, 1000])
def test_every_observation_is_resolved_as_claims_hold(spark, bucket):
    claims, seen = cases(bucket)
    claims = claims[:40]
    df = spark.createDataFrame(seen, "n_row int, address string, ts long")
    got = identity.resolve_devices(df, spark.createDataFrame(claims, CLAIM), "address", "ts", bucket).collect()
    assert len(got) == len(seen)
    for row in got:
        held = [c[1] for c in claims if holds(c, row.address, row.ts)]
        kind = ["UNRESOLVED", "RESOLVED"][len(set(held))] if len(set(held)) < 2 else "AMBIGUOUS"
        assert (row.n_claims, row.identity_status) == (len(held), kind)
        assert row.resolved_device == (held[0] if kind == "RESOLVED" else None)
    assert {r.identity_status for r in got} == {"UNRESOLVED", "RESOLVED", "AMBIGUOUS"}


@pytest.mark.parametrize("bucket", [7, 1000])
def test_conflicts_cover_exactly_the_ambiguous_instants(spark, bucket):
    claims, _ = cases(bucket)
    found = identity.conflicting_claims(spark.createDataFrame(claims, CLAIM), bucket).collect()
    for address in ("hot", "cold"):
        for at in range(-30, 130):
            held = [c[1] for c in claims if holds(c, address, at)]
            here = [
                r for r in found
                if r.address == address and (r.from_us is None or r.from_us <= at) and (r.to_us is None or at < r.to_us)
            ]
            assert len(here) == (len(set(held)) > 1)
            assert all(r.n_claims == len(held) for r in here)


def test_no_claims_and_no_observations(spark):
    none = spark.createDataFrame([], CLAIM)
    seen = spark.createDataFrame([("a", 1)], "address string, ts long")
    (row,) = identity.resolve_devices(seen, none, "address", "ts").collect()
    assert (row.n_claims, row.identity_status, row.resolved_device) == (0, "UNRESOLVED", None)
    assert identity.resolve_devices(seen.limit(0), none, "address", "ts").count() == 0
    assert identity.conflicting_claims(none).count() == 0
