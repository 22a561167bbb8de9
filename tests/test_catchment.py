"""Sums within a radius by cells, against all pairs."""

import random

import pytest

from fieldloom.operators import spatial
from fieldloom.plans.queries import QUERIES


@pytest.mark.parametrize("n,m,radius", [(400, 90, 25.0), (90, 400, 25.0), (150, 150, 1000.0)])
def test_sums_equal_all_pairs(spark, n, m, radius):
    """Whole coordinates, so that many pairs are just as far apart as the radius; some share a place, some have no value."""
    rng = random.Random(n)
    at = lambda: (float(rng.randint(-60, 60)), float(rng.randint(-40, 90)))
    left = [(i, *at()) for i in range(n)] + [(n, 5000.0, 0.0), (n + 1, None, 1.0)]
    right = [(j, *at(), None if j % 17 == 0 else float(rng.randint(-5, 50))) for j in range(m)]
    got = {r.i: r.total for r in spatial.sums_within(spark.createDataFrame(left, "i long, x double, y double"), spark.createDataFrame(right, "j long, x double, y double, v double"), radius).collect()}
    want = {}
    for i, x, y in left:
        near = [v for _, a, b, v in right if x is not None and (x - a) ** 2 + (y - b) ** 2 <= radius * radius]
        if near:
            known = [v for v in near if v is not None]
            want[i] = sum(known) if known else None
    assert got == want


def test_query_makes_no_pairs(spark, monkeypatch):
    sf_dir = "/root/testdata/sf0.001"
    demand, supply = QUERIES["two_step_fca"].__globals__["_sites"](spark, sf_dir)
    pairs = spatial.two_step_catchment(spatial.within_distance(demand, supply, 120.0), demand, supply).collect()
    monkeypatch.setattr(spatial, "within_distance", lambda *_: pytest.fail("all pairs within the radius are made"))
    got = {r.zone: r.access for r in QUERIES["two_step_fca"](spark, sf_dir).collect()}
    assert got == {r.zone: pytest.approx(r.access, abs=2e-6) for r in pairs}
