"""Neighbours by leaves against all pairs; dense cells, ties, rows without a place."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import spatial

POINTS = "j long, x double, y double"


def brute(left, right, k, limit=None):
    out = {}
    for i, x, y in left:
        d = sorted(((x - a) * (x - a) + (y - b) * (y - b), j) for j, a, b in right)
        out[i] = [(j, v) for v, j in d if limit is None or v <= limit * limit][:k]
    return out


def rows(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.i, r.rank)):
        out.setdefault(r.i, []).append((r.j, r.dist2))
    return out


def frames(spark, left, right):
    return spark.createDataFrame(left, POINTS.replace("j", "i")), spark.createDataFrame(right, POINTS)


@pytest.mark.parametrize("full,k", [(30, 11), (512, 1), (4096, 3)])
def test_equal_to_all_pairs(spark, monkeypatch, full, k):
    """Clusters, lone points, repeated places and a grid with ties, whatever a first cell may hold."""
    monkeypatch.setattr(spatial, "CELL_POINTS", full)
    monkeypatch.setattr(spatial, "LEAF_POINTS", full // 8)
    rng = random.Random(k)
    spots = [(rng.gauss(0, 0.01), rng.gauss(0, 0.01)) for _ in range(60)] + [(float(a % 5), float(a // 5)) for a in range(25)] + [(3.0, 3.0)] * 9 + [(-17.5, 12.0), (20.0, -9.0)]
    right = [(n, x, y) for n, (x, y) in enumerate(spots)]
    rng.shuffle(right)
    left = [(n, rng.choice([rng.uniform(-5, 8), rng.gauss(0, 0.02)]), rng.uniform(-5, 8)) for n in range(60)] + [(90 + n, x, y) for n, (x, y) in enumerate(spots[50:90])] + [(500, -30.0, 14.0)]
    p, q = frames(spark, left, right)
    assert rows(spatial.nearest(p, q, k, 0.7)) == brute(left, right, k)
    want = {i: v for i, v in brute(left, right, k, 4.0).items() if v}
    assert rows(spatial.connectors(p, q, k, 4.0, 0.5)) == want


def test_odd_rows(spark):
    """No place, no neighbours; fewer than k points give all of them; none give none."""
    nan, inf = float("nan"), float("inf")
    p, q = frames(spark, [(1, 0.0, 0.0), (2, None, 0.0), (3, nan, 1.0), (4, 1.0, inf)], [(1, None, 1.0), (2, 5.0, 5.0), (3, nan, nan), (4, 5.0, 5.0)])
    assert rows(spatial.nearest(p, q, 3, 1.0)) == {1: [(2, 50.0), (4, 50.0)]}
    assert spatial.nearest(p, q.limit(0), 3, 1.0).count() == 0 == spatial.nearest(p.limit(0), q, 3, 1.0).count()
    assert spatial.nearest(p, q.where("j in (1, 3)"), 2, 1.0).columns == ["i", "j", "dist2", "rank"]


def test_a_dense_cell(spark):
    """100,000 points in one cell of the caller's radius, a third of them at one place: pairs by k and leaf, not by cell."""
    n = 100_000
    df = spark.range(n).select(F.col("id").alias("j"), F.when(F.col("id") % 3 == 0, 0.25).otherwise(F.rand(5)).alias("x"), F.when(F.col("id") % 3 == 0, 0.25).otherwise(F.rand(6)).alias("y"))
    df = spark.createDataFrame(df.toPandas())
    began = time.time()
    got = spatial.nearest(df.withColumnRenamed("j", "i"), df, 4, 1.0).persist()
    assert got.count() == 4 * n and time.time() - began < 120
    pdf = df.toPandas()
    x, y, j = pdf.x.to_numpy(), pdf.y.to_numpy(), pdf.j.to_numpy()
    some = {int(i) for i in range(1, n, 9973)}
    near = rows(got.where(F.col("i").isin(list(some))))
    for i in some:
        d = (x[i] - x) ** 2 + (y[i] - y) ** 2
        best = np.lexsort((j, d))[:4]
        assert near[i] == [(int(j[b]), float(d[b])) for b in best]
    got.unpersist()
