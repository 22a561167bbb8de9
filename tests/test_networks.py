"""Components and travel times against plain algorithms, and their rounds on long ways."""

import heapq
import random

import pytest

from fieldloom.operators import networks
from fieldloom.session import Rounds

EDGE = "src string, dst string, minutes double"


def dijkstra(edges, sources):
    near = {}
    for a, b, c in edges:
        if a is not None and b is not None and c is not None:
            near.setdefault(a, []).append((b, c))
            near.setdefault(b, []).append((a, c))
    best, heap = {}, [(m, n) for n, m in sources]
    heapq.heapify(heap)
    while heap:
        m, n = heapq.heappop(heap)
        if n not in best:
            best[n] = m
            for to, c in near.get(n, []):
                heapq.heappush(heap, (m + c, to))
    return best


def slow_components(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b, *_ in edges:
        if a is not None and b is not None:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {x: top(x) for x in list(up)}


def network(seed):
    rng = random.Random(seed)
    name = lambda k: f"n{k:03d}"
    edges = [(name(rng.randrange(40)), name(rng.randrange(40)), float(rng.randint(0, 9))) for _ in range(45)]
    at = 100
    for _ in range(6):  # ways with nodes between, some back to where they begin
        a, b = name(rng.randrange(40)), name(rng.randrange(40))
        way = [a, *[name(at + k) for k in range(rng.randint(1, 25))], b]
        at += 30
        edges += [(x, y, float(rng.randint(1, 5))) for x, y in zip(way, way[1:])]
    ring = [name(900 + k) for k in range(7)]
    edges += [(x, y, 1.0) for x, y in zip(ring, ring[1:] + ring[:1])]  # a ring that nothing else meets
    edges += [edges[0], (edges[1][1], edges[1][0], 0.5), ("n950", "n950", 1.0), (None, "n001", 1.0), ("n001", None, 1.0), ("n001", "n960", None)]
    return edges, [name(rng.randrange(40)), name(105)], ring


@pytest.mark.parametrize("seed,width", [(1, None), (2, 0.5), (3, 1000.0)])
def test_travel_times(spark, seed, width):
    edges, at, ring = network(seed)
    sources = [(n, float(k)) for k, n in enumerate(at)] + [("alone", 3.0), (at[0], 5.0)] + ([(ring[2], 1.0)] if seed == 2 else [])
    got = networks.travel_times(spark.createDataFrame(edges, EDGE), spark.createDataFrame(sources + [(None, 1.0)], "node string, minutes double"), width)
    got = {r.node: r.minutes for r in got.collect()}
    want = dijkstra([e for e in edges if e[0] != e[1]], sources)
    assert got == pytest.approx(want)


@pytest.mark.parametrize("seed", [1, 4])
def test_components(spark, seed):
    edges, _, _ = network(seed)
    got = {r.node: r.component for r in networks.components(spark.createDataFrame(edges, EDGE)).collect()}
    assert got == slow_components(edges)


def test_empty_networks_and_bad_times(spark):
    none, start = spark.createDataFrame([], EDGE), spark.createDataFrame([("a", 2.0)], "node string, minutes double")
    assert networks.components(none).count() == 0
    assert [tuple(r) for r in networks.travel_times(none, start).collect()] == [("a", 2.0)]
    some = spark.createDataFrame([("a", "b", 1.0)], EDGE)
    assert networks.travel_times(some, start.limit(0)).count() == 0
    with pytest.raises(ValueError):
        networks.travel_times(spark.createDataFrame([("a", "b", -1.0)], EDGE), start)


def test_a_long_way_takes_few_rounds(spark, monkeypatch):
    """A way of 100,000 nodes: pointer jumping takes 17 rounds, and one bucket is left to do."""
    n = 100_000
    way = spark.range(n).selectExpr("id src", "id + 1 dst", "1.0 minutes")
    written = []
    keep = Rounds.keep
    monkeypatch.setattr(Rounds, "keep", lambda self, name, df: (written.append(name), keep(self, name, df))[1])
    got = networks.travel_times(way, spark.createDataFrame([(0, 0.0)], "node long, minutes double"))
    assert got.where("abs(minutes - node) > 1e-6").count() == 0 and got.count() == n + 1
    assert written.count("jumped") <= 18 and written.count("now") <= 4


def test_components_of_a_long_way(spark):
    n = 20_000
    way = spark.range(n).selectExpr("(id * 7919) % 20011 src", "((id + 1) * 7919) % 20011 dst")
    got = networks.components(way, rounds=25)
    assert got.select("component").distinct().count() == 1 and got.count() == n + 1


def test_rounds_keep_one_table_a_name(spark):
    kept = Rounds(spark)
    a = kept.keep("x", spark.range(3))
    b = kept.keep("x", a.selectExpr("id + 1 id"))
    assert [r.id for r in b.orderBy("id").collect()] == [1, 2, 3]
    path = spark._jvm.org.apache.hadoop.fs.Path(kept.root)
    assert len(path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)) == 1
