"""Orders over ranges, transfers, headers, weights and natural breaks on planted and random cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fieldloom import sources, streaming
from fieldloom.functions import geo
from fieldloom.operators import classify, fieldwork, ordering, quality, transfer
from fieldloom.sources.synthetic import submissions

RING = "array<struct<x:double,y:double>>"


def test_numbers_and_fills_over_ranges(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([None, None, "a", "b", "c"]), rng.random()) for k in range(500)]
    df = spark.createDataFrame(rows, "k int, v string, x double").repartition(7)
    want, last = {}, None
    for k, v, _ in rows:
        last = v or last
        want[k] = last
    assert {r.k: r.v for r in ordering.filled_forward(df, ["k"], ["v"]).collect()} == want
    ranks = {r.k: r.n for r in ordering.numbered(df, [F.desc("x"), "k"], "n").collect()}
    assert [ranks[k] for k, _, _ in sorted(rows, key=lambda t: (-t[2], t[0]))] == list(range(1, 501))
    assert ordering.numbered(df.limit(0), ["k"], "n").count() == 0
    assert sorted(r.k for r in ordering.first_per_key(df.where("v is not null"), ["v"], ["k"]).collect()) == sorted(min(k for k, v, _ in rows if v == c) for c in "abc")


def plain_breaks(values, k=3):
    values = sorted(values)
    if len(values) < k:
        return []
    centres = [values[0] + (values[-1] - values[0]) * i / (k - 1) for i in range(k)]
    for _ in range(100):
        groups = [[] for _ in range(k)]
        for v in values:
            groups[min(range(k), key=lambda i: abs(v - centres[i]))].append(v)
        after = [sum(g) / len(g) if g else c for g, c in zip(groups, centres)]
        if after == centres:
            break
        centres = after
    full = [g for g in groups if g]
    return [values[len(values) // 3], values[len(values) * 2 // 3]] if len(full) < k else [max(g) for g in full[:2]]


@pytest.mark.parametrize("values", [[1.0, 2.0], [5.0] * 3, [1.0, 1.0, 1.0, 9.0], [1.0, 2.0, 9.0], [1.0, 2.0, 3.0, 50.0, 51.0, 99.0, 100.0, 100.0], []])
def test_natural_breaks(spark, values):
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    got = [r["break"] for r in classify.natural_breaks(df, "v").orderBy("class").collect()]
    assert got[:2] == plain_breaks(values)


def test_snapping_equals_all_pairs(spark):
    rng = random.Random(9)
    zones = [(f"z{k}", [(x, y), (x + rng.random() * 5, y), (x + 2, y + rng.random() * 5 + 0.1)]) for k, (x, y) in enumerate((rng.random() * 40, rng.random() * 40) for _ in range(6))]
    points = [(k, rng.random() * 300 - 100, rng.random() * 300 - 100) for k in range(40)]

    def apart(px, py, ring):
        best = math.inf
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            d = (bx - ax) ** 2 + (by - ay) ** 2
            t = max(0.0, min(1.0, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / d)) if d else 0.0
            best = min(best, math.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay)))
        return best

    got = transfer.snapped(spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame(zones, f"zone string, ring {RING}"), 4.0).collect()
    assert {r.id: (r.zone, round(r.distance, 9)) for r in got} == {k: (min((apart(x, y, ring), z) for z, ring in zones)[1], round(min(apart(x, y, ring) for _, ring in zones), 9)) for k, x, y in points}
    assert transfer.snapped(spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame([], f"zone string, ring {RING}"), 4.0).count() == 0


def test_sheets(spark):
    rows = [
        ("old", 0, {"c0": "Superseded 2019", "c1": None}), ("old", 1, {"c0": "a", "c1": "b", "c2": "c", "c3": "d"}),
        ("new", 0, {"c0": "Title"}), ("new", 1, {"c0": "State", "c1": " L.G.A ", "c2": "Remarks!", "c3": None}), ("new", 2, {"c0": "X", "c1": "Y", "c2": "Z", "c3": "W"}),
    ]
    cells = spark.createDataFrame(rows, "sheet string, row_no long, cells map<string,string>")
    assert transfer.authority_sheet(cells).first().sheet == "new"
    heads = transfer.header_row(cells, ["state", "l.g.a", "district"])
    assert [tuple(r) for r in heads.collect()] == [("new", 1, 2)]
    got = {(r.name, r.value) for r in transfer.named_cells(cells, heads, {"state": "state_name", "l.g.a": "lga_name"}).collect()}
    assert got == {("state_name", "X"), ("lga_name", "Y"), ("remarks", "Z"), ("unnamed_3", "W")}


def test_joins_that_refuse_repeats(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(1, "p")], "k int, v string")
    assert {tuple(r) for r in transfer.one_to_one(a, b, "k").collect()} == {(1, "x", "p"), (2, "y", None)}
    with pytest.raises(ValueError, match="repeat on the right"):
        transfer.one_to_one(a, b.unionByName(b), "k")
    kept, entries = transfer.overridden(spark.createDataFrame([(1, "A", "B"), (2, "A", "A"), (3, "A", None)], "id int, ward string, found string"), "ward", "found", "id")
    assert [r.ward for r in kept.orderBy("id").collect()] == ["B", "A", "A"] and [r.entity_id for r in entries.collect()] == ["1"]
    totals = transfer.control_totals([("rows", a.agg(F.count("*")), b.agg(F.count("*"))), ("ones", a.agg(F.min("k")), b.agg(F.min("k")))])
    assert {r.check: r.verdict for r in totals.collect()} == {"rows": "FAIL", "ones": "PASS"}


def test_weights_and_sets(spark):
    homes = spark.createDataFrame([("s", c, "u", 2.0, c != 3 and k < 2, k == 2, k == 3) for c in (1, 2, 3) for k in range(4)], "h string, cluster int, settlement string, w double, completed boolean, ineligible boolean, no_contact boolean")
    got = fieldwork.alternative_weights(homes).where("completed").first()
    assert (got.w_cluster, got.w_cell, got.w_vacant, got.w_no_contact) == (3.0, 2.0 * 9 / 4, 4.0, 2.0)
    assert fieldwork.alternative_weights(homes).where("cluster = 3 and w_cluster is not null").count() == 0
    kids = spark.createDataFrame([(1,), (2,)], "household int")
    one = spark.createDataFrame([(1, 5.0)], "household int, w double")
    assert fieldwork.inherited(kids.limit(1), one, ["w"]).first().w == 5.0
    with pytest.raises(Exception, match="child without a household weight: household 2"):
        fieldwork.inherited(kids, one, ["w"]).collect()
    rows = spark.createDataFrame([("s", 1, "p", 1.0), ("s", 2, "q", 1.0), ("s", 2, "p", 1.0), ("s", 3, "q", 1.0)], "h string, i int, who string, w double")
    sets = fieldwork.analysis_sets(rows, spark.createDataFrame([("p",)], "who string"), 3, ["w"])
    assert sorted((r.analysis_set, r.i, r.w) for r in sets.collect()) == [("A", 1, 1.0), ("A", 2, 1.0), ("A", 2, 1.0), ("A", 3, 1.0), ("B", 3, 3.0)]


def test_the_planted_fabricator_alone_is_found(spark):
    made = submissions(spark, enumerators=50, days=4)
    for day, most in (("2026-06-01", 8), ("2026-06-04", 32)):
        rows = quality.daily_screen(made, day).where("verdict = 'INVESTIGATE'").collect()
        assert [(r.who, r.n) for r in rows] == [("ENU042", most)]
    assert made.count() == submissions(spark, enumerators=50, days=4).intersect(made).count()


def test_export_and_layers(spark):
    rows = spark.createDataFrame([(1, "1", "x"), (2, "2", "y"), (3, None, "z")], "id int, consent string, name string")
    assert [tuple(r) for r in quality.exportable(rows, "consent", ["id"]).collect()] == [(1,)]
    checks = quality.layer_checks(rows.select("id"), spark.createDataFrame([(1, 1), (1, 2), (9, 2)], "id int, rank int"), "id", "rank")
    assert {r.check: r.n_affected for r in checks.collect()} == {"layer_keys_repeat": 0, "metric_keys_repeat": 1, "layer_unmatched": 2, "metrics_unmatched": 1, "ranks_repeat": 1, "rows_lost_or_gained": 1}
    rules = quality.Catalogue([quality.Constraint("pk_up", "up", "primary_key", ("id",)), quality.Constraint("fk", "down", "foreign_key", ("id",), parent="up", parent_columns=("id",))])
    ddl = quality.schema_ddl({"down": rows, "up": rows.select("id")}, rules, {"down": ("name", "Point", 4326)})
    assert ddl.index("CREATE TABLE up") < ddl.index("CREATE TABLE down") and "name geometry(Point, 4326)" in ddl and "REFERENCES up (id)" in ddl and "USING GIST (name)" in ddl
    rows.createOrReplaceTempView("known_here")
    assert sources.catalogue_tables(spark).where("name = 'known_here' and temporary").count() == 1


def test_rings_that_cross_themselves(spark):
    rings = [[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)], [(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0)], [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0), (0.0, 1.0)]]
    df = spark.createDataFrame([(k, g) for k, g in enumerate(rings)], f"k int, ring {RING}")
    assert [r.c for r in df.select("k", geo.crosses_itself(F.col("ring")).alias("c")).orderBy("k").collect()] == [False, True, False]


def test_streamed_overlaps_equal_the_batch(spark, tmp_path):
    made = submissions(spark, enumerators=45, days=2).select("who", "start", "end", "id")
    made.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(made.schema).parquet(str(tmp_path / "in"))
    streaming.overlaps(stream, 2).writeStream.format("memory").queryName("close").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {(r.who, r.id) for r in spark.table("close").collect()}
    assert got == {(r.who, r.id) for r in quality.overlaps(made, 2).collect()} and {w for w, _ in got} == {"ENU042"}
