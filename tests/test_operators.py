"""Operators against slower independent forms and planted cases."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldloom import sources, streaming
from fieldloom.functions import geo, numeric, text
from fieldloom.operators import quality, reconcile, spatial, survey


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_names(spark):
    raw = ["Ngenuta-Central Local Govt Area", " NGENUTA  CENTRAL ", "LGA.State", "X Local Govt Area LGA", None, "Adelaja-North.", "Agbkotu south L.G.A", "Statehouse"]
    assert column(spark, raw, text.match_key) == ["NGENUTACENTRAL", "NGENUTACENTRAL", "LGA", "X", "", "ADELAJANORTH", "AGBKOTUSOUTH", "STATEHOUSE"]
    assert column(spark, ["agbkotu-SOUTH  ward", None], text.title_case_admin) == ["Agbkotu-South Ward", ""]
    assert column(spark, ["A (b) C!", "no. 12 of 345 x9"], text.slug)[0] == "a_b_c"
    assert column(spark, ["no. 12 of 345 x9", "none"], text.last_number) == [345, None]
    assert column(spark, ["ﬁeld x"], lambda c: text.clean_text(c, True)) == ["field x"]


def test_coordinates(spark):
    raw = ["7.908017", "9,066455", "9°38'33.6\"E", "10d15m30sW", "9,066", "1,2,3", "n/a", "", None, "abc", "-8.5", "7. 5"]
    got = [(r.method, None if r.value is None else round(r.value, 6)) for r in column(spark, raw, numeric.parse_coordinate)]
    assert got == [
        ("decimal", 7.908017), ("comma_decimal", 9.066455), ("dms", round(9 + 38 / 60 + 33.6 / 3600, 6)), ("dms", round(-(10 + 15 / 60 + 30 / 3600), 6)), ("unparseable", None),
        ("unparseable", None), ("missing", None), ("missing", None), ("missing", None), ("unparseable", None), ("decimal", 8.5), ("decimal", 7.5),  # marks at the ends go first, a minus too
    ]
    pairs = [(7.0, 9.0), (12.1, 9.0), (-7.0, 9.0), (70.0, 9.0), (None, 9.0), (99.0, 999.0), (12.15, -6.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, lon double, lat double")
    got = [r.s.status for r in df.select("i", numeric.repair_pair(F.col("lon"), F.col("lat")).alias("s")).orderBy("i").collect()]
    assert got == ["accepted", "repaired_axis_swap", "repaired_sign", "repaired_scale", "no_geometry", "quarantined_out_of_area", "repaired_swap_and_sign"]


def digit(serial):
    rest = sum(int(c) * w for c, w in zip(serial, (7, 6, 5, 4, 3, 2))) % 11
    return "X" if rest == 10 else str(rest)


def test_check_digits(spark):
    rng = random.Random(3)
    serials = [f"{rng.randrange(10**6):06d}" for _ in range(400)] + ["480123", "12345", "abcdef", None]
    got = column(spark, serials, numeric.check_digit)
    assert got == [digit(s) if s and len(s) == 6 and s.isdigit() else None for s in serials]
    assert column(spark, ["bsn 480123-4", "BSN480123", "X-480123-X"], numeric.parse_label)[0] == ("BSN", "480123", "4")


@given(st.integers(0, 999_999), st.integers(0, 4))
@settings(max_examples=200, deadline=None)
def test_transposed_digits_change_the_check(serial, at):
    s = f"{serial:06d}"
    t = s[:at] + s[at + 1] + s[at] + s[at + 2 :]
    assert s == t or digit(s) != digit(t)


def test_quantiles():
    for df, want in ((1, 12.7062), (10, 2.22814), (30, 2.04227), (78, 1.99085), (198, 1.97202)):
        assert numeric.t_quantile(0.975, df) == pytest.approx(want, abs=1e-4)
    assert numeric.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and numeric.chi2_tail(18.307, 10) == pytest.approx(0.05, abs=1e-4)


def test_geometry(spark):
    notched = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]
    ring = F.lit(None)
    df = spark.createDataFrame([([(float(a), float(b)) for a, b in notched],)], "ring array<struct<x:double,y:double>>")
    points = [(1, 1), (2, 2), (3.5, 3), (2, 1), (0, 2), (5, 5)]
    tests = [getattr(geo, k)(geo.edges(F.col("ring")), F.lit(float(x)), F.lit(float(y))) for k in ("within", "intersects") for x, y in points]
    got = list(df.select(*[t.alias(f"c{i}") for i, t in enumerate(tests)]).first())
    assert got == [True, False, True, False, False, False, True, False, True, True, True, False]
    area, c, ok = df.select(geo.ring_area(F.col("ring")), geo.centroid(F.col("ring")), geo.valid_ring(F.col("ring"))).first()
    assert area == 10 and ok and round(c.x, 6) == 2.0
    x, y = spark.range(1).select(geo.project(F.lit(8.0), F.lit(9.0)).alias("p")).first().p
    assert x == pytest.approx(-1769904.797, abs=0.01) and y == pytest.approx(1055700.807, abs=0.01)
    del ring


def test_grid_join_equals_all_pairs(spark):
    rng = random.Random(5)
    polygons = [(k, [(rng.uniform(0, 20) + dx, rng.uniform(0, 20) + dy) for dx, dy in ((0, 0), (6, 1), (7, 6), (1, 5))]) for k in range(15)]
    points = [(i, rng.uniform(0, 28), rng.uniform(0, 28)) for i in range(300)]
    p = spark.createDataFrame(points, "i int, x double, y double")
    z = spark.createDataFrame(polygons, "k int, ring array<struct<x:double,y:double>>")
    want = p.crossJoin(z).where(geo.intersects(geo.edges(F.col("ring")), F.col("x"), F.col("y"))).select("i", "k").collect()
    got = spatial.polygon_join(p, z, 3.0).select("i", "k").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    near = spatial.nearest(p, p.select(F.col("i").alias("j"), "x", "y"), 4, 0.5).collect()
    for i, x, y in points[:40]:
        best = sorted((round((x - a) ** 2 + (y - b) ** 2, 9), j) for j, a, b in points)[:4]
        assert [r.j for r in sorted((r for r in near if r.i == i), key=lambda r: r.rank)] == [j for _, j in best]


def test_network_equals_floyd_warshall(spark):
    rng = random.Random(6)
    edges = [(str(rng.randrange(14)), str(rng.randrange(14)), float(rng.randint(1, 9))) for _ in range(22)]
    edges = [(a, b, m) for a, b, m in edges if a != b]
    d = {(a, b): 0.0 if a == b else math.inf for a in map(str, range(14)) for b in map(str, range(14))}
    for a, b, m in edges:
        d[a, b] = d[b, a] = min(d[a, b], m)
    for k, i, j in [(str(k), str(i), str(j)) for k in range(14) for i in range(14) for j in range(14)]:
        d[i, j] = min(d[i, j], d[i, k] + d[k, j])
    df = spark.createDataFrame(edges, "src string, dst string, minutes double")
    got = {r.node: r.minutes for r in spatial.travel_times(df, spark.createDataFrame([("0", 0.0), ("5", 2.0)], "node string, minutes double")).collect()}
    want = {n: min(d["0", n], d["5", n] + 2) for n in map(str, range(14))}
    assert got == {n: m for n, m in want.items() if m < math.inf}


def test_estimator_equals_plain_python(spark):
    rng = random.Random(7)
    rows = [("all", float(rng.random() < 0.4), rng.uniform(1, 5), f"h{i % 3}", i % 20) for i in range(400)] + [("all", 1.0, 1.0, "alone", 99), ("all", None, 1.0, "h0", 1)]
    r = survey.proportions(spark.createDataFrame(rows, "domain string, y double, w double, h string, i int")).first()
    kept = [x for x in rows if x[1] is not None]
    sw = sum(x[2] for x in kept)
    p = sum(x[1] * x[2] for x in kept) / sw
    z = {}
    for _, y, w, h, i in kept:
        z[h, i] = z.get((h, i), 0) + w * (y - p) / sw
    v = 0.0
    for h in {h for h, _ in z}:
        zs = [x for (a, _), x in z.items() if a == h]
        if len(zs) > 1:
            m = sum(zs) / len(zs)
            v += len(zs) / (len(zs) - 1) * sum((x - m) ** 2 for x in zs)
    assert r.p == pytest.approx(p) and r.se == pytest.approx(math.sqrt(v)) and r.df == len(z) - 4
    sample = spark.createDataFrame(rows, "domain string, y double, w double, h string, i int").drop("domain").where("h <> 'alone'")
    b = survey.bootstrap(sample, 400)
    assert b.first().se == pytest.approx(survey.proportions(sample.withColumn("domain", F.lit("a"))).first().se, rel=0.15)
    assert tuple(survey.bootstrap(sample, 50, block=7).first()) == pytest.approx(tuple(survey.bootstrap(sample, 50, block=50).first()))


def test_constraints(spark):
    tables = {"a": spark.createDataFrame([(1, 5), (2, None), (2, 7)], "id int, v int"), "b": spark.createDataFrame([(1,), (9,), (None,)], "a_id int")}
    rules = quality.Catalogue([
        quality.Constraint("fk", "b", "foreign_key", ("a_id",), parent="a", parent_columns=("id",)), quality.Constraint("pk", "a", "primary_key", ("id",)),
        quality.Constraint("ck", "a", "check", predicate="v < 6"), quality.Constraint("nn", "a", "not_null", ("v",)), quality.Constraint("uq", "a", "unique", ("v",)),
    ])
    assert {r.name: r.violations for r in rules.report(tables).collect()} == {"fk": 1, "pk": 1, "ck": 1, "nn": 1, "uq": 0}
    assert rules.load_order() == ["a", "b"] and "FOREIGN KEY (a_id) REFERENCES a (id)" in rules.constraints[0].ddl()
    with pytest.raises(quality.ViolationError):
        rules.enforce(tables)
    quality.Catalogue([rules.constraints[4]]).enforce(tables)


def test_gate_with_nulls(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 50)], "id int, v int")
    rules = {"R1": F.col("v") > 10, "R2": F.col("id") == 9}
    assert [(r.valid, r.gate) for r in quality.gate(df, rules).orderBy("id").collect()] == [(True, "PASS"), (False, "PASS"), (False, "R1")]
    assert quality.gate(df, rules, strict=True).where("id = 2").first().gate == "UNEVALUABLE"


def test_one_fabricator_is_found(spark):
    rng = random.Random(7)
    rows = []
    for who in range(30):
        for k in range(12):
            fake = who == 17
            rows.append((f"e{who}", k // 4, rng.uniform(3, 6) if fake else rng.uniform(22, 50), 2, 0 if fake else rng.randint(1, 2), 2, 1 if fake else 2, 10.5 if fake else rng.uniform(10, 11), 7.5 if fake else rng.uniform(7, 8), False))
    out = quality.enumerator_screen(spark.createDataFrame(rows, "who string, day int, minutes double, modules int, cards int, eligible int, specimens int, lat double, lon double, overlap boolean"))
    assert [r.who for r in out.where("verdict = 'INVESTIGATE'").collect()] == ["e17"]


def test_adjudication_and_cascade(spark):
    rows = [("a", 1, "X", None, False), ("a", 2, "X", None, False), ("b", 1, "X", "transferred", False), ("b", 2, "Y", None, True), ("c", 1, "X", None, False), ("c", 2, "Y", None, True), ("d", 1, "X", None, False), ("d", 2, "Y", None, False)]
    out = reconcile.adjudicate(spark.createDataFrame(rows, "code string, ord long, district string, remark string, agrees boolean"))
    got = {(r.code, r.ord): (r.kept, r.outcome) for r in out.collect()}
    assert got["a", 2] == (False, "duplicate") and got["b", 2] == (False, "conflict_transfer") and got["c", 1] == (False, "conflict_authority")
    assert got["d", 1][0] is False and got["d", 2][0] is False and got["b", 1][0] and got["c", 2][0]
    names = spark.createDataFrame([("Daibewo",), ("Yobrifa-West",), ("Ngenuta",)], "name string")
    raw = spark.createDataFrame([("Daibewo",), ("YOBRIFA WEST LGA",), ("Ngenutta",), ("Ngena",), ("zzz",)], "raw string")
    assert {r.raw: r.method for r in reconcile.cascade(raw, names).collect()} == {"Daibewo": "exact", "YOBRIFA WEST LGA": "normalised", "Ngenutta": "fuzzy_accepted", "Ngena": "fuzzy_review", "zzz": "unresolved"}
    assert reconcile.key_collisions(names.union(spark.createDataFrame([("NGENUTA state",)], "name string"))).count() == 1


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,x,z\n3,4,5\n")
    got = sources.csv_union(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()
    assert sorted((r.x, r.y, r.z or "") for r in got) == [("1", "2", ""), ("4", "3", "5")]
    (tmp_path / "g.json").write_text('{"type":"FeatureCollection","features":[{"properties":{"a":1},"geometry":{"type":"Point","coordinates":[1,2]}}]}')
    assert sources.geojson(spark, str(tmp_path / "g.json")).first().kind == "Point"
    (tmp_path / "p.mif").write_text("Version 300\nData\n\nPoint 7.5 9.5\n    Symbol (1)\nPoint 8 10\n")
    (tmp_path / "p.mid").write_text('"F1","Clinic, old"\n"F2","Post"\n')
    assert [tuple(r) for r in sources.mif_points(spark, str(tmp_path / "p"), ["id", "name"]).orderBy("id").collect()] == [("F1", "Clinic, old", 7.5, 9.5), ("F2", "Post", 8.0, 10.0)]
    (tmp_path / "f.xml").write_text('<h:html><bind nodeset="/d/a" type="int" constraint=". &gt;= 1 and . &lt;= 9"/><bind nodeset="/d/b" type="string"/></h:html>')
    assert [(r.nodeset, r.constraint) for r in sources.xform_binds(spark, str(tmp_path / "f.xml")).orderBy("nodeset").collect()] == [("/d/a", ". >= 1 and . <= 9"), ("/d/b", None)]
    assert sources.markdown(spark.createDataFrame([(1.5, None)], "a double, b string"), {"a": "{:.2f}"}).splitlines()[-1] == "| 1.50 |  |"
    sources.write_layers({"one": spark.range(2), "two": spark.range(3)}, str(tmp_path / "layers"))
    sources.write_layers({"one": spark.range(5)}, str(tmp_path / "layers"))
    assert spark.read.parquet(str(tmp_path / "layers/one")).count() == 5 and spark.read.parquet(str(tmp_path / "layers/two")).count() == 3


def test_stream_equals_batch(spark, tmp_path):
    df = spark.sql("select id, timestamp_seconds(1704067200 + id * 3600) ts, cast(id % 3 as string) kind from range(200)")
    df.write.parquet(str(tmp_path / "in"))
    stream = streaming.read_events(spark, str(tmp_path / "in"), df.schema)
    streaming.daily_counts(stream, ["kind"]).writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    want = df.groupBy(F.to_date("ts").alias("day"), "kind").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, spark.table("days").collect())) == sorted(map(tuple, want.collect()))
    streaming.gated(stream, {"R": F.col("kind") == "1"}).writeStream.format("memory").queryName("gated").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("gated").where("gate = 'R'").count() == 67


def test_rules(spark):
    from fieldloom.operators import response, rules

    df = spark.createDataFrame([(1, 5, 1, None), (2, 50, 2, "x"), (3, None, 1, None)], "hh int, size int, result int, note string")
    own = [rules.Rule("A", "size", "size <= 40", "result = 1", True, justified_by="plate"), rules.Rule("B", "note", relevant="result = 1")]
    assert sorted(map(tuple, rules.violations(df, own, ["hh"]).collect())) == [(2, "A", "size", "answered_but_skipped"), (2, "B", "note", "answered_but_skipped"), (3, "A", "size", "missing")]
    assert {r.rule_id: r.enforcement for r in rules.register(spark, own).collect()} == {"A": "gate", "B": "skip"}
    with pytest.raises(ValueError):
        rules.register(spark, [rules.Rule("C", "size", "size > 0")])
    other = [own[0], rules.Rule("B", "note", relevant="result = 2")]
    assert [tuple(r) for r in rules.variant_diff(spark, own, other).collect()] == [("B", "relevant", "result = 1", "result = 2")]
    assert rules.derived(df, [rules.Rule("D", "twice", calculation="size * 2")]).where("hh = 1").first().twice == 10
    cells = spark.createDataFrame([("h", 1, 0.5, 2.0, 3, 1.5), ("h", 2, 0.1, 2.0, 0, 1.0)], "h string, i int, coverage double, w double, n_missing int, kids double")
    out = response.augmented(spark.createDataFrame([("h", 1, 1, 1.0)], "h string, i int, y int, w double"), cells, 0.2).collect()
    assert sorted((round(r.y, 6), r.w) for r in out) == [(0.3, 9.0), (1.0, 1.0)]


def test_binary_sources(spark, tmp_path):
    import sqlite3
    import struct
    import zipfile

    from fieldloom.sources import binary

    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 0.0)]
    wkb = struct.pack("<BII", 1, 3, 1) + struct.pack("<I", 4) + b"".join(struct.pack("<2d", *p) for p in square)
    db = sqlite3.connect(tmp_path / "a.gpkg")
    db.execute("create table gpkg_geometry_columns (table_name text, column_name text)")
    db.execute("insert into gpkg_geometry_columns values ('wards', 'geom')")
    db.execute("create table wards (code text, n int, geom blob)")
    db.execute("insert into wards values ('W1', 7, ?), ('W2', null, null)", (b"GP\0\1" + struct.pack("<i", 4326) + wkb,))
    db.commit()
    db.close()
    rows = binary.geopackage(spark, str(tmp_path / "a.gpkg"), "wards").orderBy("row_no").collect()
    assert rows[0].cells == {"code": "W1", "n": "7"} and rows[0].kind == "polygon" and len(rows[0].parts[0]) == 4 and rows[1].kind is None
    shape = struct.pack("<i4d2i", 5, 0, 0, 2, 2, 1, 4) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *p) for p in square)
    (tmp_path / "s.shp").write_bytes(bytes(100) + struct.pack(">2i", 1, len(shape) // 2) + shape)
    field = b"NAME".ljust(11, b"\0") + b"C" + bytes(4) + bytes([5, 0]) + bytes(14)
    (tmp_path / "s.dbf").write_bytes(struct.pack("<4BIHH", 3, 99, 1, 1, 1, 65, 6) + bytes(20) + field + b"\r" + b" Alpha")
    row = binary.shapefile(spark, str(tmp_path / "s")).first()
    assert row.kind == "polygon" and row.cells == {"NAME": "Alpha"}
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="One"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>LGA</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>5</v></c></row><row><c r="B2"><v>6</v></c></row></sheetData><mergeCells><mergeCell ref="A1:A2"/></mergeCells></worksheet>')
    assert [(r.sheet, r.cells) for r in binary.workbook(spark, str(tmp_path / "b.xlsx")).orderBy("row_no").collect()] == [("One", {"c0": "LGA", "c1": "5"}), ("One", {"c0": "LGA", "c1": "6"})]
    kinds = spark.createDataFrame([(["", None],), (["Total", "5"],), (["Note: x"],), (["a", "b"],)], "c array<string>").select(binary.row_kind(F.col("c")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["blank", "control_total", "footnote", "data"]
