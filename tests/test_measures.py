import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from fieldloom import sources
from fieldloom.functions import geo
from fieldloom.functions.text import clean_text, match_key, title_case_admin
from fieldloom.operators import measures, ordering, quality, reconcile, spatial, survey


def test_spearman_ties_and_p(spark):
    xs, ys = [1, 2, 2, 3, 5, 8, 8, 9, 10, 12], [2, 1, 4, 3, 6, 5, 9, 9, 8, 12]
    r = measures.spearman(spark.createDataFrame([*zip(xs, ys), (None, 3)], "x int, y int"), "x", "y").first()

    def ranks(v):
        return [sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v]

    a, b = ranks(xs), ranks(ys)
    mean = sum(a) / len(a)
    rho = sum((p - mean) * (q - mean) for p, q in zip(a, b)) / (sum((p - mean) ** 2 for p in a) * sum((q - mean) ** 2 for q in b)) ** 0.5
    assert r.n == 10 and r.rho == pytest.approx(rho) and 0 < r.p < 0.001
    # with two degrees of freedom p has a closed form: 1 - |rho| for n = 4
    four = measures.spearman(spark.createDataFrame([(1, 2), (2, 1), (3, 4), (4, 3)], "x int, y int"), "x", "y").first()
    assert four.rho == pytest.approx(0.6) and four.p == pytest.approx(0.4)


def test_quantiles_of_groups_equal_sorting(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), float(rng.randint(0, 30))) for _ in range(400)] + [("c", 5.0), ("d", None)]
    for q in (0.0, 0.1, 0.5, 0.9, 1.0):
        got = {r.h: r.m for r in ordering.group_quantile(spark.createDataFrame(rows, "h string, w double"), ["h"], "w", q, "m").collect()}
        for h in ("a", "b", None, "c"):
            own = sorted(w for g, w in rows if g == h and w is not None)
            at = q * (len(own) - 1)
            assert got[h] == pytest.approx(own[int(at)] + (own[min(int(at) + 1, len(own) - 1)] - own[int(at)]) * (at - int(at)))
        assert "d" not in got


def test_cells(spark):
    row = spark.sql("select ' V ' a, null b, timestamp '2026-01-01 10:00:00' t").select(
        measures.flag_equal(F.col("a"), "V").alias("x"), measures.flag_equal(F.col("b"), "V").alias("y"),
        measures.minutes_since(F.col("t"), F.lit("2026-01-01 09:58:31").cast("timestamp")).alias("back"), measures.minutes_since(F.col("t"), F.lit("2026-01-01 10:01:59").cast("timestamp")).alias("on"),
        measures.detectable(F.lit(0.01)).alias("mde"),
    ).first()
    assert (row.x, row.y, row.back, row.on) == (1, 0, -1, 1) and row.mde == pytest.approx(0.0395979797)


def test_small_orders_and_empty_tables(spark):
    df = spark.createDataFrame([(k,) for k in range(5)], "k int")
    assert sorted((r.k, r.side) for r in measures.ends(df, ["k"], 3).collect()) == [(0, "lowest"), (1, "lowest"), (2, "lowest"), (3, "highest"), (4, "highest")]
    assert [r.k for r in measures.every_kth(df, ["k"], 2).collect()] == [0, 2, 4] and measures.every_kth(df, ["k"], 1).count() == 5
    none = df.where("k < 0")
    assert measures.spearman(none.withColumn("y", F.col("k")), "k", "y").first().rho is None and quality.age_heaping(none.select(F.col("k").alias("age"))).count() == 0
    assert measures.histogram(df.where("k = 3"), "k", 3).collect()[0].n == 1
    assert survey.trimmed(none.select(F.lit("a").alias("h"), F.col("k").cast("double").alias("w"))).count() == 0


def test_codes_that_are_missing_stop(spark):
    codes = spark.createDataFrame([("a", 1)], "name string, code int")
    assert measures.coded(spark.createDataFrame([("a",)], "place string"), "place", codes).first().code == 1
    with pytest.raises(ValueError, match="no code for"):
        measures.coded(spark.createDataFrame([("a",), ("b",)], "place string"), "place", codes)
    with pytest.raises(ValueError, match="no severity"):
        measures.integrity_ledger([("x", "grave", codes)])
    silent = spark.createDataFrame([("c", 1.0, True, False)], "cluster string, w double, eligible boolean, responded boolean")
    assert survey.response_weights(silent).first().nr_adjustment is None
    with pytest.raises(ValueError, match="no respondents"):
        survey.response_weights(silent, strict=True)
    with pytest.raises(ValueError, match="not in"):
        geo.assert_crs("EPSG:32632", "EPSG:4326")
    geo.assert_crs(" epsg:4326", "EPSG:4326")


def test_names_lose_all_endings_and_odd_forms(spark):
    names = ["Kano" + " State LGA" * 9, "ＫＡＮＯ　ＬＧＡ", "LGA.State", "ﬁeld district", None, "", "x" * 30 + "-" + "y" * 30]
    got = [r.k for r in spark.createDataFrame(list(enumerate(names)), "i int, n string").orderBy("i").select(match_key(F.col("n"), unicode_forms=True).alias("k")).collect()]
    assert got == ["KANO", "KANO", "LGA", "FIELD", "", "", "X" * 30 + "Y" * 30]
    row = spark.createDataFrame([("a  b - ", "oke-odo  WEST " + "z" * 9)], "a string, b string").select(clean_text(F.col("a")).alias("a"), title_case_admin(F.col("b")).alias("b")).first()
    assert row.a == "a b" and row.b == "Oke-Odo West Z" + "z" * 8


def test_of_equally_like_names_the_first_counts(spark):
    rng = random.Random(4)
    names = [f"{''.join(rng.choice('abc') for _ in range(6))}" for _ in range(40)]
    names = list(dict.fromkeys(names))
    raws = ["".join(rng.choice("abcd") for _ in range(6)) for _ in range(40)] + ["zzzz"]
    out = {r.raw: r for r in reconcile.cascade(spark.createDataFrame([(x,) for x in raws], "raw string"), spark.createDataFrame(list(enumerate(names)), "ord int, name string")).collect()}
    seen = set()
    for raw in set(raws):
        best, score = None, 0.0
        for n in names:
            s = SequenceMatcher(None, raw.upper(), n.upper()).ratio()
            if s > score:
                best, score = n, s
        want = (raw, "exact") if raw in names else (best, "fuzzy_accepted") if score >= 0.88 else (best, "fuzzy_review") if score >= 0.75 else (None, "unresolved")
        assert (out[raw].resolved, out[raw].method) == want and out[raw].confidence == pytest.approx(1.0 if raw in names else score)
        seen.add(want[1])
    assert {"fuzzy_review", "unresolved"} <= seen


def test_facilities_have_no_review(spark):
    found, kept = reconcile.facilities(spark.createDataFrame([("abcdefgh",), ("abcdefxy",), ("abc clinic",)], "raw string"), spark.createDataFrame([("abcdefgh",), ("abc clinic",)], "name string"))
    assert {r.raw: r.method for r in found.collect()} == {"abcdefgh": "exact", "abcdefxy": "unresolved", "abc clinic": "exact"} and kept.count() == 1


def test_representative_points_lie_inside(spark):
    rng = random.Random(2)
    rings = [[(0, 0), (10, 0), (10, 10), (8, 10), (8, 2), (2, 2), (2, 10), (0, 10)], [(0, 0), (4, 0), (4, 4)], [(0, 0), (9, 1), (1, 1), (9, 2), (0, 2)]]
    for _ in range(30):  # stars around a middle, concave
        import math

        rings.append([(rng.uniform(1, 9) * math.cos(2 * math.pi * k / 9), rng.uniform(1, 9) * math.sin(2 * math.pi * k / 9)) for k in range(9)])
    rings = [[(float(x), float(y)) for x, y in ring] for ring in rings]
    df = spark.createDataFrame([(r,) for r in rings], "ring array<struct<x:double,y:double>>").withColumn("p", geo.representative_point(F.col("ring")))
    inside = df.select(geo.within(geo.edges(F.col("ring")), F.col("p.x"), F.col("p.y")).alias("in")).collect()
    assert all(r["in"] for r in inside)
    flat = spark.createDataFrame([([(1.0, 2.0), (3.0, 2.0)],)], "ring array<struct<x:double,y:double>>").select(geo.representative_point(F.col("ring")).alias("p"), F.size(geo.segments(F.col("ring"))).alias("n")).first()
    assert tuple(flat.p) == (1.0, 2.0) and flat.n == 1


def test_networks_that_do_not_settle_stop(spark):
    chain = spark.createDataFrame([(f"n{k:02d}", f"n{k + 1:02d}", 1.0) for k in range(12)], "src string, dst string, minutes double")
    assert {r.component for r in spatial.components(chain).collect()} == {"n00"}
    with pytest.raises(ValueError, match="still changing"):
        spatial.components(chain, rounds=1)
    points = spark.createDataFrame([(1, 0.0, 0.0)], "i int, x double, y double")
    with pytest.raises(ValueError, match="no 1 neighbours"):
        spatial.nearest(points, spark.createDataFrame([(1, 9e9, 0.0)], "j int, x double, y double"), 1, 1.0, rounds=2)


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,n,extra\n1,2.5,x\nb,1,y\n".encode())
    rows = sources.typed_csv(spark, str(tmp_path / "a.csv"), "n double, id int").collect()
    assert [(r.n, r.id) for r in rows] == [(2.5, 1), (1.0, None)] and rows[0]._unread is None and rows[1]._unread.startswith("b,1")
    with pytest.raises(ValueError, match="lacks"):
        sources.typed_csv(spark, str(tmp_path / "a.csv"), "m int")
    import pandas as pd

    assert sources.staged(pd.DataFrame({"k": [1, 2]}), "staged_frame", spark).count() == 2
    assert sources.replace_table(spark.range(3), "made_anew").count() == 3 and sources.replace_table(spark.range(2), "made_anew").count() == 2
    spark.sql("drop table made_anew")
    with pytest.raises(ValueError, match="more than 2 rows"):
        sources.markdown(spark.range(3), rows=2)


def test_points_equally_near_keep_every_polygon(spark):
    from fieldloom.operators.transfer import snapped

    box = lambda a, c: [(a, 0.0), (c, 0.0), (c, 1.0), (a, 1.0)]
    zones = spark.createDataFrame([(2, box(0.0, 1.0)), (1, box(3.0, 4.0)), (3, box(9.0, 10.0))], "zone int, ring array<struct<x:double,y:double>>")
    point = spark.createDataFrame([(7, 2.0, 0.5)], "id int, x double, y double")
    assert [tuple(r) for r in snapped(point, zones, 5.0).collect()] == [(7, 1, 1.0, "resolved_review", 0.7)]
    assert sorted(r.zone for r in snapped(point, zones, 5.0, ties=True).collect()) == [1, 2]
    with pytest.raises(ValueError, match="no polygon"):
        snapped(point, zones, 0.01, rounds=2)


def test_a_layer_in_another_system_stops(spark, tmp_path):
    (tmp_path / "p.mif").write_text('Version 300\nCoordSys Earth Projection 1, 104\nColumns 1\n  n Char(9)\nData\nPoint 1 2\n')
    (tmp_path / "p.mid").write_text('"a"\n')
    row = sources.mif_points(spark, str(tmp_path / "p"), ["n"], coordinates="Earth Projection 1").first()
    assert (row.n, row.x, row.y) == ("a", 1.0, 2.0)
    with pytest.raises(ValueError, match="not in"):
        sources.mif_points(spark, str(tmp_path / "p"), ["n"], coordinates="NonEarth")
