"""Projections there and back, and systems named by a file's header."""

import math

import pytest
from pyspark.sql import functions as F

from fieldloom import sources
from fieldloom.functions import geo

SYSTEMS = [
    geo.TransverseMercator(9, 0, 0.9996, 500_000, 0), geo.TransverseMercator(-3, -40, 1.0, 0, 1e6), geo.EqualArea(25, 0, 20, -23),
    geo.EqualArea(10, 5, 4, 13, 1000, -2000), geo.EqualArea(0, -30, -20, -50), geo.EqualArea(12, 0, 30, 30),
]


@pytest.mark.parametrize("system", SYSTEMS, ids=str)
def test_there_and_back(spark, system):
    at = spark.range(0, 41 * 33).select((system.lon0 - 10 + F.col("id") % 41 / 2.0).alias("lon"), (-80 + F.floor(F.col("id") / 41) * 5.0).alias("lat"))
    if isinstance(system, geo.EqualArea) and abs(system.parallel1 + system.parallel2) < 5:
        at = at.where("abs(lat) < 60")  # the cone is all but flat: its far end is beyond the tip
    p = at.withColumn("p", system.forward(F.col("lon"), F.col("lat"))).withColumn("b", system.inverse(F.col("p.x"), F.col("p.y")))
    worst = p.select(F.max(F.abs(F.col("b.lon") - F.col("lon"))), F.max(F.abs(F.col("b.lat") - F.col("lat"))), F.count("b.lon"), F.count(F.lit(1))).first()
    assert worst[0] < 1e-7 and worst[1] < 1e-7 and worst[2] == worst[3] > 0


def _arc(lat, steps=20_000):
    """The length of the meridian from the equator, by the midpoint rule."""
    h = math.radians(lat) / steps
    return sum(geo.A * (1 - geo.E2) / (1 - geo.E2 * math.sin((k + 0.5) * h) ** 2) ** 1.5 for k in range(steps)) * h


def test_transverse_is_true_on_its_meridian_and_conformal(spark):
    system, d = geo.TransverseMercator(9, 0, 0.9996, 500_000, 0), 1e-4
    lats = [5.0, 33.0, 61.0]
    on = spark.createDataFrame([(x,) for x in lats], "lat double").select("lat", system.forward(F.lit(9.0), F.col("lat")).alias("p")).collect()
    for r in on:
        assert abs(r.p.x - 500_000) < 1e-6 and abs(r.p.y - 0.9996 * _arc(r.lat)) < 1e-4
    at = [(lon, lat, k) for lon in (6.0, 13.5) for lat in lats for k in range(4)]
    step = {0: (d, 0), 1: (-d, 0), 2: (0, d), 3: (0, -d)}
    moved = spark.createDataFrame([(lon + step[k][0], lat + step[k][1], lon, lat, k) for lon, lat, k in at], "a double, b double, lon double, lat double, k int")
    got = {(r.lon, r.lat, r.k): r.p for r in moved.select("lon", "lat", "k", system.forward(F.col("a"), F.col("b")).alias("p")).collect()}
    for lon in (6.0, 13.5):
        for lat in lats:
            sin = math.sin(math.radians(lat))
            along, across = geo.A * (1 - geo.E2) / (1 - geo.E2 * sin**2) ** 1.5, geo.A * math.cos(math.radians(lat)) / math.sqrt(1 - geo.E2 * sin**2)
            e, w, n, s = (got[lon, lat, k] for k in range(4))
            east = ((e.x - w.x) / across, (e.y - w.y) / across)
            north = ((n.x - s.x) / along, (n.y - s.y) / along)
            assert abs(east[0] - north[1]) < 1e-8 and abs(east[1] + north[0]) < 1e-8


def test_equal_area_general_form_is_the_fixed_one(spark):
    p = spark.range(50).select(geo.project(F.col("id") * 1.0, F.col("id") - 25.0).alias("a"), geo.EqualArea(25, 0, 20, -23).forward(F.col("id") * 1.0, F.col("id") - 25.0).alias("b"))
    assert p.select(F.max(F.abs(F.col("a.x") - F.col("b.x")) + F.abs(F.col("a.y") - F.col("b.y")))).first()[0] < 1e-6


def test_systems_of_headers():
    assert geo.header_system("Earth Projection 1, 104") == (None, 1.0)
    assert geo.header_system('Earth Projection 8, 104, "m", 9, 0, 0.9996, 500000, 0') == (geo.TransverseMercator(9, 0, 0.9996, 500_000, 0), 1.0)
    assert geo.header_system('earth projection 9, 104, "km", 25, 0, 20, -23, 1, 2') == (geo.EqualArea(25, 0, 20, -23, 1000, 2000), 1000.0)


@pytest.mark.parametrize("line", ["", "NonEarth Units \"m\"", "Earth Projection 3, 104, \"m\", 1, 2, 3, 4, 5, 6", "Earth Projection 8, 62, \"m\", 9, 0, 1, 0, 0", "Earth Projection 8, 104, \"ft\", 9, 0, 1, 0, 0", "Earth Projection 8, 104, \"m\", 9"])
def test_other_systems_are_errors(line):
    with pytest.raises(ValueError):
        geo.header_system(line)


@pytest.mark.parametrize("split", ["200", "134217728"])
def test_pairs_of_many_splits_and_endings(spark, tmp_path, split):
    rows = 300
    (tmp_path / "p.mif").write_bytes(("Version 300\r\nCoordSys Earth Projection 1, 104\r\nData\r\n" + "".join(f"Point {n / 10} {-n}\r\n    Symbol (34,0,9)\r\n" for n in range(rows))).encode())
    (tmp_path / "p.mid").write_bytes("".join(f'"{n}"\r\n' + ("\r\n" if n % 7 == 0 else "") for n in range(rows)).encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        df = sources.mif_points(spark, str(tmp_path / "p"), ["n"], degrees=True)
        got = sorted((int(r.n), r.x, r.y) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(n, n / 10, float(-n)) for n in range(rows)]
