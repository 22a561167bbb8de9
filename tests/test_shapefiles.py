"""Shapefiles as a data source: many tasks write, ranges of records are read, only what was committed counts."""

import json

import pytest
from pyspark.sql import functions as F

from fieldloom.sources import binary, shapefiles, sinks

PARTS = "array<array<struct<x:double,y:double>>>"


def lines(spark, n, slices):
    at = lambda d: F.struct((F.col("id") + d).cast("double").alias("x"), (-F.col("id")).cast("double").alias("y"))
    parts = F.when(F.col("id") % 5 == 0, F.lit(None).cast(PARTS)).otherwise(F.array(F.array(at(0), at(1)), F.array(at(2), at(3), at(4))))
    return spark.range(0, n, 1, slices).select(parts.alias("parts"), F.col("id").alias("id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("né "), "id")).alias("name"))


def rows(df):
    return sorted((r.row_no, r.cells["id"], r.cells["name"], r.kind, r.parts and [[(p.x, p.y) for p in part] for part in r.parts]) for r in df.collect())


def want(n):
    return [(k, str(k), f"né {k}" if k % 3 else None, None if k % 5 == 0 else "line", None if k % 5 == 0 else [[(k, -k), (k + 1, -k)], [(k + 2, -k), (k + 3, -k), (k + 4, -k)]]) for k in range(n)]


@pytest.mark.parametrize("slices,per_set,per_task", [(1, 1000, 1000), (3, 40, 7), (4, 1, 1)])
def test_all_rows_in_order(spark, tmp_path, slices, per_set, per_task):
    path = str(tmp_path / "out")
    shapefiles.write(lines(spark, 203, slices), path, "line", rows=per_set)
    got = shapefiles.read(spark, path, per_task)
    assert rows(got) == want(203)
    assert got.rdd.getNumPartitions() >= 203 // per_task


def test_two_tasks_read_one_file(spark, tmp_path):
    path = str(tmp_path / "one")
    sinks.write_shapefile(lines(spark, 101, 2), path, "line")
    got = shapefiles.read(spark, path, 50)
    assert rows(got) == want(101) == rows(binary.shapefile(spark, path)) and got.rdd.getNumPartitions() == 3


def test_a_table_without_rows(spark, tmp_path):
    path = str(tmp_path / "none")
    shapefiles.write(lines(spark, 0, 1), path, "line")
    assert rows(shapefiles.read(spark, path)) == [] and shapefiles.read(spark, path).columns == ["row_no", "cells", "kind", "parts"]


def test_written_again_and_sets_that_nobody_committed(spark, tmp_path):
    path = str(tmp_path / "again")
    shapefiles.write(lines(spark, 30, 3), path, "line")
    shapefiles.write(lines(spark, 12, 2), path, "line")
    sinks.write_shapefile(lines(spark, 9, 1), f"{path}/part-00000-0000-99999", "line")  # left by a task that was run twice
    assert rows(shapefiles.read(spark, path)) == want(12)
    assert sum(x["rows"] for x in json.loads((tmp_path / "again" / "manifest.json").read_text())["sets"]) == 12


def test_a_failed_write_leaves_nothing_to_read(spark, tmp_path):
    path = str(tmp_path / "bad")
    df = lines(spark, 20, 2).withColumn("name", F.when(F.col("id") == 17, F.repeat(F.lit("x"), 255)).otherwise("a"))
    with pytest.raises(Exception, match="254"):
        shapefiles.write(df, path, "line")
    assert not (tmp_path / "bad" / "manifest.json").exists()
    with pytest.raises(Exception):
        shapefiles.read(spark, path).collect()
    with pytest.raises(ValueError, match="ten"):
        shapefiles.write(df.withColumn("attribute_1", F.lit(1)).withColumn("attribute_2", F.lit(2)), path, "line")


def test_shapes_and_attributes_of_different_number(spark, tmp_path):
    path = str(tmp_path / "odd")
    sinks.write_shapefile(lines(spark, 10, 1), path, "line")
    table = bytearray((tmp_path / "odd.dbf").read_bytes())
    table[4] = 9
    (tmp_path / "odd.dbf").write_bytes(bytes(table))
    with pytest.raises(Exception, match="10 shapes and 9 rows"):
        shapefiles.read(spark, path).collect()
