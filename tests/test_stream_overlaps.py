"""Visits that follow too closely, in a stream: late visits, what leaves the state, batches run again."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from fieldloom import streaming
from fieldloom.operators import quality

SCHEMA = "who string, start timestamp, end timestamp, id long"
DAY = datetime.datetime(2024, 1, 1)


def visit(who, minute, lasts, number, micros=0):
    start = DAY + datetime.timedelta(minutes=minute, microseconds=micros)
    return who, start, None if lasts is None else start + datetime.timedelta(minutes=lasts), number


def stream(spark, tmp_path, batches, late="72 hours", gap=2):
    """The rows after all batches, each of which comes in as a file of its own, and the number of states left."""
    at, left = str(tmp_path), 0
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{at}/in")
        visits = streaming.read_events(spark, f"{at}/in", spark.createDataFrame([], SCHEMA).schema, "start")
        out = streaming.overlaps(visits, gap, late)
        streaming.into_folder(out, f"{at}/out", f"{at}/checkpoint")
    got = streaming.from_folder(spark, f"{at}/out", "who string, id long, gap double").collect()
    state = spark.read.format("statestore").load(f"{at}/checkpoint")
    return sorted((r.who or "", r.id or 0, round(r.gap, 9)) for r in got), state.select("key").count()


def batch(spark, rows, gap=2):
    return sorted((r.who or "", r.id or 0, round(r.gap, 9)) for r in quality.overlaps(spark.createDataFrame(rows, SCHEMA), gap).collect())


END = [visit("end", 10_000, 1, 9_999)]  # moves the watermark past all others


def test_late_visits_give_the_batch_answer(spark, tmp_path):
    draw = random.Random(7)
    rows = [visit(f"e{draw.randrange(4)}", draw.randrange(600), draw.randrange(1, 20), n, draw.randrange(1000)) for n in range(120)]
    draw.shuffle(rows)
    got, left = stream(spark, tmp_path, [rows[:40], rows[40:80], rows[80:], END], late="24 hours")
    want = batch(spark, rows)
    assert got == want and len(want) > 20
    assert left == 1  # the enumerator of the last batch alone waits


def test_what_comes_after_the_span_is_dropped(spark, tmp_path):
    first = [visit("a", 0, 5, 1), visit("a", 100, 5, 2)]
    got, _ = stream(spark, tmp_path, [first, [visit("a", 106, 1, 4), visit("a", 10, 1, 3)], END], late="10 minutes")
    assert got == [("a", 4, 1.0)]


def test_ties_nulls_and_instants_between_milliseconds(spark, tmp_path):
    rows = [
        visit("a", 0, 5, 2), visit("a", 0, 1, 1), visit("a", 6, None, 3), visit("a", 6, 1, 4, 400), visit("a", 7, 1, 5, 800),
        visit(None, 0, 1, 6), visit(None, 1, 1, 7), visit("b", 0, 1, None), visit("b", 1, 1, 8), visit("b", 1, 1, 8),
    ]
    got, left = stream(spark, tmp_path, [rows, [("a", None, DAY, 10)], END])
    assert got == batch(spark, rows) and len(got) >= 5 and left == 1


def test_without_a_span_visits_are_judged_as_they_come(spark, tmp_path):
    first = [visit("a", 0, 5, 1), visit("a", 6, 5, 2)]
    got, left = stream(spark, tmp_path, [first, [visit("a", 12, 1, 4), visit("a", 3, 1, 3)]], late=None)
    assert got == [("a", 2, 1.0), ("a", 3, -8.0)] and left == 1  # 4 follows 3, whose end is 8 minutes before


def test_nothing_comes(spark, tmp_path):
    got, left = stream(spark, tmp_path, [[]])
    assert got == [] and left == 0


def test_a_batch_run_again_leaves_its_rows_once(spark, tmp_path):
    rows = [visit("a", 0, 1, 1), visit("a", 2, 1, 2)]
    want, _ = stream(spark, tmp_path, [rows, END])
    commits = sorted((f for f in os.listdir(tmp_path / "checkpoint" / "commits") if f.isdigit()), key=int)
    for name in (commits[-1], f".{commits[-1]}.crc"):  # as after a failure between the write and the commit
        (tmp_path / "checkpoint" / "commits" / name).unlink(missing_ok=True)
    visits = streaming.read_events(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema, "start")
    streaming.into_folder(streaming.overlaps(visits, 2, "72 hours"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = streaming.from_folder(spark, str(tmp_path / "out"), "who string, id long, gap double")
    assert [(r.who, r.id, r.gap) for r in got.collect()] == want == [("a", 2, 1.0)]


def test_complete_results_replace_each_other(spark, tmp_path):
    at = str(tmp_path)
    for day in (1, 2):
        spark.range(day).withColumn("ts", F.lit(f"2024-01-0{day}").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{at}/in")
        events = streaming.read_events(spark, f"{at}/in", "id long, ts timestamp").withColumn("kind", F.lit("k"))
        streaming.into_folder(streaming.daily_counts(events, ["kind"]), f"{at}/out", f"{at}/checkpoint", "complete")
    got = streaming.from_folder(spark, f"{at}/out", "day date, kind string, n long").collect()
    assert sorted((r.day.day, r.n) for r in got) == [(1, 1), (2, 2)]
