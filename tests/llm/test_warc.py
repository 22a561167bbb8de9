import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from fieldloom.llm import warc

PAGES = "page_id long, url string, html string, payload string, at int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], PAGES)


def test_round_trip_rejects_records_inside_payloads(spark, tmp_path):
    inner = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    long = "ä" * 600 + inner * 3
    rows = [(1, "u", None), (2, None, ""), (3, "a\r\nb", inner), (4, "u", long), (5, "u", long), (6, "u", "x" * 5_000_000), (7, "u", "y" * 999), (8, "u", "y" * 999)]
    warc.write_archives(pages(spark, rows), str(tmp_path / "w"), file_records=3)
    got = {r.page_id: r for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7, 8]
    assert all(r.intact for r in got.values())
    assert got[4].record_type == "revisit" and got[4].refers_to == 5 and bytes(got[4].payload) == b""
    for i, _, html in rows:
        want = (html or "").encode()
        assert got[i].payload_bytes == len(want) and got[i].payload_digest == hashlib.sha1(want).hexdigest()
        if i != 4:
            assert got[i].record_type == "response" and bytes(got[i].payload) == want and got[i].refers_to is None


def test_repeated_rows_and_empty_table(spark, tmp_path):
    rows = [(1, "u", "z" * 2000), (1, "u", "z" * 2000), (None, "u", "z" * 2000)]
    got = warc.round_trip(pages(spark, rows)).collect()
    assert sorted(r.record_type for r in got) == ["response", "response", "revisit"]
    assert warc.round_trip(pages(spark, []).where(F.lit(False))).count() == 0


def test_pointer_jumping_equals_a_walk(spark):
    rows = [("a", 0, 5), ("a", 5, 9), ("a", 7, 9), ("a", 9, 20), ("a", 12, 15), ("b", 3, 9), ("c", 0, 4)]
    links = spark.createDataFrame(rows, "path string, at long, next long")
    got = {(r.path, r["at"]) for r in warc.reachable(links).collect()}
    assert got == {("a", 0), ("a", 5), ("a", 9), ("c", 0)}


def test_long_chains_equal_a_walk():
    rng = random.Random(4)
    for n in (1, 2, 3, 64, 65, 5000):
        at = np.cumsum([0] + [rng.randint(1, 9) for _ in range(n)])
        after = np.array([rng.choice(at[k + 1 : k + 4]) if rng.random() < 0.99 else at[k] + 1 for k in range(n)])
        want, here = set(), 0
        while here in (places := dict(zip(at[:n].tolist(), after.tolist()))):
            want.add(here)
            here = places[here]
        assert set(at[:n][warc.chained(at[:n], after)].tolist()) == want


def test_archives_are_bounded_in_bytes(spark, tmp_path):
    rows = [(i, "u", "x" * (40_000 if i % 10 == 0 else 300)) for i in range(200)]
    warc.write_archives(pages(spark, rows).coalesce(1), str(tmp_path / "w"), file_records=50, file_bytes=150_000)
    files = list((tmp_path / "w").rglob("*.txt"))
    assert max(f.stat().st_size for f in files) <= 150_000
    assert sorted(r.page_id for r in warc.read_archives(spark, str(tmp_path / "w")).collect()) == list(range(200))


def test_one_long_page_does_not_scatter_the_others(spark, tmp_path):
    rows = [(0, "u", "y" * 800_000), *[(i, "u" * (i % 50), "x" * 4000) for i in range(1, 60)]]
    warc.write_archives(pages(spark, rows).coalesce(1), str(tmp_path / "w"), file_records=1024, file_bytes=800_000)
    files = list((tmp_path / "w").rglob("*.txt"))
    assert len(files) <= 4
    assert sorted(r.page_id for r in warc.read_archives(spark, str(tmp_path / "w")).collect()) == list(range(60))
