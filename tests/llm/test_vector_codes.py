"""Codes of vectors against plain Python, SQL, and rows that are hard to code."""

import hashlib
import math
import os
import random

import duckdb
import numpy as np
import pytest

from fieldloom.llm import queries
from fieldloom.llm import vector_codes as vc

SF = "/root/testdata/sf0.001"
DDL = "vec_id long, embedding array<double>, label int"


def slow(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in sorted(kept, key=lambda r: r[0])[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda x, book: min((far(x, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            met = {}
            for _, v, _ in kept:
                met.setdefault(best(cut(v)[p], books[p])[1], []).append(cut(v)[p])
            books[p] = [[sum(c) // len(met[e]) for c in zip(*met[e])] if e in met else old for e, old in enumerate(books[p])]
    out, by = {}, {}
    for i, v, lab in kept:
        found = [best(x, books[p]) for p, x in enumerate(cut(v))]
        out[i] = ("".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), lab)
        by[lab] = by.get(lab, 0) + out[i][1]
    digest = hashlib.sha256(",".join(str(y) for b in books for c in b for y in c).encode()).hexdigest()
    return {i: (c, e, by[lab], digest) for i, (c, e, lab) in out.items()}


def got(df):
    return {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()}


@pytest.mark.parametrize("entries", [3, 256])
def test_equals_plain_python(spark, entries):
    rng = random.Random(entries)
    rows = [(k * 3 - 40, [rng.gauss(0, 1) for _ in range(8)], rng.choice([None, 1, 2])) for k in range(300)]
    rows += [(1001, None, 1), (-99, [float("nan")] * 8, 1), (-98, [1.0] * 7 + [None], 2), (-97, [float("-inf")] + [0.0] * 7, None)]
    rows += [(1100 + k, [-0.5, 0.25] * 4, 1) for k in range(40)]  # copies: ties go to the first entry
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, DDL).repartition(5).selectExpr("*", "1 as code", "2 as error", "3 as s0")
    assert got(vc.compress(df, entries=entries)) == slow(rows, entries=entries)


def test_any_partitioning_gives_the_same_books(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet") if os.path.isdir(SF) else pytest.skip("no test data")
    one, many = vc.codebooks(df.coalesce(1)), vc.codebooks(df.repartition(7))
    assert (one == many).all() and one.dtype == np.int64


def test_odd_tables(spark):
    assert vc.compress(spark.createDataFrame([], DDL)).count() == 0
    assert vc.compress(spark.createDataFrame([(1, None, 1)], DDL)).count() == 0
    same = spark.createDataFrame([(7, [0.5] * 4, None), (7, [0.5] * 4, None), (None, [0.25] * 4, 3)], DDL)
    assert sorted((r.vec_id or -1, r.code, r.error, r.label_error) for r in vc.compress(same).collect()) == [(-1, "02020202", 0, 0), (7, "00000000", 0, 0), (7, "00000000", 0, 0)]
    for bad in ([(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], [(1, [1.0] * 6, 1)], [(1, [1e30] * 4, 1)]):
        with pytest.raises(Exception):
            vc.compress(spark.createDataFrame(bad, DDL).coalesce(1)).collect()


def test_many_labels_join_by_their_size(spark, monkeypatch):
    monkeypatch.setattr(vc, "BROADCAST_ROWS", 3)
    rng = random.Random(5)
    rows = [(k, [rng.random() for _ in range(4)], 1 if k < 40 else None if k < 60 else k) for k in range(90)]
    assert got(vc.compress(spark.createDataFrame(rows, DDL), entries=8)) == slow(rows, entries=8)


def test_codes_stand_for_vectors():
    books = np.arange(4 * 3 * 2).reshape(4, 3, 2)
    assert vc.decoded("00010200", books) == [0, 1, 8, 9, 16, 17, 18, 19]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{SF}/embeddings.parquet{'/*' if os.path.isdir(SF + '/embeddings.parquet') else ''}')")
    want = con.execute(queries.ORACLES["op13_vector_codes"])
    names = [c[0] for c in want.description]
    rows = [tuple(r) for r in queries.QUERIES["op13_vector_codes"](spark, SF).select(*names).collect()]
    assert sorted(rows) == sorted(want.fetchall())
