"""The most similar name against all pairs measured, the bounds it rests on, and the plans."""

import io
import random
from contextlib import redirect_stdout
from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldloom.operators import fuzzy, reconcile


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def slow(names, keys):
    out = {}
    for k in set(names):
        best = min(((-ratio(k, key), first, key) for first, key in keys), default=None)
        if k and best and best[0] < 0:
            out[k] = (-best[0], best[2])
    return out


NAMES = st.text("abcd1", max_size=14)


@settings(max_examples=500, deadline=None)
@given(NAMES, NAMES)
def test_bounds_hold(a, b):
    m = round(ratio(a, b) * (len(a) + len(b)) / 2)
    grams = lambda s: {(s[i : i + 2], s[: i + 1].count("") and sum(s[j : j + 2] == s[i : i + 2] for j in range(i))) for i in range(len(s) - 1)}
    assert len(grams(a) & grams(b)) >= 3 * m - len(a) - len(b) - 1
    if b:
        block = fuzzy._Block([b])
        table = [[0] * (len(b) + 1)]
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(table[-1][j] + 1 if x == y else max(table[-1][j + 1], row[j]))
            table.append(row)
        assert block.common(a, np.array([0]))[0] == table[-1][-1] >= m


def case(seed, n):
    rng = random.Random(seed)
    part = lambda k: "".join(rng.choice("ABCDEFGHIJ") for _ in range(k))
    keys = list(dict.fromkeys(part(rng.randint(1, 9)) + rng.choice(["NORTH", "SOUTH", "", "RIVER"]) for _ in range(n)))
    names = []
    for _ in range(n):
        k = list(rng.choice(keys))
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(k) + 1)
            k[at : at + rng.randint(0, 1)] = rng.choice(["", "X", "A"])
        names.append("".join(k))
    return names + ["", "Z", "QQQQ", "A" * 70, "NORTH" * 20], keys + ["B" * 66 + "A", "NORTH" * 19]


@pytest.mark.parametrize("seed,rings,block", [(1, fuzzy.RINGS, 2048), (5, (0.97, 0.67), 9), (2, (0.95, 0.8), 7), (3, (0.7,), 50), (4, (), 16)])
def test_equals_all_pairs(spark, seed, rings, block):
    names, keys = case(seed, 60)
    rng = random.Random(seed)
    order = list(range(len(keys)))
    rng.shuffle(order)
    authority = spark.createDataFrame(list(zip(keys, order)), "key string, first int")
    got = {r.k: (r.score, r.key) for r in fuzzy.most_similar(spark.createDataFrame([(n,) for n in names], "k string"), authority, rings, block).collect()}
    assert got == slow(names, list(zip(order, keys)))


def test_empty_sides(spark):
    some, none = spark.createDataFrame([("ABC",)], "k string"), spark.createDataFrame([], "key string, first int")
    assert fuzzy.most_similar(some, none).count() == 0
    assert fuzzy.most_similar(some.limit(0), spark.createDataFrame([("ABD", 1)], "key string, first int")).count() == 0
    with pytest.raises(ValueError):
        fuzzy.most_similar(some, none, rings=(0.6,))


def test_index_measures_few_pairs(spark):
    """Names that differ in two letters: each meets a handful of the others, not all of them."""
    rng = random.Random(6)
    keys = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(14)) for _ in range(600)]
    names = [k[:4] + "X" + k[5:11] + "Y" + k[12:] for k in keys]
    often = fuzzy._pairs(spark.createDataFrame([(k,) for k in keys], "key string"), "key").groupBy("gram").count().withColumnRenamed("count", "often")
    own = fuzzy._ordered(fuzzy._pairs(spark.createDataFrame([(k,) for k in names], "k string"), "k"), often, "k")
    theirs = fuzzy._ordered(fuzzy._pairs(spark.createDataFrame([(k,) for k in keys], "key string"), "key"), often, "key")
    met = fuzzy._ring(own, theirs, 0.75)
    assert 600 <= met.count() < 2 * 600 and met.where("score >= 0.75").count() >= 600


def test_no_plan_has_a_cross_join(spark):
    names = spark.createDataFrame([("Ngenutta",), ("zzz",), ("qqqqq",)], "raw string")
    authority = spark.createDataFrame([("Ngenuta",), ("Daibewo",)], "name string")
    said = io.StringIO()
    with redirect_stdout(said):
        reconcile.cascade(names, authority).explain("formatted")
    assert "CartesianProduct" not in said.getvalue() and "NestedLoop" not in said.getvalue()


def test_names_with_a_common_beginning(spark, monkeypatch):
    """In numbered names no pair of letters is rare: an index would meet nearly all, so they come by one letter or by blocks."""
    keys = [f"SUPPLIER{k:09}" for k in range(150)]
    names = [k[:13] + "X" + k[:12:-1] for k in keys] + [k[:14] + k[15:] for k in keys[::9]] + [k + "7" for k in keys[::9]] + keys[:3]
    monkeypatch.setattr(fuzzy, "_ring", lambda *_: pytest.fail("the index meets nearly all pairs"))
    order = [(k * 37) % 150 for k in range(150)]
    authority = spark.createDataFrame(list(zip(keys, order)), "key string, first int")
    got = {r.k: (r.score, r.key) for r in fuzzy.most_similar(spark.createDataFrame([(n,) for n in names], "k string"), authority, block=64).collect()}
    assert got == slow(names, list(zip(order, keys)))


def test_equals_that_come_later_are_not_measured(monkeypatch):
    block, made = fuzzy._Block([f"SUPPLIER{k:09}" for k in range(2000)]), []
    monkeypatch.setattr(fuzzy, "SequenceMatcher", lambda *a: made.append(a) or SequenceMatcher(*a))
    assert block.best("SUPPLIERX", 0.0) and len(made) < 5
