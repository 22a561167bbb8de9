"""Values that depend on rounding or on the order of rows: halves and equal sums."""

import random
from datetime import datetime
from functools import reduce
from operator import add

import duckdb
import pytest

from fieldloom.plans.queries import ORACLES, QUERIES


def both(spark, folder, name, **tables):
    """The rows of a query over tables, and those of its SQL."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    return sorted(map(tuple, QUERIES[name](spark, str(folder)).select(*columns).collect())), sorted(want.fetchall())


def test_prices_near_a_half(spark, tmp_path):
    """128.605 is a double below its half: one decimal is left at 128.6, and nothing to complain of."""
    rows = [(3 * k, 5, f, datetime(1994, 1, 1)) for k, f in enumerate([128605.0, 75395.0, 1005.0, 2675.0, 1115.0, 4395.0, 95.0, 128600.0, 128610.0])]
    rows += [(3 * k + 1, 5, 1000 * k + 50.0, datetime(1994, 1, 1)) for k in range(40)]
    rows += [(3 * k, 5, 100.0 * k - 5, datetime(1994, 1, 1)) for k in range(50, 3000)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp")
    got, want = both(spark, tmp_path, "form_constraints", orders=orders)
    assert got == want and (0, "t", "constraint") not in got and (24, "t", "constraint") in got


def test_equal_sums_share_a_rank(spark, tmp_path):
    """Suppliers with the same discounts in other orders: in doubles 0.1 + 0.2 + 0.3 is not 0.3 + 0.2 + 0.1."""
    rng, rows, sums = random.Random(4), [], {}
    for supplier in range(60):
        cents = [1 + (supplier % 6), 2, 3, 4, 5, 7, 7, 10]
        rng.shuffle(cents)
        q = rng.randint(1, 9)
        rows += [(supplier, float(q), c / 100) for c in cents]
        sums[supplier] = (q * len(cents), sum(cents))
    spark.createDataFrame(rows, "l_suppkey long, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    ranks = lambda v: [sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v]
    a, b = (ranks([s[k] for s in sums.values()]) for k in (0, 1))
    mean = (len(a) + 1) / 2
    rho = sum((p - mean) * (q - mean) for p, q in zip(a, b)) / (sum((p - mean) ** 2 for p in a) * sum((q - mean) ** 2 for q in b)) ** 0.5
    assert len({reduce(add, [d for s, _, d in rows if s == k]) for k in sums}) > 6  # doubles do part them
    assert QUERIES["spearman"](spark, str(tmp_path)).first().rho == pytest.approx(rho, abs=1e-6)


def test_means_on_a_half(spark, tmp_path):
    """Clusters of 256 and 768 rows with means that end on half of the last digit kept: they go up, whatever the order of rows."""
    rng, rows, want = random.Random(8), [], {}
    for cluster in range(40):
        size = 768 if cluster % 4 == 0 else 256
        cents = [rng.randint(0, 10) for _ in range(size)]
        cents[0] += (size // 256 - sum(cents)) % (2 * size // 256)  # an odd number of 256ths of a cent
        rows += [(cluster, "O", c / 100) for c in cents]
        want[cluster] = (20_000_000 * sum(cents) + size) // (2 * size) / 1e9
        assert 20_000_000 * sum(cents) % size == 0 and 20_000_000 * sum(cents) // size % 2 == 1
    spark.createDataFrame([*rows, (99, "F", None)], "l_suppkey long, l_linestatus string, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["caterpillar"](spark, str(tmp_path)).collect()
    assert {r.cluster: r["mean"] for r in got} == {**want, 99: None}
    assert [r.cluster for r in sorted(got, key=lambda r: r.place)] == [*sorted(want, key=lambda k: (want[k], k)), 99]  # as SQL has it, no mean comes last
