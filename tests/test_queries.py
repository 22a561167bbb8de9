"""Every query with an oracle against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from fieldloom.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def plain(x):
    return round(float(x), 5) + 0.0 if isinstance(x, float) or type(x).__name__ == "Decimal" else x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF)
    if name not in ORACLES:
        got.collect()
        return
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = lambda xs: sorted((tuple(map(plain, r)) for r in xs), key=repr)
    assert rows(got.select(*[f"`{c}`" for c in columns]).collect()) == rows(want.fetchall())
