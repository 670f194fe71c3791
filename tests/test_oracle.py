"""Every registered query of the library against its SQL over the smallest tables."""

import os

import duckdb
import pytest

from lexiflow import plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


def plain(v):
    return "null" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(cols).collect())
    if name in plans.SQL:
        want = con.execute(plans.SQL[name])
        named = [c[0] for c in want.description]
        assert sorted(named) == cols
        assert got == sorted(tuple(plain(r[named.index(c)]) for c in cols) for r in want.fetchall())
