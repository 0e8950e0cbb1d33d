"""Every query of the engine against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from keyloom.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def plain(df):
    value = lambda v: None if v is None or v != v else round(v, 2) if isinstance(v, float) and not math.isinf(v) else str(v).replace(" 00:00:00", "")
    return sorted((tuple(value(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)
