"""Each registered query against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert rows or name in ORACLES  # where there is none, a query without rows would show nothing
    if name in ORACLES:
        r = duck.execute(ORACLES[name])
        names = [x[0] for x in r.description]
        assert sorted(names) == cols
        assert sorted((tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr) == rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0
