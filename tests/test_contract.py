"""The driver's entry points; every core query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lexmill.plans import queries as core
from lexmill.plans import sql


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return str(v) if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "text" in df.columns
    assert set(sql.oracle_sql()) <= set(core.queries()) and set(core.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, sf, duck, name):
    df = core.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    assert len(cols) == len(set(cols))
    if name in sql.oracle_sql():
        r = duck.execute(sql.oracle_sql()[name])
        names = [x[0] for x in r.description]
        want = [tuple(plain(dict(zip(names, x))[c]) for c in cols) for x in r.fetchall()]
        assert sorted(names) == cols and sorted(map(repr, got)) == sorted(map(repr, want))
