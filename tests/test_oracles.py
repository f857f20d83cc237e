"""Every query of the library that SQL can express, side by side with DuckDB."""

import datetime
import os

import duckdb
import pytest

from sparrowmill import catalog


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return con


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return repr(v)
    return repr(float(v))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, data, duck, name):
    got = catalog.queries()[name](spark, data)
    want = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    a = sorted(tuple(plain(r[c]) for c in sorted(names)) for r in got.collect())
    order = sorted(range(len(names)), key=names.__getitem__)
    b = sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())
    assert a == b
