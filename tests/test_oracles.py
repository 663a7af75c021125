"""Every query with SQL gives the rows that DuckDB gives; every other one gives rows."""

import datetime
import glob
import os

import duckdb
import pytest

from docmill.plans import QUERIES, SQL


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list):
        return str([plain(x) for x in v])
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, db, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert rows
    if name in SQL:
        found = db.sql(SQL[name])
        assert sorted(found.columns) == cols
        at = [found.columns.index(c) for c in cols]
        assert rows == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
