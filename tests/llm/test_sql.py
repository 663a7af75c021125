"""The queries of the subpackage that SQL can express give the rows that DuckDB gives."""

import glob
import os

import duckdb
import pytest

from docmill.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, data, name):
    db = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = queries.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    found = db.sql(queries.SQL[name])
    assert sorted(found.columns) == cols
    at = [found.columns.index(c) for c in cols]
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in found.fetchall())


def test_base_columns_of_personal_data_are_those_of_the_operator(spark, data):
    from docmill.llm import pii
    from docmill.llm.base_columns import QUERIES

    base = QUERIES["base_of_op10"](spark, data)
    want = pii.op10_pii(spark, data).select(*base.columns)
    assert sorted(map(tuple, base.collect())) == sorted(map(tuple, want.collect()))


def test_base_columns_of_personal_data_mine_no_terms(spark, data, monkeypatch):
    from docmill.llm import pii
    from docmill.llm.base_columns import QUERIES

    monkeypatch.setattr(pii, "disclosing_terms", lambda *a: 1 / 0)
    assert QUERIES["base_of_op10"](spark, data).count() == spark.read.parquet(f"{data}/documents.parquet").count()
