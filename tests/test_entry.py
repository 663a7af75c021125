"""The driver's contract, with and without the optional subpackage."""

import importlib
import sys

import __spark_entry__
from docmill.plans import QUERIES, SQL


def test_names():
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(SQL) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark, data):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["qid", "doc_id", "rank", "vec_rank", "fts_rank", "rrf", "score", "kind"] and df.count() == 8 * spark.read.parquet(f"{data}/conversations.parquet").filter("role = 'user' AND conv_id % 50 = 0").count()


def test_without_the_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith(("docmill.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "docmill.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        bare = importlib.reload(__spark_entry__)
        assert set(bare.queries()) == set(QUERIES)
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)
