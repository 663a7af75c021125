"""The walk over a folder of files: no file is left out, and no name passes the driver."""

import duckdb

from docmill.plans import QUERIES, SQL
from docmill.sources import parsers

ROWS = [(1, "one\n\n\n\ntwo  three", "src1"), (2, "", "src1"), (4, None, "src1"), (5, " \n\t ", "a b"), (6, "six", None), (7, "seven", "%41{x}?*"), (8, "", ""), (13, "bin", "src1"), (-3, "minus", "é=1")]


def test_empty_and_odd_texts_are_walked_as_their_sql_says(spark, tmp_path):
    path = tmp_path / "documents.parquet"
    spark.createDataFrame(ROWS, "doc_id long, text string, source string").coalesce(1).write.parquet(str(path))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    wanted = sorted(db.sql(SQL["corpus_walk"]).fetchall())
    assert sorted(map(tuple, QUERIES["corpus_walk"](spark, str(tmp_path)).collect())) == wanted
    assert sum(n == 0 for _, n, _ in wanted) == 3


def test_files_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """Files at any depth, in folders of any number; others and those of no parser are left out."""
    for name in ("x.md", "a/y.TXT", "a/b/c/z.rst", "a/b/empty.md", "a/b/no.bin", "a/none", "d/bad.docx"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("" if "empty" in name else name)
    monkeypatch.setattr(parsers, "NAMES", 1)
    found = parsers.listed(spark, str(tmp_path))
    assert sorted((r["path"][len(str(tmp_path)) + 1 :], r["suffix"], r["bytes"]) for r in found.collect()) == [("a/b/c/z.rst", ".rst", 11), ("a/b/empty.md", ".md", 0), ("a/y.TXT", ".txt", 7), ("d/bad.docx", ".docx", 10), ("x.md", ".md", 4)]
    read = {r["path"].rsplit("/", 1)[1]: (r["text"], r["error"]) for r in parsers.read_parsed(found, str(tmp_path)).collect()}
    assert read["y.TXT"] == ("a/y.TXT", None) and read["empty.md"] == ("", None) and read["bad.docx"][1].startswith("BadZipFile") and len(read) == 5
