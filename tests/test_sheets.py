"""Workbooks are written and read row by row, short files in a few tasks."""

import io
import tracemalloc
import zipfile

from pyspark.sql import functions as F

from docmill.scratch import folder
from docmill.sources import parsers, written


def test_rows_of_a_sheet_are_let_go():
    raw = written.sheet_file([("big", [[str(i), "", "x"] for i in range(40_000)])])
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        tracemalloc.start()
        n = sum(1 for _ in parsers._rows(z, "xl/worksheets/sheet1.xml"))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert n == 40_000 and peak < 2_000_000  # as a tree the sheet takes over a hundred


def test_files_are_written_from_sorted_rows(spark):
    rows = [(f"{b}.xlsx", s, i, [f"{b}{s}{i}", "", "<&>\""]) for b in "ab" for s in ("one", "t<o") for i in range(30)]
    path = folder(spark, "books")
    df = spark.createDataFrame(rows, "path string, sheet string, at int, cells array<string>").repartition(7)
    assert written.write_sheets(df, path, "at") == 2
    found = parsers.parsed(parsers.corpus(spark, path)).select(F.element_at(F.split("path", "/"), -1), "section", "text", "error").collect()
    want = {(f"{b}.xlsx", s, "\n".join(f"{b}{s}{i} | | <&>\"" for i in range(30)), None) for b in "ab" for s in ("one", "t<o")}
    assert set(map(tuple, found)) == want
    assert written.write_sheets(df.filter("at < 0"), path, "at") == 0


def test_sidecars_are_read_in_a_few_tasks(spark):
    from docmill.plans import QUERIES

    found = QUERIES["sidecar_files"](spark, "/root/testdata/sf0.1")
    assert found.rdd.getNumPartitions() <= 8 * spark.sparkContext.defaultParallelism  # there were some 320 for 10,000 files
    assert found.count() == spark.read.parquet("/root/testdata/sf0.1/documents.parquet").count()
