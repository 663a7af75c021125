"""Paged files as a data source: a row for each page, in partitions of byte ranges, so a long file is many tasks.

A paged file is a zip archive with a text layer ``<page>.txt`` and a picture ``<page>.img`` for each page. The driver only lists files and their
sizes, and packs short ones together; a task opens its files, reads their directories and takes the pages that begin in its ranges. ``pictures`` are read on a second way, for
asked pages alone."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docmill.scratch import stored

SUFFIX = ".paged"
#: Bytes of a file for one task, and pages that are recognised in one.
RANGE, PAGES = 8 << 20, 64


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it; any that pyarrow knows."""
    return pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri)) if re.match(r"^\w+:/", uri) else (pafs.LocalFileSystem(), uri)


class Ranges(InputPartition):
    """Ranges (path, start, stop) of a long file or of several short ones."""

    def __init__(self, uri: str, ranges: list[tuple[str, int, int]]):
        self.uri, self.ranges = uri, ranges


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.range = options["path"], int(options.get("range", RANGE))

    def partitions(self) -> list[Ranges]:
        fs, root = _open(self.path)
        found = sorted((f for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.is_file and f.path.endswith(SUFFIX)), key=lambda f: f.path)
        out, held, size = [], [], 0
        for path, at, stop in ((f.path, at, min(f.size, at + self.range)) for f in found for at in range(0, max(1, f.size), self.range)):
            if held and size + stop - at > self.range:
                out.append(Ranges(self.path, held))
                held, size = [], 0
            held.append((path, at, stop))
            size += stop - at
        return [*out, Ranges(self.path, held)]

    def read(self, partition: Ranges) -> Iterator[tuple]:
        fs, _ = _open(partition.uri)
        for path, start, stop in partition.ranges:
            with fs.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                for member in z.infolist():
                    name, _, kind = member.filename.rpartition(".")
                    if kind == "txt" and start <= member.header_offset < stop:
                        yield path, int(name), z.read(member).decode("utf-8", "replace")


class PagedSource(DataSource):
    """``spark.read.format("paged").load(folder)``: path, page, text."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "path string, page int, text string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


def read_pages(spark: SparkSession, folder: str, **options: int) -> DataFrame:
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged").options(**{k: str(v) for k, v in options.items()}).load(folder)


def packed(pages: list[tuple[int, str, bytes]]) -> bytes:
    """A paged file of (page, text, picture)."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for page, text, picture in pages:
            z.writestr(f"{page}.txt", text)
            z.writestr(f"{page}.img", picture)
    return out.getvalue()


def write_paged(files: DataFrame, folder: str) -> int:
    """Write a paged file for each row (file_id, pages: array of page, text, picture); their number. A task that runs again writes the same file anew."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _open(folder)
        for batch in batches:
            for key, pages in zip(batch["file_id"], batch["pages"], strict=True):
                fs.create_dir(f"{root}/{int(key) % 64}", recursive=True)
                with fs.open_output_stream(f"{root}/{int(key) % 64}/{key}{SUFFIX}") as f:
                    f.write(packed([(p["page"], p["text"], bytes(p["picture"])) for p in pages]))
            yield pd.DataFrame({"n": [len(batch)]})

    return files.select("file_id", "pages").mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def recognised(asked: DataFrame, folder: str, factory: Callable[[], Callable[[bytes], str]]) -> DataFrame:
    """path, page, ocr of asked pages (path, page): their pictures are read, those of no other page, and handed to a recogniser. Pages of a file go in
    runs of PAGES, so a long file is many tasks; a picture that can't be read or recognised gives an empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = _open(folder)
        recognise = factory()
        for batch in batches:
            out = []
            for path, rows in batch.groupby("path", sort=False):
                try:
                    with fs.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                        for page in rows["page"]:
                            try:
                                out.append((path, page, recognise(z.read(f"{page}.img")) or ""))
                            except Exception:  # one bad picture must not end the job
                                out.append((path, page, ""))
                except (OSError, zipfile.BadZipFile):
                    out += [(path, page, "") for page in rows["page"]]
            yield pd.DataFrame(out, columns=["path", "page", "ocr"]).astype({"page": "int32"})

    # Names of pages are short, their pictures aren't: Spark's own sizes would put them all into a few tasks.
    asked = stored(asked.select("path", "page"), "asked-pages")
    tasks = max(asked.sparkSession.sparkContext.defaultParallelism, -(-asked.count() // (16 * PAGES)))
    dealt = asked.repartition(tasks, "path", F.floor(F.col("page") / PAGES)).sortWithinPartitions("path", "page")
    return dealt.mapInPandas(run, "path string, page int, ocr string")
