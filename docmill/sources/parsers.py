"""Files as sections: a registry of parsers by suffix, applied to binary files in batches.

A parser takes bytes and gives (page, section, text) tuples. A file that can't be parsed gives one row with an error."""

from __future__ import annotations

import email
import email.policy
import io
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.text import normalised
from docmill.scratch import stored

from .paged import _open

Section = tuple[int | None, str, str]
PARSERS: dict[str, Callable[[bytes], list[Section]]] = {}
#: Characters of parsed texts that a task holds before it hands them on.
HELD = 16 << 20
#: Files and bytes that are dealt to one task, and names that a task hands on at once.
FILES, BYTES, NAMES = 10_000, 32 << 20, 10_000
SCHEMA = "path string, page int, section string, text string, error string"


def register(*suffixes: str):
    """Make a function the parser of files with these suffixes."""

    def add(f):
        PARSERS.update({s.lower(): f for s in suffixes})
        return f

    return add


def decoded(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


@register(".txt", ".md", ".markdown", ".rst", ".log")
def plain(raw: bytes) -> list[Section]:
    return [(None, "", decoded(raw))]


@register(".csv")
def comma_rows(raw: bytes) -> list[Section]:
    return [(None, "", linear_rows(decoded(raw), ","))]


@register(".tsv")
def tab_rows(raw: bytes) -> list[Section]:
    return [(None, "", linear_rows(decoded(raw), "\t"))]


def linear_rows(text: str, delimiter: str) -> str:
    import csv

    return "\n".join(" | ".join(row) for row in csv.reader(io.StringIO(text), delimiter=delimiter))


class _Text(HTMLParser):
    def __init__(self, drop: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.drop, self.depth, self.parts = drop, 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.drop

    def handle_endtag(self, tag):
        if tag in self.drop and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if not self.depth and data.strip():
            self.parts.append(data.strip())


#: Elements that are left out of pages, and of books.
PAGE_DROPS = frozenset(("script", "style", "noscript", "header", "footer", "nav"))
BOOK_DROPS = frozenset(("script", "style", "nav"))


def html_text(html: str | None, drop: frozenset[str] = PAGE_DROPS) -> str:
    reader = _Text(drop)
    reader.feed(html or "")
    reader.close()
    return "\n".join(reader.parts)


@register(".html", ".htm", ".xhtml")
def page(raw: bytes) -> list[Section]:
    return [(None, "", html_text(decoded(raw)))]


@register(".epub")
def book(raw: bytes) -> list[Section]:
    out = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for name in sorted(n for n in z.namelist() if n.lower().endswith((".xhtml", ".html", ".htm"))):
            if text := html_text(decoded(z.read(name)), BOOK_DROPS):
                out.append((None, name, text))
    return out


@register(".eml")
def mail(raw: bytes) -> list[Section]:
    m = email.message_from_bytes(raw, policy=email.policy.default)
    head = "\n".join(f"{k}: {m[k] or ''}" for k in ("Subject", "From", "To"))
    body: list[str] = []
    for part in m.walk():
        if part.get_content_type() == "text/plain":
            body.append(part.get_content())
        elif part.get_content_type() == "text/html" and not body:
            body.append(html_text(part.get_content()))
    return [(None, "", "\n\n".join([head, *body]))]


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


@register(".docx")
def word_file(raw: bytes) -> list[Section]:
    """A section from each heading on; tables follow, row by row, in the last one."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text_of = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    sections: list[list] = [["", []]]
    for p in body.findall(f"{_W}p"):
        style = p.find(f"{_W}pPr/{_W}pStyle")
        text = text_of(p).strip()
        if style is not None and style.get(f"{_W}val", "").lower().startswith("heading"):
            sections.append([text, [f"# {text}"]])
        elif text:
            sections[-1][1].append(text)
    for t in body.findall(f"{_W}tbl"):
        for row in t.findall(f"{_W}tr"):
            sections[-1][1].append(" | ".join(text_of(c).strip() for c in row.findall(f"{_W}tc")))
    return [(None, name, "\n".join(lines)) for name, lines in sections if lines]


def _rows(z: zipfile.ZipFile, name: str) -> Iterator[ElementTree.Element]:
    """The rows of a sheet, each let go before the next one is read."""
    with z.open(name) as f:
        events = ElementTree.iterparse(f, ("start", "end"))
        parents = []
        for event, e in events:
            if event == "start":
                parents.append(e)
                continue
            parents.pop()
            if e.tag == f"{_S}row":
                yield e
                if parents:
                    parents[-1].remove(e)


@register(".xlsx", ".xlsm")
def sheets(raw: bytes) -> list[Section]:
    out = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        shared = [("".join(t.text or "" for t in s.iter(f"{_S}t"))) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")] if "xl/sharedStrings.xml" in names else []
        listed = list(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"))
        files = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        if "xl/_rels/workbook.xml.rels" in names:  # a sheet's file is named by its relationship
            target = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
            paths = [target.get(s.get(_ID), "") for s in listed]
            files = [x.lstrip("/") if x.startswith("/") else f"xl/{x}" for x in paths]
        for title, name in zip((s.get("name") for s in listed), files, strict=False):
            if name not in names:
                continue
            rows = []
            for row in _rows(z, name):
                cells = []
                for c in row.findall(f"{_S}c"):
                    v = c.find(f"{_S}v")
                    inline = c.find(f"{_S}is")
                    cells.append("".join(t.text or "" for t in inline.iter(f"{_S}t")) if inline is not None else "" if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text or "")
                if any(x.strip() for x in cells):
                    rows.append(" | ".join(cells))
            if rows:
                out.append((None, title, "\n".join(rows)))
    return out


#: Suffixes of pictures.
PICTURES = (".png", ".jpg", ".jpeg", ".webp", ".tiff", ".tif", ".bmp")


def recognise_pictures(recogniser: Callable[[bytes], str]) -> None:
    """Make a text recogniser the parser of pictures; a picture without text gives no section."""

    def read(raw: bytes) -> list[Section]:
        text = recogniser(raw)
        return [(None, "", text)] if text and text.strip() else []

    register(*PICTURES)(read)


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """path, suffix, content of the files under a folder that some parser takes."""
    wanted = "*.{" + ",".join(sorted({c for s in PARSERS for c in (s[1:], s[1:].upper())})) + "}"  # files are chosen by name before any is read
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", wanted).load(folder)
    return files.select("path", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("suffix"), "content")


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """path, suffix, bytes of the files under a folder that some parser takes, empty ones too. Each level of folders is listed by tasks and stored,
    so the driver holds no names; Spark's own listing keeps all of them there, and leaves empty files out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(folder)
        for batch in batches:
            for place in batch.column(0).to_pylist():
                found = fs.get_file_info(pafs.FileSelector(place))
                for i in range(0, len(found), NAMES):
                    named = [(f.path, (re.search(r"\.[^./]+$", f.path.lower()) or [""])[0], f.size, f.type == pafs.FileType.Directory) for f in found[i : i + NAMES]]
                    rows = [r for r in named if r[3] or r[1] in PARSERS]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names=["path", "suffix", "bytes", "inside"])

    kinds = pa.string(), pa.string(), pa.int64(), pa.bool_()
    cores = spark.sparkContext.defaultParallelism
    out, places = None, spark.createDataFrame([(_open(folder)[1],)], "path string")
    while True:
        level = stored(places.repartition(cores).mapInArrow(run, "path string, suffix string, bytes long, inside boolean"), "listed")
        files = level.filter("NOT inside").drop("inside")
        out = files if out is None else out.unionByName(files)
        places = level.filter("inside").select("path")
        if not places.limit(1).count():
            return out


def read_parsed(files: DataFrame, folder: str) -> DataFrame:
    """``parsed`` of ``listed`` files: each is opened where it is parsed, so a task holds one file's bytes."""
    size = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-size["n"] // FILES), -(-size["bytes"] // BYTES))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = _open(folder)

        def content(path: str) -> bytes:
            with fs.open_input_file(path) as f:
                return f.read()

        for batch in batches:
            yield from _sections((path, suffix, lambda path=path: content(path)) for path, suffix in zip(batch["path"], batch["suffix"], strict=True))

    found = files.select("path", "suffix").repartition(tasks, F.xxhash64("path")).mapInPandas(run, SCHEMA)
    return found.withColumn("text", normalised(F.col("text")))


def _sections(files: Iterable[tuple[str, str, Callable[[], bytes]]]) -> Iterator[pd.DataFrame]:
    """Frames of SCHEMA, some HELD characters each, of the sections of files (path, suffix, what gives their bytes)."""
    frame = lambda rows: pd.DataFrame(rows, columns=["path", "page", "section", "text", "error"]).astype({"page": "Int32"})
    rows, held = [], 0
    for path, suffix, content in files:
        try:
            found = [(path, page_no, name, text, None) for page_no, name, text in PARSERS[suffix](content())]
        except Exception as e:  # one bad file must not end the job; its row says what happened
            found = [(path, None, None, None, f"{type(e).__name__}: {e}")]
        rows += found
        held += sum(len(r[3] or "") for r in found)
        if held > HELD:
            yield frame(rows)
            rows, held = [], 0
    yield frame(rows)


def parsed(files: DataFrame) -> DataFrame:
    """One row per section of the files, its text normalised; a failing file gives one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from _sections((path, suffix, lambda content=content: bytes(content)) for path, suffix, content in zip(batch["path"], batch["suffix"], batch["content"], strict=True))

    return files.mapInPandas(run, SCHEMA).withColumn("text", normalised(F.col("text")))


@F.pandas_udf(T.StringType())
def html_to_text(html: pd.Series) -> pd.Series:
    return html.map(html_text)
