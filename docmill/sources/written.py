"""Files written from rows, a file for each, into any folder that driver and executors share."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from itertools import groupby
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .paged import _open

_TYPES = '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/></Types>'


def _put(fs, name: str, content: bytes, made: set[str]) -> None:
    """A file under its name, whole; ``made`` are folders that this task knows of."""
    if (place := name.rsplit("/", 1)[0]) not in made:
        fs.create_dir(place, recursive=True)
        made.add(place)
    with fs.open_output_stream(f"{name}._part") as f:
        f.write(content)
    fs.move(f"{name}._part", name)


def write_files(rows: DataFrame, folder: str) -> int:
    """Write ``content`` (binary) of each row under its ``path``; their number. A file appears whole, under its name, or not at all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _open(folder)
        made: set[str] = set()
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                _put(fs, f"{root}/{path}", bytes(content), made)
            yield pd.DataFrame({"n": [len(batch)]})

    return rows.select("path", "content").mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def _zipped(members: list[tuple[str, str]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members:
            z.writestr(name, text)
    return out.getvalue()


def word_file(sections: list[tuple[str, list[str]]], table: list[list[str]]) -> bytes:
    """A DOCX of sections (heading, paragraphs) and a table at its end."""
    run = lambda t: f'<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r>'
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr>{run(h)}</w:p>' + "".join(f"<w:p>{run(p)}</w:p>" for p in ps) for h, ps in sections)
    body += "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p>{run(c)}</w:p></w:tc>" for c in r) + "</w:tr>" for r in table) + "</w:tbl>" if table else ""
    return _zipped([("[Content_Types].xml", _TYPES), ("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')])


_SHEETS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


class Workbook:
    """An XLSX that is written row by row, one sheet behind the other: what is held is the compressed file."""

    def __init__(self) -> None:
        self.out, self.names = io.BytesIO(), []
        self.zip, self.member = zipfile.ZipFile(self.out, "w", zipfile.ZIP_DEFLATED), None

    def add(self, sheet: str, rows: list[list[str]]) -> None:
        """Rows of cells for a sheet; a name other than the last one begins a sheet."""
        if not self.names or self.names[-1] != sheet:
            self._end()
            self.names.append(sheet)
            self.member = self.zip.open(f"xl/worksheets/sheet{len(self.names)}.xml", "w", force_zip64=True)
            self.member.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet {_SHEETS}><sheetData>'.encode())
        cell = lambda c: f'<c t="inlineStr"><is><t xml:space="preserve">{escape(c)}</t></is></c>'
        self.member.write("".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows).encode())

    def _end(self) -> None:
        if self.member is not None:
            self.member.write(b"</sheetData></worksheet>")
            self.member.close()

    def content(self) -> bytes:
        self._end()
        names = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k}"/>' for k, n in enumerate(self.names, 1))
        self.zip.writestr("[Content_Types].xml", _TYPES)
        self.zip.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook {_SHEETS}><sheets>{names}</sheets></workbook>')
        self.zip.close()
        return self.out.getvalue()


def sheet_file(sheets: list[tuple[str, list[list[str]]]]) -> bytes:
    """An XLSX of sheets (name, rows of cells)."""
    book = Workbook()
    for name, rows in sheets:
        book.add(name, rows)
    return book.content()


def write_sheets(rows: DataFrame, folder: str, *by: str) -> int:
    """Write rows (path, sheet, cells), in the order of ``by``, as XLSX files; their number. A task takes the sorted rows of a file one after the other, so neither
    a file's rows nor its sheets are ever held as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        last, book, done, made = None, None, 0, set()
        for batch in batches:
            for (path, sheet), group in groupby(zip(*(batch.column(c).to_pylist() for c in ("path", "sheet", "cells")), strict=True), lambda r: r[:2]):
                if path != last:
                    if book is not None:
                        _put(fs, f"{root}/{last}", book.content(), made)
                    last, book, done = path, Workbook(), done + 1
                book.add(sheet, [cells for _, _, cells in group])
        if book is not None:
            _put(fs, f"{root}/{last}", book.content(), made)
        yield pa.record_batch({"n": [done]})

    laid = rows.repartition("path").sortWithinPartitions("path", "sheet", *by).select("path", "sheet", "cells")
    return laid.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def book_file(members: list[tuple[str, str]]) -> bytes:
    """An EPUB of members (name, text), each a page with its text as one paragraph a line, beside a style and a contents page."""
    page = lambda text: "<html><head><style>p {}</style></head><body><nav>Contents</nav>" + "".join(f"<p>{escape(x)}</p>" for x in text.split("\n")) + "</body></html>"
    return _zipped([("mimetype", "application/epub+zip"), ("style.css", "p {}"), *((n, page(t)) for n, t in members)])


@F.pandas_udf(T.BinaryType())
def word_files(heading: pd.Series, paragraphs: pd.Series, cells: pd.Series) -> pd.Series:
    """DOCX files from arrays: headings, arrays of paragraphs, cells of one table row."""
    return pd.Series([word_file(list(zip(h, map(list, p), strict=True)), [list(c)]) for h, p, c in zip(heading, paragraphs, cells, strict=True)])


@F.pandas_udf(T.BinaryType())
def sheet_files(names: pd.Series, rows: pd.Series) -> pd.Series:
    """XLSX files from arrays: names of sheets, arrays of rows of cells."""
    return pd.Series([sheet_file(list(zip(n, [[list(c) for c in s] for s in r], strict=True))) for n, r in zip(names, rows, strict=True)])


@F.pandas_udf(T.BinaryType())
def book_files(names: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([book_file(list(zip(n, t, strict=True))) for n, t in zip(names, texts, strict=True)])
