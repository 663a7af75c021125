"""Operator 3, quality rules by repetition coverage.

Words of every whole text are fingerprinted in numpy; rolling hashes of word n-grams of several lengths come from one running
sum over the fingerprints, and the rule measures which share of a text's word characters lies inside n-grams that
occur twice or more in it, and which share of its line characters lies inside repeated lines.

A text fails when any share is above the limit of its length, or when the share of symbols among characters is above
``SYMBOL_SHARE``. Work is per row, in blocks of whole texts of about half a megabyte; nothing is shuffled. Duplicate lines and
repeated words of the base rule are counted on the bytes themselves wherever names are equal.

Defined cases: a null or empty text has no words and fails the base rule; ties and repeated rows are judged alike, each
for itself; ids that aren't whole numbers are null; an empty table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbatch as tb
from .shared import documents, text_of

#: n-gram length and the largest share of word characters that its repeats may cover.
NGRAM_LIMITS = ((4, 0.40), (6, 0.38), (8, 0.36), (10, 0.34))
LINE_SHARE, SYMBOL_SHARE = 0.30, 0.05
MIN_WORDS, BASE_WINDOW, BASE_PERCENT = 20, 8, 30

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), *[T.StructField(f"cover_{n}", T.DoubleType()) for n, _ in NGRAM_LIMITS], T.StructField("cover_lines", T.DoubleType())])

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def covered_words(prints: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in an n-gram that its text holds twice or more, the first included."""
    out = np.zeros(len(prints), bool)
    if len(prints) < n:
        return out
    grams = tb.Prints(prints).fixed(n)
    whole = np.flatnonzero(row[: len(grams)] == row[n - 1 :])
    twice = whole[tb.repeated(tb.mixed(grams[whole] ^ (row[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))]
    delta = np.zeros(len(prints) + 1, np.int32)
    delta[twice] += 1
    np.subtract.at(delta, twice + n, 1)
    return np.cumsum(delta[:-1]) > 0


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen = Counter(x for x in raw.split(b"\n") if x.strip(b" \t\v\f\r"))
    return sum(seen.values()) - len(seen)


def repeated_words(raw: bytes) -> int:
    """Words in windows of ``BASE_WINDOW`` words that the text holds twice or more."""
    numbers: dict[bytes, int] = {}
    words = [numbers.setdefault(w, len(numbers)) for w in WORD.findall(raw)]
    windows = list(zip(*(words[k:] for k in range(BASE_WINDOW)), strict=False))
    times = Counter(windows)
    out, upto = 0, 0
    for k, w in enumerate(windows):
        if times[w] > 1:
            out += k + BASE_WINDOW - max(k, upto)
            upto = k + BASE_WINDOW
    return out


def exactly(found: np.ndarray, data: np.ndarray, offs: np.ndarray, count: Callable[[bytes], int]) -> np.ndarray:
    """Counts of equal names, counted anew on the bytes themselves: equal strings have equal names, so 0 is right already."""
    for k in np.flatnonzero(found):
        found[k] = count(data[offs[k] : offs[k + 1]].tobytes())
    return found


def measure(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The columns of ``SCHEMA`` but the id, for the texts of a block."""
    n = len(offs) - 1
    start, stop, row = tb.words(data, offs)
    chars = tb.char_counts(data)
    of_word = tb.names(data, start, stop)
    size = chars[stop] - chars[start]
    out = {"n_words": tb.per_row(row, n), "word_chars": tb.per_row(row, n, size)}
    marks = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    out["n_symbols"] = marks[offs[1:]] - marks[offs[:-1]]
    l_start, l_stop, l_row = tb.lines(data, offs)
    texty = np.searchsorted(start, l_stop, "left") > np.searchsorted(start, l_start, "left")
    l_start, l_stop, l_row = l_start[texty], l_stop[texty], l_row[texty]
    key = tb.mixed(tb.names(data, l_start, l_stop) ^ (l_row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    again = np.ones(len(key), bool)
    again[np.unique(key, return_index=True)[1]] = False
    out["n_dup_lines"] = exactly(tb.per_row(l_row[again], n), data, offs, duplicate_lines)
    l_chars = chars[l_stop] - chars[l_start]
    out["cover_lines"] = np.bincount(l_row[again], l_chars[again], n) / np.maximum(1, np.bincount(l_row, l_chars, n))
    for length, _ in NGRAM_LIMITS:
        inside = covered_words(of_word, row, length)
        out[f"cover_{length}"] = np.bincount(row[inside], size[inside], n) / np.maximum(1, out["word_chars"])
        if length == BASE_WINDOW:
            out["n_repeat_words"] = exactly(tb.per_row(row[inside], n), data, offs, repeated_words)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > BASE_PERCENT * out["n_words"])
    fine = ~out["base_failed"] & (out["cover_lines"] <= LINE_SHARE) & (out["n_symbols"] <= SYMBOL_SHARE * out["word_chars"])
    for length, limit in NGRAM_LIMITS:
        fine &= out[f"cover_{length}"] <= limit
    return out | {"kept": fine}


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of measures and the verdict ``kept`` for each row of ``docs``."""
    plain = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tb.bytes_of(batch.column(1))
            for i, j, part, at in tb.blocks(data, offs):
                found = measure(part, at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *[pa.array(found[f.name]) for f in SCHEMA.fields[1:]]], names=SCHEMA.names)

    return plain.mapInArrow(run, SCHEMA)


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge_quality(documents(spark, sf_dir))
