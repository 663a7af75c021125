"""Operator 1, token counts by offset-mapped attribution.

Every whole text is encoded once. Token character spans follow from the byte lengths of the ids; sections are joined to them
as intervals (binary search of sorted starts), and a token that crosses a section boundary is allocated by an explicit rule:

* ``start``: to the section that holds its first byte (the default of the query),
* ``most``: to the section that holds most of its bytes, the earlier one on a tie,
* ``split``: to every section that it touches, in proportion to bytes (fractional counts).

Sections are the lines of a text (each with its line feed), or spans given in a column of (start, stop) code points, in any order;
where spans overlap, the bytes belong to the one that starts first (of equal starts, the one given first), so every token counts
once; empty spans are left out. Tokens outside all spans count in ``n_outside``.

Defined cases: a null or empty text has no sections and no tokens; ties and repeated rows are counted each for itself;
an empty table gives an empty result; a null span list counts as no spans; ids that aren't whole numbers are null; other columns are passed
over. Work is per row;
nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .bpe import encoder
from .shared import documents, text_of

RULES = ("start", "most", "split")
SCHEMA = "doc_id long, n_tokens long, n_sections long, n_crossing long, n_outside double, section_tokens array<double>"


def allocate(starts: np.ndarray, stops: np.ndarray, lo: np.ndarray, hi: np.ndarray, rule: str) -> tuple[np.ndarray, int, float]:
    """(tokens per section, tokens over a boundary, tokens outside) for token intervals, sorted, and section intervals, in any order."""
    order = np.argsort(lo, kind="stable")
    upto = np.concatenate([[0], np.maximum.accumulate(hi[order])[:-1]]) if len(lo) else lo
    cut = np.maximum(lo[order], upto)
    real = cut < hi[order]
    counts, crossing, outside = _allocated(starts, stops, cut[real], hi[order][real], rule)
    out = np.zeros(len(lo))
    out[order[real]] = counts
    return out, crossing, outside


def _allocated(starts: np.ndarray, stops: np.ndarray, lo: np.ndarray, hi: np.ndarray, rule: str) -> tuple[np.ndarray, int, float]:
    """The same for sections that are sorted and disjoint."""
    out = np.zeros(len(lo))
    if not len(starts):
        return out, 0, 0.0
    if not len(lo):
        return out, 0, float(len(starts))
    first = np.searchsorted(hi, starts, "right")
    last = np.searchsorted(lo, stops, "left") - 1
    whole = (first == last) & (lo[np.minimum(first, len(lo) - 1)] <= starts) & (hi[np.minimum(first, len(lo) - 1)] >= stops)
    out += np.bincount(first[whole], minlength=len(lo))[: len(lo)]
    outside = float((first > last).sum())
    crossing = np.flatnonzero(~whole & (first <= last))
    if rule == "start":
        held = lo[first[crossing]] <= starts[crossing]
        np.add.at(out, first[crossing][held], 1)
        return out, len(crossing), outside + float((~held).sum())
    for t in crossing:
        s = np.arange(first[t], last[t] + 1)
        part = np.minimum(hi[s], stops[t]) - np.maximum(lo[s], starts[t])
        if rule == "split":
            out[s] += part / (stops[t] - starts[t])
            outside += 1 - part.sum() / (stops[t] - starts[t])
        else:
            out[s[np.argmax(part)]] += 1
    return out, len(crossing), outside


def line_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte intervals of the lines of a text, line feeds included."""
    cut = np.flatnonzero(raw == 10) + 1
    edges = np.unique(np.concatenate([[0], cut, [len(raw)]]))
    return edges[:-1], edges[1:]


def count_tokens(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", spans_col: str | None = None, rule: str = "start") -> DataFrame:
    """One row per document: tokens of the whole text, and of each section as an array. See the module for rules and cases."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    spans = F.col(spans_col).cast("array<struct<start:int,stop:int>>") if spans_col else F.lit(None).cast("array<struct<start:int,stop:int>>")
    plain = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), text_of(text_col).alias("text"), spans.alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ranks_path)
        for batch in batches:
            data, offs = tb.bytes_of(batch.column(1))
            given = batch.column(2).to_pylist() if spans_col else None
            rows: list[tuple] = []
            for i in range(len(offs) - 1):
                raw = data[offs[i] : offs[i + 1]]
                stops = np.cumsum(coder.lengths[np.asarray(coder.encode(raw.tobytes().decode()), np.int64)]) if len(raw) else np.zeros(0, np.int64)
                starts = np.concatenate([[0], stops[:-1]]) if len(stops) else stops
                if given is None:
                    lo, hi = line_spans(raw)
                else:
                    at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
                    pairs = np.array([(s["start"], s["stop"]) for s in given[i] or () if s and s["stop"] > s["start"]], np.int64).reshape(-1, 2)
                    lo, hi = at[np.clip(pairs[:, 0], 0, len(at) - 1)], at[np.clip(pairs[:, 1], 0, len(at) - 1)]
                counts, crossing, outside = allocate(starts, stops, lo, hi, rule)
                rows.append((len(stops), len(lo), crossing, outside, counts))
            if rows:
                cols = [*(pa.array(x) for x in ([r[k] for r in rows] for k in range(4))), pa.array([r[4] for r in rows], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), cols[0].cast(pa.int64()), cols[1].cast(pa.int64()), cols[2].cast(pa.int64()), cols[3].cast(pa.float64()), cols[4]], names=["doc_id", "n_tokens", "n_sections", "n_crossing", "n_outside", "section_tokens"])

    return plain.mapInArrow(run, SCHEMA)


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    whole = F.transform("section_tokens", lambda x: x.cast("long"))
    return found.select("doc_id", "n_tokens", "n_sections", "n_crossing", whole.alias("section_tokens"))
