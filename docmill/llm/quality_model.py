"""Operator 6, quality classifier: a generalised additive model with pairwise interactions.

Features are shares and lengths measured on every whole text in numpy. They are cut into at most ``BINS`` bins by quantiles
of the training rows. Cyclic boosting fits one shallow step at a time: round after round, each feature in turn gets a
two-split tree (three leaves) on the residual of the logistic loss, added at a small rate to its lookup table over bins; then
the pairs of features that explain most of what is left get tables over coarser bins in the same way. Scoring adds up table
entries and is vectorised over documents.

Training rows are those of ``labels`` whose ``crc32(doc_id as text) % 3`` is not 1, at most ``TRAIN_ROWS`` labels, the smallest
by a hash of the id, and at most twice as many documents where ids repeat; this is the one bound here. Only their measures (some twenty numbers each) go to the driver. Labels, language,
source and ids are never inputs of a score.

Defined cases: a null or empty text has measures of 0 and gets a score like any other; rows that repeat an id are scored alike;
labels without a document or null labels are not used; ids of any type are compared as text; without training rows of both classes every score is the share of ones
(0.5 where there are no rows); an empty table gives an empty result; in ``score_rows`` all columns of the input come back.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbatch as tb
from .quality_rules import measure
from .shared import documents, fresh, text_of

TRAIN_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 48, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAST = 60, 30, 0.25, 20

_CLASS = np.zeros((4, 256), bool)
_CLASS[0, 65:91] = True
_CLASS[1, 48:58] = True
_CLASS[2, [c for c in range(33, 127) if not chr(c).isalnum()]] = True
_CLASS[3, list(b"!?|#*$%&<>{}[]=_~^\\/@+")] = True
FEATURES = ("log_words", "mean_word", "sd_word", "upper", "digits", "marks", "odd_marks", "distinct", "same_as_last", "top_word", "cover_4", "cover_8", "cover_lines", "word_in_line", "capital_words", "end_marks", "not_ascii")


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text of a block."""
    n = len(offs) - 1
    found = measure(data, offs)
    start, stop, row = tb.words(data, offs)
    nw = np.maximum(1, found["n_words"])
    chars = np.maximum(1, found["word_chars"])
    sizes = (stop - start).astype(float)
    mean = np.bincount(row, sizes, n) / nw
    spread = np.sqrt(np.maximum(0, np.bincount(row, sizes**2, n) / nw - mean**2))
    shares = []
    for k in range(4):
        run = np.concatenate([[0], np.cumsum(_CLASS[k][data])])
        shares.append((run[offs[1:]] - run[offs[:-1]]) / chars)
    prints = tb.names(data, start, stop)
    key = tb.mixed(prints ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    _, at, count = np.unique(key, return_index=True, return_counts=True)
    distinct = np.bincount(row[at], minlength=n) / nw
    top = np.zeros(n)
    np.maximum.at(top, row[at], count)
    same = np.zeros(len(row), bool)
    same[1:] = (prints[1:] == prints[:-1]) & (row[1:] == row[:-1])
    n_lines = np.concatenate([[0], np.cumsum(data == 10)])
    first = data[start] if len(start) else np.zeros(0, np.uint8)
    last = data[stop - 1] if len(stop) else np.zeros(0, np.uint8)
    high = np.concatenate([[0], np.cumsum(data >= 128)])
    out = np.stack([
        np.log1p(found["n_words"]), mean, spread, *shares, distinct, np.bincount(row[same], minlength=n) / nw, top / nw,
        found["cover_4"], found["cover_8"], found["cover_lines"], found["n_words"] / (1 + n_lines[offs[1:]] - n_lines[offs[:-1]]),
        np.bincount(row[_CLASS[0][first]], minlength=n) / nw, np.bincount(row[(last == 46) | (last == 33) | (last == 63)], minlength=n) / nw,
        (high[offs[1:]] - high[offs[:-1]]) / chars,
    ], 1)
    return out


class Additive:
    """The fitted model: bin edges, a table for each feature, tables for pairs."""

    def __init__(self, bias: float, n: int):
        self.bias, self.edges = bias, [np.zeros(0)] * n
        self.tables = [np.zeros(1)] * n
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        self.coarse: list[np.ndarray] = [np.zeros(1, np.int64)] * n

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], 1)

    def margin(self, b: np.ndarray) -> np.ndarray:
        out = np.full(len(b), self.bias)
        for k, table in enumerate(self.tables):
            out += table[b[:, k]]
        for i, j, table in self.pairs:
            out += table[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(self.bins(x)), -30, 30)))


def _step(g: np.ndarray, h: np.ndarray, c: np.ndarray, splits: int) -> np.ndarray:
    """A tree with ``splits`` splits over ordered bins: gradient, curvature and rows per bin to a value per bin."""
    cuts = [0, len(g)]
    for _ in range(splits):
        best = (1e-9, -1)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi - lo < 2:
                continue
            gl, hl, cl = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1], np.cumsum(c[lo:hi])[:-1]
            gt, ht, ct = g[lo:hi].sum(), h[lo:hi].sum(), c[lo:hi].sum()
            gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
            gain[(cl < LEAST) | (ct - cl < LEAST)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], lo + k + 1)
        if best[1] < 0:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + 1)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Cyclic boosting of the additive tables, then of the pairs that explain most of the residual."""
    ones = float(y.mean()) if len(y) else 0.5
    if ones in (0.0, 1.0) or not len(y):
        return Additive(float(np.log((ones + 1e-3) / (1 - ones + 1e-3))), len(FEATURES))
    model = Additive(float(np.log(ones / (1 - ones))), x.shape[1])
    model.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    b = model.bins(x)
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in sizes]
    model.coarse = [np.arange(s) * PAIR_BINS // s for s in sizes]
    margin = np.full(len(y), model.bias)
    rows = [np.bincount(b[:, k], minlength=s) for k, s in enumerate(sizes)]
    for _ in range(ROUNDS):
        for k, s in enumerate(sizes):
            p = 1 / (1 + np.exp(-margin))
            step = RATE * _step(np.bincount(b[:, k], y - p, s), np.bincount(b[:, k], p * (1 - p), s), rows[k], 2)
            model.tables[k] += step
            margin += step[b[:, k]]
    p = 1 / (1 + np.exp(-margin))
    cb = np.stack([model.coarse[k][b[:, k]] for k in range(len(sizes))], 1)
    gains = []
    for i in range(len(sizes)):
        for j in range(i):
            cell = cb[:, i] * PAIR_BINS + cb[:, j]
            g, h = np.bincount(cell, y - p, PAIR_BINS**2), np.bincount(cell, p * (1 - p), PAIR_BINS**2)
            gains.append((float((g**2 / (h + 1)).sum()), i, j))
    for _, i, j in sorted(gains, reverse=True)[:PAIRS]:
        model.pairs.append((i, j, np.zeros((PAIR_BINS, PAIR_BINS))))
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            p = 1 / (1 + np.exp(-margin))
            cell = cb[:, i] * PAIR_BINS + cb[:, j]
            g, h, c = (np.bincount(cell, w, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for w in (y - p, p * (1 - p), None))
            # A shallow tree on two features: one split of the first, then one of the second on either side.
            outer = _step(g.sum(1), h.sum(1), c.sum(1), 1)
            step = np.zeros_like(table)
            for value in np.unique(outer):
                part = outer == value
                step[part] = _step(g[part].sum(0), h[part].sum(0), c[part].sum(0), 1)
            table += RATE * step
            margin += RATE * step[cb[:, i], cb[:, j]]
    return model


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Measures and labels of at most ``rows`` labelled documents outside the held-out third."""
    keyed = labels.select(F.col(id_col).cast("string").alias("__key"), F.col(label_col).cast("int").alias("__y")).filter("__key IS NOT NULL AND __y IS NOT NULL").filter(F.crc32("__key") % 3 != 1)
    chosen = keyed.distinct().orderBy(F.xxhash64("__key"), "__key", "__y").limit(rows)
    picked = docs.select(F.col(id_col).cast("string").alias("__key"), text_of(text_col).alias("text")).join(F.broadcast(chosen), "__key").select(F.col("__y").cast("double").alias("y"), F.xxhash64("__key").alias("h"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tb.bytes_of(batch.column(2))
            for i, j, part, at in tb.blocks(data, offs):
                x = features(part, at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "h", "x"])

    table = picked.mapInArrow(run, "y double, h long, x array<double>").orderBy("h", "y").limit(2 * rows).toPandas()
    return (np.array(table["x"].tolist(), float).reshape(-1, len(FEATURES)), table["y"].to_numpy(float))


def score_rows(docs: DataFrame, model: Additive, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with all its columns and the score of each row; a column of the score's name is replaced."""
    docs = docs.drop(score_col)
    names = docs.columns
    at_text = names.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tb.bytes_of(batch.column(at_text))
            for i, j, part, at in tb.blocks(data, offs):
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in batch.columns], pa.array(model.score(features(part, at)))], names=[*names, score_col])

    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the model, trained on the labelled ones among them, doesn't reject."""
    model = fit(*training_rows(docs, labels, id_col, text_col))
    (score,) = fresh(docs.columns, "score")
    return score_rows(docs, model, text_col, score).filter(F.col(score) >= threshold).select(*docs.columns)


def op6_quality_model(spark, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(*training_rows(docs, labels))
    scored = score_rows(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1
