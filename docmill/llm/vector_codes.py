"""Operator 11, vector code compression: product codes, whose codebooks are learned by Yinyang Lloyd on whole numbers.

A vector becomes whole numbers ``floor(SCALE * x)`` and is cut into equal parts; a part's code is the nearest entry of the codebook of its
position. Rounds assign all parts, then replace each entry by the componentwise floored mean of its parts.

The assignment skips what can't change. The entries of a codebook are clustered into groups once. Each part of each vector carries, beside
its code, one lower bound for each group: no entry of the group but its own is nearer. After an update a bound falls by the group's largest
drift; only groups whose bound doesn't exceed the distance to the own entry are scanned. Bounds are kept in sixteenths, rounded down,
drifts are rounded up, and every decision compares whole squares, so the codes are those of a full search, ties to the lower
index. Bounds travel with the vectors as two bytes for each group.

A round is one pass over the stored vectors and their bounds (written to the shared folder anew, the old table deleted) and one over codes
for the sums, which tasks add up before the shuffle; entries times width sums reach the driver, whatever the table's size. The
start needs ``entries`` rows on the driver. Totals by label are joined back, by broadcast if few, else by a join that Spark can split.

Defined cases: vectors that are null or hold null or non-finite components are dropped; rows that repeat an id are rows of their own, those
with the smaller vector first at the start; rows without an id come last there; fewer vectors than entries give smaller codebooks; rows without a
label are one group; an empty table gives an empty result; other columns are ignored. Vectors of different widths, a width that the parts
don't divide and components beyond ``LIMIT`` after scaling are errors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.sources.tables import table

from .near_dedup import bounded
from .shared import discard, stash

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries for one group, and the largest component after scaling.
GROUP, LIMIT = 8, 1 << 24
#: Bounds are distances times this, at most MOST.
FINE, MOST = 16, 65_535
FAR = np.int64(1) << np.int64(62)


@dataclass(frozen=True)
class Codes:
    """rows: id, label, codes (a byte for each part), error; codebooks: whole numbers by part, entry, position."""

    rows: DataFrame
    codebooks: np.ndarray


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances (rows, entries), exact."""
    out = np.zeros((len(x), len(entries)), np.int64)
    for d in range(x.shape[1]):
        gap = x[:, d, None] - entries[None, :, d]
        out += gap * gap
    return out


def floored(square: np.ndarray) -> np.ndarray:
    """FINE times the root of whole squares, rounded down, at most MOST."""
    n = np.minimum(square, (MOST + 1) ** 2) * FINE**2
    root = np.floor(np.sqrt(n.astype(np.float64))).astype(np.int64)
    root -= root * root > n
    return np.minimum(root, MOST)


def grouped(entries: np.ndarray, size: int = GROUP) -> np.ndarray:
    """The group of each entry: a few rounds of clustering over entries alone."""
    n = max(1, len(entries) // size)
    centres = entries[:: max(1, len(entries) // n)][:n].astype(np.float64)
    for _ in range(5):
        near = ((entries[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
        for g in np.unique(near):
            centres[g] = entries[near == g].mean(0)
    return np.unique(near, return_inverse=True)[1]


def drifts(old: np.ndarray, new: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Each group's largest drift, FINE times, rounded up."""
    moved = [isqrt(max(0, int(n) * FINE**2 - 1)) + 1 if n else 0 for n in ((new - old) ** 2).sum(1)]
    return np.array([max(m for m, g in zip(moved, group, strict=True) if g == k) for k in range(group.max() + 1)], np.int64)


def full_search(x: np.ndarray, entries: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, squared distance, bounds by group) of each row of ``x``."""
    all_ = squares(x, entries)
    code = all_.argmin(1)
    rows = np.arange(len(x))
    own = all_[rows, code]
    all_[rows, code] = FAR
    low = np.stack([all_[:, group == g].min(1) for g in range(group.max() + 1)], 1)
    return code, own, floored(low)


def bounded_search(x: np.ndarray, entries: np.ndarray, group: np.ndarray, code: np.ndarray, low: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """As ``full_search`` from the codes and bounds of the round before, and the number of distances to entries of scanned groups."""
    was, gap = code, x - entries[code]
    own = (gap * gap).sum(1)
    low = np.maximum(low.astype(np.int64) - drift, 0)
    scan = low * low <= own[:, None] * FINE**2
    best, code, scanned = own.copy(), code.copy(), 0
    least, second = np.full(low.shape, FAR), np.full(low.shape, FAR)
    for g in range(low.shape[1]):
        rows = np.flatnonzero(scan[:, g])
        if not len(rows):
            continue
        members = np.flatnonzero(group == g)
        near = squares(x[rows], entries[members])
        scanned += near.size
        first = near.argmin(1)
        at = np.arange(len(rows))
        least[rows, g] = near[at, first]
        near[at, first] = FAR
        second[rows, g] = near.min(1)
        d, e = least[rows, g], members[first]
        wins = (d < best[rows]) | ((d == best[rows]) & (e < code[rows]))
        best[rows[wins]], code[rows[wins]] = d[wins], e[wins]
    # The own entry is no part of its group's bound; one that was left for an entry of another group is part of it again.
    holds = group[code][:, None] == np.arange(low.shape[1])
    low = np.where(scan, floored(np.where(holds, second, least)), low)
    left = np.flatnonzero(code != was)
    g = group[was[left]]
    low[left, g] = np.minimum(low[left, g], np.where(scan[left, g], MOST, floored(own[left])))
    return code, best, low, scanned


def packed(x: np.ndarray) -> pa.Array:
    """Rows of numbers as binary values."""
    x = np.ascontiguousarray(x)
    width = x.itemsize * int(np.prod(x.shape[1:]))
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(x)])


def unpacked(column: pa.Array, kind: str, *shape: int) -> np.ndarray:
    offs = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offs[0] : offs[-1]].view(kind).reshape(len(column), *shape)


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes:
    """Codes and errors of all vectors, and the codebooks. See the module for the method and the cases."""
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte")
    types = dict(vectors.dtypes)
    head = f"id {types[id_col]}, label {types[label_col]}"
    whole = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kept = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), whole.alias("v")).filter(F.col("v").isNotNull() & F.forall("v", finite))
    start = [r["v"] for r in kept.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]
    spark = vectors.sparkSession
    if not start:
        return Codes(spark.createDataFrame([], f"{head}, codes binary, error long"), np.zeros((parts, 0, 0), np.int64))
    width = len(start[0])
    if width % parts:
        raise ValueError(f"{parts} parts don't divide a width of {width}")

    def numbers(flat: np.ndarray, n: int) -> np.ndarray:
        if len(flat) != n * width:
            raise ValueError("vectors differ in width")
        x = np.floor(flat * scale)
        if len(x) and np.abs(x).max() > LIMIT:
            raise ValueError("a component is out of range")
        return x.astype(np.int64).reshape(n, parts, width // parts)

    flat = [x for v in start for x in v]
    books = np.ascontiguousarray(numbers(np.array(flat, float), len(start)).transpose(1, 0, 2))
    groups = [grouped(b) for b in books]
    wide = max(g.max() + 1 for g in groups)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            if any(lists.value_lengths().to_numpy(zero_copy_only=False) != width):
                raise ValueError("vectors differ in width")
            x = numbers(lists.flatten().to_numpy(zero_copy_only=False), len(batch))
            code, low = np.zeros((len(x), parts), np.uint8), np.zeros((len(x), parts, wide), np.uint16)
            for p in range(parts):
                code[:, p], _, found = full_search(x[:, p], books[p], groups[p])
                low[:, p, : found.shape[1]] = found
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed(x.astype(np.int32)), packed(code), packed(low)], names=["id", "label", "v", "codes", "low"])

    def again(old: np.ndarray, new: np.ndarray, last: bool):
        drift = [drifts(o, n, g) for o, n, g in zip(old, new, groups, strict=True)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = unpacked(batch.column(2), "<i4", parts, width // parts).astype(np.int64)
                code, low = unpacked(batch.column(3), "u1", parts).copy(), unpacked(batch.column(4), "<u2", parts, wide).copy()
                error = np.zeros(len(x), np.int64)
                for p in range(parts):
                    n = groups[p].max() + 1
                    code[:, p], own, low[:, p, :n], _ = bounded_search(x[:, p], new[p], groups[p], code[:, p], low[:, p, :n], drift[p])
                    error += own
                rest, names = ([pa.array(error)], ["error"]) if last else ([packed(low)], ["low"])
                vectors_ = [] if last else [batch.column(2)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *vectors_, packed(code), *rest], names=["id", "label", *["v"] * (not last), "codes", *names])

        return run

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """slot (of part and entry), place (-1: the count), total of all that the task holds."""
        total = np.zeros((parts * len(start), width // parts + 1), np.int64)
        for batch in batches:
            x = unpacked(batch.column(0), "<i4", parts, width // parts).astype(np.int64)
            slot = unpacked(batch.column(1), "u1", parts).astype(np.int64) + np.arange(parts) * len(start)
            np.add.at(total[:, 1:], slot.ravel(), x.reshape(-1, width // parts))
            total[:, 0] += np.bincount(slot.ravel(), minlength=len(total))
        at, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(place - 1, pa.int32()), pa.array(total[at, place])], names=["slot", "place", "total"])

    stored = f"{head}, v binary, codes binary, low binary"
    state = stash(kept.mapInArrow(first, stored), "vector-codes")
    for k in range(rounds):
        total = np.zeros((parts * len(start), width // parts + 1), np.int64)
        for r in state.select("v", "codes").mapInArrow(sums, "slot int, place int, total long").groupBy("slot", "place").agg(F.sum("total").alias("total")).collect():
            total[r["slot"], r["place"] + 1] = r["total"]
        count = total[:, :1].reshape(parts, len(start), 1)
        means = total[:, 1:].reshape(parts, len(start), -1) // np.maximum(count, 1)
        old, books = books, np.where(count > 0, means, books)
        last = k == rounds - 1
        moved = state.mapInArrow(again(old, books, last), f"{head}, codes binary, error long" if last else stored)
        new = stash(moved, "vector-codes")
        discard(state)
        state = new
    if not rounds:
        state = stash(state.mapInArrow(again(books, books, True), f"{head}, codes binary, error long"), "vector-codes")
    return Codes(state, books)


def restored(codes: Codes, scale: int = SCALE) -> DataFrame:
    """id, vector: the entries that the codes name, as components again."""
    books, types = codes.codebooks, dict(codes.rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = unpacked(batch.column(1), "u1", len(books))
            out = (np.concatenate([books[p][code[:, p]] for p in range(len(books))], 1) / scale).astype(np.float64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * np.int32(out.shape[1])), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "vector"])

    return codes.rows.select("id", "codes").mapInArrow(run, f"id {types['id']}, vector array<double>")


def books_digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all components as decimals, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    found = compress(table(spark, sf_dir, "embeddings"))
    totals = bounded(stash(found.rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors"))
    each = found.rows.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return each.select(F.col("id").alias("vec_id"), F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(books_digest(found.codebooks)).alias("codebooks_sha256"))


def _assign(books: str, last: bool) -> str:
    """SQL of (vec_id, part, v, e, d): the nearest entry of each part in ``books`` (part, e, c)."""
    return f"""SELECT vec_id, label, part, v, arg_min(e, [d, e]) AS e, min(d) AS d FROM (
  SELECT k.vec_id, k.label, k.part, k.v, b.e, CAST(list_sum(list_transform(range(1, len(k.v) + 1), lambda i: (k.v[i] - b.c[i]) * (k.v[i] - b.c[i]))) AS BIGINT) AS d
  FROM parts k JOIN {books} b USING (part)) GROUP BY ALL"""


def _update(books: str, assigned: str) -> str:
    """SQL of (part, e, c): entries of ``books`` replaced by the floored means of their parts in ``assigned``."""
    return f"""SELECT b.part, b.e, coalesce(m.c, b.c) AS c FROM {books} b LEFT JOIN (
  SELECT part, e, list(CAST(floor(total / n) AS BIGINT) ORDER BY i) AS c FROM (
    SELECT part, e, i, sum(v[i])::DOUBLE AS total, count(*) AS n FROM {assigned}, range(1, 5) t(i) GROUP BY ALL) GROUP BY ALL) m USING (part, e)"""


OP11_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, p AS part, v[p * 4 + 1 : p * 4 + 4] AS v FROM kept, range(0, 16) t(p)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, v AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
a0 AS MATERIALIZED ({_assign('b0', False)}),
b1 AS MATERIALIZED ({_update('b0', 'a0')}),
a1 AS MATERIALIZED ({_assign('b1', False)}),
b2 AS MATERIALIZED ({_update('b1', 'a1')}),
a2 AS MATERIALIZED ({_assign('b2', True)}),
coded AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id),
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, book
"""
