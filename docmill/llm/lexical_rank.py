"""Operator 13, ranked lexical search by windowed bucket scoring.

Documents are read once. Each becomes its number of terms and the counts of those of its terms that some item asks for; these rows are
stored, dealt to ranges of document ids and sorted by id. A task walks its rows in windows of ``WINDOW`` documents. In a window the rows
are turned into postings (term, place, part of the score); for each item the postings of its terms are added into an array of one number
a place, which fits a core's cache, beside the set of places that were met; what was met and isn't under the item's current
last is harvested into its heap. A task hands on the ``top`` best of each item; they meet in two steps, so that an item's rows of many tasks
don't pass one task at once.

Scores are whole numbers: a term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), where N counts the documents with a term and df those with this one;
a document's m is 100 - 25 + 25 n N div L, for its n terms among L; an occurrence of the term in the item adds w * ((10^9 tf) div (1000 tf + 12 m)).

Items are taken in blocks of ``BLOCK_TERMS`` distinct terms of items at most (or a single item), each block by a pass over the stored rows,
so what a task is sent doesn't grow with their number. Terms are chosen while texts are read if all items together ask for ``VOCABULARY`` at most;
beyond, all terms of all texts are stored. Long texts are split into terms piece by piece. A range of ids is cut by a hash where an id repeats.

Defined cases: null or empty texts have no terms, are no part of N and are never found, and an item without terms finds nothing; rows that
repeat an id are documents, or items, of their own, and so may fill several ranks; rows without an id come after all others of their score; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.sources.tables import table

from .shared import documents, stash, text_of

TOP = 20
#: Documents whose scores are gathered at once: 128 KB of numbers.
WINDOW = 16_384
#: Rows (item, term) of a block of items, and terms up to which documents are read for these alone.
BLOCK_TERMS, VOCABULARY = 200_000, 200_000
#: Ranges of ids have about so many rows.
RANGE_ROWS = 1 << 18
#: Bytes of a text that are split into terms at once.
PIECE = 1 << 20
_PART = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_TOPS = "item long, doc_null boolean, doc_id long, score long"


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, repeats kept, piece by piece: runs of ASCII letters and digits and of all other code points, A-Z lower-cased."""
    plain, at = text.translate(_PART), 0
    while at < len(plain):
        stop = at + PIECE
        if stop < len(plain):
            cut = plain.rfind(b" ", at, stop)
            stop = cut if cut > at else (plain.find(b" ", stop) + 1 or len(plain))
        yield plain[at:stop].split()
        at = stop


def counts(text: bytes) -> Counter:
    out: Counter = Counter()
    for piece in terms(text):
        out.update(piece)
    return out


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item (a number for each row), id, term, times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                found = counts(batch.column(2)[k].as_py().encode())
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[k], len(found)), pa.repeat(batch.column(1)[k], len(found)), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["item", "id", "term", "times"])

    plain = items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return plain.mapInArrow(run, f"item long, id {dict(items.dtypes)[id_col]}, term binary, times long")


def term_counts(docs: DataFrame, id_col: str, text_col: str, only: list[bytes] | None) -> DataFrame:
    """doc_id, n (all terms), terms, tfs (those of ``only``, if given) of every document that has terms."""
    known = None if only is None else frozenset(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, ends, names, tfs = [], [0], [], []
            for text in batch.column(1):
                found = counts(text.as_buffer().to_pybytes()) if text.is_valid else Counter()
                size.append(sum(found.values()))
                held = found if known is None else known & found.keys()
                names += held
                tfs += [found[t] for t in held]
                ends.append(len(names))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (pa.array(names, pa.binary()), pa.array(tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    plain = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return plain.mapInArrow(run, "doc_id long, n long, terms array<binary>, tfs array<long>").filter("n > 0")


class Heap:
    """The ``top`` best (score, doc_id) of an item: higher scores, then smaller ids, then ids at all."""

    def __init__(self, top: int):
        self.top, self.best = top, []

    def least(self) -> int:
        return self.best[0][0] if len(self.best) == self.top else 1

    def harvest(self, scores: np.ndarray, places: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        s = scores[places]
        at = np.flatnonzero(s >= self.least())
        if len(at) > self.top:
            p = places[at]
            at = at[np.lexsort((ids[p], none[p], -s[at]))[: self.top]]
        for k in at:
            p = places[k]
            row = (int(s[k]), not none[p], -int(ids[p]))
            if len(self.best) < self.top:
                heapq.heappush(self.best, row)
            elif row > self.best[0]:
                heapq.heapreplace(self.best, row)


def bucket_scores(asked: list[tuple[int, np.ndarray, np.ndarray]], vocabulary: list[bytes], n_docs: int, n_terms: int, top: int, window: int):
    """Function for mapInArrow: rows of term counts in order of their ids -> the best documents of each item of ``asked`` (item, numbers of its
    terms in ``vocabulary``, weights times repeats)."""
    values = pa.array(vocabulary, pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = [Heap(top) for _ in asked]
        held, rows = [], 0

        def work(parts: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(parts).combine_chunks()
            ids, none = t.column("doc_id").fill_null(0).to_numpy(), t.column("doc_id").is_null().to_numpy()
            n = t.column("n").to_numpy()
            m = 75 + (25 * n * n_docs) // n_terms
            lists = t.column("terms").combine_chunks()
            place = np.repeat(np.arange(len(n)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            term = pc.index_in(lists.flatten(), value_set=values).fill_null(-1).to_numpy(zero_copy_only=False)
            tf = t.column("tfs").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            part = (1_000_000_000 * tf) // (1000 * tf + 12 * m[place])
            order = np.argsort(term, kind="stable")
            place, part = place[order], part[order]
            bounds = np.searchsorted(term[order], np.arange(len(vocabulary) + 1))
            scores, met = np.zeros(len(n), np.int64), np.zeros(len(n), bool)
            for heap, (_, numbers, weights) in zip(heaps, asked, strict=True):
                for k, w in zip(numbers.tolist(), weights.tolist(), strict=True):
                    i, j = bounds[k], bounds[k + 1]
                    if i < j and w:  # a term's places are distinct
                        p = place[i:j]
                        scores[p] += w * part[i:j]
                        met[p] = True
                places = np.flatnonzero(met)
                if len(places):
                    heap.harvest(scores, places, ids, none)
                    scores[places] = 0
                    met[places] = False

        for batch in batches:
            while len(batch):
                head = batch.slice(0, window - rows)
                held.append(head)
                rows += len(head)
                batch = batch.slice(len(head))
                if rows == window:
                    work(held)
                    held, rows = [], 0
        if rows:
            work(held)
        out = [(item, not has, None if not has else -low, score) for heap, (item, _, _) in zip(heaps, asked, strict=True) for score, has, low in heap.best]
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], names=["item", "doc_null", "doc_id", "score"])

    return run


def best_of(found: DataFrame, top: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "doc_null", "doc_id", *["salt"] * ("salt" in found.columns))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def ranked(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", top: int = TOP, window: int = WINDOW, block_terms: int = BLOCK_TERMS, vocabulary: int = VOCABULARY) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents of every item. See the module for the method and the cases."""
    spark = docs.sparkSession
    asked = stash(item_terms(items, item_col, item_text), "item-terms")
    schema = f"{item_col} {dict(items.dtypes)[item_col]}, rank int, doc_id long, score long"
    distinct = asked.select("term").distinct()
    small = distinct.count() <= vocabulary
    only = [bytes(r["term"]) for r in distinct.collect()] if small else None
    rows = stash(term_counts(docs, id_col, text_col, only), "term-counts")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    if not size["n"]:
        return spark.createDataFrame([], schema)
    each = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = stash(asked.join(each, "term").select("item", "term", "times", "df"), "weighed-terms")

    salt = F.xxhash64("n", "terms")
    ranges = max(spark.sparkContext.defaultParallelism, size["n"] // RANGE_ROWS + 1)
    dealt = rows.withColumn("salt", salt).repartitionByRange(int(ranges), "doc_id", "salt").sortWithinPartitions("doc_id", "salt").drop("salt")
    walk = stash(dealt, "windows") if weighed.count() > block_terms else dealt
    found = None
    for block in _blocks(weighed, block_terms):
        words = sorted({t for _, t, _, _ in block})
        number = {t: k for k, t in enumerate(words)}
        by_item: dict[int, list[tuple[int, int]]] = {}
        for item, term, times, df in block:
            by_item.setdefault(item, []).append((number[term], times * math.floor(1000 * math.log((2 * size["n"] + 2) / (2 * df + 1)))))
        wanted = [(item, np.array([k for k, _ in x], np.int64), np.array([w for _, w in x], np.int64)) for item, x in by_item.items()]
        part = walk.mapInArrow(bucket_scores(wanted, words, size["n"], size["l"], top, window), _TOPS)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema)
    salted = stash(found.withColumn("salt", F.spark_partition_id() % 64), "item-tops")
    best = best_of(best_of(salted, top, "item", "salt").drop("rank"), top, "item")
    names = asked.select("item", "id").distinct()
    return best.join(names, "item").select(F.col("id").alias(item_col), "rank", "doc_id", "score")


def _blocks(weighed: DataFrame, most: int) -> Iterator[list[tuple[int, bytes, int, int]]]:
    """Rows (item, term, times, df) of whole items, up to ``most`` at a time unless one item has more, in order of the items."""
    block: list[tuple[int, bytes, int, int]] = []
    last: list[tuple[int, bytes, int, int]] = []
    for r in weighed.orderBy("item").toLocalIterator():
        if last and last[0][0] != r["item"]:
            if block and len(block) + len(last) > most:
                yield block
                block = []
            block, last = block + last, []
        last.append((r["item"], bytes(r["term"]), r["times"], r["df"]))
    if block and len(block) + len(last) > most:
        yield block
        block = []
    if block or last:
        yield block + last


def op13_lexical_rank(spark, sf_dir: str) -> DataFrame:
    return ranked(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


_TERM_SQL = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_TERM_SQL.format('text')} AS ts FROM documents),
size AS (SELECT count(*) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d WHERE len(ts) > 0),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERM_SQL.format('text')}) AS term FROM benchmark) GROUP BY ALL),
tf AS MATERIALIZED (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), size),
scored AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN w USING (term) JOIN tf USING (term), size GROUP BY ALL),
ranks AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranks WHERE rank <= 20
"""
