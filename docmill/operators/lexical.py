"""Full-text search: terms, inverted index, BM25 with two sets of constants, top-k.

A query batch is a table (qid, question). A row's terms are counted where the row is read, so postings (row, term, count) come without a
shuffle. ``text_index`` stores them; what is here works on any postings."""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.text import let
from docmill.scratch import stored

from .vectors import first_k

TERM = r"[\p{L}\p{N}]+"
#: Rows up to which the terms of a batch are broadcast (some 5 MB); beyond, their joins are shuffled.
BROADCAST_TERMS = 100_000
#: Postings that one task scores at once (some 24 bytes each), terms that are counted at once, and rows that are packed at once.
GROUP, COUNTED, PACKED = 2_000_000, 1_000_000, 1_000_000
#: Tasks for each core among which groups of postings are dealt, and groups that one task walks at most.
TASKS, WALKED = 4, 50
#: Questions that one task answers (of each it holds the best rows, some 24 bytes a row).
ASKED = 65_536
#: Questions that are worth a block of their own where there are more cores than parts.
ALONE = 512


@cache
def _accents() -> tuple[str, str]:
    """Letters that are a letter and marks, and those letters alone."""
    pairs = []
    for code in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and unicodedata.category(parts[0])[0] == "L" and all(unicodedata.category(x) == "Mn" for x in parts[1:]):
            pairs.append((chr(code), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(text: Column) -> Column:
    """In lower case and without accents."""
    return F.translate(F.lower(text), *_accents())


def terms(text: Column) -> Column:
    """Runs of letters and numbers, in lower case and without accents, repeats kept."""
    return F.regexp_extract_all(folded(text), F.lit(TERM), F.lit(0))


def query_terms(queries: DataFrame, text_col: str = "question") -> DataFrame:
    """qid, term, times: a term given twice counts twice."""
    return queries.select("qid", F.explode(terms(F.col(text_col))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_TERMS else df


def counted(ts: Column) -> Column:
    """array<struct<term, tf>>: each distinct term of an array and how often it holds it, in order. The array is sorted and walked once."""

    def of_sorted(s: Column) -> Column:
        last = F.slice(F.concat(F.array(F.lit(None).cast("string")), s), F.lit(1), F.size(s))
        changes = F.transform(F.zip_with(s, last, lambda t, p: F.when(~t.eqNullSafe(p), t)), lambda t, i: F.struct(i.alias("at"), t.alias("term")))

        def of_starts(first: Column) -> Column:
            ends = F.concat(F.slice(F.transform(first, lambda x: x["at"]), F.lit(2), F.size(s)), F.array(F.size(s)))
            return F.zip_with(first, ends, lambda x, z: F.struct(x["term"].alias("term"), (z - x["at"]).alias("tf")))

        return let(F.filter(changes, lambda x: x["term"].isNotNull()), of_starts)

    none = F.expr("cast(array() AS array<struct<term: string, tf: int>>)")
    return F.when(F.size(ts) > 0, let(F.array_sort(ts), of_sorted)).otherwise(none)


def all_terms(*text_cols: str) -> Column:
    """The terms of several columns of a row, one behind the other."""
    return F.concat(*[terms(F.coalesce(F.col(c), F.lit(""))) for c in text_cols or ("text",)])


def _accented_terms(*text_cols: str) -> Column:
    """The same with their accents, which ``_pairs`` takes away from each distinct term: that changes letters only, so runs stay what they are."""
    return F.concat(*[F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(TERM), F.lit(0)) for c in text_cols or ("text",)])


def term_rows(docs: DataFrame, key: str, *text_cols: str, more: tuple[str, ...] = ()) -> DataFrame:
    """key, dl (number of terms), runs (``counted``) of every row."""
    return docs.select(key, *more, all_terms(*text_cols).alias("ts")).select(key, *more, F.size("ts").alias("dl"), counted(F.col("ts")).alias("runs"))


def _pairs(ts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms, without accents, of arrays of terms in order; for each pair of term and row, by term, then row: the term's place, the row's place, the count."""
    coded = ts.flatten().dictionary_encode()
    plain = str.maketrans(*_accents())
    folded_ = pa.array([t if t.isascii() else t.translate(plain) for t in coded.dictionary.to_pylist()], pa.string()).dictionary_encode()
    coded = pa.DictionaryArray.from_arrays(folded_.indices.take(coded.indices), folded_.dictionary)
    row = np.repeat(np.arange(len(ts), dtype=np.int64), ts.value_lengths().fill_null(0).to_numpy())
    order = np.asarray(pa.compute.sort_indices(coded.dictionary))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    pairs, tf = np.unique(place[coded.indices.to_numpy()] * len(ts) + row, return_counts=True)
    return coded.dictionary.take(pa.array(order)), pairs // len(ts), pairs % len(ts), tf


def _counts(batch: pa.RecordBatch) -> Iterator[pa.Table]:
    """Rows of ``flat_rows`` for a batch whose last column is an array of terms: its rows, then its terms in order, by row."""
    head, ts = batch.columns[:-1], batch.column(batch.num_columns - 1)
    dl = ts.value_lengths().fill_null(0).cast(pa.int32())
    yield pa.table([*head, dl, pa.nulls(len(ts), pa.string()), pa.nulls(len(ts), pa.int32())], names=[*batch.schema.names[:-1], "dl", "term", "tf"])
    if len(ts.flatten()):
        known, place, row, tf = _pairs(ts)
        pairs, of, terms_ = row, pa.array(row), known.take(pa.array(place))
        none = [pa.nulls(len(pairs), c.type) for c in head[1:]]
        yield pa.table([head[0].take(of), *none, dl.take(of), terms_, pa.array(tf.astype(np.int32))], names=[*batch.schema.names[:-1], "dl", "term", "tf"])


def _few_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, whose last column is an array of terms, with some COUNTED terms together, one row at least."""
    for batch in batches:
        ends = np.cumsum(batch.column(batch.num_columns - 1).value_lengths().fill_null(0).to_numpy())
        at = 0
        while at < len(batch):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COUNTED, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def flat_rows(docs: DataFrame, key: str, *text_cols: str, more: tuple[str, ...] = ()) -> DataFrame:
    """key, ``more``, dl, term, tf: for every row one without a term, then one for each of its terms, in which ``more`` is null. Made in one pass and
    without a shuffle: the terms of a batch of rows are numbered, and pairs of row and number are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few_terms(batches):
            for table in _counts(batch):
                yield from table.to_batches()

    rows = docs.select(key, *more, _accented_terms(*text_cols).alias("ts"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in (key, *more)) + ", dl int, term string, tf int")


def term_figures(docs: DataFrame, *text_cols: str) -> DataFrame:
    """term, df, cf, max_tf over all rows. A batch of rows hands on a row for each of its terms and not for each posting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few_terms(batches):
            if len(batch.column(0).flatten()):
                known, place, _, tf = _pairs(batch.column(0))
                starts = np.searchsorted(place, np.arange(len(known)))
                figures = np.bincount(place, minlength=len(known)), np.add.reduceat(tf, starts), np.maximum.reduceat(tf, starts)
                yield pa.record_batch([known, *[pa.array(x.astype(np.int64)) for x in figures]], names=["term", "df", "cf", "max_tf"])

    some = docs.select(_accented_terms(*text_cols).alias("ts")).mapInArrow(run, "term string, df long, cf long, max_tf long")
    return some.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"), F.max("max_tf").alias("max_tf"))


def postings(docs: DataFrame, key: str, *text_cols: str) -> DataFrame:
    """key, term, tf, dl for every term of every row over all its text columns."""
    return flat_rows(docs, key, *text_cols).filter("term IS NOT NULL").select(key, "dl", "term", "tf")


def _weight(n: int, k1: float, floor: float | None, plus_one: bool) -> Column:
    """The weight of a term (df, times) in a question."""
    ratio = (n - F.col("df") + 0.5) / (F.col("df") + 0.5)
    idf = F.log(1 + ratio) if plus_one else F.greatest(F.log(ratio), F.lit(floor))
    return idf * F.col("times") * (k1 + 1)


def scores(wanted: DataFrame, found: DataFrame, key: str, n: int, avgdl: float, k1: float = 1.2, b: float = 0.75, floor: float | None = 1e-6, plus_one: bool = False) -> DataFrame:
    """qid, key, score over all rows that hold a query term. wanted: qid, term, times; found: the postings of these terms among ``n`` rows of
    ``avgdl`` terms. ``floor`` bounds the inverse document frequency from below; ``plus_one`` adds 1 inside its logarithm
    instead. Frequencies are joined to the batch's terms first, so each posting is joined once."""
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = wanted.join(df, "term").select("qid", "term", _weight(n, k1, floor, plus_one).alias("w"))
    dl = F.greatest(F.col("dl"), F.lit(1))
    part = F.col("w") * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * dl / F.lit(avgdl)))
    return found.join(F.broadcast(weighed) if wanted.count() <= BROADCAST_TERMS else weighed, "term").groupBy("qid", key).agg(F.sum(part).alias("score"))


def _best(posts: pa.Table, asks: pa.Table, k: int, avgdl: float, k1: float, b: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """qid, key, score of the ``k`` best of some rows for each question. posts: key, t, tf, dl of these rows; asks: qid, t, w."""
    key, t, tf, dl = (posts.column(c).to_numpy() for c in range(4))
    qid, asked, w = (asks.column(c).to_numpy() for c in range(3))
    rows, at = np.unique(key, return_inverse=True)
    order = np.lexsort((at, t))
    at, t, part = at[order], t[order], (tf / (tf + k1 * (1 - b + b * np.maximum(dl, 1) / avgdl)))[order]
    first = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (at[1:] != at[:-1])]))
    if len(first) < len(t):  # rows that share a key are one
        at, t, part = at[first], t[first], np.add.reduceat(part, first)
    begin, end = np.searchsorted(t, asked, "left"), np.searchsorted(t, asked, "right")
    order = np.lexsort((asked, qid))
    total, seen, out = np.zeros(len(rows)), np.zeros(len(rows), bool), []
    for run in np.split(order, np.flatnonzero(np.diff(qid[order])) + 1):
        total[:], seen[:] = 0, False
        for i in run:
            here = at[begin[i] : end[i]]
            total[here] += w[i] * part[begin[i] : end[i]]
            seen[here] = True
        hit = np.flatnonzero(seen)
        rank = -np.round(total[hit], 9)
        if len(hit) > k:
            near = rank <= np.partition(rank, k - 1)[k - 1]
            hit, rank = hit[near], rank[near]
        hit = hit[np.argsort(rank, kind="stable")[:k]]
        out.append((np.full(len(hit), qid[run[0]]), rows[hit], total[hit]))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def packed(columns: list[np.ndarray]) -> bytes:
    """Columns of whole numbers or doubles of one length, eight bytes a value, as compressed bytes: of whole numbers the steps from one to the next, byte
    by byte, so that sorted columns take next to nothing."""
    steps = [np.diff(c, prepend=c.dtype.type(0)) if c.dtype.kind == "i" else c for c in columns]
    return pa.compress(b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T.tobytes() for c in steps), codec="zstd", asbytes=True)


def unpacked(blocks: pa.Table, kinds: str) -> list[np.ndarray]:
    """The columns of all blocks (n, block), one block behind the other; ``kinds`` has a letter for each column: i or f."""
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    for n, block in zip(blocks.column("n").to_pylist(), blocks.column("block"), strict=True):
        whole = np.frombuffer(pa.decompress(block.as_buffer(), decompressed_size=8 * n * len(kinds), codec="zstd"), np.uint8).reshape(len(kinds), 8, n)
        for kind, values, column in zip(kinds, whole, out, strict=True):
            numbers = np.ascontiguousarray(values.T).view(f"{kind}8").ravel()
            column.append(np.cumsum(numbers) if kind == "i" else numbers)
    return [np.concatenate(c) if c else np.empty(0, f"{k}8") for k, c in zip(kinds, out, strict=True)]


def _blocks(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """part, n, block: rows (part and ``columns``, longs or doubles) packed in the order of ``by``, some PACKED rows of a task at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
            if held and (batch is None or sum(map(len, held)) >= PACKED):
                table, held = pa.Table.from_batches(held), []
                of = {c: table.column(c).to_numpy() for c in table.column_names}
                order = np.lexsort([of[c] for c in reversed(["part", *by])])
                runs = np.split(order, np.flatnonzero(np.diff(of["part"][order])) + 1)
                runs = [r for r in runs if len(r)]
                parts, sizes = pa.array([of["part"][r[0]] for r in runs], pa.int32()), pa.array(map(len, runs), pa.int32())
                for i, r in enumerate(runs):
                    yield pa.record_batch([parts[i : i + 1], sizes[i : i + 1], pa.array([packed([of[c][r] for c in columns])], pa.binary())], names=["part", "n", "block"])

    return rows.select("part", *columns).mapInArrow(run, "part int, n int, block binary")


def best(wanted: DataFrame, found: DataFrame, key: str, k: int, n: int, avgdl: float, k1: float = 1.2, b: float = 0.75, floor: float | None = 1e-6, plus_one: bool = False, group: int = GROUP, block: int = ASKED) -> DataFrame:
    """qid, key, score, rank of the ``k`` best rows of each question by the scores of ``scores``, ties by key; keys and qids are whole numbers.

    Pairs of question and row grow as the product of both and are never a table: postings are dealt by a hash of
    their row to parts of some ``group``, and a task walks its parts, adds up the scores of their rows for one question after the other and gives the best
    ones of all its parts only. Postings and questions go through the shuffle as packed blocks, a few bytes a row. The questions are dealt to blocks of some ``block``; those of a block go to each of its tasks and each task
    gives ``k`` rows a question, so the number of tasks goes by the cores, and by the postings only where a task would walk more than WALKED parts. Postings go to
    each block."""
    df = stored(found.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("t", F.monotonically_increasing_id()), "term-counts")
    size = df.agg(F.count(F.lit(1)).alias("terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings")).first()
    parts = max(1, -(-size["postings"] // group))
    cores, asking = found.sparkSession.sparkContext.defaultParallelism, wanted.select("qid").distinct().count()
    blocks = max(1, -(-asking // block), min(-(-cores // parts), asking // ALONE))  # few postings leave cores to the questions
    tasks = min(parts, max(-(-TASKS * cores // blocks), -(-parts // WALKED)))
    known = F.broadcast(df) if size["terms"] <= BROADCAST_TERMS else df
    long = lambda c: F.col(c).cast("long").alias(c)
    posts = found.join(known.select("term", F.col("t").alias("number")), "term").select(F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part"), F.col(key).cast("long").alias("key"), "number", long("tf"), long("dl"))
    asks = wanted.join(known, "term").select(F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("part"), long("qid"), "t", _weight(n, k1, floor, plus_one).cast("double").alias("w"))
    each = _blocks(asks, ["qid", "t", "w"], ["t", "qid"]).withColumnRenamed("part", "asked").withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))

    def run(p: pa.Table, a: pa.Table) -> pa.Table:
        names = ["qid", "key", "score"]
        out = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if len(a):
            asked = pa.table(unpacked(a, "iif"), names=["qid", "t", "w"])
            for part in pa.compute.unique(p.column("part")):
                posted = pa.table(unpacked(p.filter(pa.compute.equal(p.column("part"), part)), "iiii"), names=["key", "number", "tf", "dl"])
                out = first_k([out, _best(posted, asked, k, avgdl, k1, b)], k)
        return pa.table(list(out), names=names)

    dealt = _blocks(posts, ["key", "number", "tf", "dl"], ["number", "key"]).withColumn("task", F.pmod("part", F.lit(tasks))).withColumn("asked", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    scored = dealt.groupBy("task", "asked").cogroup(each.groupBy("task", "asked")).applyInArrow(run, "qid long, key long, score double")
    return top_k(stored(scored, "best-rows").withColumnRenamed("key", key), key, k)


def bm25(docs: DataFrame, queries: DataFrame, key: str, *text_cols: str, **constants) -> DataFrame:
    """qid, key, score of a batch of questions against rows that no index holds: their postings are made for the batch."""
    wanted = stored(query_terms(queries), "query-terms")
    rows = stored(term_rows(docs, key, *text_cols), "term-rows")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    found = rows.select(key, "dl", F.inline("runs")).join(_small(wanted.select("term").distinct()), "term", "left_semi")
    return scores(wanted, found, key, size["n"], size["avgdl"] or 1.0, **constants)


def top_k(scored: DataFrame, key: str, k: int, score: str = "score") -> DataFrame:
    """The k best rows of each query with their rank; scores equal to nine places are ties, which go by key."""
    w = Window.partitionBy("qid").orderBy(F.round(score, 9).desc(), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
