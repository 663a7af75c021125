"""Operator 9, near-duplicates by HyperMinHash.

Texts become sets of word shingles in numpy. Each set has ``REGISTERS`` registers: the minimum of one hash over the set, kept as its
count of leading zeros and ``MANTISSA`` bits behind them, 16 bits in all, four of them in one 64-bit number. That number is a
band: sets with a Jaccard index of 0.8 share none of the 32 bands with a chance of (1 - 0.8^4)^32, about 5e-8.

1. Documents with equal sets form a class at once; only one sketch of each class goes on.
2. In a band bucket, members are paired with one leader, never with one another, so a bucket of n gives n - 1 pairs. The leader is
   the member whose buckets hold most members, that is the one in the middle of a family, so over all its
   buckets a member meets one or two leaders, and a family of copies of one text is linked at once.
3. Pairs are estimated by their registers, corrected for registers that agree by chance, and go on unless the estimate is five
   standard errors under the threshold; then their full sets (64-bit names) decide. Verified links give connected components
   (min-label propagation with pointer jumping on tables).
4. What is left are members of buckets that hold several components. Between them an exact prefix join finds what the leaders missed.
   Shingles get one order, those that a single component has first, then the rare ones, so common ones come last. Two sets that
   reach the threshold share a shingle among the first ``n - 0.8 n + 1`` of each, and from the first one that they share on, at
   most what follows it in either set is common, which bounds the index. Members that no partner in a shingle's list could make
   up for leave the list before any pair is made; pairs that pass the bound are estimated and verified.

So every pair that shares a band is verified, already connected, or proved or estimated to be under the threshold. An edit of a text
makes rare shingles, so members of a family that are too far from its middle leave the lists of the shingles that all have. Pairs grow
with the square of a family only where its members hold nearly the same, frequent shingles and still aren't linked.

Shuffles: keys and row numbers for bands; full sets only of classes that share a bucket. Joins with a hot leader or key are
plain equi-joins, which Spark splits when skewed; counts are pre-aggregated. Tables between steps are written to the shared folder.

Defined cases: a null or empty text, or one without words, has an empty set and is linked with nothing; with fewer words than
a shingle the whole sequence is the one shingle; rows that repeat an id are separate rows, whose links count for the id; rows
without an id are linked like others, and a component of such rows alone has a null component_id; ids are of any type that has an order; an
empty table gives an empty result; other columns are ignored.

Shingles travel as 64-bit names under a secret key that the driver draws for each run (``textbatch.names``): no texts can be built whose
shingles share one, and among the shingles of two given texts some do with a chance of their number squared over 2^64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .shared import discard, documents, keep_rows, stash, text_of

REGISTERS, ROWS, MANTISSA = 128, 4, 10
BANDS = REGISTERS // ROWS
#: Chance that registers of different minima agree: the sum over all register values of the square of their share.
CHANCE = 2.0**-MANTISSA / 6
#: Standard errors that an estimate may lie under the threshold.
ERRORS = 5
#: Rows up to which a table of numbers is broadcast (under 8 MB); beyond, its joins are shuffled.
BROADCAST_ROWS = 10_000
_GEN = np.random.Generator(np.random.PCG64(991))
_XOR = _GEN.integers(0, 2**32, REGISTERS, dtype=np.uint32)
_MUL = _GEN.integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(data: np.ndarray, offs: np.ndarray, size: int, key: bytes = tb.HERE) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit name) of the distinct shingles of every text of a block, sorted by row and name."""
    data = _LOWER[data]
    start, stop, row = tb.words(data, offs)
    run = tb.Prints(tb.names(data, start, stop, key))
    n = len(offs) - 1
    count = np.bincount(row, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    take = np.where(count == 0, 0, np.maximum(1, count - size + 1))
    begin = np.arange(take.sum()) + np.repeat(first - np.concatenate([[0], np.cumsum(take)])[:-1], take)
    of_row = np.repeat(np.arange(n), take)
    end = np.minimum(begin + size, np.repeat(first + count, take))
    names = run.of(begin, end)
    order = np.lexsort((names, of_row))
    of_row, names = of_row[order], names[order]
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (of_row[1:] != of_row[:-1])
    return of_row[new], names[new]


def registers(low: np.ndarray) -> np.ndarray:
    """16-bit registers of 32-bit minima: leading zeros, then the bits behind the first one."""
    zeros = 31 - np.floor(np.log2(np.maximum(low, 1).astype(np.float64))).astype(np.int64)
    shifted = (low.astype(np.uint64) << (zeros + 1).astype(np.uint64)) & np.uint64(0xFFFFFFFF)
    return ((zeros.astype(np.uint64) << np.uint64(MANTISSA)) | (shifted >> np.uint64(32 - MANTISSA))).astype(np.uint16)


def sketch(row: np.ndarray, names: np.ndarray, n: int) -> np.ndarray:
    """REGISTERS registers for each of ``n`` texts (zeros for an empty set), packed into BANDS numbers. One hash at a time."""
    out = np.zeros((n, REGISTERS), np.uint16)
    full, first = np.unique(row, return_index=True)
    if len(full):
        x = (names >> np.uint64(16)).astype(np.uint32)
        for k in range(REGISTERS):
            y = (x ^ _XOR[k]) * _MUL[k]
            y ^= y >> np.uint32(15)
            y *= _MUL[k - 1]
            out[full, k] = registers(np.minimum.reduceat(y, first))
    return out.view(np.int64)


def differing(a: str, b: str) -> Column:
    """Number of registers in which two sketches (arrays of BANDS numbers) differ, by operations on whole numbers."""
    lowest = F.lit(0x0001000100010001)

    def one(p: Column, q: Column) -> Column:
        z = p.bitwiseXOR(q)
        for step in (1, 2, 4, 8):  # the lowest bit of a register gathers all its bits
            z = z.bitwiseOR(F.shiftright(z, step))
        return F.bit_count(z.bitwiseAND(lowest))

    return F.aggregate(F.zip_with(a, b, one), F.lit(0), lambda total, n: total + n)


def may_reach(a: str, b: str, threshold: float) -> Column:
    """Whether sketches differ in few enough registers for a Jaccard index of ``threshold``: the collision-corrected estimate
    ``(equal share - CHANCE) / (1 - CHANCE)`` is no more than ERRORS standard errors under it."""
    equal = threshold + (1 - threshold) * CHANCE
    return differing(a, b) <= int(REGISTERS * (1 - equal) + ERRORS * (REGISTERS * equal * (1 - equal)) ** 0.5) + 1


def class_names(names: np.ndarray, count: np.ndarray) -> list[bytes | None]:
    """16-byte names of sets, given one after the other with their sizes; None for an empty one."""
    ends = np.concatenate([[0], np.cumsum(count)])
    sums = []
    for x in (names, tb.mixed(names ^ np.uint64(0x5555555555555555))):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)])
        sums.append(tb.mixed((total[ends[1:]] - total[ends[:-1]]) ^ (count.astype(np.uint64) << np.uint64(40))))
    both = np.stack(sums, 1)
    return [both[k].tobytes() if count[k] else None for k in range(len(count))]


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int, secret: bytes) -> DataFrame:
    """doc_id, n, cls (16-byte name of the set, null for an empty one), sig (packed registers), key (hash of the text)."""
    plain = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("key", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tb.bytes_of(batch.column(1))
            for i, j, part, at in tb.blocks(data, offs):
                n = j - i
                row, names = shingles(part, at, size, secret)
                count = np.bincount(row, minlength=n)
                sig = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(sketch(row, names, n).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(count, pa.int64()), pa.array(class_names(names, count), pa.binary()), sig, batch.column(2).slice(i, n)], names=["doc_id", "n", "cls", "sig", "key"])

    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, n long, cls binary, sig array<long>, key long")


def full_sets(docs: DataFrame, text_col: str, size: int, secret: bytes) -> DataFrame:
    """cls, set (the shingles' 64-bit names) of every text that has shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tb.bytes_of(batch.column(0))
            for i, j, part, at in tb.blocks(data, offs):
                row, names = shingles(part, at, size, secret)
                count = np.bincount(row, minlength=j - i)
                sets = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(names.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(class_names(names, count), pa.binary()), sets], names=["cls", "set"])

    return docs.select(text_of(text_col).alias("text")).mapInArrow(run, "cls binary, set array<long>").filter("cls IS NOT NULL")


def bounded(df: DataFrame) -> DataFrame:
    """A stored table of names, to be broadcast if its counted size allows; else it is shuffled whatever the session's own limit is, as the
    driver holds each broadcast and a loop makes many of them."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the least node that each node reaches over ``edges`` (a, b)."""
    both = stash(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stash(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("comp")), "labels")
    while True:
        known = bounded(labels)
        near = both.join(known.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        low = near.join(known, "node").select("node", F.least("comp", "near").alias("low"), "comp")
        jump = low.join(known.select(F.col("node").alias("low"), F.col("comp").alias("next")), "low")
        old = labels
        new = stash(jump.select("node", F.least("low", "next").alias("comp"), (F.least("low", "next") != F.col("comp")).alias("moved")), "labels")
        labels = new.select("node", "comp")
        labels.stash_path = new.stash_path
        moved = new.filter("moved").limit(1).count()
        discard(old)
        if not moved:
            discard(both)
            return labels


def verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that reach the threshold: estimated first, then on their full sets."""
    sig = lambda c: classes.select(F.col("c").alias(c), F.col("sig").alias(f"{c}_sig"))
    full = lambda c: sets.select(F.col("c").alias(c), F.col("set").alias(f"{c}_set"))
    near = pairs.join(sig("a"), "a").join(sig("b"), "b").filter(may_reach("a_sig", "b_sig", threshold)).select("a", "b")
    joined = near.join(full("b"), "b").join(full("a"), "a")
    common = F.size(F.array_intersect("a_set", "b_set")).cast("long")
    return joined.filter(common * 100 >= (F.size("a_set") + F.size("b_set") - common) * round(100 * threshold)).select("a", "b")


def led_pairs(bands: DataFrame) -> DataFrame:
    """(a, b): every member of a bucket with the bucket's leader. bands: key, c, in_key (members of the bucket)."""
    middle = bands.groupBy("c").agg(F.sum("in_key").alias("middle"))
    leaders = bands.join(middle, "c").groupBy("key").agg(F.max(F.struct("middle", "c"))["c"].alias("l"))
    return _sorted(bands.join(leaders, "key").filter("c != l"), "l", "c")


def open_classes(bands: DataFrame, comps: DataFrame, classes: DataFrame) -> DataFrame:
    """c, comp, n of the members of buckets that still hold several components."""
    member = bands.select("key", "c").join(bounded(comps).select(F.col("node").alias("c"), "comp"), "c", "left").select("key", "c", F.coalesce("comp", "c").alias("comp"))
    several = member.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("key")
    return member.join(several, "key", "left_semi").select("c", "comp").distinct().join(classes.select("c", "n"), "c")


def rarest_first(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """s, c, comp, n, at: the shingles at the head of each set, in one order for all sets, in which shingles of a single component come
    first and then the rare ones. The head is long enough to hold a shingle in common with any set that reaches the threshold."""
    each = sets.join(members, "c").select("c", "comp", "n", F.explode("set").alias("s"))
    rank = F.when(F.min("comp") == F.max("comp"), 0).otherwise(F.count(F.lit(1)))
    ranked = each.join(each.groupBy("s").agg(rank.alias("rank")), "s")
    per = ranked.groupBy("c", "comp", "n").agg(F.array_sort(F.collect_list(F.struct("rank", "s"))).alias("all"))
    head = F.slice("all", F.lit(1), (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int"))
    return per.select("c", "comp", "n", F.posexplode(head).alias("at", "x")).filter("x.rank > 0").select("x.s", "c", "comp", "n", "at")


def across(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs of different components that share a shingle of their heads and, by what follows it, may reach the threshold."""
    percent = round(100 * threshold)
    heads = stash(rarest_first(members, sets, percent), "heads")
    for _ in range(2):  # a member that could not make up for what comes before the shingle, with the smallest partner, leaves it
        per = heads.groupBy("s").agg(F.min("n").alias("least"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("s", "least")
        rest = F.col("n") - F.col("at")
        kept = heads.join(per, "s").filter(rest * 100 >= (F.col("n") + F.greatest("least", rest) - rest) * percent).drop("least")
        old, heads = heads, stash(kept, "heads")
        discard(old)
    x, y = heads.toDF("s", "a", "a_comp", "a_n", "a_at"), heads.toDF("s", "b", "b_comp", "b_n", "b_at")
    most = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))
    met = x.join(y, "s").filter((F.col("a_comp") < F.col("b_comp")) & (most * 100 >= (F.col("a_n") + F.col("b_n") - most) * percent))
    return _sorted(met, "a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key (hash of the text), component (its number, null without words) for every row. See the module for the method and the cases."""
    secret = tb.fresh_key()
    rows = stash(sketches(docs, id_col, text_col, size, secret), "sketches")
    least_row = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "key")))
    classes = rows.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.coalesce(least_row["key"], F.min("key")).alias("rep_key"), F.min("sig").alias("sig"), F.min("n").alias("n"))
    classes = stash(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    bands = classes.select("c", "rep", "rep_key", F.posexplode("sig").alias("band", "value")).select("c", "rep", "rep_key", "band", F.xxhash64("band", "value").alias("key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("in_key")).filter("in_key > 1")
    bands = stash(bands.join(shared, "key"), "bands")

    # A class is read from the text of its least id; one whose rows all lack an id, from any of them by the hash of its text.
    wanted = stash(bands.select(F.col("rep").alias("id"), F.col("rep_key").alias("of")).distinct(), "wanted")
    told = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    named = told.join(wanted.select("id").distinct().hint("merge"), "id", "left_semi").select("text")
    lacking = wanted.filter("id IS NULL").select("of")
    odd = _repeats_ids(rows)  # one id can then bear several sets, and several rows one
    sets = full_sets(named, "text", size, secret)
    if lacking.limit(1).count():
        unnamed = told.filter("id IS NULL").withColumn("of", F.xxhash64(text_of("text"))).join(lacking.distinct().hint("merge"), "of", "left_semi")
        sets, odd = sets.unionByName(full_sets(unnamed, "text", size, secret)), True
    if odd:
        sets = sets.dropDuplicates(["cls"])
    sets = stash(sets.join(classes.select("cls", "c"), "cls").select("c", "set"), "sets")

    edges = stash(verified(led_pairs(bands), classes, sets, threshold), "links")
    comps = components(edges)
    members = stash(open_classes(bands, comps, classes), "open-classes")
    found = stash(verified(across(members, sets, threshold), classes, sets, threshold), "links")
    if found.limit(1).count():
        comps = components(edges.unionByName(found))

    named = comps.join(classes.select(F.col("c").alias("node"), "rep"), "node")
    least = stash(named.groupBy("comp").agg(F.min("rep").alias("least")), "least")
    linked = stash(comps.join(bounded(least), "comp").select(F.col("node").alias("c"), "comp", "least"), "linked")
    labelled = classes.select("cls", "c", "rep").join(bounded(linked), "c", "left").select("cls", F.coalesce("least", "rep").alias("least"), F.coalesce("comp", "c").alias("component"))
    # Classes of many rows are the hot keys of this join; Spark splits them.
    final = rows.select("doc_id", "n", "cls", "key").join(labelled, "cls", "left")
    comp = F.coalesce("least", "doc_id")
    return final.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.col("doc_id").eqNullSafe(comp).alias("kept"), F.col("key").alias("text_key"), "component")


def _sorted(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _repeats_ids(rows: DataFrame) -> bool:
    """Whether some id has several rows."""
    return rows.groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one row of each component, the one of the least id; its columns are unchanged. Of rows that share that id and are in the
    component, the one whose text has the least hash stays, and of rows that are equal in both one. Rows without words are
    linked with nothing, so one of each id stays."""
    found = near_duplicates(docs, id_col, text_col, size, threshold)
    rows = stash(found.select(F.col("doc_id").alias("id"), "component", "kept", F.col("text_key").alias("key")), "near-judged")
    winners = stash(rows.filter("kept").groupBy("id", "component").agg(F.min("key").alias("key")), "near-kept")
    return keep_rows(docs, id_col, rows.select("id"), winners.select("id", "key"), F.xxhash64(text_of(text_col)))


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = near_duplicates(docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text"), size=4)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                                      ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' ')) END)) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM n
  UNION
  SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON reach.y = both_ways.x
), comp AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(comp.component_id, w.doc_id) AS component_id, coalesce(comp.component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
"""
