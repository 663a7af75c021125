"""Operator 12, near-duplicates by SimHash, compared at the anchors of covering codes.

A text's shingles of words get a 64-bit hash each (XXH64); a bit of its fingerprint is 1 if it is set in over half of them. Documents of one
fingerprint are one node; nodes that differ in ``DISTANCE`` = 3 bits or fewer are linked.

Anchors. A projection keeps some of the 64 bits, so chosen that three flips leave at most one of them in some projection (two
halves, see ``PROJECTIONS``). The anchors of a projection are the words of a covering code of radius 1: the perfect Hamming code on its first
31 bits, any value on the others. Each node has one home, the anchor within the radius, and visits every anchor within radius
plus threshold, 1 + 1: its home, the 15 words of the code at distance 2, and its home with one other bit flipped. So of two linked nodes
one visits the home of the other in some projection. At each anchor, those at home are compared with all visitors, bit by bit.

Crowded anchors. Where the comparisons of an anchor exceed ``CROWD`` times its visitors, a family of near copies stands there, whose pairs would square.
Crowded anchors that share visitors form a cluster (connected components). A member is then written as the set of bits in which it differs from the
cluster's centre, the bitwise majority of its members, and sends the sets that are left when up to three bits are taken away. Two members
that send one set after taking away i and j bits differ in i + j at most; linked ones send their common bits with i + j <= 3. So for each
set all members are linked to the one that took away least, if i + j <= 3: each link is true, all linked nodes end in one component, and rows grow with
members, not with their pairs. A member of many differences sends many sets; those over ``NEAR`` bits from the centre leave for the next round with those
they could be linked with, find anchors and clusters of their own, and after ``LEVELS`` rounds send all their sets whatever their number.

With more than ``WIDE`` nodes, six projections of 42 to 43 bits (four of six blocks) take the place of the halves, so that anchors outnumber nodes;
links are the same.

Defined cases: a null or empty text, or one without words, has fingerprint zero and is linked like any other; with fewer words than a shingle the whole sequence is the
one shingle; rows that repeat an id are rows of their own; ids that aren't whole numbers are null, and a component of such rows alone has a null
component_id; an empty table gives an empty result; other columns are ignored. Long texts are worked on in pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .near_dedup import bounded, components
from .shared import discard, documents, stash, text_of

SIZE, DISTANCE, SEED = 3, 3, 42
#: Nodes beyond which anchors are made of four blocks of six in place of halves.
WIDE = 1 << 26
#: Comparisons for each visitor of an anchor beyond which its visitors form a cluster.
CROWD = 16
#: Bits from the centre up to which members send sets at once, and rounds after which all do.
NEAR, LEVELS = 14, 4
#: Shingles whose bits are counted at once.
COUNTED = 1 << 16
#: Sets that are made at once.
SENT = 1 << 18
_BLOCKS = np.array_split(np.arange(64), 6)
#: Bits of each projection: halves; all but two of six blocks, such that of any three blocks two are left out together by one of them.
PROJECTIONS = {
    "halves": [np.arange(32), np.arange(32, 64)],
    "blocks": [np.concatenate([b for k, b in enumerate(_BLOCKS) if k not in left]) for trio in ((0, 1, 2), (3, 4, 5)) for left in combinations(trio, 2)],
}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = ~tb.SPACE


def fingerprints_of(data: np.ndarray, offs: np.ndarray, size: int) -> np.ndarray:
    """The fingerprint of each text of a block."""
    data, n = _LOWER[data], len(offs) - 1
    start, stop, row = tb.words(data, offs)
    word = _KEEP[data]
    keep = word.copy()
    keep[1:] |= word[:-1]  # of white space the first byte behind a word, as a space
    at = np.cumsum(keep, dtype=np.int64)
    plain = np.where(word, data, np.uint8(32))[keep].tobytes()
    count = np.bincount(row, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    take = np.where(count == 0, 0, np.maximum(1, count - size + 1))
    ends = np.cumsum(take)
    sums = np.zeros((n, 64), np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, int(take.sum()), COUNTED):
        k = np.arange(i, min(i + COUNTED, int(ends[-1])))
        of = np.searchsorted(ends, k, "right")
        begin = first[of] + k - (ends[of] - take[of])
        last = np.minimum(begin + size, first[of] + count[of]) - 1
        pairs = zip((at[start[begin]] - 1).tolist(), at[stop[last] - 1].tolist(), strict=True)
        hashes = np.fromiter((digest(plain[a:b], SEED) for a, b in pairs), np.uint64, len(k))
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)
        rows, head = np.unique(of, return_index=True)
        sums[rows] += np.add.reduceat(bits, head, axis=0, dtype=np.int64)
    return np.packbits(2 * sums > take[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """doc_id, node (the fingerprint as a signed number) of every row."""
    plain = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tb.bytes_of(batch.column(1))
            for i, j, part, at in tb.blocks(data, offs):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(fingerprints_of(part, at, size).view(np.int64))], names=["doc_id", "node"])

    return plain.mapInArrow(run, "doc_id long, node long")


def visited(nodes: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchors, at home) of shape (nodes, anchors) that each node visits in the projection to ``bits``: word of the code, then the other bits."""
    one = (nodes[:, None] >> (63 - bits).astype(np.uint64)) & np.uint64(1)
    value = (one << np.arange(len(bits), dtype=np.uint64)).sum(1, dtype=np.uint64)
    places = np.arange(1, 32, dtype=np.uint64)
    odd = np.bitwise_xor.reduce(np.where(one[:, :31] > 0, places, np.uint64(0)), axis=1)  # the place that is off, 0 for a word of the code
    flip = lambda place: np.where(place > 0, np.uint64(1) << (np.maximum(place, 1) - np.uint64(1)), np.uint64(0))
    home = value ^ flip(odd)
    out = [home]
    for i in places:  # two places that make up for the one that is off; each pair once
        other = odd ^ i
        out.append(np.where((odd > 0) & (other > i), value ^ flip(np.broadcast_to(i, odd.shape)) ^ flip(other), home))
    out += [home ^ (np.uint64(1) << np.uint64(k)) for k in range(31, len(bits))]
    anchors = np.stack(out, 1)
    at_home = np.zeros(anchors.shape, bool)
    at_home[:, 0] = True
    again = np.ones(anchors.shape, bool)
    again[:, 1:] = anchors[:, 1:] != home[:, None]
    return anchors, at_home, again


def visits(nodes: DataFrame, projections: list[np.ndarray]) -> DataFrame:
    """anchor, node, home: the anchors that each node visits in any projection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, bits in enumerate(projections):
                anchors, home, real = visited(x, bits)
                at, _ = np.nonzero(real)
                yield pa.RecordBatch.from_arrays([pa.array((anchors[real] << np.uint64(3) | np.uint64(k)).view(np.int64)), pa.array(x[at].view(np.int64)), pa.array(home[real])], names=["anchor", "node", "home"])

    return nodes.select("node").mapInArrow(run, "anchor long, node long, home boolean")


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is made by a shuffle, whatever size Spark takes it for: behind a step that makes many rows of one, and of packed
    columns, its estimate is far too low, and a broadcast passes the driver."""
    return df.hint("merge")


def compared(here: DataFrame) -> DataFrame:
    """(a, b): nodes at home that differ from a visitor of their anchor in DISTANCE bits or fewer."""
    home = here.filter("home").select("anchor", F.col("node").alias("a"))
    met = home.join(shuffled(here.select("anchor", F.col("node").alias("b"))), "anchor").filter("a != b")
    near = met.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def centred(members: DataFrame) -> DataFrame:
    """cluster, node, gap (bits in which the node differs from the majority of its cluster)."""
    counts = [F.sum(F.shiftrightunsigned("node", k).bitwiseAND(F.lit(1))).alias(f"b{k}") for k in range(64)]
    majority = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *counts)
    bits = [F.when(F.col(f"b{k}") * 2 > F.col("n"), F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for k in range(64)]
    centre = bits[0]
    for b in bits[1:]:
        centre = centre.bitwiseOR(b)
    joined = members.join(bounded(stash(majority.select("cluster", centre.alias("centre")), "centres")), "cluster")
    return joined.select("cluster", "node", F.col("node").bitwiseXOR(F.col("centre")).alias("gap"))


def sets_sent(members: DataFrame) -> DataFrame:
    """cluster, set, taken, node: the gaps of the members with up to DISTANCE bits taken away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, node, gap = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            bits = np.unpackbits(gap.view(np.uint64).astype(">u8").view(np.uint8)).reshape(-1, 64) > 0
            size = bits.sum(1)
            for n in np.unique(size).tolist():
                for taken in range(min(DISTANCE, n) + 1):
                    which = np.array(list(combinations(range(n), taken)), np.int64)
                    step = max(1, SENT // len(which))
                    all_ = np.flatnonzero(size == n)
                    for rows in (all_[i : i + step] for i in range(0, len(all_), step)):
                        place = np.uint64(1) << (63 - np.nonzero(bits[rows])[1].reshape(len(rows), n)).astype(np.uint64)
                        left = gap[rows].view(np.uint64)[:, None] ^ np.bitwise_or.reduce(place[:, which], axis=2)
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cluster[rows], len(which))), pa.array(left.ravel().view(np.int64)), pa.array(np.full(left.size, taken, np.int32)), pa.array(np.repeat(node[rows], len(which)))], names=["cluster", "set", "taken", "node"])

    return members.select("cluster", "node", "gap").mapInArrow(run, "cluster long, set long, taken int, node long")


def linked_in_clusters(members: DataFrame) -> DataFrame:
    """(a, b): links that connect all nodes of a cluster that differ in DISTANCE bits or fewer."""
    sent = stash(sets_sent(members), "sets")
    least = sent.groupBy("cluster", "set").agg(F.min(F.struct("taken", "node")).alias("l"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("cluster", "set", "l.taken", "l.node")
    leaders = least.select("cluster", "set", F.col("taken").alias("l_taken"), F.col("node").alias("l"))
    found = sent.join(shuffled(leaders), ["cluster", "set"]).filter((F.col("taken") + F.col("l_taken") <= DISTANCE) & (F.col("node") != F.col("l")))
    return found.select(F.least("node", "l").alias("a"), F.greatest("node", "l").alias("b"))


def links(nodes: DataFrame, projections: list[np.ndarray], crowd: int = CROWD, near: int = NEAR, levels: int = LEVELS) -> DataFrame:
    """(a, b): links among ``nodes`` (node, distinct) that connect all that differ in DISTANCE bits or fewer."""
    out = None
    for level in range(levels):
        all_ = visits(nodes, projections)
        met = all_.groupBy("anchor").agg(F.count(F.lit(1)).alias("here"), F.sum(F.col("home").cast("long")).alias("homes")).filter("here > 1 AND homes > 0")
        here = stash(all_.join(shuffled(met), "anchor"), "visits")
        found = compared(here.filter(F.col("homes") <= crowd))
        full = here.filter(F.col("homes") > crowd)
        if not full.limit(1).count():
            return found if out is None else out.unionByName(found)
        found = stash(found.distinct(), "links")
        out = found if out is None else out.unionByName(found)
        # Crowded anchors that share a visitor are one cluster. Anchors and nodes get different numbers: odd and even.
        first = full.groupBy("node").agg(F.min("anchor").alias("first"))
        joined = components(full.join(shuffled(first), "node").filter("anchor != first").select(F.col("anchor").alias("a"), F.col("first").alias("b")).distinct())
        of = first.join(bounded(joined).select(F.col("node").alias("first"), "comp"), "first", "left").select("node", F.coalesce("comp", "first").alias("cluster"))
        members = stash(centred(stash(of, "clusters")), "members")
        size = F.bit_count("gap")
        last = level == levels - 1
        out = out.unionByName(stash(linked_in_clusters(members if last else members.filter(size <= near)).distinct(), "links"))
        discard(here)
        if last:
            return out
        nodes = stash(members.filter(size > near - DISTANCE).select("node"), "far-nodes")
        if not members.filter(size > near).limit(1).count():
            return out
    return out


def simhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, wide: int = WIDE, **limits: int) -> DataFrame:
    """doc_id, fingerprint, component_id of every row. See the module for the method and the cases."""
    rows = stash(fingerprints(docs, id_col, text_col, size), "fingerprints")
    nodes = stash(rows.groupBy("node").agg(F.min("doc_id").alias("rep")), "nodes")
    projections = PROJECTIONS["halves" if nodes.count() <= wide else "blocks"]
    comps = components(links(nodes, projections, **limits))
    named = comps.join(shuffled(nodes), "node")
    least = stash(named.groupBy("comp").agg(F.min("rep").alias("least")), "least")
    linked = stash(comps.join(bounded(least), "comp").select(F.col("node").alias("of"), "least"), "linked")
    labelled = nodes.join(bounded(linked), F.col("node") == F.col("of"), "left").select(F.col("node").alias("of"), F.coalesce("least", "rep").alias("component_id"))
    # Fingerprints of many rows are the hot keys of this join; Spark splits them.
    each = rows.join(shuffled(labelled), F.col("node") == F.col("of"))
    return each.select("doc_id", F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id")


def op12_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    return simhash_duplicates(documents(spark, sf_dir))
