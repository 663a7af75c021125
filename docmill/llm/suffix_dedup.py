"""Operator 5, suffix-array dedup: removal of every byte that a repeated string of ``length`` bytes covers.

The suffix order is needed only to a depth of ``length`` bytes and only as far as it tells repeated strings from unique ones, so
this is prefix doubling cut down to that: positions get ranks, a rank being a 64-bit name of the string of some length that
starts there; names meet across the corpus by a shuffle on their value, positions whose name is unique drop out, and those
that are left get names of longer strings until they are unique or the length is ``length``.

* Round 1, ``GRAM`` bytes, at sampled positions: each window of ``length`` bytes elects the position of its least gram name
  (rightmost on ties). Equal windows elect equal grams at equal places, so a window can be repeated only if the name of
  its elected gram is. Consecutive windows with one elected position form a run, about one run for 68 bytes.
* Round 2, the whole stretch of a run (``length`` to about ``2 * length`` bytes): runs whose pair of names (gram, stretch) is repeated
  are repeated as a whole. What is left are runs that share their gram but not their stretch.
* Round 3, ``length`` bytes, at every position of such runs, and of one run for each distinct stretch they could match.

Names of a length are made of the names of two shorter strings, as ranks are. They travel packed: a bucket of whole texts
(about ``BUCKET`` bytes, by hash) sends an array of names to each part of the name space, and gets back one code or bit for each name
in the same order, so positions never travel. A bucket sends a gram and a pair once, however often it holds them: grams go to
parts by gram, pairs by gram and stretch. So a passage that a third of all texts share is one name for each bucket, and the pairs
at its edges, which differ from text to text, are dealt to all parts; no group of rows is gathered by a common gram. Texts are
shuffled to their buckets once, and Spark reuses that exchange in all three passes.

Names are made under secret keys that the driver draws for each run (``textbatch.names``), so no texts can be built that share one. What removes
bytes rests on two of them: runs are compared by gram and by the name of their whole stretch, windows by the names of all their grams and by a name of
their bytes under an independent key, which any two different windows share for one key in 2^64 whatever the first names are.

Defined cases: a null or empty text has no bytes and one digest; texts under ``length`` bytes keep all; repeated rows are texts of their
own and so repeat each other; ids that aren't whole numbers are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .shared import documents, text_of

LENGTH, GRAM = 200, 64
#: Bytes of text in a bucket, and bytes of text whose names meet in one part.
BUCKET, PART = 4 << 20, 16 << 20
NAMES = "round int, part int, bucket long, names binary"
REPLY = "bucket long, round int, part int, codes binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

UNIQUE, REPEATED, REPEATED_SENDS, OPEN_SENDS = 0, 1, 2, 3
#: Messages and their answers: grams, pairs of gram and stretch, windows.
GRAMS, PAIRS, WINDOWS = 1, 2, 3


def elected(names: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` consecutive names, the position of the least (of its upper half), rightmost on ties."""
    low = np.uint64(0xFFFFFFFF)
    best = (names & ~low) | (low - np.arange(len(names), dtype=np.uint64))
    done = 1
    while done * 2 <= width:
        best = np.minimum(best[:-done], best[done:])
        done *= 2
    if width > done:
        best = np.minimum(best[: done - width], best[width - done :])
    return (low - (best & low)).astype(np.int64)


class Block:
    """The runs of the windows of a block of texts."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, length: int, gram: int, keys: tuple[bytes, bytes] = (b"", b"2")):
        self.data, self.offs, self.length, self.keys = data, offs, length, keys
        grams = self.grams = tb.doubled(data, gram, keys[0])
        self.gram = gram
        count = np.maximum(0, np.diff(offs) - length + 1)
        self.first = np.concatenate([[0], np.cumsum(count)])
        total = int(self.first[-1])
        if total:
            at = elected(grams, length - gram + 1)
            self.window = np.arange(total) + np.repeat(offs[:-1] - self.first[:-1], count)
            at = at[self.window]
            new = np.ones(total, bool)
            new[1:] = at[1:] != at[:-1]
            self.run = np.flatnonzero(new)
            self.size = np.diff(np.append(self.run, total))
            begin = self.window[self.run]
            self.key = grams[at[self.run]]
            self.stretch = tb.names(data, begin, begin + length + self.size - 1, keys[1])
        else:
            self.window = self.run = self.size = np.zeros(0, np.int64)
            self.key = self.stretch = np.zeros(0, np.uint64)

    def sending(self, codes: np.ndarray) -> np.ndarray:
        """Which windows are compared in round 3."""
        return np.repeat(codes >= REPEATED_SENDS, self.size)

    def names(self, which: np.ndarray) -> np.ndarray:
        """Two names for each window: by its grams, and by its bytes."""
        at = self.window[which]
        places = [*range(0, self.length - self.gram, self.gram), self.length - self.gram]
        return np.stack([tb.joined([self.grams[at + p] for p in places], self.keys[0]), tb.names(self.data, at, at + self.length, self.keys[1])])


def _ordered(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """ids, bytes and offsets of a bucket in an order that each pass finds again."""
    table = table.select(["doc_id", "text"]).combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    data, offs = tb.bytes_of(table.column("text"))
    return table.column("doc_id").combine_chunks(), data, offs


def _sent(round_: int, bucket: int, part: np.ndarray, names: list[np.ndarray]) -> pa.Table:
    """One row of names for each part; several arrays of names are laid one after the other."""
    order = np.argsort(part, kind="stable")
    parts, begin = np.unique(part[order], return_index=True)
    ends = np.append(begin, len(order))[1:]
    names = [x[order] for x in names]
    packed = [b"".join(x[i:j].tobytes() for x in names) for i, j in zip(begin, ends, strict=True)]
    n = len(parts)
    return pa.table({"round": pa.array([round_] * n, pa.int32()), "part": pa.array(parts, pa.int32()), "bucket": pa.array([bucket] * n, pa.int64()), "names": pa.array(packed, pa.binary())})


def _part(names: np.ndarray, parts: int) -> np.ndarray:
    return ((names >> np.uint64(40)) % np.uint64(parts)).astype(np.int32)


def _new(*sorted_: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    out = np.ones(len(sorted_[0]), bool)
    if len(out) > 1:
        out[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in sorted_])
    return out


class Runs:
    """The runs of a bucket by distinct gram and by distinct pair of gram and stretch."""

    def __init__(self, key: np.ndarray, stretch: np.ndarray, parts: int):
        order = np.lexsort((stretch, key))
        k, s = key[order], stretch[order]
        new_key, new_pair = _new(k), _new(k, s)
        n_key, n_pair = np.cumsum(new_key) - 1, np.cumsum(new_pair) - 1
        self.gram_of, self.pair_of, self.first = (np.empty(len(k), x) for x in (np.int64, np.int64, bool))
        self.gram_of[order], self.pair_of[order], self.first[order] = n_key, n_pair, new_pair
        self.grams, self.pair_key, self.pair_stretch = k[new_key], k[new_pair], s[new_pair]
        # The only stretch of a gram here, or 0 for several; what a part has to know beside is whether there are several runs.
        several = np.bincount(n_key[new_pair], minlength=len(self.grams)) > 1
        self.only = np.where(several, np.uint64(0), s[new_key])
        self.often = (np.bincount(n_key, minlength=len(self.grams)) > 1).astype(np.uint64)
        self.twice = (np.bincount(n_pair, minlength=len(self.pair_key)) > 1).astype(np.uint64)
        self.gram_part = _part(self.grams, parts)
        self.pair_part = _part(tb.mixed(self.pair_key + self.pair_stretch), parts)

    def messages(self, bucket: int) -> pa.Table:
        """A flag goes in the lowest bit of a name, which loses nothing that a comparison of 63 bits, and of another name, would miss."""
        grams = _sent(GRAMS, bucket, self.gram_part, [(self.grams << np.uint64(1)) | self.often, self.only])
        pairs = _sent(PAIRS, bucket, self.pair_part, [(self.pair_key << np.uint64(1)) | self.twice, self.pair_stretch])
        return pa.concat_tables([grams, pairs])

    def codes(self, reply: pa.Table) -> np.ndarray:
        """A code for each run."""
        gram, pair = _answers(reply, GRAMS, self.gram_part)[self.gram_of], _answers(reply, PAIRS, self.pair_part)[self.pair_of]
        repeated = np.where((gram == 2) & (pair == 2) & self.first, REPEATED_SENDS, REPEATED)
        return np.where(gram == 0, UNIQUE, np.where(pair > 0, repeated, OPEN_SENDS)).astype(np.uint8)


def judge_grams(tagged: np.ndarray, only: np.ndarray) -> np.ndarray:
    """For grams of all buckets: 0 for one that a single run has, 1 for one with a single stretch, 2 for one with several."""
    key, often = tagged >> np.uint64(1), (tagged & np.uint64(1)).astype(bool)
    order = np.lexsort((only, key))
    k, s = key[order], only[order]
    no = np.cumsum(_new(k)) - 1
    runs = np.bincount(no, 1 + often[order])
    several = (np.bincount(no, _new(k, s)) > 1) | (np.bincount(no, s == 0) > 0)
    out = np.empty(len(k), np.uint8)
    out[order] = np.where(runs == 1, 0, np.where(several, 2, 1))[no]
    return out


def judge_pairs(tagged: np.ndarray, stretch: np.ndarray) -> np.ndarray:
    """For pairs of all buckets: 0 for one that a single run has, else 1, and 2 in the first bucket that holds it."""
    key, twice = tagged >> np.uint64(1), (tagged & np.uint64(1)).astype(bool)
    order = np.lexsort((stretch, key))
    new = _new(key[order], stretch[order])
    no = np.cumsum(new) - 1
    runs = np.bincount(no, 1 + twice[order])
    out = np.empty(len(key), np.uint8)
    out[order] = np.where(runs[no] == 1, 0, np.where(new, 2, 1))
    return out


def judge_windows(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Which windows of all buckets are repeated, by both names."""
    out = tb.repeated(first)
    at = np.flatnonzero(out)
    order = at[np.lexsort((second[at], first[at]))]
    new = _new(first[order], second[order])
    no = np.cumsum(new) - 1
    out[order] = np.bincount(no)[no] > 1
    return out


def _meet(table: pa.Table) -> pa.Table:
    """What a part answers to the buckets that sent it names."""
    table = table.sort_by("bucket")  # two passes compute this answer, and must find the same
    round_, buckets, part = table.column("round")[0].as_py(), table.column("bucket").to_pylist(), table.column("part")[0].as_py()
    sent = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("names").combine_chunks()]
    judge = {GRAMS: judge_grams, PAIRS: judge_pairs, WINDOWS: judge_windows}[round_]
    code = judge(np.concatenate([x[: len(x) // 2] for x in sent]), np.concatenate([x[len(x) // 2 :] for x in sent]))
    ends = np.cumsum([len(x) // 2 for x in sent])
    packed = [(np.packbits(x) if round_ == WINDOWS else x).tobytes() for x in np.split(code, ends[:-1])]
    n = len(buckets)
    return pa.table({"bucket": pa.array(buckets, pa.int64()), "round": pa.array([round_] * n, pa.int32()), "part": pa.array([part] * n, pa.int32()), "codes": pa.array(packed, pa.binary())})


def _answers(reply: pa.Table, round_: int, part: np.ndarray) -> np.ndarray:
    """The codes of a bucket's names, back in their own order."""
    out = np.zeros(len(part), np.uint8)
    if not len(part):
        return out
    order = np.argsort(part, kind="stable")
    parts, begin = np.unique(part[order], return_index=True)
    where = dict(zip(parts.tolist(), np.split(order, begin[1:]), strict=True))
    for r, p, codes in zip(*(reply.column(c).to_pylist() for c in ("round", "part", "codes")), strict=True):
        if r == round_:
            at = where[p]
            x = np.frombuffer(codes, np.uint8)
            out[at] = np.unpackbits(x, count=len(at)) if round_ == WINDOWS else x
    return out


def _cat(parts: list[np.ndarray], kind=np.uint64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _side_by_side(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts, 1) if parts else np.zeros((2, 0), np.uint64)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, bucket_bytes: int = BUCKET, part_bytes: int = PART, texts: bool = False) -> DataFrame:
    """One row per document: its bytes, those removed, the maximal runs removed, a digest of the rest; with ``texts`` the
    bytes that are left, too. See the module for the method and the cases."""
    plain = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, parts = total // bucket_bytes + 1, total // part_bytes + 1
    keys = tb.fresh_key(), tb.fresh_key()
    dealt = plain.select(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(buckets)).alias("bucket"), "doc_id", "text")

    def blocks_of(table: pa.Table):
        ids, data, offs = _ordered(table)
        return [(i, j, Block(part, at, length, gram, keys)) for i, j, part, at in tb.blocks(data, offs)], ids

    def judged(found: list, reply: pa.Table) -> list[np.ndarray]:
        """Codes of the runs, block by block."""
        if not found:
            return []
        codes = Runs(_cat([b.key for *_, b in found]), _cat([b.stretch for *_, b in found]), parts).codes(reply)
        return np.split(codes, np.cumsum([len(b.key) for *_, b in found])[:-1])

    def send_runs(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found, _ = blocks_of(table)
        return Runs(_cat([b.key for *_, b in found]), _cat([b.stretch for *_, b in found]), parts).messages(key[0].as_py())

    def send_windows(key: tuple[pa.Scalar, ...], table: pa.Table, reply: pa.Table) -> pa.Table:
        found, _ = blocks_of(table) if table.num_rows else ([], None)
        names = _side_by_side([b.names(b.sending(c)) for (*_, b), c in zip(found, judged(found, reply), strict=True)])
        return _sent(WINDOWS, key[0].as_py() if found else 0, _part(names[0], parts), [*names])

    def finish(key: tuple[pa.Scalar, ...], table: pa.Table, reply: pa.Table) -> pa.Table:
        found, ids = blocks_of(table) if table.num_rows else ([], pa.array([], pa.int64()))
        code_of = judged(found, reply)
        which = [b.sending(c) for (*_, b), c in zip(found, code_of, strict=True)]
        names = [b.names(w) for (*_, b), w in zip(found, which, strict=True)]
        bits = _answers(reply, WINDOWS, _part(_side_by_side(names)[0], parts))
        bit_of = np.split(bits, np.cumsum([x.shape[1] for x in names])[:-1]) if found else []
        size, removed, spans, digest, rest = [], [], [], [], []
        for (_, _, b), c, w, bit in zip(found, code_of, which, bit_of, strict=True):
            twice = np.repeat((c == REPEATED) | (c == REPEATED_SENDS), b.size)
            twice[np.flatnonzero(w)[bit > 0]] = True
            delta = np.zeros(len(b.data) + 1, np.int32)
            start = b.window[twice]
            delta[start] += 1
            np.subtract.at(delta, start + length, 1)
            gone = np.cumsum(delta[:-1]) > 0
            before = np.zeros(len(gone), bool)
            before[1:] = gone[:-1]
            before[b.offs[:-1][b.offs[:-1] < len(gone)]] = False
            n_gone, n_spans = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, gone & ~before))
            size.append(np.diff(b.offs))
            removed.append(np.diff(n_gone[b.offs]))
            spans.append(np.diff(n_spans[b.offs]))
            kept, at = b.data[~gone].tobytes(), b.offs - n_gone[b.offs]
            pieces = [kept[at[k] : at[k + 1]] for k in range(len(at) - 1)]
            digest += [hashlib.sha256(x).hexdigest() for x in pieces]
            rest += pieces if texts else []
        out = {"doc_id": ids, "n_bytes": pa.array(_cat(size, np.int64), pa.int64()), "n_removed": pa.array(_cat(removed, np.int64), pa.int64()), "n_spans": pa.array(_cat(spans, np.int64), pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        return pa.table(out | ({"rest": pa.array(rest, pa.binary())} if texts else {}))

    by_bucket = dealt.groupBy("bucket")
    first = by_bucket.applyInArrow(send_runs, NAMES).groupBy("round", "part").applyInArrow(_meet, REPLY)
    third = by_bucket.cogroup(first.groupBy("bucket")).applyInArrow(send_windows, NAMES).groupBy("round", "part").applyInArrow(_meet, REPLY)
    answers = first.unionByName(third)
    return by_bucket.cogroup(answers.groupBy("bucket")).applyInArrow(finish, RESULT + (", rest binary" if texts else ""))


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
