"""Operator 7, byte-level BPE encoding and decoding by a monoid tree reduction.

``encode`` halves a text until a part has at most ``LEAF`` characters, encodes the parts and joins neighbours. At a join only a
window around the seam is encoded anew; it grows outwards until what lies outside provably can't change:

* Between texts, the window grows to the next position where a blank or line end follows a character that is no white space. The
  pattern's matches never run over such a position and look no further than it, so the matches, and with them the ids,
  on either side are those of the halves.
* A window without such a position can be as long as the text. It is split into matches first, by classes of characters that the
  tokenizer itself is asked for: pattern libraries don't agree on the letters and digits of recent Unicode versions.
* Inside one match, its bytes are halved instead. There the window
  grows by tokens, doubling, until the pair of tokens at either edge is stable: encoding the pair's bytes alone gives the pair
  again. A sequence all of whose neighbouring pairs are stable is the encoding of its bytes.

Decoding concatenates bytes up the same kind of tree; its operation is concatenation, so any tree gives the same bytes.

Defined cases: a null or empty text has no ids; rows are encoded each for itself; ids that aren't whole numbers are null; an empty table gives an empty result; other
columns are passed over. The ranks come from a file whose path is a parameter; every executor needs it at that path.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .shared import documents, text_of

#: Characters and bytes up to which a part is encoded at once, and the tokens of the first window inside a match.
LEAF, PIECE_LEAF, WINDOW = 512, 256, 4
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: What stands for a character of each class where a text is split: letter, number, other, white space; all of them old.
_LIKE = {"a": "é", "1": "²", ".": "§", "": "\u2003"}


class Coder:
    """Encodes and decodes with one rank file."""

    def __init__(self, path: str, pattern: str, leaf: int = LEAF, piece_leaf: int = PIECE_LEAF):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.edge = regex.compile(r"(?<=[^\s\x1c-\x1f\x85\u180e])(?=[\x20\n\r\t])")
        self.last_edge = regex.compile(r"(?r)(?<=[^\s\x1c-\x1f\x85\u180e])(?=[\x20\n\r\t])")
        pairs = [x + bytes([b]) for x in (b"a", b"1", b".") for b in range(128, 256)]
        self.probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)} | {x: 256 + k for k, x in enumerate(pairs)}, special_tokens={})
        self.like: dict[int, str] = {}
        self.leaf, self.piece_leaf = leaf, piece_leaf
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.bytes: list[bytes] = [b""] * len(self.lengths)
        for token, rank in ranks.items():
            self.lengths[rank], self.bytes[rank] = len(token), token
        self.names = [b"%d" % i for i in range(len(self.lengths))]
        self.stable = lru_cache(1 << 16)(self._stable)

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.leaf:
            return self.core.encode_ordinary(text)
        half = len(text) // 2
        return self.join(text[:half], self.encode(text[:half]), text[half:], self.encode(text[half:]))

    def class_of(self, char: str) -> str:
        """What stands for a character beyond ASCII: the class whose run it continues for the tokenizer."""
        return _LIKE[next((x for x in ("a", "1", ".") if self.probe.encode_ordinary(x + char)[0] >= 256), "")]

    def matches_ids(self, text: str) -> list[int]:
        for char in set(text) if not text.isascii() else ():
            if ord(char) > 127 and ord(char) not in self.like:
                self.like[ord(char)] = self.class_of(char)
        out: list[int] = []
        for match in self.pattern.finditer(text.translate(self.like)):
            out += self.encode_match(text[match.start() : match.end()].encode())
        return out

    def join(self, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
        """Ids of ``left + right``; only the text between the nearest edges on both sides of the seam is encoded anew."""
        before, after = self.last_edge.search(left), self.edge.search(right)
        at, to = before.start() if before else 0, after.start() if after else len(right)
        window = left[at:] + right[:to]
        keep = len(left_ids) - self.ids_within(reversed(left_ids), len(left[at:].encode()))
        drop = self.ids_within(right_ids, len(right[:to].encode()))
        middle = self.core.encode_ordinary(window) if len(window) <= self.leaf else self.matches_ids(window)
        return left_ids[:keep] + middle + right_ids[drop:]

    def ids_within(self, ids: Iterable[int], n_bytes: int) -> int:
        """How many of the first ids make up ``n_bytes``, an edge between tokens."""
        count = 0
        for i in ids:
            if n_bytes <= 0:
                break
            n_bytes -= len(self.bytes[i])
            count += 1
        return count

    def encode_match(self, raw: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        if len(raw) <= self.piece_leaf:
            return list(self.core._encode_single_piece(raw))
        half = len(raw) // 2
        return self.join_match(self.encode_match(raw[:half]), self.encode_match(raw[half:]))

    def _stable(self, a: int, b: int) -> bool:
        return list(self.core._encode_single_piece(self.bytes[a] + self.bytes[b])) == [a, b]

    def join_match(self, left: list[int], right: list[int]) -> list[int]:
        size = WINDOW
        while True:
            before, after = left[: max(0, len(left) - size)], right[size:]
            raw = b"".join(self.bytes[i] for i in left[len(before) :] + right[:size])
            middle = list(self.core._encode_single_piece(raw))
            settled = (not before or self.stable(before[-1], middle[0])) and (not after or self.stable(middle[-1], after[0]))
            if settled or not (before or after):
                return before + middle + after
            size *= 2

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return self.core.decode_bytes(ids)
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_CODERS: dict[tuple, Coder] = {}


def encoder(path: str, pattern: str | None = None, **sizes: int) -> Coder:
    """The coder of a rank file, built once in each process."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    key = (path, pattern, *sorted(sizes.items()))
    if key not in _CODERS:
        _CODERS[key] = Coder(path, pattern, **sizes)
    return _CODERS[key]


def encode_decode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded bytes; with ``ids`` also the ids themselves."""
    plain = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ranks_path)
        for batch in batches:
            data, offs = tb.bytes_of(batch.column(1))
            for i, j, part, at in tb.blocks(data, offs):
                cols: tuple[list, ...] = ([], [], [], [])
                for k in range(j - i):
                    found = coder.encode(part[at[k] : at[k + 1]].tobytes().decode())
                    cols[0].append(len(found))
                    cols[1].append(hashlib.sha256(b" ".join([coder.names[x] for x in found])).hexdigest())
                    cols[2].append(hashlib.sha256(coder.decode(found)).hexdigest())
                    if ids:
                        cols[3].append(found)
                arrays = [batch.column(0).slice(i, j - i), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    arrays.append(pa.array(cols[3], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return plain.mapInArrow(run, SCHEMA + (", ids array<int>" if ids else ""))


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))
