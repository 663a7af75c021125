"""Operator 8, secret scans by a linear-chain conditional random field.

Base: assignments, access keys and hex strings by pattern. Method: the words of a whole text are tagged as secret begin (B), inside
(I) or outside (O) by a conditional random field over features of a word's shape, of the words beside it and of the file; the
tags are the most likely sequence (Viterbi). Tagged stretches that overlap no base span are added.

Training is supervised by construction: ``TRAIN_DOCS`` texts of the corpus (the smallest by a hash of the id; of a text over ``TRAIN_CHARS``
code points a stretch of that size, which begins where a hash of the id says; these two are the bound of the sample) get made-up secrets and look-alikes (addresses, numbers, dates,
long words) all along, after every ``GAP`` words; their own base spans count as secrets too. No other real secrets are in training.
All words of these stretches train, in chunks of ``CHUNK``. The ids are chosen first, so only the chosen texts go to the driver. The
weights maximise the penalised conditional likelihood, with exact gradients by forward-backward.

Decoding is exact but skips most words: where no stretch around a word could make up for tagging it, O is certain, and such words
cut a text into short stretches that are decoded at once, side by side, in numpy.

Defined cases: a null or empty text has no spans; ties between tag sequences go to the earlier tag in the order O, B, I;
repeated rows are scanned each for itself; ids that aren't whole numbers are null; an empty table trains on the made-up words alone and gives an empty result; other
columns are passed over. Work is per row; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .shared import documents, text_of

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 6, 20, 24
TRAIN_DOCS, TRAIN_CHARS, CHUNK, STEPS = 300, 20_000, 32, 80
#: Words of a training text before the next made-up one, at least and at most.
GAP = (4, 60)
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_tagged long"

_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key", b"api-key", b"bearer", b"credential", b"private")
_UPPER, _LOW, _DIGIT, _HEX, _BASE64 = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = _LOW[97:123] = _DIGIT[48:58] = True
_HEX[list(b"0123456789abcdef")] = True
_BASE64[list(b"+/_-=.")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
O, B, I = 0, 1, 2  # noqa: E741
_NEVER = -1e4
FEATURES = (
    "bias", "len10", "len16", "len24", "len40", "digits3", "digit_share", "mixed_case", "three_classes", "upper_digits", "hex_like", "base64_marks",
    "switches4", "switches8", "assigns_inside", "keyword", "ends_with_sign", "address", "numeric", "not_ascii", "plain_letters",
    "last_keyword", "last_ends_with_sign", "last_is_sign", "last_odd", "next_odd", "next_keyword", "file_digits", "file_signs",
)


def _all(haystack: bytes, needle: bytes) -> list[int]:
    out, at = [], haystack.find(needle)
    while at >= 0:
        out.append(at)
        at = haystack.find(needle, at + 1)
    return out


def base_spans(data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, start, kind number, stop) in bytes of the block, sorted."""
    raw, lower = data.tobytes(), _LOWER[data].tobytes()
    out = []
    hex_start, hex_stop, hex_row = tb.runs(_HEX[data], offs)
    long = hex_stop - hex_start >= HEX_MIN
    out += [(int(r), int(a), 2, int(z)) for a, z, r in zip(hex_start[long], hex_stop[long], hex_row[long], strict=True)]
    hits = [p for w in (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key") for p in _all(lower, w)]
    for r in np.unique(np.searchsorted(offs, hits, "right") - 1) if hits else ():
        out += [(int(r), m.start() + int(offs[r]), 0, m.end() + int(offs[r])) for m in ASSIGN.finditer(raw[offs[r] : offs[r + 1]]) if len(m[2]) >= ASSIGN_MIN]
    hits = _all(raw, b"AKIA")
    for r in np.unique(np.searchsorted(offs, hits, "right") - 1) if hits else ():
        out += [(int(r), m.start() + int(offs[r]), 1, m.end() + int(offs[r])) for m in ACCESS.finditer(raw[offs[r] : offs[r + 1]]) if len(m[0]) >= ACCESS_MIN]
    return sorted(out)


def word_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, row, matrix of FEATURES as float32) of the words of a block."""
    start, stop, row = tb.words(data, offs)
    n = len(start)

    def count(mask: np.ndarray) -> np.ndarray:
        run = np.zeros(len(data) + 1, np.int32)
        np.cumsum(mask, out=run[1:])
        return run[stop] - run[start]

    size = stop - start
    kind = _UPPER[data] + 2 * _LOW[data] + 3 * _DIGIT[data]
    digit, upper, low = count(kind == 3), count(kind == 1), count(kind == 2)
    switch = np.zeros(len(data), bool)
    switch[1:] = ((kind[1:] == 3) != (kind[:-1] == 3)) | ((kind[1:] == 1) & (kind[:-1] == 2))
    switches = count(switch)
    hexes, marks, high, sign = count(_HEX[data]), count(_BASE64[data]), count(data >= 128), count((data == 61) | (data == 58))
    keyword = np.zeros(n, bool)
    lower = _LOWER[data].tobytes()
    hits = np.array([p for w in _KEYWORDS for p in _all(lower, w)], np.int64)
    if len(hits) and n:
        keyword[np.clip(np.searchsorted(start, hits, "right") - 1, 0, n - 1)] = True
    last = data[stop - 1] if n else np.zeros(0, np.uint8)
    ends = (last == 61) | (last == 58)
    odd = (size >= 10) & (digit >= 2) & (upper + low >= 2)
    new = np.ones(n, bool)
    new[1:] = row[1:] != row[:-1]

    def of_last(x: np.ndarray) -> np.ndarray:
        out = np.zeros(n, bool)
        out[1:] = x[:-1]
        return out & ~new

    def of_next(x: np.ndarray) -> np.ndarray:
        out = np.zeros(n, bool)
        out[:-1] = x[1:] & ~new[1:]
        return out

    texts = len(offs) - 1
    chars = np.maximum(1, np.diff(offs))
    file_digits = (np.bincount(row, digit, texts) / chars > 0.02)[row] if n else new
    file_signs = (np.bincount(row, sign, texts) / chars > 0.01)[row] if n else new
    cols = [
        np.ones(n, bool), size >= 10, size >= 16, size >= 24, size >= 40, digit >= 3, 4 * digit >= size, (upper >= 2) & (low >= 2), (upper >= 1) & (low >= 1) & (digit >= 1),
        (upper >= 4) & (digit >= 2) & (low == 0), (hexes >= size - 2) & (size >= 16) & (digit >= 3), marks >= 2, switches >= 4, switches >= 8, (sign > ends) & (size >= 8),
        keyword, ends, count(data == 64) > 0, (digit >= 1) & (upper + low == 0), high > 0, (digit == 0) & (sign == 0),
        of_last(keyword), of_last(ends), of_last((size <= 2) & (sign > 0)), of_last(odd), of_next(odd), of_next(keyword), file_digits, file_signs,
    ]
    return start, stop, row, np.stack(cols, 1).astype(np.float32) if n else np.zeros((0, len(FEATURES)), np.float32)


class Field:
    """Weights of features by tag, and scores of tag pairs; a text begins and ends as if O stood beside it."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray):
        self.weights, self.steps = weights, steps

    def possible(self, e: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Which words some best sequence could tag. Tags of a stretch in place of O add at most the sum of what each word and the step
        into it can add, and a constant for the steps at both ends; a word is out if no stretch around it can reach 0."""
        s = self.steps
        inner = max(s[B, B], s[B, I], s[I, B], s[I, I]) - s[O, O]
        ends = s[O, B] + max(s[B, O], s[I, O]) - 2 * s[O, O] - inner
        gain = np.maximum(e[:, B], e[:, I]) - e[:, O] + inner

        def best_before(gain: np.ndarray, row: np.ndarray) -> np.ndarray:
            """The largest sum of a stretch of the same text that ends right before each word, 0 for none."""
            run = np.concatenate([[0.0], np.cumsum(gain)])
            # A text begins with its own lowest sum: what came before is lifted out of the way.
            lift = 2.0 * (np.abs(run).max() + 1.0) * (row - row[0])
            low = np.minimum.accumulate(run[:-1] - lift) + lift
            return run[:-1] - low

        left, right = best_before(gain, row), best_before(gain[::-1], (row.max() - row)[::-1])[::-1]
        return left + gain + right + ends >= -1e-6 * (1 + np.abs(gain).max())

    def decode(self, x: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The most likely tags of the words."""
        e = x @ self.weights.astype(np.float32)
        tags = np.zeros(len(e), np.int8)
        if not len(e):
            return tags
        open_ = np.flatnonzero(self.possible(e.astype(float), row))
        if not len(open_):
            return tags
        new = np.ones(len(open_), bool)
        new[1:] = (open_[1:] != open_[:-1] + 1) | (row[open_[1:]] != row[open_[:-1]])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(open_)))
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        score = e[open_].astype(float)
        back = np.zeros((len(open_), 3), np.int8)
        best = self.steps[O] + score[begin]
        done = np.empty_like(best)
        for k in range(1, int(size[0]) + 1):
            live = int(np.searchsorted(-size, -k, "right"))
            going = int(np.searchsorted(-size, -(k + 1), "right"))
            done[going:live] = best[going:live]
            if not going:
                break
            paths = best[:going, :, None] + self.steps[None]
            back[begin[:going] + k] = paths.argmax(1)
            best[:going] = paths.max(1) + score[begin[:going] + k]
        tag = (done + self.steps[:, O]).argmax(1)
        found = np.zeros(len(open_), np.int8)
        for k in range(int(size[0]) - 1, -1, -1):
            live = int(np.searchsorted(-size, -(k + 1), "right"))
            at = begin[:live] + k
            found[at] = tag[:live]
            tag[:live] = back[at, tag[:live]]
        tags[open_] = found
        return tags


def train(x: np.ndarray, y: np.ndarray, steps: int = STEPS, penalty: float = 0.02) -> Field:
    """x: (chunks, CHUNK, features), y: tags, -1 behind a chunk's end. Gradient ascent with a step size for each weight."""
    n, size, _ = x.shape
    real = y >= 0
    weights, moves = np.zeros((x.shape[2], 3)), np.zeros((3, 3))
    banned = np.zeros((3, 3))
    banned[O, I] = _NEVER
    tagged = np.stack([y == t for t in range(3)], 2).astype(float)
    want_w = np.einsum("ntf,ntk->fk", x, tagged)
    pair = real[:, 1:] & real[:, :-1]
    want_m = np.einsum("nta,ntb->ab", tagged[:, :-1] * pair[..., None], tagged[:, 1:])
    rate = [np.full_like(weights, 0.1), np.full_like(moves, 0.1)]
    old = [np.zeros_like(weights), np.zeros_like(moves)]
    for _ in range(steps):
        e = x @ weights
        e[~real] = 0
        t = moves + banned
        f, b = np.empty((n, size, 3)), np.zeros((n, size, 3))
        f[:, 0] = e[:, 0] + t[O]
        for k in range(1, size):
            z = f[:, k - 1, :, None] + t
            top = z.max(1)
            f[:, k] = np.where(real[:, k, None], top + np.log(np.exp(z - top[:, None]).sum(1)) + e[:, k], f[:, k - 1])
        b[:, -1] = 0
        for k in range(size - 2, -1, -1):
            z = t[None] + (e[:, k + 1] + b[:, k + 1])[:, None, :]
            top = z.max(2)
            b[:, k] = np.where(real[:, k + 1, None], top + np.log(np.exp(z - top[..., None]).sum(2)), 0)
        total = f[:, -1].max(1, keepdims=True)
        total = total + np.log(np.exp(f[:, -1] - total).sum(1, keepdims=True))
        p = np.exp(np.minimum(0, f + b - total[:, None])) * real[..., None]
        q = np.exp(np.minimum(0, f[:, :-1, :, None] + t + (e[:, 1:] + b[:, 1:])[:, :, None, :] - total[:, None, :, None])) * pair[..., None, None]
        grads = [want_w - np.einsum("ntf,ntk->fk", x, p) - penalty * weights, want_m - q.sum((0, 1)) - penalty * moves]
        for k, (value, g) in enumerate(zip((weights, moves), grads, strict=True)):
            agree = np.sign(g) * np.sign(old[k])
            rate[k] = np.clip(rate[k] * np.where(agree > 0, 1.2, np.where(agree < 0, 0.5, 1)), 1e-4, 1.0)
            value += np.sign(g) * rate[k]
            old[k] = g
    return Field(weights, moves + banned)


def _made_up(rnd: random.Random) -> tuple[list[str], bool]:
    """Words that are one secret (True) or a look-alike (False)."""
    upper, letters, digits, hexes = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
    mix = upper + letters + digits
    pick = lambda alphabet, n: "".join(rnd.choice(alphabet) for _ in range(n))
    key = rnd.choice(["password", "passwd", "secret", "token", "api_key", "apikey", "API_KEY", "Secret", "client_secret", "access_token"])
    value = rnd.choice([lambda: pick(mix, rnd.randint(12, 40)), lambda: pick(hexes, rnd.choice([16, 32, 40, 64])), lambda: pick(mix + "+/", rnd.randint(20, 60)) + "=="])()
    if rnd.random() < 0.5:
        return rnd.choice([
            lambda: ["AKIA" + pick(upper + digits, 16)], lambda: [pick(hexes, rnd.choice([24, 32, 40, 64]))], lambda: [f"{key}={value}"], lambda: [f"{key}:", value], lambda: [key, "=", value],
            lambda: [f'"{key}":', f'"{value}"'], lambda: ["sk-" + pick(mix, 40)], lambda: ["ghp_" + pick(mix, 36)], lambda: ["Bearer", pick(mix + "-_", 50)], lambda: [pick(mix + "+/", 40)],
            lambda: ["eyJ" + pick(mix, 20) + "." + pick(mix, 40) + "." + pick(mix, 30)],
        ])(), True
    return rnd.choice([
        lambda: [f"{pick(letters, 7)}.{pick(digits, 2)}@mail{pick(digits, 1)}.example.com"], lambda: [".".join(str(rnd.randint(0, 255)) for _ in range(4))], lambda: [pick(digits, 16)],
        lambda: [pick(digits, 4)] * 4, lambda: ["+" + pick(digits, 2), pick(digits, 3), pick(digits, 7)], lambda: [f"20{pick(digits, 2)}-{pick('01', 2)}-{pick('12', 2)}"],
        lambda: [pick(letters, rnd.randint(12, 40))], lambda: [pick(letters, 9).capitalize() + pick(letters, 5) + "."], lambda: [key], lambda: [key + "."], lambda: ["https://" + pick(letters, 8) + ".com/" + pick(letters, 9)],
        lambda: [pick(upper, rnd.randint(6, 20)) + "!!"], lambda: [pick(letters, 6) + rnd.choice(["###", "$$$", "&&&", "%%%", "***"])], lambda: [pick(letters, 5) + ":"], lambda: [pick(letters, 6).capitalize() + pick(digits, 2)],
    ])(), False


def fit(texts: list[str], seed: int = 11) -> Field:
    """Train on texts with made-up secrets and look-alikes put in."""
    rnd = random.Random(seed)
    texts = [*texts, "it is one of the words that we had here. " * 20] * (1 if len(texts) > 50 else 20)
    chunks_x, chunks_y = [], []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        out: list[str] = []
        marks: list[int] = []  # -2: a word of the text itself
        i = 0
        while i < len(words):
            j = min(len(words), i + rnd.randint(*GAP))
            out += words[i:j]
            marks += [-2] * (j - i)
            extra, secret = _made_up(rnd)
            out += extra
            marks += [B if k == 0 else I for k in range(len(extra))] if secret else [O] * len(extra)
            i = j
        data, offs = tb.bytes_of(pa.array([" ".join(out)]))
        start, stop, row, x = word_features(data, offs)
        mark = np.array(marks)
        y = np.where(mark == -2, O, mark)
        for _, a, _, z in base_spans(data, offs):
            lo, hi = np.searchsorted(stop, a, "right"), np.searchsorted(start, z, "left")
            if hi > lo and (mark[lo:hi] == -2).all():
                y[lo:hi] = I
                y[lo] = B
        for a in range(0, len(y), CHUNK):
            xs, ys = np.zeros((CHUNK, len(FEATURES)), np.float32), np.full(CHUNK, -1)
            m = min(CHUNK, len(y) - a)
            xs[:m], ys[:m] = x[a : a + m], y[a : a + m]
            if ys[0] == I:
                ys[0] = B
            chunks_x.append(xs)
            chunks_y.append(ys)
    return train(np.stack(chunks_x), np.stack(chunks_y))


_TRIM = bytes(c for c in range(33, 127) if chr(c) in "\"'`.,;:!?()[]{}<>")


def tagged_spans(field: Field, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, start, 3, stop) in bytes of the stretches that the field tags, without quotes and marks around them."""
    start, stop, row, x = word_features(data, offs)
    tags = field.decode(x, row)
    out = []
    first = np.flatnonzero(tags == B)
    for k in first:
        j = k + 1
        while j < len(tags) and tags[j] == I and row[j] == row[k]:
            j += 1
        raw = data[start[k] : stop[j - 1]].tobytes()
        a = int(start[k]) + len(raw) - len(raw.lstrip(_TRIM))
        z = int(stop[j - 1]) - len(raw) + len(raw.rstrip(_TRIM))
        if z > a:
            out.append((int(row[k]), a, 3, z))
    return out


def scan_block(field: Field, data: np.ndarray, offs: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, kind number, stop) in code points; kind 3 is the field's."""
    base = base_spans(data, offs)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offs) - 1)]
    taken: dict[int, list[tuple[int, int]]] = {}
    for r, a, _, z in base:
        taken.setdefault(r, []).append((a, z))
    more = [s for s in tagged_spans(field, data, offs) if all(s[3] <= a or s[1] >= z for a, z in taken.get(s[0], ()))]
    if base or more:
        chars = tb.char_counts(data)
        for r, a, kind, z in sorted([*base, *more]):
            zero = chars[offs[r]]
            out[r].append((int(chars[a] - zero), kind, int(chars[z] - zero)))
    return out


def scan_secrets(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts, the digest of the base spans, and all spans. See the module for the cases."""
    plain = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    names = (*KINDS, "crf")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tb.bytes_of(batch.column(1))
            for i, j, part, at in tb.blocks(data, offs):
                spans = scan_block(field, part, at)
                listed = lambda s: ",".join(f"{names[k]}:{a}:{z}" for a, k, z in s)
                cols = [pa.array([sum(k == kind for _, k, _ in s) for s in spans], pa.int64()) for kind in range(4)]
                base = pa.array([hashlib.sha256(listed([x for x in s if x[1] < 3]).encode()).hexdigest() for s in spans], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *cols[:3], base, pa.array([listed(s) for s in spans], pa.string()), cols[3]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_tagged"])

    return plain.mapInArrow(run, SCHEMA)


def fit_on(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """The field trained on a bounded sample of ``docs``."""
    text = text_of(text_col)
    size = F.greatest(F.lit(1), F.length("text") - TRAIN_CHARS + 1)
    stretch = F.when(F.length("text") > TRAIN_CHARS, F.substring(F.col("text"), (F.pmod(F.xxhash64("id", F.lit("stretch")), size) + 1).cast("int"), F.lit(TRAIN_CHARS))).otherwise(F.col("text"))
    plain = docs.select(F.col(id_col).cast("string").alias("id"), text.alias("text")).filter(F.col("id").isNotNull() & (F.col("text") != ""))
    sized = plain.select("id", stretch.alias("text"))
    ids = sized.select(F.xxhash64("id").alias("h"), "id").distinct().orderBy("h", "id").limit(TRAIN_DOCS)
    chosen = sized.join(F.broadcast(ids), "id").orderBy("h", "id", F.xxhash64("text")).limit(TRAIN_DOCS).collect()
    return fit([r["text"] for r in chosen])


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scan_secrets(docs, fit_on(docs))
