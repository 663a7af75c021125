"""Whole batches of texts as one byte array: words, lines and fingerprints with numpy, without a loop over documents."""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = 0x9E3779B97F4A7C15
_MIX1, _MIX2 = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: Bytes up to which a stretch is named in numpy; longer ones get a keyed digest.
CHAIN = 512
#: Stretches that are named at once, so that their sums stay in a core's cache.
NAMED = 1 << 14
_LOW = np.uint64(0xFFFFFFFF)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Bytes and texts that are worked on at once; a longer text is a block of its own.
BLOCK, BLOCK_ROWS = 512 << 10, 4096


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def blocks(data: np.ndarray, offs: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, their bytes, their offsets), each of about ``limit`` bytes of whole texts."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, i + BLOCK_ROWS)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_ODD, pow(_ODD, -1, 2**64))):
            x = np.full(size, np.uint64(base))
            x[0] = 1
            _POWERS[k] = np.multiply.accumulate(x)
    return _POWERS[0][:n], _POWERS[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x *= _MIX1
    x ^= x >> np.uint64(29)
    x *= _MIX2
    x ^= x >> np.uint64(32)
    return x


def loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as one number, zeros beyond the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))


def fresh_key() -> bytes:
    """A secret key, to be drawn on the driver for each run whose names travel."""
    return secrets.token_bytes(16)


#: Key of names that never leave this process.
HERE = fresh_key()


@cache
def _factors(key: bytes) -> np.ndarray:
    """Two rows of secret factors: one to start from, one for the size, one for each four bytes."""
    n = CHAIN // 4 + 2
    return np.frombuffer(hashlib.shake_256(b"names" + key).digest(16 * n), "<u8").reshape(2, n)


def names(data: np.ndarray, start: np.ndarray, stop: np.ndarray, key: bytes = HERE) -> np.ndarray:
    """64-bit names of stretches of bytes under a secret key: the high halves of two sums of four bytes at a time by secret 64-bit factors.
    That family is strongly universal: two different strings, whatever they are, share a name for one key in 2^64; longer
    ones get a keyed BLAKE2. Without the key, which is drawn for each run, no strings can be built that share one."""
    size = stop - start
    load, factors = loads(data), _factors(key)
    if len(size) <= NAMED:
        out = _sums(load, start, size, factors)
    else:
        out = np.concatenate([_sums(load, start[i : i + NAMED], size[i : i + NAMED], factors) for i in range(0, len(size), NAMED)])
    for k in np.flatnonzero(size > CHAIN):
        out[k] = int.from_bytes(hashlib.blake2b(data[start[k] : stop[k]], digest_size=8, key=key).digest(), "little")
    return out


def _sums(load: np.ndarray, start: np.ndarray, size: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Names of stretches of at most CHAIN bytes. Eight bytes that all of them have are added at once, without a look at which have them."""
    low, high = factors
    a, b = low[0] + size.astype(np.uint64) * low[1], high[0] + size.astype(np.uint64) * high[1]
    done, every = 0, int(size.min()) if len(size) and size.max() <= CHAIN else 0
    while done + 8 <= every:
        value, k = load[start + done], 2 + done // 4
        first, second = value & _LOW, value >> np.uint64(32)
        a += first * low[k]
        a += second * low[k + 1]
        b += first * high[k]
        b += second * high[k + 1]
        done += 8
    live = np.flatnonzero((size > done) & (size <= CHAIN))
    while len(live):
        left = np.minimum(8, size[live] - done)
        value = load[start[live] + done] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - 8 * left.astype(np.uint64)))
        first, second, k = value & _LOW, value >> np.uint64(32), 2 + done // 4
        a[live] += first * low[k] + second * low[k + 1]
        b[live] += first * high[k] + second * high[k + 1]
        done += 8
        live = live[size[live] > done]
    return mixed(((a & ~_LOW) | (b >> np.uint64(32))) ^ low[0])


def joined(parts: list[np.ndarray], key: bytes) -> np.ndarray:
    """One name for each row of names, by secret factors as in ``names``."""
    low, high = _factors(b"joined" + key)
    a, b = np.full(len(parts[0]), low[0]), np.full(len(parts[0]), high[0])
    for k, x in enumerate(parts):
        first, second = x & _LOW, x >> np.uint64(32)
        a += first * low[2 * k + 1] + second * low[2 * k + 2]
        b += first * high[2 * k + 1] + second * high[2 * k + 2]
    return mixed(((a & ~_LOW) | (b >> np.uint64(32))) ^ low[0])


def doubled(data: np.ndarray, size: int, key: bytes = HERE) -> np.ndarray:
    """Quick names of the strings of ``size`` bytes (8 or more) from every position that has one, made of the names of two shorter strings
    as ranks are in prefix doubling; the two may overlap. They choose and sieve: equal strings share one, and where others do, ``names`` decide."""
    factor = _factors(key)[0]
    name, now = mixed(loads(data)[: max(0, len(data) - 7)] ^ factor[0]), 8
    while now < size:
        step = min(now, size - now)
        name = mixed(mixed(name[: max(0, len(name) - step)] + np.uint64(step)) ^ (name[step:] * (factor[1] | np.uint64(1))))
        now += step
    return name


class Prints:
    """Fingerprints of short stretches of a sequence of names from one running sum of powers. The names are secret, so no stretches can be
    built that share one."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        up, self.down = powers(n + 1)
        self.run = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=self.run[1:])

    def raw(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.run[stop] - self.run[start]) * self.down[start]

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed(self.raw(start, stop) + (stop - start).astype(np.uint64) * _MIX1)

    def fixed(self, size: int) -> np.ndarray:
        """Of the stretches of ``size`` from every position that has one."""
        n = len(self.run) - size
        return mixed((self.run[size:] - self.run[:n]) * self.down[:n] + np.uint64(size * int(_MIX1) % 2**64)) if n > 0 else np.zeros(0, np.uint64)


def runs(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, row) of every maximal run of marked bytes inside one text."""
    before = np.empty_like(mask)
    before[:1] = False
    before[1:] = mask[:-1]
    first = offs[:-1][offs[:-1] < offs[1:]]
    before[first] = False
    after = np.empty_like(mask)
    after[-1:] = False
    after[:-1] = mask[1:]
    after[first[1:] - 1] = False
    start, stop = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    return start, stop, np.searchsorted(offs, start, "right") - 1


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, row) of every word: a run of bytes other than the six of white space."""
    return runs(~SPACE[data], offs)


def lines(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, row) of every line that isn't empty, without its line feed."""
    cut = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([offs[:-1], cut + 1]))
    stop = np.unique(np.concatenate([offs[1:], cut]))
    start = start[start < len(data)]
    start = start[data[start] != 10]
    return start, stop[np.searchsorted(stop, start, "right")], np.searchsorted(offs, start, "right") - 1


def char_counts(data: np.ndarray) -> np.ndarray:
    """Code points before each byte position (one more entry than bytes)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    table = np.zeros(1 << 16, bool)
    table[(twice >> np.uint64(48)).astype(np.int64)] = True
    out = table[(keys >> np.uint64(48)).astype(np.int64)]
    maybe = np.flatnonzero(out)
    at = np.searchsorted(twice, keys[maybe])
    out[maybe] = twice[np.minimum(at, len(twice) - 1)] == keys[maybe]
    return out


def per_row(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(rows, weights, n).astype(np.int64)
