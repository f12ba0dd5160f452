"""Words and their 64-bit hashes, computed over whole Arrow string buffers with numpy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. UTF-8 never uses those bytes inside a longer
character, so bytes and characters give the same words. The hash of a word is a polynomial over a random value
for each byte, modulo 2**64: prefix sums give every word's hash without a loop over words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import caches

U = np.uint64
_BLOCK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit (splitmix64's finaliser)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_VALUE = mix(np.arange(1, 257, dtype=U) * U(_BASE))
_LOWER = _VALUE.copy()
_LOWER[65:91] = _VALUE[97:123]
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        n = max(n, _BLOCK + 1)
        with np.errstate(over="ignore"):
            _powers["up"] = np.cumprod(np.r_[U(1), np.full(n - 1, _BASE, U)])
            _powers["down"] = np.cumprod(np.r_[U(1), np.full(n - 1, _INVERSE, U)])
    return _powers["up"], _powers["down"]


def _block(buf: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = _SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    up, down = _power(len(buf) + 1)
    total = np.zeros(len(buf) + 1, U)
    np.cumsum(value[buf] * up[: len(buf)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U)), start, end


def words(buf: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of each word of ``buf`` (uint8). ``lower`` folds A-Z in the hash."""
    value = _LOWER if lower else _VALUE
    if len(buf) <= _BLOCK:
        return _block(buf, value)
    parts, at = [], 0
    while at < len(buf):
        to = min(len(buf), at + _BLOCK)
        while to < len(buf) and not _SPACE[buf[to]]:  # a block ends where a word ends
            step = np.flatnonzero(_SPACE[buf[to : to + _BLOCK]])
            to += int(step[0]) if len(step) else min(_BLOCK, len(buf) - to)
        h, s, e = _block(buf[at:to], value)
        parts.append((h, s + at, e + at))
        at = to
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class Texts:
    """A string column's bytes and words. Null counts as empty.

    ``hash``, ``start`` and ``end`` are of all its words; those of row ``i`` lie at ``cut[i]:cut[i + 1]``.
    """

    def __init__(self, column: pa.Array | pa.ChunkedArray, lower: bool = False):
        caches.free()  # no operator that works on hashes of words keeps any
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_string()).fill_null("")
        n = len(column)
        _, offsets, data = column.buffers()
        off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and n else np.zeros(0, np.uint8)
        # one space between rows, so that no word runs over from one to the next
        self.offset = off - off[0] + np.arange(n + 1)
        self.bytes = np.insert(raw, (off[1:] - off[0]), 0x20) if n else raw
        self.hash, self.start, self.end = words(self.bytes, lower)
        self.cut = np.searchsorted(self.start, self.offset)

    def __len__(self) -> int:
        return len(self.offset) - 1

    def of(self, i: int) -> np.ndarray:
        return self.hash[self.cut[i] : self.cut[i + 1]]

    def counts(self) -> np.ndarray:
        return np.diff(self.cut)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.counts())

    def text(self, first: int, last: int) -> bytes:
        """The bytes from word ``first`` up to word ``last``, not included."""
        return self.bytes[self.start[first] : self.end[last - 1]].tobytes() if last > first else b""


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """The sorted set of hashes of ``k`` consecutive words; with fewer words, of the whole sequence; else empty."""
    if not len(h):
        return h
    k = min(k, len(h))
    out = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        out = out * U(_BASE) + h[j : len(h) - k + 1 + j]
    return np.unique(mix(out + U(k)))
