"""Vectorised text kernels shared by the operators: they run inside tasks on
the UTF-8 bytes of one slice of rows at a time and never build Python strings.

Hashes are 64-bit: two different words or word windows collide with
probability about 2**-64, so results that compare hashes are exact up to that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
"""Text handled at a time: the kernels need about 60 bytes per byte of it. A
single longer text makes a slice of its own."""

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_MUL = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, 9, 10, 11, 12, 13]] = False
"""Bytes of words ``[^\\x20\\x09-\\x0D]+``."""

ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[0x30:0x3A] = True
ALNUM_WORDS[0x61:0x7B] = True
ALNUM_WORDS[0x41:0x5B] = True
ALNUM_WORDS[0x80:] = True
"""Bytes of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a lower-cased text."""


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes (one row at least)."""
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


_POWERS: dict[str, np.ndarray] = {"b": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["b"]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        for k, base in (("b", _BASE), ("i", _BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    return _POWERS["b"], _POWERS["i"]


class Prefix:
    """Polynomial prefix hashes of a byte slice: the hash of any range in O(1)."""

    def __init__(self, data: np.ndarray, lower: bool = False):
        p, self.inv = _powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        v = (_BYTE_LOWER if lower else _BYTE)[data]
        v *= p[:len(data)]
        np.cumsum(v, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Position-independent hashes of ``[start, end)`` (with their length)."""
        h = self.sums[end]
        h -= self.sums[start]
        h *= self.inv[start]
        h += (end - start).astype(np.uint64) * _MUL[63]
        return mix(h)


class Words:
    """The words of one slice of texts.

    ``start``/``end`` are byte positions in the slice, ``doc`` the row of each
    word, ``hash`` its 64-bit hash, ``first`` the index of each row's first word
    (``len(rows) + 1`` entries).
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = True, table: np.ndarray = SPACE_WORDS):
        n = len(data)
        inside = table[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            before[1:], after[:-1] = inside[:-1], inside[1:]
            full = np.flatnonzero(np.diff(offs))
            before[offs[:-1][full]] = False
            after[offs[1:][full] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offs)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offs) - 1), self.count)
        self.prefix = Prefix(data, lower)
        self.hash = self.prefix.of(self.start, self.end)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every ``n``-word window and the index of its first word;
        a row with fewer words (but one at least) gives its whole sequence."""
        w, total = self.hash, len(self.hash)
        at = np.arange(total)
        left = self.first[1:][self.doc] - at if total else at
        h = np.zeros(total, np.uint64)
        for k in range(n):
            term = np.zeros(total, np.uint64)
            term[:total - k if k else total] = w[k:] * _MUL[k]
            term[left <= k] = 0
            h += term
        short = self.count[self.doc] < n if total else np.zeros(0, bool)
        h[short] += self.count[self.doc[short]].astype(np.uint64) * _MUL[62]
        use = np.flatnonzero((left >= n) | (short & (at == self.first[:-1][self.doc])) if total else short)
        return mix(h[use]), use


def per_row(values: np.ndarray, doc: np.ndarray, rows: int) -> np.ndarray:
    """Sum of ``values`` by row."""
    return np.bincount(doc, weights=values, minlength=rows).astype(np.int64)


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(has an equal elsewhere, is not the first of its equals) for every key."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = np.zeros(len(s), bool)
    same[1:] = s[1:] == s[:-1]
    any_ = same.copy()
    any_[:-1] |= same[1:]
    out_any, out_later = np.zeros(len(s), bool), np.zeros(len(s), bool)
    out_any[order], out_later[order] = any_, same
    return out_any, out_later


def salted(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within one row."""
    return mix(hashes ^ mix(doc.astype(np.uint64) * _MUL[61] + _MUL[60]))


def home(chunk, blocks: int) -> np.ndarray:
    """The block that holds a chunk: an even deal, however chunks are numbered."""
    return (mix(np.atleast_1d(np.asarray(chunk, np.int64)).view(np.uint64)) % np.uint64(blocks)).astype(np.int32)
