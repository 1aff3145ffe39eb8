"""Vectorised tokenising and hashing of Arrow text columns.

Texts of a batch are handled as one byte buffer.  A word's 64-bit hash comes
from prefix sums of ``(byte + 1) * P**i`` (mod 2**64), so no Python string is
made per word.  Work goes in slices of whole documents of about ``SLICE``
bytes, and the sums over no more bytes at a time, so that a longer document,
which is a slice by itself, takes some 25 bytes for each of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
U = np.uint64
P = 0x9E3779B97F4A7C15 | 1
P_INV = pow(P, -1, 1 << 64)
_pow: dict[str, np.ndarray] = {}

#: Fixed: white space that separates words, and A-Z lower-cased.
WORD = np.ones(256, bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _pow or len(_pow["p"]) < n:
        size = max(n, SLICE + (1 << 18))
        for k, base in (("p", P), ("i", P_INV)):
            a = np.full(size, U(base), U)
            a[0] = 1
            _pow[k] = np.multiply.accumulate(a)
    return _pow["p"], _pow["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def arrow_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a text column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if off and len(col) else np.zeros(len(col) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(col) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(col: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole documents."""
    data, off = arrow_bytes(col)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        j = min(j, n)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def spans(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each document the index of its first word (n + 1)."""
    m = is_word[data]
    if not len(m):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    before = np.empty(len(m), bool)
    before[0] = False
    before[1:] = m[:-1]
    after = np.empty(len(m), bool)
    after[-1] = False
    after[:-1] = m[1:]
    before[off[:-1][off[:-1] < len(m)]] = False
    ends = off[1:][off[1:] > 0] - 1
    after[ends] = False
    s = np.flatnonzero(m & ~before)
    e = np.flatnonzero(m & ~after) + 1
    return s, e, np.searchsorted(s, off)


def _sums(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Sum of ``(byte + 1) * P**i`` of each span of bytes, i from its start."""
    p, inv = powers(len(data) + 1)
    c = np.empty(len(data) + 1, U)
    c[0] = 0
    v = data.astype(U)
    v += U(1)
    v *= p[: len(data)]
    np.cumsum(v, out=c[1:])
    h = c[e]
    h -= c[s]
    h *= inv[s]
    return h


def hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes; spans are ascending.  Prefix sums are taken over about ``SLICE`` bytes at a time, also inside a longer span."""
    out = np.empty(len(s), U)
    i = 0
    while i < len(s):
        a = int(s[i])
        j = max(i + 1, int(np.searchsorted(e, a + SLICE, "right")))
        b = int(e[j - 1])
        if b - a <= SLICE:
            out[i:j] = _sums(data[a:b], s[i:j] - a, e[i:j] - a)
        else:  # one long span
            total = 0
            for x in range(a, b, SLICE):
                y = min(x + SLICE, b)
                total += int(_sums(data[x:y], np.zeros(1, int), np.array([y - x]))[0]) * pow(P, x - a, 1 << 64)
            out[i] = U(total & (2**64 - 1))
        i = j
    return mix(out)


def hash_of(text: str | bytes) -> int:
    """The hash that ``hashes`` gives a span of these bytes."""
    b = text.encode() if isinstance(text, str) else text
    d = np.frombuffer(b, np.uint8)
    return int(hashes(d, np.array([0]), np.array([len(d)]))[0])


def words(data: np.ndarray, off: np.ndarray, is_word: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased word, and the index of each document's first word (n + 1)."""
    low = LOWER[data]
    s, e, first = spans(low, off, is_word)
    return hashes(low, s, e), first


def lookup(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index of each hash in a sorted table, or -1."""
    if not len(table):
        return np.full(len(h), -1, np.int64)
    at = np.searchsorted(table, h)
    at[at == len(table)] = 0
    return np.where(table[at] == h, at, -1)
