"""Vectorised text kernels on UTF-8 buffers: words, rolling hashes, shingles, repeated windows.

A piece of documents is one byte buffer plus offsets. Nothing here loops over words or characters in Python.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POW: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U))


def _powers(base: int, n: int) -> np.ndarray:
    have = _POW.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16) if have is None else max(n, min(2 * len(have), 1 << 23))
        p = np.full(size, U(base), U)
        p[0] = 1
        have = _POW[base] = np.cumprod(p, dtype=U)
    return have[:n]


class Rolling:
    """Hash of any byte range of a buffer in O(1): polynomial prefix sums modulo 2^64 over random byte values, finalised."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(_BYTE[data] * _powers(_BASE, n), out=self.sums[1:])
        self.inv = _powers(_INV, n + 1)

    def raw(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.inv[a]

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(self.raw(a, b) + (b - a).astype(U) * U(0xD6E8FEB86659FD93))


def per_doc(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Number of set flags (or sum of values) in each document."""
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[offs[1:]] - c[offs[:-1]]


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every run of bytes other than space, \\t, \\n, \\v, \\f, \\r. Runs end with their document."""
    solid = ~WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def windows(h: np.ndarray, doc: np.ndarray, n: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each run of n hashes within a document; with `short`, a document of fewer has one run of all."""
    out = np.zeros(max(0, len(h) - n + 1), U)
    if len(out):
        for k in range(n):
            out = out * U(0x9E6C63D0876A9A47) + h[k : len(h) - n + 1 + k]
        ok = doc[: len(out)] == doc[n - 1 :]
        out, at = mix(out[ok]), doc[: len(out)][ok]
    else:
        at = np.zeros(0, np.int64)
    if short and len(h):
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        size = np.diff(np.r_[first, len(h)])
        for i, c in zip(first[size < n].tolist(), size[size < n].tolist(), strict=True):
            x = np.zeros(1, U)
            for k in range(c):
                x = x * U(0x9E6C63D0876A9A47) + h[i + k : i + k + 1]
            out, at = np.r_[out, mix(x + U(c))], np.r_[at, doc[i : i + 1]]
    return out, at


def multiset(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, hash) pairs, by document and hash, and how often each occurs."""
    if not len(h):
        return h, doc, np.zeros(0, np.int64)
    o = np.lexsort((h, doc))
    h, doc = h[o], doc[o]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
    return h[new], doc[new], np.diff(np.r_[new, len(h)])


def shingles(data: np.ndarray, offs: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multiset of word n-grams of each document: hash, document, count."""
    a, b, doc = words(data, offs)
    return multiset(*windows(Rolling(data).of(a, b), doc, n, True))
