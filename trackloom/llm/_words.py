"""Vectorised word kernels over Arrow string columns.

A batch's string buffer is read as one byte array, so words, word hashes and n-gram
hashes of all its documents come from a few numpy passes and no per-word Python runs.
Work goes in slices of ``SLICE_BYTES`` of text (or one longer document), which bounds
the memory a batch takes whatever its rows hold.

Words are ``[^\\x20\\x09-\\x0D]+``; as the separators are single ASCII bytes the UTF-8
bytes can be split without decoding. A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


@lru_cache(maxsize=8)
def constants(seed: int, n: int) -> np.ndarray:
    """n odd pseudo-random multipliers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


_BASE = U64(0x2545F4914F6CDD1D)
_BASE_INV = U64(pow(0x2545F4914F6CDD1D, -1, 1 << 64))
_POWERS = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown when a longer slice comes."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 64), base, dtype=U64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= SLICE_BYTES + 64:
            _POWERS[int(base)] = have
    return have[:n]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """The words of documents lo..hi of a column, in order."""

    lo: int
    hi: int
    data: np.ndarray  # their bytes
    offsets: np.ndarray  # where each document begins in data, with the end
    start: np.ndarray  # of each word, in data
    end: np.ndarray
    doc: np.ndarray  # of each word, from 0
    first: np.ndarray  # each document's first word, with the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        n = len(self.data)
        if not len(self.start):
            return np.zeros(0, dtype=U64)
        table = constants(7, 256)
        sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(table[self.data] * powers(_BASE, n), out=sums[1:])
        h = (sums[self.end] - sums[self.start]) * powers(_BASE_INV, n)[self.start]
        return mix(h + (self.end - self.start).astype(U64) * U64(0x9E3779B97F4A7C15))


def slices(column: pa.Array, most: int = SLICE_BYTES, lower: bool = False) -> Iterator[Words]:
    """Words of a string column, in slices of at most ``most`` bytes or one document."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64, count=n + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    if column.null_count:
        lengths = np.where(np.asarray(column.is_null()), 0, lengths)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        hi = min(hi, n, lo + 60_000)
        a, b = int(offsets[lo]), int(offsets[hi])
        yield _cut(raw[a:b], offsets[lo : hi + 1] - a, lengths[lo:hi], lo, hi, lower)
        lo = hi


def _cut(raw: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, lo: int, hi: int, lower: bool) -> Words:
    if lower:
        raw = _LOWER[raw]
    word = ~_SPACE[raw]
    gaps = np.flatnonzero(lengths != np.diff(offsets))  # a null's bytes, if it has any, are no text
    for k in gaps:
        word[offsets[k] : offsets[k + 1]] = False
    before = np.empty(len(word), dtype=bool)
    before[:1] = False
    before[1:] = word[:-1]
    edges = offsets[:-1][lengths > 0]
    before[edges] = False
    start = np.flatnonzero(word & ~before)
    after = np.empty(len(word), dtype=bool)
    after[-1:] = False
    after[:-1] = word[1:]
    after[edges[edges > 0] - 1] = False
    end = np.flatnonzero(word & ~after) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(hi - lo), np.diff(first))
    return Words(lo, hi, raw, offsets, start, end, doc, first)


def grams(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """The hash of the k words from each on; of use where they are of one document."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    c = constants(seed, k)
    out = h[:n] * c[0]
    for j in range(1, k):
        out += h[j : j + n] * c[j]
    return mix(out)


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """The least of the w values from each on."""
    have, n = 1, len(a)
    out = a
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out[: max(0, n - w + 1)]


def by_doc(values: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The order that sorts by document, then value; documents number below 65 536."""
    o = np.argsort(values)
    return o[np.argsort(doc[o].astype(np.uint16), kind="stable")]
