"""Periodic runs of words by Main–Lorentz divide and conquer.

A run is a stretch of words with smallest period q, at least ``LEAST`` words and ``EXPONENT``
periods long, that no neighbouring word extends keeping the period.

Words are interned as numbers. A text is halved again and again at the multiples of powers of
two; a run belongs to the highest midpoint that lies within it, and so ends within that
midpoint's segment. For a period p such a run holds the pair of words (m - 1, m - 1 + p) or the
pair (m - p, m) about its midpoint m; Z-functions of the segment's halves, read forwards and
backwards, tell how far pairs of that distance go on being equal from there. One numpy comparison
finds the nonzero Z-values of all midpoints of a level, of all texts of a slice, and a few more
follow them up to ``DEPTH`` words, where nearly all end; a segment in which one goes on has its
Z-functions computed by the linear algorithm. So a text of n words takes at most some n log n
steps, whatever it repeats.

What a pair extends to is a repetition of period p; of equal intervals the smallest period stays,
which is the smallest of the stretch, as it repeats more than twice. A stretch that would go on
beyond its segment is a higher midpoint's and is left to it.

A text is one row, and no rows meet: there is no shuffle. Memory follows the slice of texts at
hand, or the longest one.

Defined results: a null, empty or blank text has no words and no runs, and collapses to ''; texts
of any length are taken whole; every row has its own result, whatever its id (null or repeated);
of equally good runs the one that starts first, then that of the smaller period, is the best; an
empty table gives an empty result; other columns are ignored, or carried along by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm import _words
from trackloom.llm._shared import only

EXPONENT = 4
LEAST = 6
DEPTH = 32


def z_function(x: list) -> list[int]:
    """For each place, how many values from there on equal those from the beginning on."""
    n = len(x)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _segment(x: np.ndarray, m: int, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many equal pairs go on from each (at, at + period) forwards, itself included, and
    backwards, within one segment, whose midpoint is m; at is m - 1 or m - period."""
    n, values = len(x), x.tolist()
    back = values[::-1]
    rightward = at == m - 1
    forward, backward = np.empty(len(at), dtype=np.int64), np.empty(len(at), dtype=np.int64)
    if rightward.any():
        p = period[rightward]
        forward[rightward] = np.array(z_function(values[m - 1 :]))[p]
        # Words before m - 1, read backwards, against those before m - 1 + p.
        before = back[n - m + 1 :]
        z = np.array(z_function([*before, -1, *back]))
        backward[rightward] = z[len(before) + 1 + n - (m - 1 + p)]
    if not rightward.all():
        p = period[~rightward]
        after = values[m:]
        z = np.array(z_function([*after, -1, *values]))
        forward[~rightward] = z[len(after) + 1 + m - p]
        backward[~rightward] = np.append(np.array(z_function(back[n - m :])), 0)[p]
    return forward, backward


def runs_of(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and period of all runs, sorted, of texts whose words are ids[first[k] : first[k + 1]]."""
    found, n = [], np.diff(first)
    half, longest = 4, int(n.max(initial=0))
    while half < longest:
        per_text = np.maximum(0, -(-(n - half) // (2 * half)))
        text = np.repeat(np.arange(len(n)), per_text)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        middle = first[text] + half * (2 * nth + 1)
        found.append(_level(ids, middle, middle - half, np.minimum(middle + half, first[text + 1]), first[text], first[text + 1], half // 2))
        half *= 2
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 3
    start, end, period = (np.concatenate(x) for x in zip(*found, strict=True))
    o = np.lexsort((period, end, start))
    start, end, period = start[o], end[o], period[o]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    o = np.lexsort((period, start))
    return start[o], end[o], period[o]


def _level(ids: np.ndarray, middle: np.ndarray, lo: np.ndarray, hi: np.ndarray, begin: np.ndarray, stop: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The repetitions of all segments of a level, with periods up to ``most``."""
    n, steps = len(ids), np.arange(1, most + 1)
    allowed = (hi - lo)[:, None] // EXPONENT >= steps
    ahead = (middle - 1)[:, None] + steps
    seg_r, p_r = np.nonzero(allowed & (ahead < hi[:, None]) & (ids[np.minimum(ahead, n - 1)] == ids[middle - 1][:, None]))
    behind = middle[:, None] - steps
    seg_l, p_l = np.nonzero(allowed & (ids[behind] == ids[middle][:, None]))
    seg, period = np.concatenate([seg_r, seg_l]), np.concatenate([p_r, p_l]) + 1
    at = np.concatenate([middle[seg_r] - 1, middle[seg_l] - p_l - 1])
    forward, backward = np.ones(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
    on_f = on_b = np.arange(len(at))
    for _ in range(DEPTH):
        if len(on_f):
            x = at[on_f] + forward[on_f]
            y = x + period[on_f]
            go = (y < hi[seg[on_f]]) & (ids[x] == ids[np.minimum(y, n - 1)])
            on_f = on_f[go]
            forward[on_f] += 1
        if len(on_b):
            x = at[on_b] - backward[on_b] - 1
            y = np.minimum(x + period[on_b], n - 1)
            go = (x >= lo[seg[on_b]]) & (ids[np.maximum(x, 0)] == ids[y])
            on_b = on_b[go]
            backward[on_b] += 1
    for k in np.unique(seg[np.union1d(on_f, on_b)]).tolist():
        own = np.flatnonzero(seg == k)
        a = lo[k]
        forward[own], backward[own] = _segment(ids[a : hi[k]], int(middle[k] - a), at[own] - a, period[own])
    start, end = at - backward, at + forward + period
    long_enough = np.flatnonzero(end - start >= np.maximum(LEAST, EXPONENT * period))
    start, end, period, seg = start[long_enough], end[long_enough], period[long_enough], seg[long_enough]
    before, after = np.maximum(start - 1, 0), np.minimum(end, n - 1)
    goes_on = (start == lo[seg]) & (start > begin[seg]) & (ids[before] == ids[np.minimum(before + period, n - 1)])
    goes_on |= (end == hi[seg]) & (end < stop[seg]) & (ids[after] == ids[after - period])
    return start[~goes_on], end[~goes_on], period[~goes_on]


def _interned(w: _words.Words) -> tuple[pa.Array, np.ndarray]:
    """The words of a slice, and a number for each: equal words have equal numbers."""
    size = w.end - w.start
    steps = np.zeros(len(w.data) + 1, dtype=np.int8)
    steps[w.start] += 1
    steps[w.end] -= 1
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(w.data[np.cumsum(steps[:-1], dtype=np.int8) > 0])])
    return words, np.asarray(words.dictionary_encode().indices)


def _per_text(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rest = [c for c in batch.schema.names if c != "text"]
        for w in _words.slices(batch.column("text")):
            docs = w.hi - w.lo
            words, ids = _interned(w)
            start, end, period = runs_of(ids, w.first)
            doc = np.searchsorted(w.first, start, side="right") - 1
            runs = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (start - w.first[doc], end - start, period)], names=["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(_per_text(np.bincount(doc, minlength=docs))), runs)
            gone = np.zeros(len(ids) + 1, dtype=np.int64)
            np.add.at(gone, start + period, 1)
            np.add.at(gone, end, -1)
            kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
            lists = pa.ListArray.from_arrays(pa.array(_per_text(np.bincount(w.doc[kept], minlength=docs))), words.take(pa.array(kept)))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).slice(w.lo, docs) for c in rest], pc.binary_join(lists, " "), pa.array(w.counts.astype(np.int64)), runs],
                names=[*rest, "text", "n_words", "runs"],
            )


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, text (without what a run repeats: its words after its first period, the kept ones
    joined by one space), n_words, runs (start, length and period of each, by start and period)
    and the columns of ``keep``."""
    extra = {f"_x{k}": c for k, c in enumerate(keep or [])}
    named = only(docs, doc_id=id_col, text=text_col, **extra)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema if f.name != "text")
    out = named.select(*[c for c in named.columns if c != "text"], "text").mapInArrow(_found, f"{kinds}, text string, n_words long, runs array<struct<start:int,length:int,period:int>>")
    return out.select("doc_id", "text", "n_words", "runs", *[F.col(k).alias(c) for k, c in extra.items()])


def best(runs: Column) -> Column:
    """Of runs sorted by start and period, the first of those with most periods, compared exactly."""
    long = lambda x, f: x[f].cast("long")
    return F.aggregate(
        runs,
        F.try_element_at(runs, F.lit(1)),
        lambda top, x: F.when(long(x, "length") * long(top, "period") > long(top, "length") * long(x, "period"), x).otherwise(top),
    )
