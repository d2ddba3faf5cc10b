"""Substring de-duplication by relative Lempel-Ziv parsing.

A window is ``WINDOW`` consecutive words. A word is removed when a window that covers it also
starts in a document with a smaller id.

The reference, all documents, is indexed in blocks: a window belongs to the block of its
anchor, the first among its ``ANCHOR``-word sequences by frequency class, rare ones first, and
hash. Classes come from a sketch of fixed size over all documents, so a phrase that very many
documents hold in different contexts is no anchor. Neighbouring windows mostly share an anchor, so a document is cut into a few stretches, each parsed against just the one block
that can contain it. A block's index holds every window's hash with the smallest document
that has it. A stretch is parsed greedily: at its first window that a smaller document has, the
longest run of windows that stands in one smaller document is the factor (length, source), and
parsing goes on at the window after the factor's last. That next window overlaps the factor by
all words but one, so the windows across two factors' boundary, and those across two
stretches', are looked up like the rest; a factor of a single window is ``WINDOW`` words, the
least that counts. Factors are the duplicate spans.

Windows are compared by 56 bits of a hash and their anchor's independent 64-bit hash together.
A span goes back to its text with its windows' summed hashes, and only where the text at that
place has the same sum: rows that repeat an id with other texts are judged each by its own.

Skew: what repeats within a slice of a task is decided there (every copy but the smallest id's
has a smaller one), so a passage that a third of all documents hold leaves a task once a slice,
not once a document, and windows often met are remembered for the task's later slices. The
block side streams over rows sorted by bucket and keeps one row for each open window; it sorts
these again only when as many new ones have come, so a bucket of any size is sorted a
logarithmic number of times. Only hashes move; texts move once, to meet their spans.

Defined results: a null text has no words; a row with a null id keeps all words and is no
reference; rows that repeat an id do not shorten each other, and whole repeated rows get equal
results; an empty table gives an empty result; other columns are ignored by ``repeats`` and
kept by ``remove``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm import _sketch, _words
from trackloom.llm._shared import only, partitions

WINDOW = 13
ANCHOR = 4
REMEMBERED = 1 << 20
BUCKETS_A_PARTITION = 16
SLICES_A_ROW = 3
VALUES_AT_ONCE = 1 << 20
VALUE_BYTES = 7
VALUE_BITS = (1 << 8 * VALUE_BYTES) - 1
SALTS = 4096
SKETCH_CELLS = 1 << 20
U64 = np.uint64


def _spans(where: np.ndarray, row: np.ndarray, flags: np.ndarray, hashes: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Runs of flagged windows as (index of the first, words covered, sum of the windows' hashes)."""
    k = np.flatnonzero(flags)
    if not len(k):
        return k, k, np.zeros(0, dtype=U64)
    new = np.ones(len(k), dtype=bool)
    new[1:] = (where[k[1:]] != where[k[:-1]] + 1) | (row[k[1:]] != row[k[:-1]])
    at = np.flatnonzero(new)
    return k[at], np.diff(np.append(at, len(k))) + window - 1, np.add.reduceat(hashes[k], at)


def _parse(where: np.ndarray, row: np.ndarray, doc: np.ndarray, win: np.ndarray, anchor: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """The greedy parse of a block's stretches: each factor's first window, its words, the sum of
    its windows' hashes and its source; and, for each window, whether a smaller document has it."""
    low, _, source = _least(win, anchor, doc)
    known = doc > low
    n = len(win)
    follows = np.zeros(n + 1, dtype=bool)
    follows[1:n] = (where[1:] == where[:-1] + 1) & (row[1:] == row[:-1])
    at = np.flatnonzero(known & ~(follows[:n] & np.append(False, known[:-1])))
    begins, lengths = [at[:0]], [at[:0]]
    while len(at):
        # Each stretch's next factor grows as far as the source goes on like it.
        length, going = np.ones(len(at), dtype=np.int64), np.arange(len(at))
        while len(going):
            x, y = at[going] + length[going], source[at[going]] + length[going]
            on = follows[np.minimum(x, n)] & follows[np.minimum(y, n)]
            going, x, y = going[on], x[on], y[on]
            going = going[(win[x] == win[y]) & (anchor[x] == anchor[y])]
            length[going] += 1
        begins.append(at)
        lengths.append(length)
        # The window across the factor's end is looked up like any other.
        at = at + length
        at = at[follows[at] & np.append(known, False)[at]]
    begin, length = np.concatenate(begins), np.concatenate(lengths)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(win)])
    return begin, length + window - 1, sums[begin + length] - sums[begin], low[begin], known


def _least(keys: np.ndarray, also: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the smallest document among the rows of its key, whether the key has several documents, and a row of the smallest."""
    o = np.argsort(keys)
    k = keys[o]
    same = k[1:] == k[:-1]
    if np.any(same & (also[o][1:] != also[o][:-1])):
        o = np.lexsort((also, keys))
        k = keys[o]
        same = (k[1:] == k[:-1]) & (also[o][1:] == also[o][:-1])
    begins = np.flatnonzero(np.append(True, ~same))
    d = docs[o]
    low = np.minimum.reduceat(d, begins)
    sizes = np.diff(np.append(begins, len(k)))
    group = np.repeat(np.arange(len(begins)), sizes)
    its = np.flatnonzero(d == low[group])
    place = np.empty(len(begins), dtype=np.int64)
    place[group[its]] = o[its]
    out, many, source = np.empty_like(docs), np.empty(len(docs), dtype=bool), np.empty(len(docs), dtype=np.int64)
    out[o] = low[group]
    many[o] = (np.maximum.reduceat(d, begins) > low)[group]
    source[o] = place[group]
    return out, many, source


PARTS = {"anchors": "<u8", "lows": "<u4", "highs": "<u4", "starts": "<u2", "far": "<u2", "counts": "u1"}
STRETCHES = "bucket int, " + ", ".join(f"{k} binary" for k in [*PARTS, "values"])
LONGEST = 255


def _shipped(buckets: int, anchors: np.ndarray, docs: np.ndarray, starts: np.ndarray, counts: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """Stretches gathered by bucket, a row each, its parts as plain byte planes: what is shuffled is mostly hashes.

    A count of 0 marks a span decided here, whose two values are its length in words and its windows' sum.
    """
    bucket = (_words.mix(anchors) % U64(buckets)).astype(np.int32)
    o = np.argsort(bucket, kind="stable")
    sizes = np.where(counts, counts, 2).astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    sizes = sizes[o]
    ends = np.cumsum(sizes)
    flat = values[np.repeat(begin[o], sizes) + np.arange(int(ends[-1])) - np.repeat(ends - sizes, sizes)]
    sorted_ = bucket[o]
    cut = np.append(np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])), len(o))
    pair = docs[o].astype("<i8").view("<u4").reshape(-1, 2)
    start = starts[o]
    parts = {"anchors": anchors[o], "lows": pair[:, 0], "highs": pair[:, 1], "starts": start & 0xFFFF, "far": start >> 16, "counts": counts[o]}
    columns = [pa.array(sorted_[cut[:-1]])]
    planes = [(np.ascontiguousarray(parts[k].astype(kind)), cut, np.dtype(kind).itemsize) for k, kind in PARTS.items()]
    planes.append((np.ascontiguousarray(flat.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :VALUE_BYTES]), np.append(0, ends)[cut], VALUE_BYTES))
    for x, at, width in planes:
        columns.append(pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((at * width).astype(np.int32)), pa.py_buffer(x)]))
    return pa.RecordBatch.from_arrays(columns, names=["bucket", *PARTS, "values"])


def _received(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """bucket, anchor, id, start, count and values of every stretch of a batch."""

    def plane(name: str) -> tuple[np.ndarray, np.ndarray]:
        c = batch.column(name)
        offs = np.frombuffer(c.buffers()[1], dtype=np.int32, count=len(c) + 1 + c.offset)[c.offset :].astype(np.int64)
        return offs, np.frombuffer(c.buffers()[2], dtype=np.uint8)[offs[0] : offs[-1]]

    parts = {k: np.frombuffer(plane(k)[1].tobytes(), dtype=kind) for k, kind in PARTS.items()}
    rows = np.diff(plane("counts")[0])
    packed = plane("values")[1].reshape(-1, VALUE_BYTES)
    values = np.zeros((len(packed), 8), dtype=np.uint8)
    values[:, :VALUE_BYTES] = packed
    docs = np.stack([parts["lows"], parts["highs"]], axis=1).copy().view("<i8").reshape(-1)
    starts = parts["starts"].astype(np.int64) + (parts["far"].astype(np.int64) << 16)
    return np.repeat(batch.column("bucket").to_numpy(), rows), parts["anchors"], docs, starts, parts["counts"].astype(np.int64), values.view("<u8").reshape(-1)


class _Remembered:
    """Windows met in several documents, and the smallest id met: a bounded memory of one task."""

    def __init__(self):
        self.key, self.also, self.doc = np.zeros(REMEMBERED, dtype=U64), np.zeros(REMEMBERED, dtype=U64), np.full(REMEMBERED, np.iinfo(np.int64).max)

    def smaller(self, keys: np.ndarray, also: np.ndarray, docs: np.ndarray) -> np.ndarray:
        slot = (keys & U64(REMEMBERED - 1)).astype(np.int64)
        return (self.key[slot] == keys) & (self.also[slot] == also) & (self.doc[slot] < docs)

    def add(self, keys: np.ndarray, also: np.ndarray, docs: np.ndarray) -> None:
        # Largest ids first: where a window comes twice, the smallest stays.
        o = np.argsort(-docs, kind="stable")
        keys, also, docs = keys[o], also[o], docs[o]
        slot = (keys & U64(REMEMBERED - 1)).astype(np.int64)
        keep = (self.key[slot] != keys) | (self.also[slot] != also) | (docs < self.doc[slot])
        slot, keys, also, docs = slot[keep], keys[keep], also[keep], docs[keep]
        self.key[slot], self.also[slot], self.doc[slot] = keys, also, docs


def _counted(anchor: int):
    """A task's counts of anchor-word sequences, as blocks of a sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(SKETCH_CELLS, dtype=np.uint32)
        for batch in batches:
            for w in _words.slices(batch.column("text")):
                g = _words.grams(w.hashes(), anchor, 21)
                cells += np.bincount((g & U64(SKETCH_CELLS - 1)).astype(np.int32), minlength=SKETCH_CELLS).astype(np.uint32)
        block, raw = _sketch.blocks(cells)
        yield pa.RecordBatch.from_arrays([block, raw], names=["block", "cells"])

    return run


def _ranked(grams: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Keys in the order of anchors: the class above, then the hash's upper bits."""
    return classes[(grams & U64(SKETCH_CELLS - 1)).astype(np.int64)].astype(U64) << U64(58) | grams >> U64(6)


def _stretches(window: int, anchor: int, buckets: int, table):
    """Task side: the stretches that other tasks' documents must be held against, and, with no windows, spans decided here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, waiting, classes = _Remembered(), [], table.value
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for w in _words.slices(batch.column("text")):
                h = w.hashes()
                n = len(h) - window + 1
                if n <= 0:
                    continue
                idx = np.flatnonzero(w.doc[:n] == w.doc[window - 1 :])
                if not len(idx):
                    continue
                least = _words.sliding_min(_ranked(_words.grams(h, anchor, 21), classes), window - anchor + 1)[idx]
                win = _words.grams(h, window, 22)[idx] & U64(VALUE_BITS)
                doc = w.doc[idx]
                d = ids[w.lo + doc]
                low, many, _ = _least(win, least, d)
                known = (d > low) | seen.smaller(win, least, d)
                first = many & ~known
                seen.add(win[first], least[first], d[first])
                begin = idx - w.first[doc]
                at, words, sums = _spans(idx, doc, known, win, window)
                open_ = np.flatnonzero(~known)
                new = np.ones(len(open_), dtype=bool)
                new[1:] = (open_[1:] != open_[:-1] + 1) | (least[open_[1:]] != least[open_[:-1]]) | (doc[open_[1:]] != doc[open_[:-1]])
                run = np.cumsum(new) - 1
                inside = np.arange(len(open_)) - np.flatnonzero(new)[run] if len(open_) else run
                runs = np.flatnonzero(new | (inside % LONGEST == 0))
                o = open_[runs]
                found = d[at]
                spread = _words.mix(found.astype(U64) * U64(31) + begin[at].astype(U64))
                waiting.append(
                    (
                        np.concatenate([least[o], spread]),
                        np.concatenate([d[o], found]),
                        np.concatenate([begin[o], begin[at]]),
                        np.concatenate([np.diff(np.append(runs, len(open_))), np.zeros(len(at), dtype=np.int64)]),
                        np.concatenate([win[open_], np.stack([words.astype(U64), sums], axis=1).reshape(-1)]),
                    )
                )
                if len(waiting) == SLICES_A_ROW:
                    yield _shipped(buckets, *map(np.concatenate, zip(*waiting, strict=True)))
                    waiting = []
        if waiting:
            yield _shipped(buckets, *map(np.concatenate, zip(*waiting, strict=True)))

    return run


def _smaller(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about VALUES_AT_ONCE values, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.diff(np.frombuffer(batch.column("values").buffers()[1], dtype=np.int32, count=batch.num_rows + 1 + batch.column("values").offset)[batch.column("values").offset :]).astype(np.int64)) // 8
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + VALUES_AT_ONCE, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _factors(window: int):
    """Block side: rows come sorted by bucket; factors go out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the open bucket's windows that still have no smaller document
        waiting, n_waiting, rows = [], 0, 0

        def spans(parts: list[tuple]) -> pa.RecordBatch:
            doc, start, words, sums, source = (np.concatenate(x) for x in zip(*parts, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start.astype(np.int32)), pa.array(words.astype(np.int32)), pa.array((sums & U64(VALUE_BITS)).astype(np.int64)), pa.array(source)], names=["doc_id", "start", "n", "sum", "source"])

        def parsed() -> pa.RecordBatch:
            nonlocal held, waiting, n_waiting
            home, anchor, row, doc, pos, win = (np.concatenate(x) for x in zip(*([held] if held else []), *waiting, strict=True))
            at, words, sums, source, known = _parse(pos, row, doc, win, anchor, window)
            keep = ~known & (home == home[-1])
            held = tuple(x[keep] for x in (home, anchor, row, doc, pos, win))
            waiting, n_waiting = [], 0
            return spans([(doc[at], pos[at], words, sums, source)])

        for batch in _smaller(batches):
            bucket, anchor, d, start, count, values = _received(batch)
            size = np.where(count, count, 2)
            first = np.cumsum(size) - size
            done = np.flatnonzero(count == 0)
            if len(done):
                yield spans([(d[done], start[done], values[first[done]], values[first[done] + 1], np.full(len(done), -1))])
            of = np.repeat(np.arange(len(d)), size)
            inside = np.arange(len(values)) - first[of]
            open_ = np.flatnonzero(count[of] > 0)
            of, inside = of[open_], inside[open_]
            if len(of):
                waiting.append((bucket[of], anchor[of], of + rows, d[of], start[of] + inside, values[open_]))
                n_waiting += len(of)
            rows += len(d)
            # What is held is sorted again only with as many new windows.
            if n_waiting >= max(VALUES_AT_ONCE, len(held[0]) if held else 0):
                yield parsed()
        if waiting:
            yield parsed()

    return run


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, n, sum and source: factors, possibly overlapping, whose windows a smaller document has.

    ``sum`` is that of the windows' hashes; ``source`` is the document a factor was found in, -1
    where a task decided alone.
    """
    if not 1 <= anchor <= window:
        raise ValueError("an anchor has 1 word to a window's")
    # A task takes one bucket of its partition into memory at a time.
    buckets = min(1 << 30, BUCKETS_A_PARTITION * partitions(docs.sparkSession))
    named = only(docs, doc_id=id_col, text=text_col).where("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("long"))
    cells = _sketch.total(named.select("text").mapInArrow(_counted(anchor), "block long, cells binary"), SKETCH_CELLS)
    table = docs.sparkSession.sparkContext.broadcast(_sketch.classes(cells))
    return (
        named.mapInArrow(_stretches(window, anchor, buckets, table), STRETCHES)
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_factors(window), "doc_id long, start int, n int, sum long, source long")
    )


def _own(w: _words.Words, row: np.ndarray, at: np.ndarray, length: np.ndarray, sums: np.ndarray, window: int) -> np.ndarray:
    """Which spans are of these texts: they lie inside and their windows have the same sum."""
    ok = (at + length <= w.counts[row]) & (at >= 0) & (length >= window)
    win = _words.grams(w.hashes(), window, 22) & U64(VALUE_BITS)
    total = np.concatenate([np.zeros(1, U64), np.cumsum(win)])
    begin = np.minimum(w.first[row] + at, len(win))
    end = np.clip(begin + length - window + 1, 0, len(win))
    return ok & ((total[end] - total[begin]) & U64(VALUE_BITS) == sums)


def _kept(window: int):
    return lambda batches: _kept_of(batches, window)


def _kept_of(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, spans = batch.column("text"), batch.column("spans")
        rest = [c for c in batch.schema.names if c not in ("text", "spans")]
        counts = np.where(np.asarray(spans.is_null()), 0, np.asarray(spans.value_lengths().fill_null(0)))
        flat = spans.flatten()
        at, length, sums = (flat.field(k).to_numpy().astype(np.int64) for k in (0, 1, 2))
        ends = np.cumsum(counts)
        for w in _words.slices(text):
            lo, hi = w.lo, w.hi
            s0, s1 = int(ends[lo] - counts[lo]), int(ends[hi - 1])
            row = np.repeat(np.arange(hi - lo), counts[lo:hi])
            own = _own(w, row, at[s0:s1], length[s0:s1], sums[s0:s1].astype(U64), window) if s1 > s0 else np.zeros(0, dtype=bool)
            begin = w.first[row[own]] + at[s0:s1][own]
            steps = np.bincount(begin, minlength=len(w.start) + 1) - np.bincount(begin + length[s0:s1][own], minlength=len(w.start) + 1)
            keep = np.flatnonzero(np.cumsum(steps[:-1]) == 0)
            doc = w.doc[keep]
            kept = np.bincount(doc, minlength=hi - lo)
            follows = np.append(doc[1:] == doc[:-1], False) if len(keep) else np.zeros(0, dtype=bool)
            data = w.data.copy()
            data[w.end[keep[follows]]] = 0x20
            mask = np.zeros(len(data) + 1, dtype=np.int32)
            mask[w.start[keep]] += 1
            # A kept word's separator may be where the next word's bytes begin to count, so ends are taken off apart.
            np.subtract.at(mask, w.end[keep] + follows, 1)
            chosen = np.cumsum(mask[:-1]) > 0
            sizes = np.bincount(doc, weights=(w.end - w.start)[keep] + follows, minlength=hi - lo).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            new = pa.Array.from_buffers(pa.large_string(), hi - lo, [None, pa.py_buffer(offsets), pa.py_buffer(data[chosen])]).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).slice(lo, hi - lo) for c in rest], new, pa.array(w.counts.astype(np.int64)), pa.array((w.counts - kept).astype(np.int64))],
                names=[*rest, "text", "n_words", "n_removed"],
            )


def remove(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The documents with the kept words, joined by one space, as ``text``, and n_words and n_removed.

    ``keep`` names further columns to carry along.
    """
    extra = {f"_x{k}": c for k, c in enumerate(keep or [])}
    found = repeats(docs, window, anchor, id_col, text_col)
    # A document's spans lie within its words; a text's own copies of one span are given once.
    spans = found.groupBy("doc_id").agg(F.collect_set(F.struct("start", "n", "sum")).alias("spans")).select(F.col("doc_id").alias("_doc"), F.lit(0).alias("_s"), "spans")
    named = only(docs, doc_id=id_col, text=text_col, **extra)
    # Rows with a null id meet no spans; a salt deals them out.
    salt = F.when(named.doc_id.isNull(), F.pmod(F.xxhash64("text"), F.lit(SALTS)) + 1).otherwise(0)
    joined = named.join(spans, (named.doc_id.cast("long") == spans._doc) & (salt == spans._s), "left").drop("_doc", "_s")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema if f.name != "text")
    out = joined.select(*[c for c in named.columns if c != "text"], "text", "spans").mapInArrow(_kept(window), f"{kinds}, text string, n_words long, n_removed long")
    return out.select("doc_id", "text", "n_words", "n_removed", *[F.col(k).alias(c) for k, c in extra.items()])
