"""N-gram Jaccard join by rare-first prefix filtering.

A document's set is its distinct ``n``-word shingles, as 64-bit hashes (with fewer words, the
whole sequence as one). Two documents link when their sets' Jaccard similarity is at least
``percent`` / 100, compared in whole numbers.

1. One pass gives each set's size and fingerprint, and a sketch of shingle frequencies over all
   documents. Equal sets are one class, whose smallest id stands for them.
2. Each set is ordered rare first by the sketch's frequency class, then by hash: one total
   order for all. Two similar sets share a shingle among their first size - ceil(t size) + 1.
3. Prefix rows meet by shingle, sorted by size. Each is paired with the eight rows before it and
   a few further back, those that pass the length and positional filters; each pair is verified
   once, behind a suffix filter.
4. Rows of a larger group that these links leave in different components are paired too, by the
   same filters. A pair inside one component cannot change a class, so a group of m near copies
   costs some m pairs where it holds together.

Hot shingles: one whose frequency in the sketch is over ``HOT_ROWS`` has its rows dealt by salts of
row and shingle in step 3, so its groups stay below that, and near copies, which share many
shingles, meet under others where one shingle's salt parts them. Step 4 parts a group of more
than ``BLOCK_ROWS`` rows by size: a band's sets can link with those of its own and the next one
only, and meet no others. What two neighbouring bands hold, or a smaller group, gives its largest
component and its other rows blocks of ``BLOCK_ROWS`` each, and lets each block of the one meet
each of the others: every pair is looked at in one task, and no task has more than two blocks.

Components are whole: no group, pair or document is dropped. Texts are needed thrice: for
sketch and sizes, for prefixes, and for the candidates' sets, which a Bloom filter of fixed
size picks before any shuffle.

Defined results: a null, empty or blank text has an empty set and links with nothing; a row
with a null id keeps its row with a null class; rows that repeat an id count as one document,
whose text is the smallest of theirs, and get a row each, with the size of their own set; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm import _sketch, _words
from trackloom.llm._shared import discard, only, settle
from trackloom.llm.components import components

SKETCH_CELLS = 1 << 22
BLOOM_CELLS = 1 << 22
SEEN_SETS = 1 << 16
HOT_ROWS = 512
BLOCK_ROWS = 256
U64 = np.uint64


class Sets:
    """The distinct shingles of a slice's documents, sorted by document and hash."""

    def __init__(self, w: _words.Words, n: int):
        h, docs = w.hashes(), w.hi - w.lo
        g = _words.grams(h, n, 31)
        whole = w.doc[: len(g)] == w.doc[n - 1 :] if len(g) else np.zeros(0, dtype=bool)
        g, doc = g[whole], w.doc[: len(whole)][whole]
        few = np.flatnonzero((w.counts > 0) & (w.counts < n))
        if len(few):
            c = _words.constants(32, n)
            short = np.zeros(len(few), dtype=U64)
            for j in range(n - 1):
                there = w.counts[few] > j
                short[there] += h[w.first[few[there]] + j] * c[j]
            short = _words.mix(short + w.counts[few].astype(U64))
            g, doc = np.concatenate([g, short]), np.concatenate([doc, few])
        o = _words.by_doc(g, doc)
        g, doc = g[o], doc[o]
        keep = np.ones(len(g), dtype=bool)
        keep[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
        self.hash, self.doc = g[keep], doc[keep]
        self.size = np.bincount(self.doc, minlength=docs)
        self.first = np.concatenate([[0], np.cumsum(self.size)])

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for salt in (0x1234567, 0x89ABCDE):
            sums = np.concatenate([np.zeros(1, U64), np.cumsum(_words.mix(self.hash ^ U64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))])
            out.append((sums[self.first[1:]] - sums[self.first[:-1]]).view(np.int64))
        return out[0], out[1]


def _measure(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(SKETCH_CELLS, dtype=np.uint32)
        for batch in batches:
            for w in _words.slices(batch.column("text"), lower=True):
                s = Sets(w, n)
                at, n_here = np.unique((s.hash & U64(SKETCH_CELLS - 1)).astype(np.int32), return_counts=True)
                cells[at] += n_here.astype(np.uint32)
                one, two = s.fingerprints()
                docs = w.hi - w.lo
                none = pa.nulls(docs, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(docs, np.int32)), batch.column("doc_id").slice(w.lo, docs), pa.array(s.size.astype(np.int64)), pa.array(one), pa.array(two), pa.nulls(docs, pa.int64()), none],
                    names=["kind", "doc_id", "n_shingles", "one", "two", "block", "cells"],
                )
        block, raw = _sketch.blocks(cells)
        gap = [pa.nulls(len(block), pa.int64())] * 4
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(block), np.int32)), *gap, block, raw], names=["kind", "doc_id", "n_shingles", "one", "two", "block", "cells"])

    return run


def frequency_classes(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each cell's frequency class, and for each class the salts that its shingles' rows are dealt to."""
    unit = _sketch.over(cells)[1]
    salts = np.minimum(np.ceil(unit * 2 ** (np.arange(64) / 2) / HOT_ROWS), 1 << 20).astype(np.int32)
    return _sketch.classes(cells), salts


def _prefixes(n: int, percent: int, table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (classes, salts), seen = table.value, {}
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for w in _words.slices(batch.column("text"), lower=True):
                s = Sets(w, n)
                # A task sends one of the equal sets it meets: any stands for its class.
                one, two = s.fingerprints()
                fresh = np.zeros(w.hi - w.lo, dtype=bool)
                for k, key in enumerate(zip(one.tolist(), two.tolist(), strict=True)):
                    if s.size[k] and key not in seen:
                        fresh[k] = True
                        if len(seen) >= SEEN_SETS:
                            seen.clear()
                        seen[key] = None
                c = classes[(s.hash & U64(SKETCH_CELLS - 1)).astype(np.int64)]
                o = np.argsort(c, kind="stable")
                o = o[np.argsort(s.doc[o].astype(np.uint16), kind="stable")]
                h, doc, dealt = s.hash[o], s.doc, salts[c[o]]
                pos = np.arange(len(h)) - s.first[doc]
                size = s.size[doc]
                keep = (pos < size - (percent * size + 99) // 100 + 1) & fresh[doc]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[keep].view(np.int64)), pa.array(dealt[keep]), pa.array(ids[w.lo + doc[keep]]), pa.array(size[keep].astype(np.int32)), pa.array(pos[keep].astype(np.int32))],
                    names=["token", "salts", "doc_id", "n", "pos"],
                )

    return run


ROWS = "token long, salts int, doc_id long, n int, pos int"


def _dealt(row: str = "doc_id") -> Column:
    """Which of its token's salts a row has; another one for another token."""
    return F.when(F.col("salts") > 1, F.pmod(F.xxhash64(row, "token"), F.col("salts"))).otherwise(0)


def _in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of tokens that have several, or may have them under another salt; rows come sorted by token."""
    before, held = None, None  # the last row's token if it has gone out or not, and the row if it waits
    for batch in batches:
        if not batch.num_rows:
            continue
        token = batch.column("token").to_numpy()
        if held is not None:
            if held.column("token")[0].as_py() == token[0]:
                yield held
            held = None
        same = token[1:] == token[:-1]
        keep = np.append(before is not None and token[0] == before, same) | np.append(same, False) | (batch.column("salts").to_numpy() > 1)
        if not keep[-1]:
            held = batch.slice(batch.num_rows - 1, 1)
        before = token[-1]
        yield batch.filter(pa.array(keep))


def need(a, b, percent: int):
    """The least common shingles that sets of these sizes link with: ceil(t/(1+t) (a+b))."""
    return (percent * (a + b) + 99 + percent) // (100 + percent)


#: How far back a row looks for partners in its group: all of a small group, and a sparse net over a large one.
DENSE = tuple(range(1, 9))
SKIPS = (*DENSE, 16, 32, 64, 128)


def _neighbours(percent: int):
    """Rows sorted by token, salt and size to pairs with the rows SKIPS before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            rows = tuple(batch.column(c).to_numpy() for c in ("token", "doc_id", "n", "pos"))
            if not len(rows[0]):
                continue
            old = 0 if before is None else len(before[0])
            if old:
                rows = tuple(np.concatenate([x, y]) for x, y in zip(before, rows, strict=True))
            token, doc, n, pos = rows
            left, right = [], []
            for k in SKIPS:
                j = np.arange(max(old, k), len(token))
                j = j[token[j] == token[j - k]]
                j = j[_may_link(n[j - k], pos[j - k], n[j], pos[j], percent) & (doc[j - k] != doc[j])]
                left.append(np.minimum(doc[j - k], doc[j]))
                right.append(np.maximum(doc[j - k], doc[j]))
            before = tuple(x[-max(SKIPS) :] for x in rows)
            a, b = np.concatenate(left), np.concatenate(right)
            # One pair often shares many tokens of one batch.
            o = np.lexsort((b, a))
            new = np.ones(len(o), dtype=bool)
            new[1:] = (a[o[1:]] != a[o[:-1]]) | (b[o[1:]] != b[o[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array(a[o[new]]), pa.array(b[o[new]])], names=["a", "b"])

    return run


def _may_link(na, pa_, nb, pb, percent: int):
    """The length filter, and the positional one for the first shingle two sets share."""
    na, nb = na.astype(np.int64), nb.astype(np.int64)
    return (percent * na <= 100 * nb) & (percent * nb <= 100 * na) & (1 + np.minimum(na - pa_ - 1, nb - pb - 1) >= need(na, nb, percent))


#: The zone of a group that is not parted by size.
WHOLE = -2


def _zones(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (…, n, big) of big groups once for each pair of neighbouring size bands (zone and zone + 1) they are in.

    Bands are as wide as the largest ratio of two sizes that can link, so linked sets are in one band
    or in neighbours. ``low`` is 1 for rows of the zone's lower band; two upper rows meet in the next zone.
    """
    band = F.floor(F.log("n") / math.log(100 / percent * 1.001)).cast("int")
    zone = lambda z, low: F.struct(z.cast("int").alias("zone"), F.lit(low).alias("low"))
    zones = F.when(F.col("big"), F.array(zone(band, 1), zone(band - 1, 0))).otherwise(F.array(zone(F.lit(WHOLE), 1)))
    return rows.select("token", "rep", "n", "pos", "comp", F.explode(zones).alias("z")).select("token", "z.*", "rep", "n", "pos", "comp")


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Rows (token, zone, low, rep, n, pos, comp) of zones with several components, under each key (token, zone, kind, i, j) where they meet others.

    Kind 0 is a block of the zone's largest component (side 0) and one of the other rows (side 1);
    kind 1 is two blocks of the other rows, or one that meets itself (side 2).
    """
    sizes = rows.groupBy("token", "zone", "comp").agg(F.count("*").alias("c"), F.sum("low").alias("low"))
    sizes = sizes.groupBy("token", "zone").agg(F.max_by("comp", F.struct("c", "comp")).alias("top"), F.max("c").alias("main"), F.sum("c").alias("all"), F.sum("low").alias("low")).where("low > 0 and all > main")
    blocks = lambda c: F.ceil(c / BLOCK_ROWS).cast("int")
    # Written first, so that the join is no stage of the aggregation's and Spark may broadcast it or split a hot token's rows.
    sizes = settle(sizes.select("token", "zone", "top", blocks(F.col("main")).alias("m"), blocks(F.col("all") - F.col("main")).alias("o")), "mixed-sizes")
    r = rows.join(sizes, ["token", "zone"])
    at = lambda c: F.pmod(F.xxhash64("rep", "token"), F.col(c)).cast("int")
    each = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    key = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    main = F.transform(each("o"), lambda x: key(0, at("m"), x, F.lit(0)))
    own = at("o")
    others = F.concat(
        F.transform(each("m"), lambda x: key(0, x, own, F.lit(1))),
        F.transform(each("o"), lambda x: key(1, F.least(own, x), F.greatest(own, x), F.when(own == x, 2).when(own < x, 0).otherwise(1))),
    )
    keyed = r.select("token", "zone", "low", "rep", "n", "pos", "comp", F.explode(F.when(F.col("comp") == F.col("top"), main).otherwise(others)).alias("k"))
    return keyed.select("token", "zone", "k.*", "low", "rep", "n", "pos", "comp")


MEETING = ["token", "zone", "kind", "i", "j"]


def _across(percent: int):
    """Rows sorted by MEETING to pairs of different components that pass the filters."""
    names = [*MEETING, "side", "low", "rep", "n", "pos", "comp"]

    def met(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        side, low, rep, n, pos, comp = group[len(MEETING) :]
        a, b = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        here = (comp[a][:, None] != comp[b][None, :]) & ((low[a][:, None] | low[b][None, :]) > 0)
        x, y = np.nonzero(here & _may_link(n[a][:, None], pos[a][:, None], n[b][None, :], pos[b][None, :], percent))
        x, y = rep[a[x]], rep[b[y]]
        return np.minimum(x, y), np.maximum(x, y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(names), 0), dtype=np.int64)

        def pairs(rows: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
            found = [met(rows[:, a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            # Both orders of a pair of one block, and pairs that share several tokens, once.
            o = np.lexsort((b, a))
            new = np.ones(len(o), dtype=bool)
            new[1:] = (a[o[1:]] != a[o[:-1]]) | (b[o[1:]] != b[o[:-1]])
            return pa.RecordBatch.from_arrays([pa.array(a[o[new]]), pa.array(b[o[new]])], names=["a", "b"])

        for batch in batches:
            rows = np.concatenate([held, np.stack([batch.column(c).to_numpy().astype(np.int64) for c in names])], axis=1)
            if not rows.shape[1]:
                continue
            cuts = np.append(0, np.flatnonzero(np.any(rows[: len(MEETING), 1:] != rows[: len(MEETING), :-1], axis=0)) + 1)
            held = rows[:, cuts[-1] :]
            if len(cuts) > 1:
                yield pairs(rows, cuts)
        if held.shape[1]:
            yield pairs(held, np.array([0, held.shape[1]]))

    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link."""
    least = need(len(a), len(b), percent)
    if percent * len(a) > 100 * len(b) or percent * len(b) > 100 * len(a):
        return False
    # Suffix filter: cut both at a few of a's values; what the parts' sizes differ by is in one set only.
    if len(a) >= 32:
        at = np.arange(1, 8) * len(a) // 8
        parts = np.diff(np.concatenate([[0], at, [len(a)]])) - np.diff(np.concatenate([[0], np.searchsorted(b, a[at]), [len(b)]]))
        if np.abs(parts).sum() > len(a) + len(b) - 2 * least:
            return False
    k = np.searchsorted(b, a)
    k[k == len(b)] = len(b) - 1
    return int((b[k] == a).sum()) >= least


def _verify(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}

        def sets(ids: list[int], texts: pa.Array) -> list[np.ndarray]:
            """Sets by id; few are held, as pairs that share one mostly come together."""
            missing = [k for k, i in enumerate(ids) if i not in kept]
            if len(kept) > 2000:
                kept.clear()
                missing = list(range(len(ids)))
            first = {}
            for k in missing:
                first.setdefault(ids[k], k)
            if first:
                wanted = list(first)
                for w in _words.slices(texts.take(pa.array([first[i] for i in wanted])), lower=True):
                    s = Sets(w, n)
                    for k in range(w.hi - w.lo):
                        kept[wanted[w.lo + k]] = s.hash[s.first[k] : s.first[k + 1]].copy()
            return [kept[i] for i in ids]

        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
                left = sets(a, batch.column("text_a"))
                right = sets(b, batch.column("text_b"))
                ok = pa.array([bool(len(x) and len(y)) and similar(x, y, percent) for x, y in zip(left, right, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], names=["a", "b"])

    return run


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells = np.zeros(BLOOM_CELLS, dtype=np.int64)
    for batch in batches:
        for at in _bloom_cells(batch.column("doc_id").to_numpy()):
            cells[at] = 1
    block, raw = _sketch.blocks(cells)
    yield pa.RecordBatch.from_arrays([block, raw], names=["block", "cells"])


def _bloom_cells(ids: np.ndarray) -> list[np.ndarray]:
    h = _words.mix(ids.astype(np.int64).view(U64) + U64(0x51ED270B))
    return [(h & U64(BLOOM_CELLS - 1)).astype(np.int64), (h >> U64(32) & U64(BLOOM_CELLS - 1)).astype(np.int64)]


def _texts_of(named: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and text of wanted documents, settled: a fixed-size Bloom filter goes before the join."""
    spark = named.sparkSession
    cells = _sketch.total(wanted.mapInArrow(_bits, "block long, cells binary"), BLOOM_CELLS)
    table = spark.sparkContext.broadcast(np.packbits(cells > 0))

    @F.pandas_udf("boolean")
    def may_be(ids: pd.Series) -> pd.Series:
        bits = table.value
        out = np.ones(len(ids), dtype=bool)
        for at in _bloom_cells(ids.to_numpy()):
            out &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return pd.Series(out)

    texts = named.where(may_be("doc_id")).join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return settle(texts, "candidate-texts")


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return settle(pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInArrow(_verify(n, percent), "a long, b long"), "verified")


MEASURED = "kind int, doc_id long, n_shingles long, one long, two long, block long, cells binary"


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links, its own included)."""
    named = only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    measured = settle(named.mapInArrow(_measure(n), MEASURED), "measured", ["kind"])
    rows = measured.where("kind = 0")
    sets = F.struct("one", "two", "n_shingles")
    several = settle(rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(sets).alias("lo"), F.max(sets).alias("hi")).where("lo <> hi").select("doc_id"), "ids-of-several-sets")
    if several.isEmpty():
        return _classes(named, measured, n, percent)
    # Ids whose rows have different sets: one text stands for each.
    chosen = named.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    once = named.where("doc_id is not null").join(several, "doc_id", "left_anti").unionByName(chosen)
    classes = _classes(once, settle(once.mapInArrow(_measure(n), MEASURED), "measured", ["kind"]), n, percent)
    of = classes.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return rows.select("doc_id", "n_shingles").join(of, "doc_id", "left").select("doc_id", "n_shingles", "component_id")


def _classes(named: DataFrame, measured: DataFrame, n: int, percent: int) -> DataFrame:
    """The result where rows of one id have one set."""
    spark = named.sparkSession
    rows = measured.where("kind = 0").select("doc_id", "n_shingles", "one", "two")
    cells = _sketch.total(measured.where("kind = 1").select("block", "cells"), SKETCH_CELLS)
    table = spark.sparkContext.broadcast(frequency_classes(cells))

    shared = settle(rows.where("n_shingles > 0 and doc_id is not null").groupBy("one", "two").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c"), "equal-sets")
    members = settle(
        rows.join(shared, ["one", "two"], "left").select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")).alias("rep")),
        "members",
    )
    discard(shared)
    rep_of = members.where("n_shingles > 0 and doc_id is not null").select("doc_id", "rep").distinct()

    named = named.where("doc_id is not null")
    grouped = settle(
        named.mapInArrow(_prefixes(n, percent, table), ROWS).repartition(F.col("token"), _dealt()).sortWithinPartitions("token").mapInArrow(_in_groups, ROWS),
        "prefix-groups",
    )
    # Rows of a representative: equal sets that different tasks sent meet here.
    reps = settle(grouped.join(rep_of, "doc_id").select("token", "salts", F.col("rep").alias("doc_id"), "n", "pos").distinct(), "prefix-reps")
    discard(grouped)
    met = reps.withColumn("salt", _dealt()).repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "doc_id").drop("salt")
    first = settle(met.mapInArrow(_neighbours(percent), "a long, b long").distinct(), "pairs")
    texts = _texts_of(named, reps.select("doc_id").distinct())
    links = _verified(first, texts, n, percent)
    found = settle(components(links), "components")

    known = reps.join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("token", "salts", F.col("doc_id").alias("rep"), "n", "pos", F.coalesce("component", "doc_id").alias("comp"))
    known = settle(known, "labelled")
    discard(reps)
    discard(found)
    # In a smaller group without salts all pairs have been looked at.
    mixed = settle(known.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c"), F.max("salts").alias("salts")).where(f"lo < hi and (c > {len(DENSE) + 1} or salts > 1)").select("token", F.expr(f"c > {BLOCK_ROWS}").alias("big")), "mixed")
    rest = settle(_zones(known.join(mixed, "token"), percent), "mixed-rows")
    more = settle(
        _in_blocks(rest)
        .repartition(*MEETING)
        .sortWithinPartitions(*MEETING)
        .mapInArrow(_across(percent), "a long, b long")
        .distinct()
        .join(first, ["a", "b"], "left_anti"),
        "pairs-across",
    )
    late = _verified(more, texts, n, percent)
    for used in (first, texts, known, mixed, rest, more):
        discard(used)
    found = settle(components(links.union(late)), "components")
    discard(links)
    discard(late)
    out = members.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
