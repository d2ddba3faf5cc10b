"""The best of many names for each of many, exactly, without scoring or bounding every pair.

Similarity of names is dear, but it is bounded from above: what matches is no more than the longest
common subsequence, which bits of a word follow for a whole block of names at once, and words that fit
no other add nothing. The same bound holds for all names that begin alike, from their beginning only.
So stations lie in blocks by beginnings (and main ones apart), and a name visits blocks in the order of
their bounds, in a few rounds: its best ones so far say which blocks, and which stations of a block,
could still enter. Of stations of one name, just the first ``most`` can. What leaves a task is ``most``
rows a name, which a window brings together.
"""

from __future__ import annotations

import os
from bisect import bisect_left
from collections import defaultdict
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions import text
from trackloom.operators.lineage import cut

NAMES_A_BLOCK, STATIONS_A_BLOCK = 1024, 4096
BEGIN_ALIKE = 1024  # names of a block, unless one name is more
NAMES_A_VISIT = 16384
ROUNDS = [(0, 2), (2, 5), (5, 16), (16, None)]  # which of a name's blocks are visited, by rank
LETTERS, BITS = 64, 63
END = "\x00"


class Block:
    """Canonical names, and upper bounds of what another one scores with each.

    Given ``sizes`` (least and greatest) and ``counts`` of words (greatest), names are only the
    beginnings of those that are meant, and bounds hold for all of these.
    """

    def __init__(self, names: list[str], sizes: tuple[np.ndarray, np.ndarray] | None = None, counts: np.ndarray | None = None):
        self.names, self.open = names, sizes is not None
        known = np.array([len(n) for n in names])
        words = [(n.split(" ") if self.open else n.split()) for n in names]
        held = np.array([len(w) for w in words])
        self.least, self.size = sizes if self.open else (known, known)
        self.words = np.maximum(1, counts if self.open else held)
        self.known, self.tail, self.more = held, self.size - known, self.words > held if self.open else np.zeros(len(names), bool)
        self.letters = None if self.open else np.stack([letters(n) for n in names])
        self.begin = os.path.commonprefix(names)
        rest = [n[len(self.begin) :] for n in names]
        self.alphabet = sorted(set("".join(rest)))
        code = {c: k for k, c in enumerate(self.alphabet)}
        self.codes = np.full((max(map(len, rest)), len(names)), len(code))  # a last code, which nothing matches
        for k, r in enumerate(rest):
            self.codes[: len(r), k] = [code[c] for c in r]
        self.holders: dict = defaultdict(list)  # of each word, as often as they hold it
        self.begins: dict = defaultdict(list)
        for k, own in enumerate(words):
            for w in own:
                self.holders[w].append(k)
            if own:
                self.begins[own[0]].append(k)
        self.holders = {w: np.array(k) for w, k in self.holders.items()}
        self.sorted = sorted(self.holders)
        self._fitting: dict = {}

    def fitting(self, word: str) -> list[str]:
        """The block's words that fit a word, or, of beginnings, may."""
        if (found := self._fitting.get(word)) is None:
            found = {word[:n] for n in range(0 if self.open else 3, len(word) + 1)} | {word}
            found = {w for w in found if w in self.holders}
            if self.open or len(word) == 1 or len(word) >= 3:
                k = bisect_left(self.sorted, word)
                while k < len(self.sorted) and self.sorted[k].startswith(word):
                    found.add(self.sorted[k])
                    k += 1
            found = self._fitting[word] = sorted(found)
        return found

    def common(self, name: str) -> np.ndarray:
        """At least as many letters as the name has in common with each, in their order.

        Bits that are 0 count the longest common subsequence (Hyyrö), up to any place of the name.
        """
        if len(name) > BITS:
            return np.minimum(self.size, len(name)) if self.open else np.minimum(self.letters, letters(name)).sum(axis=1)
        masks: dict = defaultdict(int)
        for k, c in enumerate(name):
            masks[c] |= 1 << k
        row, whole = (1 << len(name)) - 1, (1 << len(name)) - 1
        for c in self.begin:
            if m := masks.get(c, 0):
                u = row & m
                row = ((row + u) | (row - u)) & whole
        rows, mask = np.full(len(self.names), row, dtype=np.uint64), np.array([*[masks.get(c, 0) for c in self.alphabet], 0], dtype=np.uint64)
        for codes in self.codes:
            u = rows & mask[codes]
            rows = (rows + u) | (rows - u)
        if not self.open:
            return np.bitwise_count(~rows & np.uint64(whole)).astype(np.int64)
        free = np.minimum(self.tail, len(name))
        upto = (np.uint64(1) << (len(name) - free).astype(np.uint64)) - np.uint64(1)
        return np.bitwise_count(~rows & upto).astype(np.int64) + free

    def bounds(self, name: str) -> np.ndarray:
        """In the order of operations of ``text.similarity``, so that rounding keeps them above."""
        own, m = name.split(), len(self.names)
        if not own:
            return np.zeros(m)
        most = self.common(name)
        size = np.clip(most, self.least, self.size)
        ratio = 2.0 * np.minimum(most, size) / np.maximum(1, size + len(name))
        here, there, first = np.zeros(m), np.zeros(m), np.zeros(m, dtype=bool)
        for w in own:
            met = [self.holders[o] for o in self.fitting(w)]
            if met:
                hit = np.zeros(m, dtype=bool)
                hit[met[0] if len(met) == 1 else np.concatenate(met)] = True
                here += hit
        for o in {o for w in own for o in self.fitting(w)}:
            np.add.at(there, self.holders[o], 1)
        for o in self.fitting(own[0]):
            first[self.begins.get(o, [])] = True
        if self.open:
            here, there = np.where(self.more, len(own), here), self.words - (self.known - there)
        score = 0.45 * ratio + 0.35 * (here / len(own)) + 0.20 * (there / self.words)
        return np.where(self.size == 0, 0.0, np.minimum(1.0, score + np.where(first, 0.10, 0.0)))


def letters(name: str) -> np.ndarray:
    """How often letters occur, those of a cell together, which can only raise a bound."""
    return np.bincount([ord(c) % LETTERS for c in name], minlength=LETTERS).astype(np.int32)


def reached(bound: np.ndarray, extra: np.ndarray | float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether what has a bound is spare at best, and how high it comes in the order."""
    spare = bound < least
    return spare, np.where(spare, bound, np.minimum(1.0, bound + extra))


def best_of_block(names: list[str], ids: np.ndarray, others: list[str], main: np.ndarray, most: int, least: float, bonus: float, worst: list | None = None) -> list[tuple]:
    """(name, id, score, spare) of each name's best stations of a block, in the order of ``candidates``.

    worst: for each name what its best ones of other blocks need not be beyond (spare, -value, id), or None.
    """
    o = np.argsort(ids, kind="stable")
    ids, others, extra = ids[o], [others[k] for k in o], np.where(main[o], bonus, 0.0)
    distinct = list(dict.fromkeys(others))
    at = {n: k for k, n in enumerate(distinct)}
    of, block, out = np.array([at[n] for n in others]), Block(distinct), []
    for name, end in zip(names, worst or [None] * len(names), strict=True):
        bound = block.bounds(name)
        spare, reach = reached(bound[of], extra, least)
        scores: dict[int, float] = {k: 0.0 for k in np.flatnonzero(bound == 0)}
        best: list[tuple] = []
        left = np.arange(len(ids)) if end is None or end[0] else np.flatnonzero(~spare & (reach >= -end[1]))
        # Ids break ties, and stations come sorted by them.
        for k in left[np.lexsort((-reach[left], spare[left]))].tolist():
            if end is not None and (bool(spare[k]), -reach[k], ids[k]) > end:
                break
            if (s := scores.get(of[k])) is None:
                s = scores[of[k]] = text.similarity(name, others[k])
            low = s < least
            key = (low, -(s if low else min(1.0, s + extra[k])), ids[k], s)
            if len(best) < most or key < best[-1]:
                best = sorted([*best, key])[:most]
                if len(best) == most and (end is None or best[-1][:3] < end):
                    end = best[-1][:3]
        out += [(name, int(i), float(s), bool(low)) for low, _, i, s in best]
    return out


def in_blocks(stations: DataFrame) -> DataFrame:
    """Stations (other, main) with ``block``: the shortest beginning that at most ``BEGIN_ALIKE`` names of their kind have."""
    c = F.col
    names = stations.select("other", "main").distinct()
    ends = F.explode(F.sequence(F.lit(0), F.char_length("other"))).alias("size")
    begins = names.select("other", "main", ends).withColumn("begin", F.expr("substring(other, 1, size)"))
    large = begins.groupBy("main", "begin").agg(F.count("*").alias("n")).where(c("n") > BEGIN_ALIKE).select("main", "begin")
    longest = begins.join(F.broadcast(large), ["main", "begin"]).groupBy("other", "main").agg((F.max("size") + 1).alias("size"))
    block = F.expr("substring(concat(other, char(0)), 1, size)")
    placed = names.join(longest, ["other", "main"], "left").select("other", "main", F.coalesce(block, F.lit("")).alias("block"))
    return stations.join(placed, ["other", "main"])


def best_names(names: DataFrame, stations: DataFrame, most: int, least: float, bonus: float = 0.03) -> DataFrame:
    """name, sid, score, spare, n: each name's ``most`` best stations, those of ``least`` or more before the others (spare).

    names: name, canonical and distinct; stations: sid, name (canonical), main. Order: score, with
    ``bonus`` for main ones and at most 1, for those that are not spare, then sid.
    """
    c = F.col
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    deal = lambda x, k: F.pmod(F.xxhash64(*x), F.lit(k)).cast("int")
    alike = W.partitionBy("other", "main").orderBy("sid")
    kept = stations.select("sid", c("name").alias("other"), F.coalesce("main", F.lit(False)).alias("main")).withColumn("k", F.row_number().over(alike)).where(c("k") <= most).drop("k")
    kept = cut(in_blocks(cut(kept)))
    said = [F.min("other").alias("low"), F.max("other").alias("high"), F.min(F.char_length("other")).alias("least"), F.max(F.char_length("other")).alias("greatest"), F.max(F.size(F.split("other", " "))).alias("words"), F.min("sid").alias("sid")]
    about = cut(kept.groupBy("main", "block").agg(*said))
    n, m = names.count(), max(1, about.count())
    blocks, cells, visits = max(1, -(-n // NAMES_A_BLOCK)), max(1, -(-m // STATIONS_A_BLOCK)), max(1, -(-n // NAMES_A_VISIT))
    about = about.select("*", every(blocks).alias("a"), deal(["main", "block"], cells).alias("b"))
    rows = kept.select("*", every(visits).alias("v"))
    limit = "low boolean, value double, last long"
    # Rows are few and their work is much, so partitions are counted by names; sizes would make one of them.
    most_parts = max(4 * names.sparkSession.sparkContext.defaultParallelism, n // NAMES_A_BLOCK)
    dealt = lambda x, groups, *key: x.repartition(min(groups, most_parts), *key).groupBy(*key)

    def ends(x: pd.DataFrame) -> list:
        return [None if pd.isna(v) else (bool(s), -v, int(i)) for s, v, i in zip(x["low"], x["value"], x["last"], strict=True)]

    def choose(lo: int, hi: int | None, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        """The blocks that are next for each name, of those that could better its best ones."""
        out = []
        if len(x) and len(y):
            sid, main, key = y["sid"].to_numpy(), y["main"].to_numpy(dtype=bool), y["block"].to_numpy(dtype=object)
            block = Block([os.path.commonprefix([p, q]) for p, q in zip(y["low"], y["high"], strict=True)], (y["least"].to_numpy(), y["greatest"].to_numpy()), y["words"].to_numpy())
            for name, end in zip(x["name"], ends(x), strict=True):
                spare, reach = reached(block.bounds(name), np.where(main, bonus, 0.0), least)
                for j in np.lexsort((sid, -reach, spare))[lo:hi].tolist():
                    if end is not None and (bool(spare[j]), -reach[j], sid[j]) > end:
                        break
                    out.append((name, *((None, None, 0) if end is None else (end[0], -end[1], end[2])), bool(main[j]), key[j]))
        return pd.DataFrame(out, columns=["name", "low", "value", "last", "main", "block"])

    def visit(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        found = best_of_block(x["name"].tolist(), y["sid"].to_numpy(), y["other"].tolist(), y["main"].to_numpy(dtype=bool), most, least, bonus, ends(x)) if len(x) and len(y) else []
        return pd.DataFrame(found, columns=["name", "sid", "score", "spare"]).assign(main=bool(len(y)) and bool(y["main"].iloc[0]))

    value = F.when(c("spare"), c("score")).otherwise(F.least(F.lit(1.0), c("score") + F.when(c("main"), bonus).otherwise(0.0)))
    w, best = W.partitionBy("name").orderBy("spare", F.desc("value"), "sid"), None
    for lo, hi in ROUNDS:
        left = names.select("name", deal(["name"], blocks).alias("a"), every(cells).alias("b"))
        if best is None:
            left = left.select("*", F.lit(None).cast("boolean").alias("low"), F.lit(None).cast("double").alias("value"), F.lit(0).cast("long").alias("last"))
        else:
            left = left.join(best.where(c("n") == most).select("name", c("spare").alias("low"), "value", c("sid").alias("last")), "name", "left").fillna(0, ["last"])
        pairs = dealt(left, blocks * cells, "a", "b").cogroup(dealt(about, blocks * cells, "a", "b")).applyInPandas(partial(choose, lo, hi), f"name string, {limit}, main boolean, block string")
        pairs = pairs.withColumn("v", deal(["name"], visits))
        key = ["main", "block", "v"]
        found = dealt(pairs, m * visits, *key).cogroup(dealt(rows, m * visits, *key)).applyInPandas(visit, "name string, sid long, score double, spare boolean, main boolean").withColumn("value", value)
        found = found if best is None else best.drop("n").unionByName(found)
        best = cut(found.withColumn("n", F.row_number().over(w)).where(c("n") <= most))
    return best.select("name", "sid", "score", "spare", "n")
