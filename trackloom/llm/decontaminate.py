"""Benchmark decontamination by winnowing, in DataFrame functions only.

A benchmark window is ``WINDOW`` consecutive words of an item; an item of fewer words is one
window. A document's word is hit if it lies in a stretch of words that equals a window.

Of every document's and item's ``WINDOW`` consecutive words the smallest hash of ``GRAM``
consecutive ones is the fingerprint. Neighbouring windows mostly share theirs, so a document
leaves few: its windows are cut into stretches of one fingerprint. Equal windows have equal
fingerprints, so joining the fingerprints of documents and items misses no shared window, and a
shared span of ``WINDOW`` words or more always holds one. A hit is extended to the words around it,
the windows of its stretch, which are held against the items' windows word by word. A short item's
fingerprint is the hash of all its words, held against the documents' sequences of as many.

Fingerprints and windows of the benchmark are distinct, so a document's stretch and window meet
one row each at most, however many items hold them; items come last, through the set of those that
hold the same window. They are broadcast if they number at most ``BROADCAST_ROWS`` and hold at
most ``BROADCAST_BYTES`` of text. Beyond that the documents' fingerprints are shuffled alone, with
a key of their row, and those hit go back to the texts by that key; equal rows share a key and have
equal results. Spark may split the joins' hot keys.

Defined results: a null or empty text has no words and is hit by nothing; every row has its own
result, whatever its id (null or repeated); an item without words has no windows; repeated items
and repeated ids count once; a window of an item without an id hits words and names no item; texts
of any length are taken whole; an empty table or benchmark leaves nothing hit; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm._shared import discard, lower_az, only, settle

WINDOW = 10
GRAM = 5
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
TO_END = 1 << 30
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What parts the same words where A-Z is not yet lowered.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_az(F.coalesce(text, F.lit(""))), SEPARATOR), "")


def _joined(w: str, at: Column | str, n: Column | int) -> Column:
    return F.array_join(F.slice(F.col(w), F.col(at) + 1 if isinstance(at, str) else at + 1, n), " ")


def _rolled(frame: DataFrame, k: int) -> DataFrame:
    """frame with _g{k}: the hashes of k consecutive words from each on, made of shorter ones'; the last k - 1 are of fewer.

    Each step is a column of its own, so it is computed once.
    """
    if f"_g{k}" in frame.columns:
        return frame
    half = 1 << ((k - 1).bit_length() - 1)
    frame = _rolled(_rolled(frame, half), k - half)
    return frame.select("*", F.zip_with(f"_g{half}", F.slice(f"_g{k - half}", half + 1, TO_END), lambda a, b: F.xxhash64(a, b)).alias(f"_g{k}"))


def _stretches(frame: DataFrame, lengths: list[int], window: int, gram: int) -> DataFrame:
    """frame's columns with rows of f, m (words of a window) and lo and hi, the first and last place
    where a window of this fingerprint may begin; each window lies in the one or more of its own.

    frame: w, words. Sequences of each of the lengths under ``window`` are fingerprints of their own.
    """
    own, n, c = frame.columns, F.size("w"), F.col
    frame = frame.select(*own, F.transform("w", lambda x: F.xxhash64(x)).alias("_g1"))
    for k in [*([gram] if window in lengths else []), *[m for m in lengths if m < window]]:
        frame = _rolled(frame, k)
    frame = frame.select("*", F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).alias("_at"))
    row = lambda f, m, ahead: F.struct(f.alias("f"), F.lit(m).alias("m"), c("_at").alias("lo"), (c("_at") + ahead).alias("hi"))
    found = []
    if window in lengths:
        count = window - gram + 1
        g = [F.get(f"_g{gram}", c("_at") + j) for j in range(-1, count)]
        f, before = F.least(*g[1:]) if count > 1 else g[1], F.least(*g[:-1]) if count > 1 else g[0]
        # Where the smallest changes, or gives way to an equal one, a stretch begins; it ends when its gram is left behind.
        begins = (c("_at") == 0) | (f != before) | (f == g[0])
        found.append(F.when((c("_at") <= n - window) & begins, row(f, window, F.lit(count - 1))))
    found += [F.when(c("_at") <= n - m, row(F.xxhash64(F.get(f"_g{m}", c("_at")), F.lit(m)), m, F.lit(0))) for m in lengths if m < window]
    # The one generator for all lengths, past which no filter is pushed down.
    return frame.select(*own, F.inline(F.array(*found) if found else F.expr("cast(array() as array<struct<f:bigint,m:int,lo:int,hi:int>>)")))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """m, g (the words), item: every window of every item, each once."""
    named = only(benchmark, item=item_col, text=text_col).select("item", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    m = F.least(F.size("w"), F.lit(window))
    rows = named.select("item", "w", m.alias("m"), F.explode(F.sequence(F.lit(0), F.size("w") - m)).alias("at"))
    return rows.select("m", _joined("w", "at", F.col("m")).alias("g"), "item").distinct()


def _fingerprints(windows: DataFrame, lengths: list[int], window: int, gram: int) -> DataFrame:
    """f and m of each window's own words, each once."""
    own = windows.select("m", "g").distinct().select(F.col("m").alias("_own"), F.split("g", " ").alias("w"))
    return _stretches(own, lengths, window, gram).where("m = _own and lo = 0").select("f", "m").distinct()


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, spans (first and last word of each stretch of hit words) and items
    (the sorted distinct ids, as strings, of items that have a window in the text), for every row."""
    if not 1 <= gram <= window:
        raise ValueError("a fingerprint has 1 word to a window's")
    c = F.col
    named = only(docs, doc_id=id_col, text=text_col).withColumn("key", F.struct(F.xxhash64("doc_id", "text").alias("a"), F.hash("text", "doc_id").alias("b")))
    listed = settle(benchmark_windows(benchmark, window, item_col, item_text_col), "benchmark-windows")
    by_window = listed.groupBy("m", "g").agg(F.array_sort(F.collect_set(c("item").cast("string"))).alias("items"))
    by_window = settle(by_window.select("m", "g", F.md5(F.to_json("items")).alias("held"), F.size("items").alias("n"), "items"), "windows")
    size = by_window.agg(F.count("*").alias("n"), F.sum(F.octet_length("g") + 32 * c("n") + 64).alias("bytes")).first()
    # Windows have 1 to ``window`` words.
    lengths = sorted(r.m for r in by_window.select("m").distinct().collect())
    small = size.n <= BROADCAST_ROWS and (size.bytes or 0) <= BROADCAST_BYTES
    sent = F.broadcast if small else (lambda x: x)
    prints = settle(_fingerprints(by_window, lengths, window, gram), "fingerprints")
    sets = by_window.where("n > 0").groupBy("held").agg(F.first("items").alias("items"))
    windows = by_window.select("m", "g", "held")

    tokenised = named.select("key", words(c("text")).alias("w"))
    if small:
        met = _stretches(tokenised, lengths, window, gram).join(sent(prints), ["f", "m"])
    else:
        found = _stretches(tokenised, lengths, window, gram).drop("w").join(prints, ["f", "m"], "left_semi")
        by_key = found.groupBy("key").agg(F.collect_set(F.struct("m", "lo", "hi")).alias("s")).withColumnRenamed("key", "_key")
        met = named.join(by_key, c("key") == c("_key")).select("key", words(c("text")).alias("w"), F.inline("s"))
    tried = met.select("key", "m", "w", F.explode(F.sequence("lo", "hi")).alias("at")).select("key", "m", "at", _joined("w", "at", c("m")).alias("g"))
    # Of rows that share a key one is enough; a key's places are those of one text.
    right = tried.join(sent(windows), ["m", "g"]).groupBy("key").agg(F.collect_set(F.struct("at", "m")).alias("places"), F.collect_set("held").alias("held"))
    right = settle(right, "hit-texts")
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p["at"], p["at"] + p["m"] - 1)))))
    hit = right.select("key", covered.alias("p"), "held")
    first = F.filter("p", lambda x, i: (i == 0) | (F.get("p", i - 1) != x - 1))
    last = F.filter("p", lambda x, i: (i == F.size("p") - 1) | (F.get("p", i + 1) != x + 1))
    hit = hit.select(c("key").alias("_key"), F.size("p").cast("long").alias("n_hit"), F.arrays_zip(first.alias("first"), last.alias("last")).alias("spans"))
    of_items = right.select("key", F.explode("held").alias("held")).join(sent(sets), "held").groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    hit = hit.join(of_items.withColumnRenamed("key", "_items_of"), c("_key") == c("_items_of"), "left").drop("_items_of")
    counted = named.select("key", "doc_id", F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), BETWEEN), "")).cast("long").alias("n_words"))
    out = counted.join(hit, c("key") == c("_key"), "left")
    discard(listed)
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("spans", F.expr("cast(array() as array<struct<first:int,last:int>>)")).alias("spans"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
    )
