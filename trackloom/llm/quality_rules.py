"""Line-first quality rules, in DataFrame functions only.

Each line is held against the rules on its own: it must hold a sentence's end of any script
(punctuation), must not be a menu or link list (navigation), mostly notices (boilerplate), or
mostly signs and shouting (noise). Failing lines go; a document that loses more than ``MOST_LOST`` percent of its
characters, or fails the base rules on repetition and length, is rejected.

Everything of a document is computed within its row, so there is no shuffle and no state:
repeated eight-word windows are found by sorting the row's window hashes, and only in
documents whose distinct hashes are fewer than their windows.

Defined results: a null or blank text has no words and is rejected, being under the base
length; repeated rows get a row each; an empty table gives an empty result; other columns are
ignored by ``assess`` and kept by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
MOST_LOST = 50

#: Sentence ends of many scripts (Latin, CJK, Arabic, Urdu, Devanagari, Armenian, Ethiopic, Khmer, Burmese, Tibetan).
TERMINALS = ".!?…。！？｡．؟۔।॥։።៖។၊။།༎‼⁇⁈⁉"
CLOSERS = """"'”’»›)\\]』」）］》〉*_"""
#: A line needs no space after its last end; inside a line an ASCII end needs one ("3.14").
ENDS = rf"""[{TERMINALS}][{CLOSERS}]*([\x20\x09-\x0D]|\z)|[。！？｡؟۔।॥]"""
MARKS = r"[|›»]"
OPENERS = r"[«‹]"
MENU = r"(?i)^[\x20\x09-\x0D]*(home|menu|log ?in|sign ?(in|up)|search|contact( us)?|about( us)?|next|previous|back to top|skip to content)[\x20\x09-\x0D.!?]*\z"
BOILERPLATE = r"(?i)all rights reserved|lorem ipsum|enable javascript|uses? cookies|cookie policy|privacy policy|terms (of (use|service)|and conditions)|subscribe to our|click here to"
WORD = r"[^\x20\x09-\x0D]+"
SIGNS = r"[#*$%&<>]"
SHOUT = "!!"
WORDS_A_MARK = 4
WORDS_A_NOTICE = 15


def bad_line(line: Column) -> Column:
    """Whether a line with words fails a rule.

    Navigation: two marks or more between short pieces, a closing quotation mark being one only
    where none was opened. Boilerplate: notices that make up a good part of the line.
    """
    count = lambda p: F.regexp_count(line, F.lit(p))
    marks = count(MARKS) - count(OPENERS)
    # Most lines end a sentence with their last character, which is soon seen.
    ended = F.right(F.rtrim(line), F.lit(1)).isin(*TERMINALS)
    return (
        ~(ended | line.rlike(ENDS))
        | ((marks >= 2) & (count(WORD) <= WORDS_A_MARK * (marks + 1)))
        | line.rlike(MENU)
        | (line.rlike(BOILERPLATE) & (count(WORD) <= WORDS_A_NOTICE * count(BOILERPLATE)))
        | (count(SIGNS) * 10 > F.length(line))
        | (count(SHOUT) >= 3)
    )


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The base measures, the verdict and kept_text of every text.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, n_lines, n_kept_lines, kept_text, and those of ``keep``.
    """
    carried = keep or []
    c = F.col
    d = docs.select(c(id_col).alias("_id"), F.coalesce(c(text_col), F.lit("")).alias("_t"), *[c(x).alias(f"_x{k}") for k, x in enumerate(carried)])
    own = ["_id", *[f"_x{k}" for k in range(len(carried))]]
    d = d.select(
        *own,
        F.array_remove(F.split("_t", SPACE + "+"), "").alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    d = d.select(
        *own,
        "n_symbols",
        "_w",
        "_lines",
        F.filter("_lines", lambda x: ~bad_line(x)).alias("_good"),
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.when(
            F.size("_w") > WINDOW,
            F.transform("_w", lambda x: F.xxhash64(x)),
        ).alias("_hw"),
    )
    # A window's hash is made of its halves' hashes, from single words up, so each is made once.
    step = 1
    while step < WINDOW:
        both = F.zip_with("_hw", F.slice("_hw", F.lit(step + 1), F.size("_hw")), lambda a, b: F.xxhash64(a, b))
        d = d.select(*own, *["n_symbols", "n_words", "word_chars", "_lines", "_good", "_w"], F.when(F.col("_hw").isNotNull(), both).alias("_hw"))
        step *= 2
    d = d.withColumn("_h", F.slice("_hw", F.lit(1), F.size("_w") - (WINDOW - 1)))
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    d = d.select(
        *own,
        *["n_symbols", "n_words", "word_chars", "_lines", "_good", "_w"],
        F.when(repeats, F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s"),
    )
    # Neighbours in hash order with equal hashes, and equal words, are repeated windows.
    window = lambda x: F.slice("_w", x["i"] + 1, WINDOW)
    same = F.zip_with(
        F.slice("_s", F.lit(1), F.size("_s") - 1), F.slice("_s", F.lit(2), F.size("_s") - 1), lambda a, b: F.when((a["h"] == b["h"]) & (window(a) == window(b)), F.array(a["i"], b["i"]))
    )
    places = F.array_sort(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))
    d = d.select(*own, *["n_symbols", "n_words", "word_chars", "_lines", "_good"], F.when(c("_s").isNotNull(), places).alias("_p"))
    covered = F.aggregate(
        "_p",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("sum")),
        lambda acc, p: F.struct(p.alias("last"), (acc["sum"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("sum")),
        lambda acc: acc["sum"],
    )
    d = d.select(
        *own,
        *["n_symbols", "n_words", "word_chars"],
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(c("_p").isNotNull(), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size("_good").cast("long").alias("n_kept_lines"),
        F.length(F.array_join("_lines", "")).alias("_all"),
        F.length(F.array_join("_good", "")).alias("_left"),
        F.array_join("_good", "\n").alias("kept_text"),
    )
    failed = (c("n_words") < LEAST_WORDS) | (100 * c("n_repeat_words") > MOST_REPEATED * c("n_words"))
    enough = 100 * c("_left").cast("long") >= (100 - MOST_LOST) * c("_all").cast("long")
    return d.select(
        c("_id").alias("doc_id"),
        *["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        failed.alias("base_failed"),
        (~failed & enough).alias("kept"),
        *["n_lines", "n_kept_lines", "kept_text"],
        *[c(f"_x{k}").alias(x) for k, x in enumerate(carried)],
    )


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, text (the kept lines) and the columns of ``keep`` of the documents that are kept.

    The verdict leaves through a generator, past which no filter is pushed: pushed down, it
    would be spelled out in terms of the text and computed many times over.
    """
    carried = keep or []
    judged = assess(docs, id_col, text_col, carried)
    own = F.struct("doc_id", "kept", F.col("kept_text").alias("text"), *[F.col(x).alias(f"_x{k}") for k, x in enumerate(carried)])
    out = judged.select(F.inline(F.array(own))).where("kept")
    return out.select("doc_id", "text", *[F.col(f"_x{k}").alias(x) for k, x in enumerate(carried)])
