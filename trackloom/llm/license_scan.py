"""License scan by diagonal voting, in DataFrame functions only.

Every ``K``-word sequence of every text is joined by its hash to the places it has in the
license templates, a small fixed table. A hit at word p of the text and word t of a template
votes for the diagonal p - t; votes are summed by text, template and diagonal, and
neighbouring diagonals merge (a word put in or left out shifts the rest by one) into a span.

A span is verified word by word: the template's words and the span's words that lie in equal
sequences are counted, each place once however many diagonals met it, and the smaller count is
held against the longer of template and span. So words put in, left out or changed lower the
share, a span's words that the template lacks do too, and ``LEAST_SHARE`` decides.

Only hits, phrase places and one row a text are shuffled, once, by the id and a digest of the
text, so a task that runs again sends them alike. The templates' places are broadcast if they are at most
``BROADCAST_PLACES``; if a caller brings more, the join is left to Spark.

Defined results: a null or empty text has no words, nulls for the places, empty labels and
score 0; every row has its own result, whatever its id (null or repeated), and rows of one id and text
have equal ones; a very long text is read as a stream of words, and one task holds its hits; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.llm._shared import lower_az

K = 3
NEAR = 2
BROADCAST_PLACES = 50_000
LEAST_SHARE = 60  # percent of the template's words, or the span's where these are more

#: Between words: ASCII that is no letter or digit, once A-Z is lowered.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Public license notices and their labels.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    (
        "mit",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "apache",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "gpl",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details.",
    ),
    (
        "bsd",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "bsd",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    (
        "isc",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ),
    (
        "unlicense",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc", "This work is licensed under a Creative Commons Attribution"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("reserved", "All rights reserved"),
]


def template_words(text: str) -> list[str]:
    return [w for w in re.split(GAP, "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]


def template_places(templates: list[tuple[str, str]]) -> list[tuple]:
    """template, label, its number of words, place, and the K words there."""
    out = []
    for k, (label, text) in enumerate(templates):
        words = template_words(text)
        if len(words) < K:
            raise ValueError(f"a template needs {K} words: {text}")
        out += [(k, label, len(words), t, *words[t : t + K]) for t in range(len(words) - K + 1)]
    return out


def _table(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    words, places = [f"t{j}" for j in range(K)], template_places(templates)
    table = spark.createDataFrame(places, "template int, label string, size int, t int, " + ", ".join(f"{w} string" for w in words))
    table = table.select("template", "label", "size", "t", *words, F.xxhash64(*words).alias("h"))
    return F.broadcast(table) if len(places) <= BROADCAST_PLACES else table


def _covered(places: str) -> Column:
    """How many words the K-word sequences at these places cover, each word once."""
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda v: F.sequence(v, v + (K - 1))))))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans
    (label, first word, last word and share of each verified span), for every row."""
    phrases = PHRASES if phrases is None else phrases
    parts = [(p.split(" "), label) for p, label in phrases]
    ahead = max(K, *(len(p) for p, _ in parts)) if parts else K
    spark, c = docs.sparkSession, F.col
    text = F.coalesce(c(text_col), F.lit(""))
    words = docs.select(c(id_col).alias("doc_id"), F.unhex(F.md5(text)).alias("row"), F.array_remove(F.split(lower_az(text), GAP), "").alias("w"))
    n = F.size("w")
    rolled = F.arrays_zip(c("w").alias("w0"), *[F.slice("w", F.lit(j + 1), n).alias(f"w{j}") for j in range(1, ahead)])
    rows = words.select("row", "doc_id", n.alias("n_words"), F.posexplode_outer(rolled).alias("pos", "g")).select(
        "row", "doc_id", "n_words", "pos", *[c("g").getField(f"w{j}").alias(f"w{j}") for j in range(ahead)]
    )
    at_phrase = F.coalesce(F.lit(None).cast("string"), *[F.when(_all([c(f"w{j}") == w for j, w in enumerate(p)]), F.lit(label)) for p, label in parts])
    rows = rows.select("*", at_phrase.alias("phrase"), F.xxhash64(*[f"w{j}" for j in range(K)]).alias("h"))
    hits = rows.join(_table(spark, TEMPLATES if templates is None else templates), "h", "left")
    # Equal hashes are held against the words themselves.
    equal = _all([c(f"w{j}") == c(f"t{j}") for j in range(K)])
    hits = hits.select("row", "doc_id", "n_words", "pos", "phrase", *[F.when(equal, c(x)).alias(x) for x in ("template", "label", "size", "t")])
    hits = hits.where(c("template").isNotNull() | c("phrase").isNotNull() | c("pos").isNull() | (c("pos") == 0)).repartition("doc_id", "row")
    # Rows of one id and text are scanned as one; a diagonal that passes the first word has it once for each.
    votes = hits.groupBy("doc_id", "row", "template", (c("pos") - c("t")).alias("diagonal")).agg(
        F.count(F.when(c("pos").isNull() | (c("pos") == 0), 1)).alias("copies"),
        F.max("label").alias("label"),
        F.max("size").alias("size"),
        F.max("n_words").alias("n_words"),
        F.collect_set("t").alias("ts"),
        F.collect_set(F.when(c("t").isNotNull(), c("pos"))).alias("ps"),
        F.min("pos").alias("lo"),
        F.max("pos").alias("hi"),
        F.collect_set(F.when(c("phrase").isNotNull(), F.struct("pos", "phrase"))).alias("found"),
    )
    along = W.partitionBy("doc_id", "row", "template").orderBy("diagonal")
    votes = votes.withColumn("new", F.when(c("diagonal") - F.lag("diagonal").over(along) <= NEAR, 0).otherwise(1)).withColumn("span", F.sum("new").over(along))
    spans = votes.groupBy("doc_id", "row", "template", "span").agg(
        F.max("copies").alias("copies"),
        F.max("label").alias("label"),
        F.max("size").alias("size"),
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("ts")).alias("ts"),
        F.flatten(F.collect_list("ps")).alias("ps"),
        F.min("lo").alias("lo"),
        (F.max("hi") + K - 1).alias("hi"),
        F.flatten(F.collect_list("found")).alias("found"),
    )
    share = F.least(_covered("ts"), _covered("ps")) / F.greatest("size", c("hi") - c("lo") + 1)
    spans = spans.withColumn("share", F.when(c("template").isNotNull(), share)).withColumn("good", F.coalesce(100 * c("share") >= LEAST_SHARE, F.lit(False)))
    good = c("good")
    out = spans.groupBy("doc_id", "row").agg(
        F.max("copies").alias("copies"),
        F.max("n_words").cast("long").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"),
        F.collect_set(F.when(good, c("label"))).alias("own"),
        F.coalesce(F.max(F.when(good, c("share"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(good, F.struct("label", "lo", "hi", "share")))).alias("spans"),
    )
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), c("copies").cast("int"))))
    base = F.transform("found", lambda x: x["phrase"])
    return out.select(
        "doc_id",
        "n_words",
        F.size("found").cast("long").alias("n_base"),
        F.try_element_at("found", F.lit(1)).getField("pos").cast("long").alias("first_word"),
        F.try_element_at("found", F.lit(-1)).getField("pos").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, "own"))), ",").alias("labels"),
        "score",
        "spans",
    )


def _all(parts: list):
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out
