"""Token counts by prefix dynamic programming.

Every text's exact token count at every prefix is computed once (see ``_bpe``); a total, a
truncation point or the answer to "do the first n characters fit?" is then read off, with no
second encoding. The counts are whole: no text is cut.

Defined results: a null text counts as empty (0 bytes, 0 tokens, fits every budget); repeated
rows each get a row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from trackloom.llm import _bpe
from trackloom.llm._shared import only

TEXTS_AT_ONCE = 512
CHARS_AT_ONCE = 2 << 20


def portions(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """A column's texts, some at a time: at most so many, or so many characters, or one."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    lo, n = 0, len(column)
    while lo < n:
        before = int(ends[lo - 1]) if lo else 0
        hi = int(np.searchsorted(ends, before + CHARS_AT_ONCE, side="right"))
        hi = min(n, lo + TEXTS_AT_ONCE, max(lo + 1, hi))
        yield lo, column.slice(lo, hi - lo).to_pylist()
        lo = hi


def cut_at(text: str, tables: list, limit: int) -> int:
    """Characters in the longest prefix of at most ``limit`` tokens."""
    ends = list(accumulate([t[-1] for t in tables]))
    if not ends or ends[-1] <= limit:
        return len(text)
    k = next(i for i, e in enumerate(ends) if e > limit)
    at = sum([len(t) - 1 for t in tables[:k]])
    base = ends[k - 1] if k else 0
    # Counts may fall again inside a piece, so the last prefix that fits is looked for.
    return at + max(i for i, c in enumerate(tables[k]) if base + c <= limit)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and limit_chars (the longest prefix within the limit) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe.load(tokenizer)
        for batch in batches:
            text = batch.column("text")
            totals, cuts = [], []
            for _, texts in portions(text):
                for t, tables in zip(texts, bpe.prefix_tables(texts), strict=True):
                    total = sum([x[-1] for x in tables])
                    totals.append(total)
                    cuts.append(len(t or "") if total <= limit else cut_at(t, tables, limit))
            n_tokens = pa.array(totals, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.cast(pc.fill_null(pc.binary_length(text), 0), pa.int64()), n_tokens, pc.greater(n_tokens, limit), pa.array(cuts, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "limit_chars"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return only(docs, doc_id=id_col, text=text_col).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, limit_chars long")


def prefix_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and prefix_tokens: the exact token count of each of the text's prefixes, by characters, from 0 on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe.load(tokenizer)
        for batch in batches:
            for lo, texts in portions(batch.column("text")):
                flat, ends = array("i"), [0]
                for tables in bpe.prefix_tables(texts):
                    base = 0
                    flat.append(0)
                    for t in tables:
                        flat.extend(base + c for c in t[1:])
                        base += t[-1]
                    ends.append(len(flat))
                counts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(texts)), counts], names=["doc_id", "prefix_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return only(docs, doc_id=id_col, text=text_col).mapInArrow(run, f"doc_id {kind}, prefix_tokens array<int>")
