"""Order-preserving packing of documents into sequences of bounded length.

Each input partition is one stream: its documents' ids in input order. Cuts are chosen by
dynamic programming over the places after a document, after a sentence, after a clause and,
only where none of these comes within a sixteenth of a sequence, anywhere:

    cost(j) = penalty(j) + min over i, j - i <= size, of cost(i) + padding(j - i)

As padding is size - (j - i), the minimum is over cost(i) + i in a sliding window, which a
monotone queue answers in constant time. The stream is cut in blocks; a block's last few
sequences stay open and are chosen anew with what follows. The chosen sequences whose padding
costs more than further cuts are then split into sequences of powers of two, which need none;
the split lowers the cost of the choice and does not enter it. A sentence ends where white space
follows its sign, so "3.14" is one.

No shuffle: the rows that leave a task are the pieces of the documents it read. A lost task
runs again over the same split and gives the same sequence ids.

Defined results: a null text is an empty one, whose ids are the end id alone; repeated rows
are packed each; an empty table gives no sequences; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from trackloom.llm import _bpe
from trackloom.llm._shared import only
from trackloom.llm.token_counts import portions

SENTENCE_PENALTY = 4
CLAUSE_PENALTY = 8
INSIDE_PENALTY = 32
INSIDE_STEP = 32
BLOCK_TOKENS = 1 << 19
OPEN_SEQUENCES = 16


def choose_cuts(ends: np.ndarray, penalties: np.ndarray, size: int) -> list[int]:
    """Of the places ``ends`` (rising, the stream's end last), those that end a sequence, at the least cost."""
    where, cost_of = ends.tolist(), penalties.tolist()
    came = [0] * len(where)
    queue = deque([(0, 0, -1)])  # cost + place, place, index; costs rise from the left
    for j, at in enumerate(where):
        while queue[0][1] < at - size:
            queue.popleft()
        key, _, came[j] = queue[0]
        cost = key - at + size + cost_of[j]
        key = cost + at
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, at, j))
    cuts, j = [], len(where) - 1
    while j >= 0:
        cuts.append(where[j])
        j = came[j]
    return cuts[::-1]


def places(doc_ends: np.ndarray, sentence_ends: np.ndarray, clause_ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the stream may be cut, and each cut's penalty."""
    penalty = np.zeros(int(doc_ends[-1]) + 1, dtype=np.int16)
    penalty[clause_ends] = CLAUSE_PENALTY + 1
    penalty[sentence_ends] = SENTENCE_PENALTY + 1
    penalty[doc_ends] = 1
    ends = np.flatnonzero(penalty)
    penalties = penalty[ends].astype(np.int64) - 1
    gaps = np.diff(ends, prepend=0)
    if (long := np.flatnonzero(gaps > size // 16)).size:
        inside = np.concatenate([np.arange(ends[k] - gaps[k] + INSIDE_STEP, ends[k], INSIDE_STEP) for k in long])
        ends = np.concatenate([ends, inside])
        penalties = np.concatenate([penalties, np.full(len(inside), INSIDE_PENALTY)])
        order = np.argsort(ends, kind="stable")
        ends, penalties = ends[order], penalties[order]
    return ends, penalties


def powers_of_two(length: int) -> list[int]:
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


def split_padded(cuts: list[int], start: int, size: int) -> list[int]:
    """Cuts with those sequences split into powers of two that this makes cheaper than padding."""
    out, before = [], start
    for c in cuts:
        n = c - before
        parts = powers_of_two(n)
        if len(parts) > 1 and size - n > INSIDE_PENALTY * (len(parts) - 1):
            for p in parts[:-1]:
                before += p
                out.append(before)
        out.append(c)
        before = c
    return out


class Stream:
    """The open end of one partition's stream."""

    def __init__(self, partition: int, size: int, bpe: _bpe.ByteBPE, end_id: int):
        self.next_id, self.size, self.end_id, self.bpe = partition << 40, size, end_id, bpe
        self.docs: list[tuple[int, int, int, bytes]] = []  # id, ids before this part, tokens of the document, ids
        self.tokens = 0

    def add(self, doc_id: int, ids: bytes) -> None:
        ids += self.end_id.to_bytes(4, "little")
        self.docs.append((doc_id, 0, len(ids) // 4, ids))
        self.tokens += len(ids) // 4

    def cut(self, last: bool) -> list[tuple]:
        """Rows of the pieces of all sequences that are settled."""
        if not self.docs:
            return []
        raw = b"".join([d[3] for d in self.docs])
        ids = np.frombuffer(raw, dtype="<u4")
        doc_ends = np.cumsum([len(d[3]) // 4 for d in self.docs])
        sentences, clauses = self.bpe.ends(ids, self.bpe.sentence_end), self.bpe.ends(ids, self.bpe.clause_end)
        cuts = choose_cuts(*places(doc_ends, sentences, clauses, self.size), self.size)
        if not last:
            cuts = cuts[: max(0, len(cuts) - OPEN_SEQUENCES)]
        cuts = split_padded(cuts, 0, self.size)
        if not cuts:
            return []
        stop = cuts[-1]
        bounds = np.union1d(np.array(cuts), doc_ends[doc_ends < stop])
        begins = np.concatenate([[0], bounds[:-1]])
        doc = np.searchsorted(doc_ends, begins, side="right")
        seq = np.searchsorted(cuts, begins, side="right")
        seq_begin = np.concatenate([[0], cuts[:-1]])[seq]
        doc_begin = np.concatenate([[0], doc_ends[:-1]])[doc]
        rows = []
        for a, b, d, s, sb, db in zip(begins.tolist(), bounds.tolist(), doc.tolist(), seq.tolist(), seq_begin.tolist(), doc_begin.tolist(), strict=True):
            doc_id, before, total, _ = self.docs[d]
            rows.append((doc_id, before + a - db, b - a, zlib.crc32(raw[4 * a : 4 * b]), total, self.next_id + s, a - sb))
        self.next_id += len(cuts)
        k = int(np.searchsorted(doc_ends, stop, side="right"))
        rest = self.docs[k:]
        if rest and (used := stop - int(doc_ends[k - 1] if k else 0)):
            doc_id, before, total, own = rest[0]
            rest[0] = (doc_id, before + used, total, own[4 * used :])
        self.docs, self.tokens = rest, self.tokens - stop
        return rows


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe.load(tokenizer)
        stream = Stream(TaskContext.get().partitionId(), size, bpe, end_id)
        id_type = None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            id_type = batch.column("doc_id").type
            for lo, texts in portions(batch.column("text")):
                names = batch.column("doc_id").slice(lo, len(texts)).to_pylist()
                for doc_id, ids in zip(names, bpe.encode(texts), strict=True):
                    stream.add(doc_id, ids)
                    if stream.tokens >= BLOCK_TOKENS and (rows := stream.cut(False)):
                        yield out(rows)
        if rows := stream.cut(True):
            yield out(rows)

    return only(docs, doc_id=id_col, text=text_col).mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
