"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search walks a normalised text once. At each place it keeps the best path that ends there,
a backpointer and the last piece; only places within the longest piece's length can still be
reached from, so the paths that survive end at these. When all of them lead back to one
boundary, the ids before it are settled and leave the window. The search looks for such a
boundary each time the window has grown by the longest piece's length, and before each run of
space marks, where all paths meet at once, as no piece has a mark after another character.
So the window is bounded by the longest piece and the longest word, for texts of any length.

What lies between two boundaries before space marks is a function of its characters alone, so
a bounded cache answers those that repeat; texts are taken in chunks that end at such a boundary.

In unigram models the best path has the largest sum of piece scores (in double precision); in
BPE models the path is the one whose every two neighbours the merges leave apart, of which each
place has exactly one, so both give the ids of the ``sentencepiece`` library.

Characters without a piece become byte pieces, or the unknown id in models without them.

Defined results: a null or empty text has no ids and decodes to an empty one; ids that are null,
negative or not in the model decode like the unknown id; repeated rows get a row each; null ids
of rows stay null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from trackloom.llm._bpe import CACHE_ENTRIES, _Held
from trackloom.llm._shared import only
from trackloom.llm.token_counts import portions

SPACE = "▁"
CHUNK = 1 << 18
UNKNOWN_PENALTY = 10.0
UNIGRAM, BPE = 1, 2
#: Piece types of the model file (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_RUNS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+$")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (number, value) pairs of a protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = data[at]
            out |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return out, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        elif key & 7 == 1:
            value, at = data[at : at + 8], at + 8
        elif key & 7 == 5:
            value, at = data[at : at + 4], at + 4
        else:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        yield key >> 3, value


class Codec:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = f.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces, kind, prefix = [], UNIGRAM, True
        for number, value in _fields(model):
            if number == 1:
                p = dict(_fields(value))
                pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
            elif number == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                prefix = bool(dict(_fields(value)).get(3, 1))
        if kind not in (UNIGRAM, BPE) or any(t == USER_DEFINED for *_, t in pieces):
            raise ValueError(f"{path}: neither a plain unigram nor a plain BPE model")
        self.bpe, self.dummy_prefix = kind == BPE, prefix
        self.ids = {p: k for k, (p, _, t) in enumerate(pieces) if t == NORMAL}
        self.scores = [s for _, s, _ in pieces]
        self.names = [p for p, *_ in pieces]
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError(f"{path}: pieces go across words")
        self.longest = max(map(len, self.ids))
        self.unknown = next(k for k, (*_, t) in enumerate(pieces) if t == UNKNOWN)
        self.low = min((s for _, s, t in pieces if t == NORMAL), default=0.0) - UNKNOWN_PENALTY
        byte = {int(p[3:5], 16): k for k, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.bytes = [byte[b] for b in range(256)] if len(byte) == 256 else None
        back = {k: bytes([b]) for b, k in byte.items()}
        self.raw = [back.get(k, b"" if t == CONTROL else b" \xe2\x81\x87 " if t == UNKNOWN else p.replace(SPACE, " ").encode()) for k, (p, _, t) in enumerate(pieces)]
        self._follows: dict[int, bool] = {}
        self._alone: dict[int, bool] = {}
        self._words = _Held(lambda w: self._word(self._spelled(w)), lambda many: {w: self._word(self._spelled(w)) for w in many})

    # Viterbi

    def _merged(self, s: str) -> list[str]:
        """The merges of a short string: the best-scored neighbours first, of equal ones the left."""
        parts = list(s)
        while len(parts) > 1:
            found = [(-self.scores[k], i) for i in range(len(parts) - 1) if (k := self.ids.get(parts[i] + parts[i + 1])) is not None]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether the merges leave two pieces apart; a negative one, a character without piece, is no neighbour."""
        if a < 0:
            if (known := self._alone.get(b)) is None:
                known = self._alone[b] = len(self._merged(self.names[b])) == 1
            return known
        x, y = self.names[a], self.names[b]
        known = self._merged(x + y) == [x, y]
        if len(self._follows) < 4 * CACHE_ENTRIES:
            self._follows[a << 20 | b] = known
        return known

    def search(self, text: str, every: int | None = None) -> Iterator[int]:
        """The piece of each step of the best path through a normalised text; -1 - code point for a character without piece.

        Each time the window has grown by ``every`` places (the longest piece's length), what all surviving paths share is given.
        """
        every = every or self.longest
        due = every
        ids, longest, scores, follows, bpe = self.ids.get, self.longest, self.scores, self._follows.get, self.bpe
        n, base = len(text), 0  # base: where the window begins
        last, back, best = [-1], [0], [0.0]
        for i in range(1, n + 1):
            if bpe:
                # Just one piece fits, so the likely ones go first: the last one grown, then short ones.
                j, down = back[i - 1 - base], i
                least = max(base, i - longest)
                while True:
                    if j >= least and (t := ids(text[j:i])) is not None:
                        a = last[j - base]
                        ok = follows(a << 20 | t) if a >= 0 else None
                        if ok is None:
                            ok = self._may_follow(a, t)
                        if ok:
                            break
                    down -= 1
                    if down < least:
                        t, j = -1 - ord(text[i - 1]), i - 1
                        break
                    j = down
                last.append(t)
                back.append(j)
            else:
                top, at, t = -1e300, i - 1, -1 - ord(text[i - 1])
                for j in range(max(base, i - longest), i):
                    k = ids(text[j:i])
                    if k is not None and best[j - base] + scores[k] > top:
                        top, at, t = best[j - base] + scores[k], j, k
                if ids(text[i - 1]) is None and best[i - 1 - base] + self.low > top:
                    top, at, t = best[i - 1 - base] + self.low, i - 1, -1 - ord(text[i - 1])
                last.append(t)
                back.append(at)
                best.append(top)
            if i - base >= due:
                # Surviving paths end at the last places a piece can still begin from.
                alive = set(range(max(base, i - longest + 1), i + 1))
                while len(alive) > 1:
                    k = max(alive)
                    alive.discard(k)
                    alive.add(back[k - base])
                meet = alive.pop()
                due = i - meet + every
                if meet > base:
                    yield from self._path(last, back, base, meet)
                    cut = meet - base
                    last, back, best = last[cut:], back[cut:], best[cut:]
                    base = meet
        yield from self._path(last, back, base, n)

    @staticmethod
    def _path(last: list[int], back: list[int], base: int, end: int) -> list[int]:
        out = []
        while end > base:
            out.append(last[end - base])
            end = back[end - base]
        return out[::-1]

    def _word(self, word: str) -> bytes:
        out = array("I")
        for t in self.search(word):
            if t >= 0:
                out.append(t)
            elif self.bytes is None:
                out.append(self.unknown)
            else:
                out.extend(self.bytes[b] for b in chr(-1 - t).encode("utf-8"))
        return out.tobytes()

    # Texts

    def chunks(self, text: str) -> Iterator[str]:
        """A normalised text in parts of about CHUNK characters, cut before runs of space marks."""
        at = 0
        while len(text) - at > CHUNK:
            cut = text.find(SPACE, at + CHUNK)
            while cut > 0 and text[cut - 1] == SPACE:
                cut = text.find(SPACE, cut + 1)
            if cut < 0:
                break
            yield text[at:cut]
            at = cut
        yield text[at:] if at else text

    def words(self, s: str) -> list[str]:
        """A normalised text cut before each run of space marks."""
        if s[:1] == SPACE and s[-1:] != SPACE and SPACE * 2 not in s:
            return s[1:].split(SPACE)
        return [w[1:] if w[0] == SPACE and len(w) > 1 and w[1] != SPACE else SPACE + w for w in _RUNS.findall(s)]

    def _spelled(self, word: str) -> str:
        """A word stands for itself after a space mark; one that begins with a mark, for the rest of itself."""
        return word[1:] if word[:1] == SPACE else SPACE + word

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts, as little-endian unsigned 32-bit numbers."""
        whole = [self.library.normalize(t) if t else "" for t in texts]
        short = iter(self._encode([self.words(s) if s else [] for s in whole if len(s) <= CHUNK]))
        return [next(short) if len(s) <= CHUNK else self._long(s) for s in whole]

    def _long(self, s: str) -> bytes:
        return b"".join([self._encode([self.words(part)])[0] for part in self.chunks(s)])

    def _encode(self, cut: list[list[str]]) -> list[bytes]:
        wanted: set[str] = set()
        for c in cut:
            wanted.update(c)
        self._words.prepare(wanted)
        look = self._words.__getitem__
        return [b"".join(map(look, c)) for c in cut]

    def decode(self, ids: bytes) -> str:
        return self._text(map(self.raw.__getitem__, memoryview(ids).cast("I").tolist()))

    def decode_any(self, ids: list[int | None]) -> str:
        """Ids of any kind: those that the model lacks are unknown ones."""
        n, unknown = len(self.raw), self.raw[self.unknown]
        return self._text([self.raw[i] if i is not None and 0 <= i < n else unknown for i in ids])

    def _text(self, parts: Iterable[bytes]) -> str:
        raw = b"".join(parts).decode("utf-8", "replace")
        return raw[1:] if self.dummy_prefix and raw[:1] == " " else raw


@lru_cache(maxsize=2)
def load(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(model)
        for batch in batches:
            for lo, texts in portions(batch.column("text")):
                ids = codec.encode(texts)
                ends = array("i", [0])
                for x in ids:
                    ends.append(ends[-1] + len(x) // 4)
                flat = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(ids))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(texts)), lists], names=["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return only(docs, doc_id=id_col, text=text_col).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of every row's ids; null where these are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(model)
        for batch in batches:
            texts = [None if x is None else codec.decode_any(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return only(encoded, doc_id=id_col, ids=ids_col).mapInArrow(run, f"doc_id {kind}, text string")


def round_trips(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of little-endian 32-bit ids) and whether decoding gives the text again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(model)
        for batch in batches:
            for lo, texts in portions(batch.column("text")):
                ids = codec.encode(texts)
                same = [codec.decode(x) == (t or "") for x, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, len(texts)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(same)],
                    names=["doc_id", "n_pieces", "ids_crc32", "round_trip"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return only(docs, doc_id=id_col, text=text_col).mapInArrow(run, f"doc_id {kind}, n_pieces long, ids_crc32 long, round_trip boolean")
