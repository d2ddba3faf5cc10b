"""Byte-level BPE with exact counts at every prefix.

``ByteBPE`` reads a ``tokenizers`` JSON file and gives the ids that library gives, without
begin, end or added special tokens, truncation or padding; a special token's string inside a
text counts as that token, which is the library's default. Texts are cut at single spaces and
newlines that stand between other characters, where the pre-tokeniser always cuts. The
pieces repeat, so a bounded cache answers most of them, and what it lacks is encoded once a
slice of texts, in one call.

Prefix dynamic programming: the encoding of a piece's prefix of i bytes ends in exactly one
token t that may follow the encoding of the prefix without t, so last[i] and
count[i] = count[i - len(t)] + 1 come from the earlier entries alone.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

CACHE_ENTRIES = 400_000

#: The byte-level pre-tokeniser's pattern (fixed value of the file format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPLIT = PATTERN.replace("[^\\s", "[^\\p{White_Space}").replace("\\s", "\\p{White_Space}").replace("\\S", "\\P{White_Space}")

_SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
_OTHER_SPACE = re.compile(f"[{_SPACES.replace(' ', '').replace(chr(10), '')}\x1c-\x1f]")
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def regular(text: str) -> bool:
    """Whether all white space is single spaces and newlines between other characters or at the ends."""
    return not (
        "  " in text or "\n\n" in text or " \n" in text or "\n " in text or _OTHER_SPACE.search(text)
    )


def pieces(text: str) -> list[str]:
    """The text cut where the pre-tokeniser always cuts. A piece after the first stands for a
    space and itself, or begins with the newline it was cut at."""
    if regular(text):
        return text.replace("\n", " \n").split(" ")
    return [w if k == 0 or w[:1] != "\n" else "  " + w for k, w in enumerate(_SAFE_SPACE.split(text))]


def spelled(piece: str) -> str:
    """What a piece after the first stands for."""
    return piece if piece[:1] == "\n" else " " + piece


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of the file format: visible bytes stand for themselves, the rest follow from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Held(dict):
    """piece -> value: a bounded cache, and beside it what the present slice alone needs."""

    def __init__(self, make, make_many):
        self.make, self.make_many, self.now = make, make_many, {}

    def __missing__(self, piece):
        value = self.now.get(piece)
        if value is None:
            value = self.now[piece] = self.make(piece)
        return value

    def prepare(self, wanted: set[str]) -> None:
        self.now = {}
        missing = list(wanted.difference(self))
        made = self.make_many(missing)
        room = max(0, CACHE_ENTRIES - len(self))
        self.update(made if room >= len(made) else {w: made[w] for w in missing[:room] if len(w) < 64})
        if room < len(made):
            self.now = made


class ByteBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        added = {x["content"] for x in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in added}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        order = [vocab[a + b] for a, b in merges]
        pre = spec.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or order != sorted(order):
            raise ValueError(f"{path}: not a plain byte-level BPE whose ids follow its merges")
        core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.core, self.single, self.plain = core, core._core_bpe.encode_single_piece, core._core_bpe.encode_ordinary
        self.ranks, self.token = ranks, {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.specials = sorted(added)
        self.special_ids = [self.library.token_to_id(s) for s in self.specials]
        # The first special string from a place on is cut out, of several there the longest.
        self._special = re.compile("|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)) or r"(?!)")
        self._nested = {x for x in added if any(y in x for y in added if y != x)}
        self._split = regex.compile(SPLIT)
        self._follows: dict[int, bool] = {}
        self._alone: dict[int, bool] = {}
        size = max([*ranks.values(), *self.special_ids]) + 1
        self.sentence_end, self.clause_end, self._spaced, self._begins = np.zeros((4, size), dtype=bool)
        for b, i in ranks.items():
            self.sentence_end[i] = b.rstrip(b"\"')]")[-1:] in (b".", b"!", b"?", b"\n")
            self.clause_end[i] = b[-1:] in (b",", b";", b":")
            self._spaced[i] = b[:1] == b" "
            self._begins[i] = b[:1] in (b" ", b"\n", b"\t", b"\r")
        self._newline = ranks[b"\n"]
        self._ids = _Held(lambda w: array("I", self.plain(spelled(w))).tobytes(), self._many)
        self._tables = _Held(self._table, lambda many: {w: self._table(w) for w in many})

    def ends(self, ids: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Places after a sentence's or clause's last token: one that ends like it, before one that begins with white space, or the last."""
        last = kind[ids]
        last[:-1] &= self._begins[ids[1:]] | (ids[:-1] == self._newline)
        return np.flatnonzero(last) + 1

    def special_in(self, text: str) -> bool:
        return any(s in text for s in self.specials)

    # Ids

    def _many(self, many: list[str]) -> dict[str, bytes]:
        """Ids of pieces, one call for those after a space and one for those after a newline:
        a token that begins with the space, or the newline's own, begins the next piece."""
        out = {}
        plain = [w for w in many if w and w[0] != "\n" and not _OTHER_SPACE.search(w) and " " not in w and "\n" not in w]
        lines = [w for w in many if w[:1] == "\n" and len(w) > 1 and not _OTHER_SPACE.search(w) and " " not in w and "\n" not in w[1:]]
        for group, begins, sep in ((plain, self._spaced, " "), (lines, None, "")):
            if not group:
                continue
            text = sep + sep.join(group)
            ids = np.frombuffer(self.core._core_bpe.encode_to_tiktoken_buffer(text, set()), dtype="<u4")
            at = np.flatnonzero(begins[ids] if begins is not None else ids == self._newline)
            if len(at) != len(group):
                raise AssertionError("pieces and their tokens do not match")
            raw, at = ids.tobytes(), [*(at * 4).tolist(), 4 * len(ids)]
            out.update(zip(group, [raw[a:b] for a, b in zip(at, at[1:], strict=False)], strict=True))
        if len(out) < len(many):
            for w in many:
                if w not in out:
                    out[w] = array("I", self.plain(spelled(w))).tobytes()
        return out

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of whole texts, as little-endian unsigned 32-bit numbers."""
        cut = [pieces(t) if t and not self.special_in(t) else t or "" for t in texts]
        wanted: set[str] = set()
        for c in cut:
            if type(c) is list:
                wanted.update(c[1:])
        ids = self._ids
        ids.prepare(wanted)
        look = ids.__getitem__
        out = []
        for c in cut:
            if type(c) is str:
                out.append(array("I", self.library.encode(c, add_special_tokens=False).ids).tobytes() if c else b"")
            else:
                out.append(array("I", self.plain(c[0])).tobytes() + b"".join(map(look, c[1:])))
        return out

    # Prefix dynamic programming

    def _may_follow(self, a: int, b: int) -> bool:
        known = self.single(self.token[a] + self.token[b]) == [a, b]
        if len(self._follows) < 4 * CACHE_ENTRIES:
            self._follows[a << 20 | b] = known
        return known

    def _whole(self, t: int) -> bool:
        if (known := self._alone.get(t)) is None:
            known = self._alone[t] = len(self.single(self.token[t])) == 1
        return known

    def piece_counts(self, piece: bytes) -> list[int]:
        """Tokens of piece[:i] for each i from 0 on, of one pre-token."""
        ranks, follows = self.ranks.get, self._follows.get
        n = len(piece)
        last, count, start = [0] * (n + 1), [0] * (n + 1), 0
        for i in range(1, n + 1):
            # Just one token fits, so the likely ones go first: the last one grown by this byte, then short ones.
            j, down = start, i
            while True:
                t = ranks(piece[j:i])
                if t is not None:
                    if j == 0:
                        ok = self._whole(t)
                    else:
                        ok = follows(last[j] << 20 | t)
                        if ok is None:
                            ok = self._may_follow(last[j], t)
                    if ok:
                        last[i], count[i], start = t, count[j] + 1, j
                        break
                down -= 1
                j = down
                if j < 0 or i - j > self.longest:
                    raise AssertionError("no token fits")
        return count

    def prefix_counts(self, text: str) -> list[int]:
        """Tokens of text[:i] for each i from 0 to len(text), exactly.

        Until its last character a special string is plain text; from there on it is one token, and
        what follows stands alone.
        """
        if not self.special_in(text):
            return self._plain_counts(text)
        out, base, begin = [0], 0, 0
        for m in self._special.finditer(text):
            at, end = m.span()
            before = self._plain_counts(text[begin : end - 1])
            if m.group() in self._nested:  # one that ends within it is cut out first
                for i in range(at + 1, end):
                    before[i - begin] = len(self.library.encode(text[begin:i], add_special_tokens=False).ids)
            out += [base + c for c in before[1:]]
            base += before[at - begin] + 1
            out.append(base)
            begin = end
        return out + [base + c for c in self._plain_counts(text[begin:])[1:]]

    def _plain_counts(self, text: str) -> list[int]:
        bare = text[1:] if text[:1] == " " else text
        if bare.isascii() and bare.isalpha():
            return self.piece_counts(text.encode())
        out = [0]
        base, at, run, run_base = 0, 0, -1, 0
        for m in self._split.finditer(text):
            tok = m.group()
            k = len(tok)
            if tok[0] in _SPACES:
                if run < 0:
                    run, run_base = at, base
            else:
                run = -1
            if tok[0] == "'" and k > 1 and tok[1].isalpha():
                out += [base + len(self.plain(tok[:i])) for i in range(1, k + 1)]
                base = out[-1]
            else:
                raw = tok.encode("utf-8")
                counts = self.piece_counts(raw)
                if len(raw) == k:
                    out += [base + c for c in counts[1:]]
                else:
                    b = 0
                    for c in tok:
                        b += len(c.encode("utf-8"))
                        out.append(base + counts[b])
                base += counts[-1]
            if run >= 0:
                # A text that ends inside white space takes the run so far as one pre-token.
                stop = at + next((i for i, c in enumerate(tok) if c not in _SPACES), k)
                if run < at:
                    counts, b = self.piece_counts(text[run:stop].encode()), 0
                    for i in range(run, stop):
                        b += len(text[i].encode())
                        out[i + 1] = run_base + counts[b]
                if stop < at + k:
                    run = -1
            at += k
        return out

    def _table(self, piece: str) -> bytes | list[int]:
        counts = self.prefix_counts(spelled(piece))
        return bytes(counts) if counts[-1] < 200 and max(counts) < 256 else counts

    def prefix_tables(self, texts: Iterable[str | None]) -> list[list]:
        """For each text its pieces' tables: tokens at every prefix of the piece, the empty one
        and the whole one included. A text's count at any prefix is the whole counts of the
        pieces before, and the table's entry."""
        cut = [pieces(t) if t else [] for t in texts]
        wanted: set[str] = set()
        for c in cut:
            wanted.update(c[1:])
        tables = self._tables
        tables.prepare(wanted)
        look = tables.__getitem__
        return [[self.prefix_counts(c[0]), *map(look, c[1:])] if c else [] for c in cut]


@lru_cache(maxsize=4)
def load(path: str) -> ByteBPE:
    """One per Python worker; its caches live as long as the worker."""
    return ByteBPE(path)
