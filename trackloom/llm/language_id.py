"""Language identification by hierarchical discrimination.

The family is predicted first, by a linear machine for each family against the rest; inside a
family, a linear support vector machine for each pair of its languages votes, and the language
with most votes, then with the larger summed margin, wins. All machines read hashed byte n-grams
of the whole text, scaled to unit length.

Fitting takes a bounded sample: of each language the ``per_language`` labelled rows with letters
that have the smallest hashes, fewer where ``fitting_rows`` over all languages would be passed. One
scan counts the languages' rows, one picks the sample; a picked row's whole text becomes its
n-gram vector where it is read, so the driver gets at most ``fitting_rows`` vectors of fixed
size and no texts. No language is left out. Machines grow with the number of languages, and with
the square of the languages in one of the ``FAMILIES`` alone. Prediction reads whole texts of all
rows, in one pass with no shuffle; the weights are broadcast.

Defined results: a null text or one without letters is ``und`` with score 0; without any
labelled row every text is ``und``; with one language in the sample it is that language; ties
go to the smaller label; repeated rows get a row each and enter the sample once; rows with a
null id are predicted like the rest; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.llm import _words
from trackloom.llm._shared import only

PER_LANGUAGE = 600
FITTING_ROWS = 6000
BITS = 13
DIMENSIONS = 1 << BITS
ROWS_AT_ONCE = 128
BYTES_AT_ONCE = 1 << 20
EPOCHS = 12
LEAST_STEPS = 600
REGULAR = 1e-4
UNDETERMINED = "und"

#: Language families (fixed values); a language not named here is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "bg", "sr", "hr", "sl", "cs", "sk", "pl", "mk", "bs"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
    "indic": ["hi", "bn", "mr", "gu", "pa", "ne", "ur"],
    "semitic": ["ar", "he", "mt"],
}
_LETTER = regex.compile(r"\p{L}")


def family(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang.lower().split("-")[0] in members), lang)


def _plain(data: np.ndarray) -> np.ndarray:
    """Lower-cased bytes; digits and signs tell no language and are spaces."""
    b = _words._LOWER[data].astype(np.uint32)
    b[(b >= 0x21) & (b <= 0x40)] = 0x20
    return b


def _cells(b: np.ndarray, k: int) -> np.ndarray:
    """The hashed cell of each gram of k + 1 bytes."""
    g = b
    for j, base in ((1, 257), (2, 263))[:k]:
        g = g[:-1] * np.uint32(base) + b[j:]
    return ((g + np.uint32(k * 7919)) * np.uint32(2654435761) >> np.uint32(32 - BITS)).astype(np.int32)


def _scaled(counts: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def vectors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Unit-length rows of square-root counts of grams of 1, 2 and 3 bytes, one for each text."""
    n = len(offsets) - 1
    b = _plain(data)
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    x = np.zeros(n * DIMENSIONS, dtype=np.float32)
    for k in range(3):
        if len(b) > k:
            c = _cells(b, k)
            inside = doc[: len(c)] == doc[k:]
            x += np.bincount((doc[: len(c)] * DIMENSIONS + c)[inside], minlength=len(x))
    return _scaled(x.reshape(n, DIMENSIONS))


def long_vector(data: np.ndarray) -> np.ndarray:
    """The row of one text of any length, counted piece by piece."""
    x = np.zeros(DIMENSIONS, dtype=np.float64)
    for at in range(0, len(data), BYTES_AT_ONCE):
        for k in range(3):
            b = _plain(data[at : at + BYTES_AT_ONCE + k])
            if len(b) > k:
                x += np.bincount(_cells(b, k), minlength=DIMENSIONS)
    return _scaled(x[None, :].astype(np.float32))


def batches_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, vectors) of a column's texts, some at a time or a long one alone; nulls are empty."""
    raw = pc.fill_null(column, "").cast(pa.large_string())
    _, offs, data = raw.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64, count=len(raw) + 1 + raw.offset)[raw.offset :]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(raw):
        hi = int(np.searchsorted(offsets, offsets[lo] + BYTES_AT_ONCE, side="right")) - 1
        hi = max(lo + 1, min(hi, lo + ROWS_AT_ONCE))
        a, b = int(offsets[lo]), int(offsets[hi])
        yield lo, long_vector(flat[a:b]) if b - a > BYTES_AT_ONCE else vectors(flat[a:b], offsets[lo : hi + 1] - a)
        lo = hi


def fit_pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A linear machine by sub-gradient steps on the hinge loss (Pegasos, averaged); x ends with ones, y is +1 or -1."""
    rng = np.random.default_rng(0)
    w, total, steps = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    weight = np.where(y > 0, 1 / max(1, (y > 0).sum()), 1 / max(1, (y < 0).sum())) * len(y) / 2
    t, parts = 0, max(1, len(x) // 32)
    rounds = max(EPOCHS, -(-LEAST_STEPS // parts))
    for _ in range(rounds):
        for part in np.array_split(rng.permutation(len(x)), parts):
            t += 1
            rate = 1 / (REGULAR * (t + 1000))
            active = part[y[part] * (x[part] @ w) < 1]
            w *= 1 - rate * REGULAR
            if len(active):
                w += rate / len(part) * ((weight[active] * y[active]) @ x[active])
            if 4 * t > rounds * parts:
                total += w
                steps += 1
    return total / max(1, steps)


@dataclass
class Model:
    languages: list[str]
    families: list[str]  # a machine each, against the rest, where there are several
    pairs: list[tuple[str, str]] = field(default_factory=list)  # of languages of one family, a machine each
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, DIMENSIONS + 1), dtype=np.float32))

    def margins(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.weights[:, :-1].T + self.weights[:, -1]).astype(np.float64)

    def decide(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Labels and scores of rows of margins, one column for each machine."""
        n = len(margins)
        own = len(self.families) if len(self.families) > 1 else 0
        column = {p: own + k for k, p in enumerate(self.pairs)}
        sure = lambda m: 1 / (1 + np.exp(-4 * np.clip(m, -20, 20)))
        fam, score = np.zeros(n, dtype=np.int64), np.ones(n)
        if own:
            fam = np.argmax(margins[:, :own], axis=1)
            score = sure(margins[np.arange(n), fam])
        out = np.empty(n, dtype=object)
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(fam == k)
            members = [x for x in self.languages if family(x) == f]
            votes, sums, least = np.zeros((3, len(rows), len(members)))
            least[:] = np.inf
            for i, j in combinations(range(len(members)), 2):
                m = margins[rows, column[members[i], members[j]]]
                votes[:, i] += m >= 0
                votes[:, j] += m < 0
                sums[:, i] += m
                sums[:, j] -= m
                least[:, i] = np.minimum(least[:, i], m)
                least[:, j] = np.minimum(least[:, j], -m)
            best = np.argmax(votes + np.clip(sums, -1e6, 1e6) * 1e-9, axis=1)
            out[rows] = np.array(members, dtype=object)[best]
            if len(members) > 1:
                score[rows] *= sure(least[np.arange(len(rows)), best])
        return list(out), score


def fit(labels: list[str], x: np.ndarray) -> Model:
    """A model of labelled vectors; the last column of x is 1."""
    langs = sorted(set(labels))
    model = Model(langs, sorted({family(a) for a in langs}))
    if len(langs) < 2:
        return model
    label, kin = np.array(labels), np.array([family(a) for a in labels])
    weights = [fit_pair(x, np.where(kin == f, 1.0, -1.0)) for f in model.families] if len(model.families) > 1 else []
    for f in model.families:
        for a, b in combinations([a for a in langs if family(a) == f], 2):
            rows = np.flatnonzero((label == a) | (label == b))
            model.pairs.append((a, b))
            weights.append(fit_pair(x[rows], np.where(label[rows] == a, 1.0, -1.0)))
    model.weights = np.array(weights, dtype=np.float32)
    return model


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts' vectors, their cells that are not zero as numbers and values."""
    for batch in batches:
        for lo, x in batches_of(batch.column("text")):
            cells = [np.flatnonzero(r) for r in x]
            raw = [np.concatenate([c.astype("<u2").view(np.uint8), r[c].astype("<f4").view(np.uint8)]).tobytes() for c, r in zip(cells, x, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(lo, len(x)) for c in ("lang", "u")], pa.array(raw, pa.binary())], names=["lang", "u", "vector"])


def sample(docs: DataFrame, train: Column, per_language: int, fitting_rows: int = FITTING_ROWS) -> tuple[list[str], np.ndarray]:
    """Labels and vectors, with a last column of ones, of the rows to fit on."""
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return [], np.zeros((0, DIMENSIONS + 1), dtype=np.float32)
    most = min(per_language, max(1, fitting_rows // len(counts)))
    # A threshold for each language picks about the wanted number of rows in one scan.
    u = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    least = F.create_map(*[F.lit(x) for a, n in sorted(counts.items()) for x in (a, int(min(1.0, (1.5 * most + 50) / n) * (1 << 40)))])
    picked = rows.select("lang", u.alias("u"), "text").where(F.col("u") < F.try_element_at(least, F.col("lang")))
    once = picked.mapInArrow(_sparse, "lang string, u long, vector binary").groupBy("lang", "u").agg(F.min("vector").alias("vector"))
    ranked = once.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("u"))).where(F.col("k") <= most)
    got = sorted(ranked.select("lang", "u", "vector").collect(), key=lambda r: (r.lang, r.u))
    x = np.zeros((len(got), DIMENSIONS + 1), dtype=np.float32)
    x[:, -1] = 1
    for k, r in enumerate(got):
        n = len(r.vector) // 6
        x[k, np.frombuffer(r.vector, dtype="<u2", count=n)] = np.frombuffer(r.vector, dtype="<f4", offset=2 * n)
    return [r.lang for r in got], x


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            text = batch.column("text")
            rest = [c for c in batch.schema.names if c != "text"]
            for lo, x in batches_of(text):
                n = len(x)
                lang, score = [UNDETERMINED] * n, np.zeros(n)
                if len(model.languages) == 1:
                    lang, score = [model.languages[0]] * n, np.ones(n)
                elif model.languages:
                    lang, score = model.decide(model.margins(x))
                for k, t in enumerate(text.slice(lo, n)):
                    if not t.is_valid or not _LETTER.search(t.as_py()):
                        lang[k], score[k] = UNDETERMINED, 0.0
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(lo, n) for c in rest], pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1))], names=[*rest, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, train: Column, per_language: int = PER_LANGUAGE, fitting_rows: int = FITTING_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred and score of every text, and the columns of ``keep``.

    ``train``, a condition on ``doc_id``, names the rows whose text and label may be learned
    from; no other column enters a prediction.
    """
    model = fit(*sample(only(docs, doc_id=id_col, text=text_col, lang=lang_col), train, per_language, fitting_rows))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    extra = {f"_x{k}": c for k, c in enumerate(keep or [])}
    named = only(docs, doc_id=id_col, text=text_col, **extra)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema if f.name != "text")
    out = named.mapInArrow(_predict(shared), f"{kinds}, lang_pred string, score double")
    return out.select("doc_id", "lang_pred", "score", *[F.col(k).alias(c) for k, c in extra.items()])


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id's text, modulo 3: 1 is held out."""
    return F.crc32(F.col(id_col).cast("string")) % 3
