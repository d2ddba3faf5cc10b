"""The training-data operators: their queries over small folders against SQL, the libraries or brute force."""

import hashlib
import itertools
import json
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
from trackloom.llm import _bpe, components, jaccard_join, language_id, license_scan, packing, queries, sentencepiece_codec, substring_dedup, token_counts, vector_search, warc  # noqa: E402

Q = queries.queries()
SF = "/root/testdata/sf0.001"
LOREM = [f"w{k}" for k in range(400)]


def text(a, b, end="."):
    return " ".join(LOREM[a:b]) + end


#: Nulls, empties, white space of all kinds, one word, ties and repeats, near copies, shared passages, licences.
HARD = [
    None,
    "",
    " \t\n\r\x0b\x0c ",
    "one",
    "four words are here",
    text(0, 60),
    text(0, 60),
    text(0, 58) + " other end.",
    "Start. " + text(10, 40) + "\nThe tail is new and long enough to stand alone.",
    text(100, 113, ""),
    "x " + text(100, 113, "") + " y",
    text(100, 112, ""),
    ("again and again and again we say it. " * 30).strip(),
    "\n".join(["Same line here with words."] * 6),
    "Released under the MIT License. Apache  license; GNU General-Public\nLicense.",
    "This work is licensed under the GNU General Public License, version 3",
    "UPPER lower Über straße İstanbul K naïve space wide \x1c sep",
    "home | about | login | search\nA | B | C\n" + text(200, 230),
    "日本語 のテキスト 。" * 20,
    "<|endoftext|> inside <|endoftext|>text  double  spaces\n\n\nand lines",
    text(0, 400) + "\n" + text(0, 400),
    "é combining 😀 emoji",
]


def folder(tmp_path, rows, extra=True, name="documents"):
    n = len(rows)
    cols = {"doc_id": pa.array(range(n), pa.int64()), "text": pa.array(rows, pa.string()), "lang": pa.array([None if k % 5 == 0 else "en" for k in range(n)], pa.string()), "source": pa.array(["s"] * n, pa.string()), "n_chars": pa.array([len(r or "") for r in rows], pa.int64())}
    if extra:
        cols |= {c: pa.array([1] * n, pa.int32()) for c in ("spans", "n_words", "token", "kind", "_t", "score", "rep", "text_a", "w", "pos")}
    pq.write_table(pa.table(cols), tmp_path / f"{name}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["op1_quality_rules", "op3_substring_dedup", "op7_license_scan", "op8_jaccard_join"])
def test_hard_documents_against_sql(spark, duck, same_rows, tmp_path, name):
    d = folder(tmp_path, HARD)
    same_rows(duck(d).sql(queries.oracle_sql()[name]).df(), Q[name](spark, d).toPandas())


#: Clean texts of other scripts and quoting habits, and lines that only look like navigation or notices.
CLEAN = [
    "Le ministre a dit « oui » puis « non » devant la presse réunie hier soir. Il a ajouté que « rien » ne changera avant la fin de cette longue année.",
    "Er sagte »ja« und dann »nein« vor der ganzen versammelten Presse. Danach ging er ohne ein weiteres Wort mit seinen Leuten nach Hause zurück.",
    " ".join(["これは 普通の 文章 です。", "次の 文も 静かに 続きます。"] * 1 + [f"第{k} の 文は 少しだけ 長く なります。" for k in range(6)]),
    "این متن ساده است و هیچ مشکلی ندارد؟ بله این جمله‌ها همه روشن هستند و خواننده آنها را خوب می‌فهمد۔ پس باید در مجموعه بماند و حذف نشود؟",
    "यह एक साधारण लेख है जिसमें कोई दोष नहीं है। इसमें कई वाक्य हैं जो साफ और सरल भाषा में लिखे गए हैं। पाठक इसे आसानी से समझ सकता है।",
    "The committee read the privacy policy aloud, line by line, before the members voted on the new rules for the library and its many reading rooms.",
    "In the shell, cat a | sort | uniq prints each line once, and it does so for files of any length, as long as the disk holds the sorted runs it needs.",
]


def test_quality_rules_of_scripts(spark, duck, same_rows, tmp_path):
    dirty = ["Home | News | Shop | Login.\nTerms of use. Privacy policy. All rights reserved.\n" + "word " * 25, "a › b › c. " + "\n" + "x " * 30]
    d = _rows(tmp_path, [(k, t) for k, t in enumerate(CLEAN + dirty)] + [(None, CLEAN[0]), (0, CLEAN[1]), (0, CLEAN[1])])
    got = Q["op1_quality_rules"](spark, d).toPandas()
    assert len(got) == len(CLEAN) + len(dirty) + 3
    same_rows(duck(d).sql(queries.oracle_sql()["op1_quality_rules"]).df(), got)
    kept = dict(zip(got.doc_id, got.kept, strict=True))
    assert all(kept[k] for k in range(len(CLEAN))) and not any(kept[k] for k in range(len(CLEAN), len(CLEAN) + len(dirty)))


@pytest.mark.parametrize("name", [n for n in Q if n not in ("op9_vector_search", "op10_warc", "op11_whitening", "op13_decontaminate")])
def test_empty_table(spark, tmp_path, name):
    assert Q[name](spark, folder(tmp_path, [])).count() == 0


#: Rows that repeat, with null ids, null texts and one id of several texts.
ROWS = [(1, text(0, 40)), (1, text(0, 40)), (1, "other text of it"), (None, text(0, 40)), (None, None), (2, None), (2, ""), (3, text(5, 45)), (3, text(5, 45))]


@pytest.mark.parametrize("name", [n for n in Q if n not in ("op9_vector_search", "op10_warc", "op4_packing", "op11_whitening", "op13_decontaminate")])
def test_null_and_repeated_ids(spark, duck, same_rows, tmp_path, name):
    """Every row has a result, whatever its id."""
    d = _rows(tmp_path, ROWS)
    got = Q[name](spark, d).toPandas()
    assert sorted(-1 if i != i or i is None else i for i in got.doc_id) == sorted(-1 if i is None else i for i, _ in ROWS)
    if name in ("op1_quality_rules", "op3_substring_dedup", "op7_license_scan"):
        same_rows(duck(d).sql(queries.oracle_sql()[name]).df(), got)


def test_packing_null_and_repeated_ids(spark, tmp_path):
    library = _bpe.load(P.path("byte_bpe_50k.json")).library
    got = Q["op4_packing"](spark, _rows(tmp_path, ROWS)).collect()
    for i in (1, 2, 3, None):
        want = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for k, t in ROWS if k == i)
        assert sum(r.length for r in got if r.doc_id == i) == want


LONG = 3_000_000


def test_very_long_texts(spark, tmp_path):
    """One text of some megabytes, of words and of one word, beside short ones, through every operator on documents."""
    words = " ".join(f"w{k % 9973}x{k % 7}" for k in range(LONG // 9))
    rows = [(1, words), (2, "a" * LONG), (3, words + " end"), (4, text(0, 40))]
    d = _rows(tmp_path, rows)
    run = lambda name: {r.doc_id: r for r in Q[name](spark, d).collect()}
    n = len(words.split(" "))
    one = run("op1_quality_rules")
    assert one[1].n_words == n and one[2].word_chars == LONG and not one[2].kept
    two = run("op2_token_counts")
    assert two[1].n_bytes == len(words) and two[1].over_limit and not two[4].over_limit
    three = run("op3_substring_dedup")
    assert three[3].n_removed == n and three[1].n_removed == 0 and three[2].n_words == 1
    pieces = Q["op4_packing"](spark, d).where("doc_id = 1").collect()
    assert sum(r.length for r in pieces) == two[1].n_tokens + 1 and all(r.length <= 2048 for r in pieces)
    assert all(r.round_trip for r in run("op5_sentencepiece").values())
    assert len(run("op6_language_id")) == 4 and run("op7_license_scan")[1].n_words == n
    eight = run("op8_jaccard_join")
    assert eight[1].component_id == eight[3].component_id == 1 and eight[2].component_id == 2
    back = warc.write_and_read(spark.read.parquet(d + "/documents.parquet").selectExpr("doc_id as page_id", "source as url", "text as html")).collect()
    assert sorted(r.payload_bytes for r in back) == sorted(len(t) for _, t in rows)


def test_token_counts(spark, tmp_path):
    library = _bpe.load(P.path("byte_bpe_50k.json")).library
    got = {r.doc_id: r for r in Q["op2_token_counts"](spark, folder(tmp_path, HARD)).collect()}
    for k, t in enumerate(HARD):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len((t or "").encode()), n, n > 1024)
        if n > 1024:
            at = got[k].limit_chars
            assert len(library.encode(t[:at], add_special_tokens=False).ids) <= 1024


def test_every_prefix(spark, tmp_path):
    library = _bpe.load(P.path("byte_bpe_50k.json")).library
    rows = [t for t in HARD if t and len(t) < 120] + ["<|endoftext|>", "a<|endoftext|>b<|endoftext|>", "<|endoftext", " <|endoftext|> <|endoftext|>\n", "x" * 60 + "<|endoftext|>" + "'s 12"]
    got = token_counts.prefix_counts(spark.read.parquet(folder(tmp_path, rows) + "/documents.parquet"), P.path("byte_bpe_50k.json"))
    for r in got.collect():
        t = rows[r.doc_id]
        assert r.prefix_tokens == [len(library.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]


def test_packing(spark, tmp_path):
    library = _bpe.load(P.path("byte_bpe_50k.json")).library
    rows = HARD + [text(0, 400) * 6]
    pieces, sequences = {}, {}
    for r in Q["op4_packing"](spark, folder(tmp_path, rows)).collect():
        ids = np.array([*library.encode(rows[r.doc_id] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r["offset"], r.length))
    assert set(pieces) == set(range(len(rows)))
    for parts in [*pieces.values(), *sequences.values()]:
        at = 0
        for start, n in sorted(parts):
            assert start == at and n > 0
            at += n
    assert all(sum(n for _, n in s) <= 2048 for s in sequences.values())


def test_sentences_end_before_white_space():
    bpe = _bpe.load(P.path("byte_bpe_50k.json"))
    ids = np.frombuffer(bpe.encode(["It is 3.14 or more. Yes!\nNo"])[0], dtype="<u4")
    texts = [bpe.token[i].decode() for i in ids.tolist()]
    ends = ["".join(texts[:k]) for k in bpe.ends(ids, bpe.sentence_end)]
    assert "It is 3.14 or more." in ends and not any(e.endswith("3.") for e in ends)


def test_cuts_are_cheapest():
    rng = np.random.default_rng(0)
    for _ in range(20):
        ends = np.unique(rng.integers(1, 60, 14))
        pen = rng.integers(0, 9, len(ends))
        if np.diff(ends, prepend=0).max() > 16:
            continue
        best = min(
            sum(16 - (b - a) + pen[list(ends).index(b)] for a, b in itertools.pairwise([0, *c]))
            for r in range(len(ends))
            for c in ([*x, ends[-1]] for x in itertools.combinations(ends[:-1].tolist(), r))
            if all(b - a <= 16 for a, b in itertools.pairwise([0, *c]))
        )
        cuts = packing.choose_cuts(ends, pen, 16)
        assert sum(16 - (b - a) + pen[list(ends).index(b)] for a, b in itertools.pairwise([0, *cuts])) == best


def test_pieces_equal_the_library(spark, tmp_path):
    codec = sentencepiece_codec.load(P.path("piece_bpe_32k.model"))
    ids = codec.encode(HARD)
    for t, x in zip(HARD, ids, strict=True):
        assert np.frombuffer(x, "<u4").tolist() == codec.library.encode(t or "")
        assert codec.decode(x) == codec.library.decode(codec.library.encode(t or ""))
    docs = spark.read.parquet(folder(tmp_path, HARD) + "/documents.parquet")
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, P.path("piece_bpe_32k.model")), P.path("piece_bpe_32k.model"))
    assert {r.doc_id: r.text for r in back.collect()} == dict(enumerate(t or "" for t in HARD))
    assert all(r.round_trip for r in Q["op5_sentencepiece"](spark, str(tmp_path)).collect())
    long = codec.library.normalize(text(0, 400))
    assert list(codec.search(long, 3)) == list(codec.search(long)) == list(codec.search(long, 10**9))


def test_pieces_in_chunks(monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "CHUNK", 50)
    codec = sentencepiece_codec.load(P.path("piece_bpe_32k.model"))
    rows = [*HARD, "a" * 500, "  x   " * 90, " " * 200, ("é日 " * 40) + "x" * 120]
    for t, x in zip(rows, codec.encode(rows), strict=True):
        assert np.frombuffer(x, "<u4").tolist() == codec.library.encode(t or "")


def test_bad_ids(spark):
    codec = sentencepiece_codec.load(P.path("piece_bpe_32k.model"))
    good = codec.library.encode("good ids")
    rows = spark.createDataFrame([(1, good), (2, [*good, -1, None, 10**6, 0]), (3, None), (4, [])], "doc_id int, ids array<int>")
    got = {r.doc_id: r.text for r in sentencepiece_codec.decode(rows, P.path("piece_bpe_32k.model")).collect()}
    assert got == {1: "good ids", 2: "good ids" + " \u2047 " * 4, 3: None, 4: ""}


def _message(fields):
    """A protocol-buffer message of (number, value) pairs; a float is written as 32 bits."""
    import struct

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    parts = []
    for number, v in fields:
        if isinstance(v, int):
            parts.append(varint(number << 3) + varint(v))
        elif isinstance(v, float):
            parts.append(varint(number << 3 | 5) + struct.pack("<f", v))
        else:
            parts.append(varint(number << 3 | 2) + varint(len(v)) + v)
    return b"".join(parts)


def test_unigram_ids_equal_the_library(tmp_path):
    """The vocabulary file's pieces as a unigram model with scores by rule, no two paths' sums being rounded."""
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        own = list(sentencepiece_codec._fields(f.read()))
    rng, out = np.random.default_rng(9), []
    for number, value in own:
        if number == 1:
            p = dict(sentencepiece_codec._fields(value))
            out.append((1, _message([(1, p[1]), (2, -float(rng.integers(64, 900)) / 64), (3, p.get(3, 1))])))
        elif number == 2:
            spec = [(k, v) for k, v in sentencepiece_codec._fields(value) if k not in (3,) and isinstance(v, int)]
            out.append((2, _message([*spec, (3, 1)])))
        elif isinstance(value, bytes):
            out.append((number, value))
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(_message(out))
    codec = sentencepiece_codec.Codec(path)
    assert not codec.bpe
    rows = [*HARD, *CLEAN, "x" * 300, "straße " * 60, "日本" * 100]
    for t, x in zip(rows, codec.encode(rows), strict=True):
        assert np.frombuffer(x, "<u4").tolist() == codec.library.encode(t or "")


def test_unigram_search():
    """The largest sum of scores, against all ways to cut short strings."""
    codec = sentencepiece_codec.load(P.path("piece_bpe_32k.model"))
    own = object.__new__(sentencepiece_codec.Codec)
    own.__dict__.update(codec.__dict__, bpe=False, ids={"a": 0, "b": 1, "ab": 2, "ba": 3, "aba": 4}, scores=[-1.0, -1.5, -1.9, -2.2, -3.1], longest=3, low=-13.0, _follows={}, _alone={})
    for n in range(1, 8):
        for s in map("".join, itertools.product("ab", repeat=n)):
            got = sum(own.scores[k] for k in own.search(s, 4))
            best = [0.0] + [-1e9] * n
            for i in range(1, n + 1):
                best[i] = max(best[j] + own.scores[own.ids[s[j:i]]] for j in range(i) if s[j:i] in own.ids)
            assert got == pytest.approx(best[n])


def test_language_id(spark, tmp_path):
    got = Q["op6_language_id"](spark, SF).join(spark.read.parquet(SF + "/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == 200 and (got[got.held_out].lang_pred == got[got.held_out].lang).mean() > 0.95
    assert got.score.between(0, 1).all()
    hard = {r.doc_id: r for r in Q["op6_language_id"](spark, folder(tmp_path, [*HARD, "123 456 !"])).collect()}
    assert [hard[k].lang_pred for k in (0, 1, 2, len(HARD))] == ["und"] * 4 and hard[5].lang_pred == "en"


def _vectors_of(texts):
    raw = [t.encode() for t in texts]
    x = language_id.vectors(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    return np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])


def test_language_pairs():
    rows = [("en", "the cat and the dog with that thing"), ("de", "der hund und die katze mit dem ding"), ("fr", "le chien et la chatte avec une chose"), ("es", "el perro y la gata con una cosa")] * 4
    fit = lambda rows: language_id.fit([a for a, _ in rows], _vectors_of([t for _, t in rows]))
    model = fit(rows)
    assert model.families == ["germanic", "romance"] and model.pairs == [("de", "en"), ("es", "fr")] and len(model.weights) == 4
    assert language_id.fit([], np.zeros((0, language_id.DIMENSIONS + 1))).languages == [] and fit(rows[:1]).languages == ["en"]
    many = fit([(f"x{k}", f"{chr(97 + k % 26)}{chr(97 + k // 26)} " * 20) for k in range(230)])
    assert len(many.languages) == 230 and len(many.weights) == 230 and not many.pairs


def test_language_brute_force(spark):
    """Sample, features, margins and votes, spelled out one text and one gram at a time."""
    docs = spark.read.parquet(SF + "/documents.parquet")
    labels, x = language_id.sample(docs, language_id.fold() != 1, 30)
    model = language_id.fit(labels, x)
    assert len(model.languages) == 4 and all(10 <= labels.count(a) <= 30 for a in model.languages)

    def counted(text):
        b = [c + 32 if 65 <= c <= 90 else 32 if 33 <= c <= 64 else c for c in text.encode()]
        cells = {}
        for k in range(3):
            for i in range(len(b) - k):
                g = b[i] if k == 0 else b[i] * 257 + b[i + 1] if k == 1 else (b[i] * 257 + b[i + 1]) * 263 + b[i + 2]
                h = ((g + k * 7919) * 2654435761 & 0xFFFFFFFF) >> (32 - language_id.BITS)
                cells[h] = cells.get(h, 0) + 1
        return {h: n**0.5 / sum(cells.values()) ** 0.5 for h, n in cells.items()}

    def predicted(text):
        v = counted(text)
        m = [sum(float(w[h]) * y for h, y in v.items()) + float(w[-1]) for w in model.weights]
        sigmoid = lambda y: 1 / (1 + np.exp(-4 * y))
        k = max(range(len(model.families)), key=lambda k: (m[k], -k))
        score = sigmoid(m[k])
        members = [a for a in model.languages if language_id.family(a) == model.families[k]]
        tally = {a: [0, 0.0, 99.0] for a in members}
        for j, (a, b) in enumerate(model.pairs):
            if a in tally:
                y = m[len(model.families) + j]
                for name, own in ((a, y), (b, -y)):
                    tally[name][1] += own
                    tally[name][2] = min(tally[name][2], own)
                tally[a if y >= 0 else b][0] += 1
        best = max(members, key=lambda a: (tally[a][0], tally[a][1]))
        return best, score * (sigmoid(tally[best][2]) if len(members) > 1 else 1)

    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in language_id.identify(docs, language_id.fold() != 1, per_language=30).collect():
        lang, score = predicted(texts[r.doc_id])
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-3)


def test_language_long_and_repeated(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(language_id, "BYTES_AT_ONCE", 1000)
    for t in ("äß " * 700, "a", "ab", "x" * 1000, "x" * 1001):
        raw = np.frombuffer(t.encode(), dtype=np.uint8)
        assert np.allclose(language_id.long_vector(raw), language_id.vectors(raw, np.array([0, len(raw)])), atol=1e-6)
    monkeypatch.undo()
    a, b = 0, 1  # learned from
    rows = [(None, CLEAN[0]), (a, CLEAN[0]), (a, CLEAN[0]), (a, None), (b, "12 34")] + [(a, CLEAN[5])] * 5
    got = Q["op6_language_id"](spark, _rows(tmp_path, rows)).collect()
    assert len(got) == len(rows) and sum(r.lang_pred == "und" for r in got) == 2 and not any(r.held_out for r in got)


def _components(rows, n=5, percent=80):
    sets = []
    for t in rows:
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if x]
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((label[a], label[b]))
            label = [x if v == y else v for v in label]
    return {k: (len(s), v) for k, (s, v) in enumerate(zip(sets, label, strict=True))}


def test_jaccard_chains(spark, tmp_path):
    """Chains of near copies, whose ends do not link, and groups that share hot shingles without linking."""
    rng = np.random.default_rng(1)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for step in range(40):
        base = base.copy()
        base[int(rng.integers(120))] = f"n{step}"
        rows.append(" ".join(base))
    hot = " ".join(f"h{k}" for k in range(12))
    rows += [hot + " " + " ".join(f"u{k}_{j}" for j in range(int(rng.integers(1, 9)))) for k in range(60)]
    got = jaccard_join.jaccard_components(spark.read.parquet(folder(tmp_path, rows) + "/documents.parquet"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == _components(rows)


def test_jaccard_hot_groups_in_blocks(spark, tmp_path, monkeypatch):
    """Salts and blocks far smaller than the groups: near copies that partly link, hot shingles, outliers."""
    monkeypatch.setattr(jaccard_join, "HOT_ROWS", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 3)
    rng = np.random.default_rng(4)
    base = [f"b{k}" for k in range(90)]
    rows = []
    for k in range(70):
        own = base.copy()
        for at in rng.choice(90, int(rng.integers(0, 6)), replace=False):
            own[at] = f"n{k}_{at}"
        rows.append(" ".join(own[: 90 - int(rng.integers(0, 12))]))
    rows += [" ".join(["hot"] * 9) + f" q{k}" for k in range(20)] + ["short one"] * 3
    d = folder(tmp_path, rows)
    got = jaccard_join.jaccard_components(spark.read.parquet(d + "/documents.parquet").repartition(6))
    want = _components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == want and len({c for _, c in want.values()}) > 3


def test_jaccard_hot_shingle_of_many_sizes(spark):
    """A hot shingle's unlike rows meet those of their size band and the next, and every pair that may link is found."""
    rng = np.random.default_rng(8)
    n = np.concatenate([np.exp(rng.uniform(np.log(4), np.log(2000), 3000)).astype(int), [4, 5, 5, 8, 10, 16, 20, 125, 156, 157]])
    pos = (rng.random(len(n)) * (n - jaccard_join.need(n, n, 80) + 1)).astype(int)
    comp = np.where(rng.random(len(n)) < 0.4, 0, np.arange(len(n)))
    pdf = pd.DataFrame({"token": 7, "rep": np.arange(len(n)), "n": n, "pos": pos, "comp": comp, "big": True})
    rows = spark.createDataFrame(pdf, "token long, rep long, n int, pos int, comp long, big boolean")

    def met(rows):
        blocks = jaccard_join._in_blocks(jaccard_join._zones(rows, 80))
        keys = jaccard_join.MEETING
        pairs = blocks.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(jaccard_join._across(80), "a long, b long")
        return blocks.count(), {(r.a, r.b) for r in pairs.collect()}

    i, j = np.triu_indices(len(n), 1)
    may = jaccard_join._may_link(n[i], pos[i], n[j], pos[j], 80) & (comp[i] != comp[j])
    want = set(zip(i[may].tolist(), j[may].tolist(), strict=True))
    parted, whole = met(rows), met(rows.withColumn("big", F.lit(False)))
    assert parted[1] == want == whole[1]
    assert parted[0] < 4 * len(n) and whole[0] > 8 * len(n)


def test_jaccard_repeated_ids_with_other_texts(spark, tmp_path):
    """The smallest text of an id stands for it; every row keeps its own size."""
    rows = [(1, text(0, 40, "")), (1, "zz " + text(100, 150, "")), (2, "zz " + text(100, 150, "")), (3, text(0, 40, "")), (None, text(0, 40, "")), (1, None), (4, text(0, 40, ""))]
    d = _rows(tmp_path, rows)
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in Q["op8_jaccard_join"](spark, d).collect())
    assert got == [(0, 36, 0), (1, 0, 1), (1, 36, 1), (1, 47, 1), (2, 47, 2), (3, 36, 1), (4, 36, 1)]


def test_jaccard_filters_are_exact():
    rng = np.random.default_rng(2)
    for _ in range(400):
        a = np.unique(rng.integers(0, 90, int(rng.integers(1, 80))).astype(np.uint64))
        b = np.unique(np.concatenate([rng.choice(a, int(len(a) * 0.9) or 1), rng.integers(0, 90, 5).astype(np.uint64)]))
        want = 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
        assert jaccard_join.similar(a, b, 80) == want


def test_repeated_ids_and_null_ids(spark, tmp_path):
    t = pa.table({"doc_id": pa.array([1, 1, 2, None], pa.int64()), "text": pa.array([text(0, 30)] * 4)})
    pq.write_table(t, tmp_path / "documents.parquet")
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup.remove(docs).collect()) == [(0, 0), (1, 0), (1, 0), (2, 30)]
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard_join.jaccard_components(docs).collect()) == [(0, 0), (1, 1), (1, 1), (2, 1)]


def _rows(tmp_path, rows, ids=pa.int64()):
    """documents of (doc_id, text) rows."""
    n = len(rows)
    cols = {"doc_id": pa.array([r[0] for r in rows], ids), "text": pa.array([r[1] for r in rows], pa.string()), "lang": pa.array(["en"] * n), "source": pa.array(["s"] * n), "n_chars": pa.array([0] * n, pa.int64())}
    pq.write_table(pa.table(cols), tmp_path / "documents.parquet")
    return str(tmp_path)


def test_substring_repeated_ids_with_other_texts(spark, duck, same_rows, tmp_path):
    """Spans of one row touch neither another row of its id nor the next document."""
    passage, own = text(0, 40, ""), " ".join(f"u{k}" for k in range(30))
    rows = [(1, passage), (2, passage), (2, "short two"), (3, own), (4, "x " + passage + " y"), (4, own + " z"), (4, "z " + own), (None, passage), (None, own), (5, text(0, 20, "") + " " + text(20, 40, "")), (-3, text(5, 25, "")), (6, ("la " * 700).strip()), (7, ("la " * 650).strip())]
    d = _rows(tmp_path, rows)
    same_rows(duck(d).sql(queries.oracle_sql()["op3_substring_dedup"]).df(), Q["op3_substring_dedup"](spark, d).toPandas())
    got = substring_dedup.remove(spark.read.parquet(d + "/documents.parquet").repartition(5), keep=["lang"]).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got if r.n_words in (2, 40)) == [(0, 0), (1, 20), (2, 0), (2, 40), (5, 40)]


def test_substring_factors(spark, tmp_path):
    """A factor runs as far as its source does; the windows across two factors are looked up as well."""
    rows = [(1, text(0, 30, "")), (2, text(30, 60, "")), (3, text(0, 60, "")), (4, "q " + text(10, 45, ""))]
    found = substring_dedup.repeats(spark.read.parquet(_rows(tmp_path, rows) + "/documents.parquet").repartition(4)).collect()
    covered = lambda i: {w for r in found if r.doc_id == i for w in range(r.start, r.start + r.n)}
    assert covered(1) == covered(2) == set() and covered(3) == set(range(60)) and covered(4) == set(range(1, 36))
    assert all(r.source in (-1, 1, 2, 3) and r.source < r.doc_id and r.n >= 13 for r in found)


def test_hot_passage(spark, tmp_path):
    """A passage in every document, in many partitions, and long runs of one word."""
    rows = [f"a{k} " + text(0, 20, "") + f" z{k}" for k in range(300)] + ["the " * 900, "the " * 900]
    d = spark.read.parquet(folder(tmp_path, rows) + "/documents.parquet").repartition(7)
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove(d).collect()}
    assert got[0] == 0 and all(got[k] == 20 for k in range(1, 300)) and (got[300], got[301]) == (0, 900)


def test_components(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(1, 200).select(F.lit(1000).cast("long").alias("a"), (F.col("id") + 1000).alias("b"))
    got = {r.node: r.component for r in components.components(chain.union(star)).collect()}
    assert len(got) == 501 and {got[k] for k in range(301)} == {0} and {got[k] for k in range(1000, 1200)} == {1000}
    assert components.components(chain.limit(0)).count() == 0


def test_license_diagonals(spark, tmp_path):
    mit = license_scan.TEMPLATES[1][1]
    words = mit.split(" ")
    rows = ["Intro. " + mit, " ".join(words[:9] + ["really"] + words[9:]), " ".join(words[:5]), "Permission is hereby " * 3, " ".join(words[:10] + ["of"] * 9 + words[10:]), mit.replace("free", "sold").replace("software", "thing")]
    d = spark.read.parquet(folder(tmp_path, rows) + "/documents.parquet")
    got = {r.doc_id: r for r in license_scan.scan(d).collect()}
    assert got[0].labels == "mit" and got[0].score == 1.0 and got[0].n_base == 0 and got[0].spans[0].lo == 1
    assert got[1].labels == "mit" and 0.9 <= got[1].score < 1 and got[2].labels == "" and got[3].labels == ""
    # Nine strange words within split the diagonals; changed words lower the share.
    assert got[4].labels == "" and 0.6 <= got[5].score <= 0.9
    long = {r.doc_id: r for r in license_scan.scan(d, phrases=[("free of charge to any person", "six"), ("intro", "one")]).collect()}
    assert (long[0].n_base, long[0].first_word, long[0].base_labels) == (2, 0, "one,six") and long[5].n_base == 0
    assert {r.n_base for r in license_scan.scan(d, phrases=[]).collect()} == {0}


def test_licenses_of_every_row(spark, duck, same_rows, tmp_path):
    """Rows with null and repeated ids have a result each."""
    rows = [(1, "Apache License here"), (1, "the MIT license of it"), (1, "the MIT license of it"), (None, "GNU General Public License"), (None, None), (2, ""), (None, "plain")]
    d = _rows(tmp_path, rows)
    got = Q["op7_license_scan"](spark, d).toPandas()
    assert len(got) == len(rows)
    same_rows(duck(d).sql(queries.oracle_sql()["op7_license_scan"]).df(), got)


def _vectors(n=500, dim=10, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).round(3).tolist()
    x[3], x[4], x[5], x[6] = None, [0.0] * dim, [1.0] * (dim - 1) + [None], [float("nan")] * dim
    for k in range(100, 260):
        x[k] = x[40]
    return x


def test_vector_search(spark, tmp_path):
    x = _vectors()
    pq.write_table(pa.table({"vec_id": pa.array(range(len(x)), pa.int64()), "embedding": pa.array(x, pa.list_(pa.float32())), "label": pa.array([0] * len(x)), "list": pa.array([1] * len(x))}), tmp_path / "embeddings.parquet")
    got = Q["op9_vector_search"](spark, str(tmp_path)).toPandas()
    ids = np.array([k for k, v in enumerate(x) if v is not None and None not in v and np.isfinite(v).all() and np.any(v)])
    y = np.array([np.array(x[k], dtype=np.float32) for k in ids]).astype(np.float64)
    hits = 0
    for k in ids[ids % 20 == 0]:
        s = (y * y[ids == k][0]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != k][:20]
        mine = got[got.query_id == k].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 21)) and np.all(np.diff(mine.score) <= 0)
        hits += len(set(ids[order]) & set(mine.vec_id))
    assert hits / (20 * (ids % 20 == 0).sum()) >= 0.9
    pq.write_table(pa.table({"vec_id": pa.array([], pa.int64()), "embedding": pa.array([], pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    assert Q["op9_vector_search"](spark, str(tmp_path)).count() == 0


def test_vector_repeated_queries(spark, tmp_path):
    """A query row that comes twice is asked once, and finds k different neighbours."""
    x = np.random.default_rng(5).normal(size=(120, 8)).round(3)
    ids = [*range(120), 0, 20, 20, 40, None, None]
    rows = [*x.tolist(), x[0].tolist(), x[20].tolist(), x[21].tolist(), x[40].tolist(), x[1].tolist(), x[1].tolist()]
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    got = Q["op9_vector_search"](spark, str(tmp_path)).toPandas()
    assert sorted(got.query_id.unique()) == [0, 20, 40, 60, 80, 100]
    for q, part in got.groupby("query_id"):
        assert sorted(part["rank"]) == list(range(1, 21)) and q not in set(part.vec_id)
        assert part[~part.vec_id.isin([0, 20, 40])].vec_id.is_unique


def test_vector_lists_hold_enough(spark, tmp_path):
    """A query whose probed lists hold too few rows goes on to further lists."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(900, 6)), 60 + rng.normal(size=(3, 6)), -60 + rng.normal(size=(3, 6))])
    pq.write_table(pa.table({"vec_id": pa.array([*range(900), 1000, 1001, 1002, 1020, 1021, 1022], pa.int64()), "embedding": pa.array(x.tolist(), pa.list_(pa.float64()))}), tmp_path / "e.parquet")
    got = vector_search.search(spark.read.parquet(str(tmp_path / "e.parquet")), F.col("vec_id") % 1000 == 0, k=20, probes=1).toPandas()
    assert got.groupby("query_id").size().to_dict() == {0: 20, 1000: 20}


def _recall(spark, tmp_path, x, name):
    pq.write_table(pa.table({"vec_id": pa.array(range(len(x)), pa.int64()), "embedding": pa.array(x.tolist(), pa.list_(pa.float64()))}), tmp_path / f"{name}.parquet")
    got = vector_search.search(spark.read.parquet(str(tmp_path / f"{name}.parquet")), F.col("vec_id") % 20 == 0, k=20).toPandas()
    hits = 0
    for k, part in got.groupby("query_id"):
        s = x @ x[k]
        s[k] = -np.inf
        hits += (part.score >= np.sort(s)[-20] - 1e-9).sum()
    return hits / (20 * len(x[::20]))


def test_vector_search_of_other_rows(spark, tmp_path):
    """Queries that are not like the rows, and rows so near each other that codes do not tell them apart."""
    rng = np.random.default_rng(7)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(unit(rng.normal(size=(100, 32)))[rng.integers(0, 100, 4000)] + 0.02 * rng.normal(size=(4000, 32)))
    x[::20] = unit(rng.normal(size=(200, 32)))
    assert _recall(spark, tmp_path, x, "shifted") >= 0.93
    x = unit(rng.normal(size=(12000, 32)))
    x[:4000] = x[0] + 1e-4 * rng.normal(size=(4000, 32))
    assert _recall(spark, tmp_path, x[rng.permutation(12000)], "close") >= 0.93


def test_quantiser():
    x = np.random.default_rng(3).normal(size=(300, 6))
    index = vector_search.fit(x, 300)
    at, codes = index.assign(x)
    back = index.centroids[at] + np.concatenate([index.codebooks[j][codes[:, j]] for j in range(codes.shape[1])], axis=1)[:, : index.dim]
    assert np.abs(back - x).mean() < np.abs(x).mean() / 2


def _pages(tmp_path, rows):
    pq.write_table(pa.table({"page_id": pa.array([r[0] for r in rows], pa.int64()), "url": pa.array([r[1] for r in rows]), "html": pa.array([r[2] for r in rows], pa.string()), "size": pa.array([1] * len(rows)), "digest": pa.array(["x"] * len(rows))}), tmp_path / "pages.parquet")
    return str(tmp_path)


def test_warc_against_sql(spark, duck, same_rows, tmp_path):
    big, small = "é" * 600, "s" * 999
    rows = [(0, "http://a", big), (1, None, big), (2, "u\r\nx: y", big), (3, "b", small), (4, "b", small), (5, "c", None), (6, "d", ""), (7, "e", "x" * 1000), (8, "e", "WARC/1.1\r\n" * 120)]
    d = _pages(tmp_path, rows)
    same_rows(duck(d).sql(queries.oracle_sql()["op10_warc"]).df(), Q["op10_warc"](spark, d).toPandas())
    same_rows(duck(SF).sql(queries.oracle_sql()["op10_warc"]).df(), Q["op10_warc"](spark, SF).toPandas())
    assert Q["op10_warc"](spark, _pages(tmp_path, [])).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    raw = [warc.record("response", f"urn:page:{k}", "u", f"body {k}".encode() * 50, hashlib.sha1(f"body {k}".encode() * 50).hexdigest(), None) for k in range(6)]
    parts = [(lambda z: z.compress(r) + z.flush())(zlib.compressobj(6, zlib.DEFLATED, 31)) if packed else r for r in raw]
    ids = lambda data: [x[2]["warc-record-id"] for x in warc.salvage(data) if x[0] == "record"]
    whole = b"".join(parts)
    assert len(ids(whole)) == 6 and not [x for x in warc.salvage(whole) if x[0] == "gap"]
    bad = bytearray(whole)
    at = len(parts[0]) + len(parts[1]) // 2
    bad[at] ^= 0xFF
    found = list(warc.salvage(bytes(bad)))
    gaps = [x for x in found if x[0] == "gap"]
    assert len(ids(bytes(bad))) == 5 and gaps[0][1] == len(parts[0]) and gaps[0][2] == len(parts[1])
    assert len(ids(b"junk" + whole if not packed else parts[0] + b"junk" + b"".join(parts[1:]))) == 6
    cut = whole[: -len(parts[5]) // 2]
    assert len(ids(cut)) == 5 and [x for x in warc.salvage(cut) if x[0] == "gap"]
    assert list(warc.salvage(b"")) == []


def test_warc_null_and_repeated_ids(spark, duck, same_rows, tmp_path):
    big = "b" * 2000
    d = _pages(tmp_path, [(None, "a", big), (None, "a", big), (None, None, None), (7, "b", big), (7, "b", big), (3, "c", big), (4, "d", "x")])
    got = Q["op10_warc"](spark, d).toPandas()
    assert len(got) == 7
    same_rows(duck(d).sql(queries.oracle_sql()["op10_warc"]).df(), got)


def test_warc_long_urls(spark, duck, same_rows, tmp_path):
    d = _pages(tmp_path, [(k, "data:" + "é" * n, "x" * 1200) for k, n in enumerate((10, 32_600, 65_536, 2_000_000))])
    same_rows(duck(d).sql(queries.oracle_sql()["op10_warc"]).df(), Q["op10_warc"](spark, d).toPandas())
    got = warc.write_and_read(spark.read.parquet(d + "/pages.parquet")).select(F.length("url").alias("n")).collect()
    assert sorted(r.n for r in got) == [15, 32_605, 65_541, 2_000_005]


def _record(k, body=None):
    body = f"body {k} ".encode() * 50 if body is None else body
    return warc.record("response", f"urn:page:{k}", "u", body, hashlib.sha1(body).hexdigest(), None)


def _gz(raw, level=6):
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _found(data):
    found = list(warc.salvage(data))
    return [int(x[2]["warc-record-id"].rpartition(":")[2].strip(">")) for x in found if x[0] == "record"], [x for x in found if x[0] == "gap"]


def test_salvage_inside_members():
    noise = np.random.default_rng(1).integers(33, 127, (9, 3000), dtype=np.uint8)
    raw = [_record(k, noise[k].tobytes()) for k in range(9)]
    one = _gz(b"".join(raw))
    assert _found(one) == (list(range(9)), [])
    # One bad record in a sound member: the others stay, the gap is that record.
    bad = raw[4].replace(noise[4].tobytes()[:9], b"#########")
    ids, gaps = _found(_gz(b"".join([*raw[:4], bad, *raw[5:]])) + _gz(_record(20)))
    assert ids == [0, 1, 2, 3, 5, 6, 7, 8, 20] and [(g[1], g[2]) for g in gaps] == [(0, len(bad))]
    # A cut tail, and a cut in the trailer alone.
    ids, gaps = _found(one[: len(one) // 2])
    assert ids == list(range(len(ids))) and 3 <= len(ids) <= 5 and gaps
    ids, gaps = _found(one[:-3])
    assert ids == list(range(9)) and gaps
    # A wrong CRC, and a cut member before a sound one.
    ids, gaps = _found(one[:-8] + bytes([one[-8] ^ 1]) + one[-7:] + _gz(_record(20)))
    assert ids == [*range(9), 20] and len(gaps) == 1
    ids, gaps = _found(one[: len(one) // 2] + _gz(_record(20)))
    assert ids[-1] == 20 and 4 <= len(ids) <= 6 and gaps
    # A flipped byte in stored bytes costs one record; what is there twice is given once.
    flat = bytearray(_gz(b"".join(raw), 0))
    flat[flat.find(noise[4].tobytes()) + 10] ^= 1
    ids, gaps = _found(bytes(flat))
    assert ids == [0, 1, 2, 3, 5, 6, 7, 8] and len(gaps) == 2
    # What a damaged member gave says so.
    notes = lambda data: [x[2].get(":salvaged-from") for x in warc.salvage(data) if x[0] == "record"]
    assert notes(one) == [None] * 9 and all(notes(one[:-8] + bytes(8))) and len(notes(one[:-8] + bytes(8))) == 9


def test_salvage_finds_either_kind():
    large = np.random.default_rng(2).integers(0, 256, 200_000, dtype=np.uint8).tobytes()
    # The first member has no magic and is longer than any prefix.
    ids, gaps = _found(b"XXX" + (first := _gz(_record(0, large)))[3:] + _gz(_record(1)) + _gz(_record(2)))
    assert ids == [1, 2] and [g[1:3] for g in gaps] == [(0, len(first))]
    # A plain file whose first bytes are damaged, with gzip bodies, whole and cut, in and after the damaged record.
    body = _gz(b"<p>page</p>" * 99)
    plain = [_record(0, body), _record(1, body[:-9]), _record(2), _record(3, body)]
    ids, gaps = _found(b"XXXXX" + b"".join(plain)[5:])
    assert ids == [1, 2, 3] and [g[1:3] for g in gaps] == [(0, len(plain[0]))]
    # Both kinds in one file, either first.
    assert _found(_record(0) + _gz(_record(1)) + _record(2)) == ([0, 1, 2], [])
    assert _found(_gz(_record(0)) + b"junk" + _record(1) + _gz(_record(2)))[0] == [0, 1, 2]
    # Records that a damaged member stored as they are come once.
    flat = _gz(b"".join(_record(k) for k in range(4)), 0)
    assert _found(flat[:-8] + bytes(8) + _record(9))[0] == [0, 1, 2, 3, 9]
    # A cut one swallows the next member's bytes, which is read all the same.
    assert _found(flat[:1500] + _gz(_record(8)) + _gz(_record(9)))[0] == [0, 8, 9]
    # A lone record whose CRC differs does not come back as a plain one.
    alone = _gz(_record(0), 0)
    assert _found(alone.replace(b"urn:page:0", b"urn:page:7") + _gz(_record(9)))[0] == [9]


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    clean = [f"The {k} first sentence of this text is here and it is fine. " + text(k, k + 40) for k in range(0, 200, 45)]
    rows = [None, "", "short", *clean, clean[0], "a | b | c | d\n" * 30, clean[1] + " More words at the end of it."]
    d = folder(tmp_path, rows, extra=False)
    docs = spark.read.parquet(d + "/documents.parquet")
    seen = []
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, d)
        path = str(tmp_path / name.replace(" ", "-"))
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != "packing":
            assert docs.columns == pipeline.COLUMNS
    keep = set(range(3, 3 + len(clean)))
    assert keep <= seen[0] and not {0, 1, 2} & seen[0] and len(rows) - 2 not in seen[0]
    assert keep <= seen[2] and 3 + len(clean) not in seen[2] and seen[4] == seen[3]
    assert {r.doc_id for r in pipeline.run(spark, d).select("doc_id").collect()} == seen[4]
    assert json.dumps([n for n, _ in pipeline.STAGES])


def test_pipeline_empty_and_extra_columns(spark, tmp_path):
    """Each stage takes an empty table, and columns of any name beside those of documents."""
    pipeline = pytest.importorskip("corpus_pipeline")
    d = folder(tmp_path, [])
    assert pipeline.run(spark, d).count() == 0
    for name, stage in pipeline.STAGES:
        out = stage(spark, spark.read.parquet(d + "/documents.parquet"), d)
        assert out.count() == 0 and (name == "packing" or out.columns == pipeline.COLUMNS)
    clean = [f"The {k} first sentence of this text is here and it is fine. " + text(k, k + 40) for k in range(0, 200, 45)]
    d = folder(tmp_path, [*clean, None, ""])
    for name, stage in pipeline.STAGES:
        out = stage(spark, spark.read.parquet(d + "/documents.parquet"), d)
        assert out.count() > 0 and (name == "packing" or out.columns == pipeline.COLUMNS)
    assert {r.doc_id for r in pipeline.run(spark, d).collect()} == set(range(len(clean)))


def test_pipeline_against_brute_force(spark, tmp_path):
    """Which documents each stage keeps, and with which words, one rule at a time."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(11)
    shared = "this passage stands in several documents and it is long enough to be one of those that go away"
    bodies = [f"The {k} text begins here and goes on for a while. " + " ".join(f"q{k}_{j}" for j in range(30)) + "." for k in range(24)]
    bodies[3] += " " + shared + "."
    bodies[7] = bodies[7] + " " + shared + "."
    bodies[9] = bodies[5].replace("q5_3", "changed")
    bodies[11] = bodies[5]
    bodies[13] = "a | b | c\n" * 30
    bodies[15] = bodies[15] + "\nshort line without an end"
    d = folder(tmp_path, [bodies[k] for k in rng.permutation(24)], extra=False)
    docs = spark.read.parquet(d + "/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    good = {k: "\n".join(x for x in t.split("\n") if x.rstrip().endswith(".")) for k, t in before.items()}
    good = {k: t for k, t in good.items() if len(t.replace("\n", "")) * 2 >= len(before[k].replace("\n", "")) and len(before[k].split()) >= 20}
    one = pipeline.quality(spark, docs, d).collect()
    assert {r.doc_id: r.text for r in one} == good
    sets = _components([good.get(k) for k in range(24)])
    first = {k for k in good if sets[k][1] == k}
    three = pipeline.near_duplicates(spark, pipeline.quality(spark, docs, d), d).collect()
    assert {r.doc_id: r.text for r in three} == {k: good[k] for k in first}
    windows, want = {}, {}
    for k in sorted(first):
        w = good[k].split()
        gone = {j for i in range(len(w) - 12) if windows.setdefault(tuple(w[i : i + 13]), k) < k for j in range(i, i + 13)}
        want[k] = " ".join(x for j, x in enumerate(w) if j not in gone)
    four = pipeline.repeated_passages(spark, spark.createDataFrame(three, docs.schema), d).collect()
    assert {r.doc_id: r.text for r in four} == {k: t for k, t in want.items() if t} and want != {k: " ".join(good[k].split()) for k in first}


def test_pipeline_null_and_repeated_ids(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    clean = [f"The {k} first sentence of this text is here and it is fine. " + text(k, k + 40) for k in range(0, 200, 45)]
    a, b, c, e = (r.doc_id for r in spark.range(1, 99).toDF("doc_id").where(language_id.fold() != 1).orderBy("doc_id").limit(4).collect())
    rows = [(None, clean[0], "b"), (None, clean[1], "b"), (a, clean[2], "c"), (a, clean[2], "b"), (a, clean[2], "b"), (b, clean[3], "b"), (c, clean[3], "b"), (c, clean[3], "b"), (e, clean[4], "b")]
    cols = list(zip(*rows, strict=True))
    pq.write_table(pa.table({"doc_id": pa.array(cols[0], pa.int64()), "text": pa.array(cols[1]), "lang": pa.array(["en"] * len(rows)), "source": pa.array(cols[2]), "n_chars": pa.array([len(t) for t in cols[1]], pa.int64())}), tmp_path / "documents.parquet")
    d = str(tmp_path)
    got = pipeline.near_duplicates(spark, spark.read.parquet(d + "/documents.parquet"), d)
    assert got.columns == pipeline.COLUMNS
    want = [(None, clean[0], "b"), (None, clean[1], "b"), (a, clean[2], "b"), (b, clean[3], "b"), (e, clean[4], "b")]
    assert sorted(((r.doc_id or 0, r.text, r.source) for r in got.collect())) == sorted((i or 0, t, s) for i, t, s in want)
    out = pipeline.run(spark, d)
    assert {r.doc_id for r in out.select("doc_id").collect()} == {None, a, b, e}
