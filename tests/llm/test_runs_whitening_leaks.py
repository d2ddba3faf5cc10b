"""Periodic runs, whitening and benchmark decontamination against brute force, numpy and SQL."""

import hashlib
import math
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
from trackloom.llm import decontaminate, periodic_runs, queries, whitening  # noqa: E402

Q = queries.queries()
CLASH = ("runs", "w", "key", "_h", "_at", "x", "n", "items", "_key", "held", "top", "p", "a")


def table(folder, name, extra=True, **columns):
    n = len(next(iter(columns.values())))
    more = {c: pa.array([1] * n, pa.int32()) for c in CLASH if c not in columns} if extra else {}
    pq.write_table(pa.table({k: pa.array(v, pa.int64() if k.endswith("_id") else None) if not isinstance(v, pa.Array) else v for k, v in columns.items()} | more), folder / f"{name}.parquet")


def documents(folder, rows):
    table(folder, "documents", doc_id=[i for i, _ in rows], text=pa.array([t for _, t in rows], pa.string()))
    return str(folder)


# Periodic runs


def brute_runs(t):
    out = set()
    for q in range(1, len(t) // 4 + 1):
        i = 0
        while i + q < len(t):
            j = i
            while j + q < len(t) and t[j] == t[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q) and not any((i, j + q, p) in out for p in range(1, q)):
                out.add((i, j + q, q))
            i = j + 1
    return sorted((s, e - s, q) for s, e, q in out)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def expected_runs(doc_id, text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute_runs(w)
    gone = {i for s, n_words, q in runs for i in range(s + q, s + n_words)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    return (
        doc_id,
        len(runs),
        *top,
        1000 * top[1] // top[2] if runs else None,
        sha("".join(f"{s},{n_words},{q}\n" for s, n_words, q in runs)),
        sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


PLANTED = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]


def test_runs_of_a_table(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, rng.integers(1, 4), rng.integers(0, 90)))) for i in range(200)]
    rows += [(i, " ".join(f"v{k}" for k in rng.integers(0, 10**6, rng.integers(1, 300)))) for i in PLANTED]
    line = "Same line\there,  with\nwords. "
    rows += [
        (None, line * 9), (None, None), (7, None), (7, ""), (7, " \t\n "), (8, "a"), (8, "a"), (9, "a b a b a b a b c a b a b a b a b"), (10, "x x x x x"), (11, "x x x x x x"),
        (12, "é 日 é 日 é 日 é 日 é"), (13, "a\x1cb " * 8), (PLANTED[0], None), (PLANTED[1], "one"), (PLANTED[2], line * 50),
    ]
    got = Q["op12_periodic_runs"](spark, documents(tmp_path, rows)).collect()
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    want = [expected_runs(i, t) for i, t in rows]
    assert sum(r[1] for r in want) > 100
    assert sorted((tuple(r[c] for c in names) for r in got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("depth", [1, 2, 32])
def test_runs_of_small_alphabets(monkeypatch, depth):
    """With any depth of the first look, so that the linear Z-functions are tested as well."""
    monkeypatch.setattr(periodic_runs, "DEPTH", depth)
    rng = np.random.default_rng(depth)
    for _ in range(300):
        docs = []
        for _ in range(rng.integers(1, 5)):
            t = rng.integers(0, rng.integers(1, 4), rng.integers(0, 80))
            if rng.random() < 0.6 and len(t) > 8:
                a = rng.integers(0, len(t))
                p = 1 + (len(t) - a) // rng.integers(3, 10)
                t = np.array([t[i] if i < a else t[a + (i - a) % p] for i in range(len(t))])
            docs.append(t.astype(np.int32))
        first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        start, end, period = periodic_runs.runs_of(np.concatenate(docs), first)
        want = [(s + f, n + s + f, q) for d, f in zip(docs, first, strict=False) for s, n, q in brute_runs(d.tolist())]
        assert list(zip(start.tolist(), end.tolist(), period.tolist(), strict=True)) == want


def test_long_repetitions():
    for t, want in ((np.zeros(100_000), (0, 100_000, 1)), (np.tile(np.arange(7), 20_000), (0, 140_000, 7)), (np.tile(np.arange(9_999), 8), (0, 79_992, 9_999))):
        assert [x.tolist() for x in periodic_runs.runs_of(t.astype(np.int32), np.array([0, len(t)]))] == [[v] for v in want]


def test_runs_keep_columns(spark):
    df = spark.createDataFrame([(1, "a b a b a b a b c", "x"), (None, None, None)], "id int, body string, text string")
    got = {r.doc_id: r for r in periodic_runs.find(df, "id", "body", keep=["text"]).select("doc_id", "n_words", "runs").collect()}
    assert got[1].n_words == 9 and [tuple(r) for r in got[1].runs] == [(0, 8, 2)] and got[None].runs == []


# Whitening


def embeddings(folder, ids, vectors):
    table(folder, "embeddings", vec_id=ids, embedding=pa.array(vectors, pa.list_(pa.float32())))
    return str(folder)


def whitened_by_numpy(ids, vectors, k):
    ok = [(i, v) for i, v in zip(ids, vectors, strict=True) if v is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    rows = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in ok]
    x = np.array(sorted({tuple(v) for _, v in rows}), dtype=np.int64)
    n, sums = len(x), x.sum(axis=0)
    off = x - sums / n
    cov = off.T @ off / n
    values, vectors_ = np.linalg.eigh(cov)
    values, vectors_ = values[::-1][:k], vectors_[:, ::-1][:, :k]
    return n, {(i, j + 1): (sum((n * a - int(s)) ** 2 for a, s in zip(v, sums, strict=True)), float((np.array(v) - sums / n) @ vectors_[:, j] / np.sqrt(values[j])), values[j] / np.trace(cov)) for i, v in rows for j in range(k)}


def holds(got, n, want):
    assert sorted((r.vec_id, r.component) for r in got) == sorted(want)
    sign = {}
    for r in sorted(got, key=lambda r: -abs(want[r.vec_id, r.component][1])):
        deviation, value, explained = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation) and r.identity_error < 1e-9
        assert r.explained == pytest.approx(explained, rel=1e-9)
        flip = sign.setdefault(r.component, np.sign(r.whitened * value))
        assert r.whitened * flip == pytest.approx(value, abs=1e-7)


@pytest.mark.parametrize("clusters", [0, 5])
def test_whitening_against_numpy(spark, tmp_path, clusters):
    rng = np.random.default_rng(clusters)
    x = rng.standard_normal((600, 24)) + (rng.standard_normal((clusters, 24))[rng.integers(0, clusters, 600)] * 3 if clusters else 0)
    vectors = [v.tolist() for v in x] + [x[0].tolist()] * 300 + [None, [], [None] * 24, [float("nan")] + [0.0] * 23, [float("inf")] * 24, [0.0] * 24]
    ids = list(range(len(vectors)))
    n, want = whitened_by_numpy(ids, vectors, 4)
    got = Q["op11_whitening"](spark, embeddings(tmp_path, ids, vectors)).collect()
    assert n == 601
    holds(got, n, want)


def test_whitening_restarts(spark):
    """A basis far smaller than the dimension: new blocks from the best vectors so far."""
    rng = np.random.default_rng(5)
    x = np.unique(np.floor(rng.standard_normal((3000, 120)) * np.linspace(400, 40, 120)).astype(np.int64), axis=0)
    rows = spark.createDataFrame([(r.tolist(),) for r in x], "x array<bigint>").repartition(3)
    mean = x.mean(axis=0)
    vectors, values, trace, passes = whitening.subspace(rows, len(x), mean, 3, block=8, most_basis=32)
    off = x - mean
    cov = off.T @ off / len(x)
    assert passes > 5 and trace == pytest.approx(np.trace(cov))
    assert np.abs(cov @ vectors - vectors * values).max() < 1e-10 * values[0]
    assert values == pytest.approx(np.linalg.eigvalsh(cov)[::-1][:3], rel=1e-12)


def test_whitening_edges(spark, tmp_path):
    rows = [[1.0, 2.0, 3.0], [1.0, 2.0, 4.0], [1.0, 2.0, 4.0], [9.0], [9.0, 9.0, 1e30]]
    got = Q["op11_whitening"](spark, embeddings(tmp_path, [None, 5, 5, 6, 7], rows)).collect()
    # Two directions hold all there is; the vector of another length takes no part, and one entry counts as the largest.
    assert {r.component for r in got} <= {1, 2} and {r.vec_id for r in got} == {None, 5, 7} and {r.n for r in got} == {3}
    assert next(r for r in got if r.vec_id == 7).deviation is None
    for vectors in ([], [None], [[1.0, 2.0]] * 3):
        assert Q["op11_whitening"](spark, embeddings(tmp_path, list(range(len(vectors))), vectors)).count() == 0


# Benchmark decontamination

LOREM = [f"w{k}" for k in range(300)]


def text(a, b):
    return " ".join(LOREM[a:b])


ITEMS = [
    (1, text(0, 30)), (2, text(20, 40)), (2, text(100, 115)), (3, text(0, 30)), (None, text(200, 212)), (4, None), (5, " .,; "), (10, "Short one."), (11, "five words are in here"), (12, "x"),
    (13, text(150, 159)), (14, "again " * 12), (15, "again again"), (16, "ÜBER straße Été — naïve"), (17, text(250, 260)),
]
LEAKS = [
    (0, "Before " + text(0, 30) + " after"), (1, text(5, 15)), (2, text(5, 14)), (3, text(25, 35) + ", " + text(100, 110)), (3, text(25, 35)), (None, text(3, 20)), (None, None), (4, None), (4, ""), (5, " \t"),
    (6, text(200, 212)), (7, "a short, ONE here. Five words-are in HERE"), (8, "X"), (9, text(149, 160)), (10, "again " * 200), (11, "again"), (12, "Über STRASSE ÜBER straße Été naïve"), (13, text(20, 30) * 3),
    (14, " ".join([text(250, 260)] * 40)), (15, text(0, 9) + " w9x " + text(10, 19)), (16, text(0, 300)), (16, text(0, 300)),
]


def leaks(folder, docs=LEAKS, items=ITEMS):
    documents(folder, docs)
    table(folder, "benchmark", item_id=[i for i, _ in items], text=pa.array([t for _, t in items], pa.string()))
    return str(folder)


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("items", [ITEMS, [x for x in ITEMS if x[0] in (1, 2, 3, 17)], [(k, "one") for k in range(3)]])
def test_leaks_against_sql(spark, duck, same_rows, tmp_path, monkeypatch, small, items):
    """With the benchmark broadcast, and with its joins left to shuffles."""
    if not small:
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", -1)
    d = leaks(tmp_path, items=items)
    same_rows(duck(d).sql(queries.oracle_sql()["op13_decontaminate"]).df(), Q["op13_decontaminate"](spark, d).toPandas())


def test_leaks_of_many_repeats(spark, duck, same_rows, tmp_path):
    rng = np.random.default_rng(1)
    words = lambda n: " ".join(f"v{k}" for k in rng.integers(0, 4, n))
    d = leaks(tmp_path, [(k, words(rng.integers(0, 400))) for k in range(60)], [(k, words(rng.integers(1, 40))) for k in range(25)])
    same_rows(duck(d).sql(queries.oracle_sql()["op13_decontaminate"]).df(), Q["op13_decontaminate"](spark, d).toPandas())


def test_spans_and_items(spark):
    docs = spark.createDataFrame([(1, "z " + text(0, 12) + " z " + text(5, 30))], "doc_id int, text string")
    bench = spark.createDataFrame([("b", text(0, 12)), ("a", text(5, 15))], "item_id string, text string")
    row = decontaminate.hits(docs, bench).first()
    assert [tuple(s) for s in row.spans] == [(1, 12), (14, 23)] and row["items"] == ["a", "b"] and row.n_hit == 22


def test_no_documents_no_benchmark(spark, tmp_path):
    assert Q["op13_decontaminate"](spark, leaks(tmp_path, docs=[])).count() == 0
    got = Q["op13_decontaminate"](spark, leaks(tmp_path, items=[])).collect()
    assert len(got) == len(LEAKS) and not any(r.contaminated for r in got)


def test_leak_in_a_long_text(spark, tmp_path):
    words = [f"w{k}" for k in range(300_000)]
    d = leaks(tmp_path, [(1, " ".join(words)), (2, "q " * 200_000)], [(1, " ".join(words[-12:])), (2, "q " * 10)])
    got = {r.doc_id: r for r in Q["op13_decontaminate"](spark, d).collect()}
    assert got[1].n_hit == 12 and got[2].n_hit == 200_000 and got[1].n_words == 300_000
    assert Q["op12_periodic_runs"](spark, d).where(F.col("doc_id") == 1).first().n_runs == 0
