"""The best names by bounds against scoring every pair."""

import numpy as np
import pandas as pd
import pytest

from trackloom.functions import text
from trackloom.operators import matching, names

SYLLABLES = "ка мо ро ло ни во се пе ти да ля зо гу ры ше".split()


def made(rng, n):
    word = lambda: "".join(rng.choice(SYLLABLES, rng.integers(2, 5)))
    stock = [word() for _ in range(n // 2 + 20)]
    out = [" ".join(rng.choice(stock, rng.integers(1, 4))) for _ in range(n)]
    return [*out, "", "а", stock[0][:3], stock[1][:1] + " " + stock[2], out[0] + " " + out[0]]


def brute(wanted, ids, others, main, most):
    out = []
    for name in wanted:
        scored = []
        for i, o, m in zip(ids, others, main, strict=True):
            s = text.similarity(name, o)
            low = s < matching.LEAST
            scored.append((low, -(s if low else min(1.0, s + (0.03 if m else 0.0))), i, s))
        out += [(name, i, s, low) for low, _, i, s in sorted(scored)[:most]]
    return out


def test_bounds_are_above(rng=None):
    rng = np.random.default_rng(1)
    others = made(rng, 150)
    block = names.Block(others)
    for name in made(rng, 60):
        real = np.array([text.similarity(name, o) for o in others])
        assert (block.bounds(name) >= real).all()


def test_best_of_a_block_and_calls(monkeypatch):
    rng = np.random.default_rng(2)
    wanted, others = list(dict.fromkeys(made(rng, 80))), made(rng, 900)
    ids, main = rng.permutation(len(others)), rng.random(len(others)) < 0.3
    want = brute(wanted, ids.tolist(), others, main.tolist(), 8)
    calls, real = [0], text.similarity

    def counted(a, b):
        calls[0] += 1
        return real(a, b)

    monkeypatch.setattr(text, "similarity", counted)
    got = names.best_of_block(wanted, ids, others, main, 8, matching.LEAST, 0.03)
    assert got == want
    assert calls[0] < len(wanted) * len(others) / 10


def test_best_names_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(names, "NAMES_A_BLOCK", 20)
    monkeypatch.setattr(names, "STATIONS_A_BLOCK", 70)
    rng = np.random.default_rng(3)
    wanted, others = list(dict.fromkeys(made(rng, 50))), made(rng, 200)
    main = (rng.random(len(others)) < 0.3).tolist()
    left = spark.createDataFrame([(w,) for w in wanted], "name string")
    right = spark.createDataFrame(list(zip(range(len(others)), others, main, strict=True)), "sid long, name string, main boolean")
    got = names.best_names(left, right, 8, matching.LEAST)
    assert "Cartesian" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()
    rows = sorted((r.name, r.n, r.sid, round(r.score, 12), r.spare) for r in got.collect())
    frame = pd.DataFrame(brute(wanted, range(len(others)), others, main, 8), columns=["name", "sid", "score", "spare"])
    frame["n"] = frame.groupby("name").cumcount() + 1
    assert rows == sorted((r.name, r.n, r.sid, round(r.score, 12), r.spare) for r in frame.itertuples())
    assert names.best_names(left.limit(0), right, 8, 0.18).count() == names.best_names(left, right.limit(0), 8, 0.18).count() == 0


@pytest.mark.parametrize("word", ["к", "ка", "кам", "камор"])
def test_fitting_words(word):
    others = ["к", "ка", "кам", "камо", "каморро", "мо", "камень"]
    assert names.Block(others).fitting(word) == sorted(o for o in others if text.fits(word, o))


def test_bounds_of_beginnings_are_above():
    rng = np.random.default_rng(4)
    groups: dict[str, list[str]] = {}
    for o in [*made(rng, 300), *(f"ПОСТ {k:06d}" for k in rng.integers(0, 5000, 100)), "а" * 70]:
        groups.setdefault(o[: rng.integers(0, 8)], []).append(o)
    span = lambda f: np.array([f(map(len, g)) for g in groups.values()])
    words = np.array([max(len(o.split(" ")) for o in g) for g in groups.values()])
    block = names.Block([names.os.path.commonprefix(g) for g in groups.values()], (span(min), span(max)), words)
    for name in [*made(rng, 60), "ПОСТ 000123", "а" * 65]:
        real = np.array([max(text.similarity(name, o) for o in g) for g in groups.values()])
        assert (block.bounds(name) >= real).all()


def test_numbered_names_need_few_calls(monkeypatch):
    """Names that differ in few digits share nearly all letters, in whatever order."""
    others, calls, real = [f"ПОСТ {k:09d}" for k in range(1500)], [0], text.similarity
    ids, main, wanted = np.arange(1500), np.arange(1500) % 5 == 0, [f"ПОСТ {k:09d}" for k in (123, 1357, 1290)]
    want = brute(wanted, ids.tolist(), others, main.tolist(), 8)

    def counted(a, b):
        calls[0] += 1
        return real(a, b)

    monkeypatch.setattr(text, "similarity", counted)
    assert names.best_of_block(wanted, ids, others, main, 8, matching.LEAST, 0.03) == want
    assert calls[0] < 40 * len(wanted)


def test_best_names_in_small_blocks(spark, monkeypatch):
    """Every round is used; of equal names only the first ids count."""
    monkeypatch.setattr(names, "BEGIN_ALIKE", 6)
    monkeypatch.setattr(names, "ROUNDS", [(0, 1), (1, 3), (3, None)])
    monkeypatch.setattr(names, "NAMES_A_BLOCK", 20)
    monkeypatch.setattr(names, "STATIONS_A_BLOCK", 30)
    monkeypatch.setattr(names, "NAMES_A_VISIT", 30)
    rng = np.random.default_rng(5)
    others = [*made(rng, 60), *(f"ПОСТ {k:05d}" for k in range(80)), *["ПОСТ 00007"] * 30, "ПОСТ"]
    wanted = list(dict.fromkeys([*others[::4], *made(rng, 20), "ПОСТ 00019", "ПОСТ 1"]))
    main = (rng.random(len(others)) < 0.3).tolist()
    right = spark.createDataFrame(list(zip(range(len(others)), others, main, strict=True)), "sid long, name string, main boolean")
    sizes = names.in_blocks(right.withColumnRenamed("name", "other")).groupBy("main", "block").agg({"other": "count"}).collect()
    assert len(sizes) > 10 and sum(r[2] for r in sizes) == len(others)
    got = names.best_names(spark.createDataFrame([(w,) for w in wanted], "name string"), right, 8, matching.LEAST)
    assert sorted((r.name, r.sid, r.score, r.spare) for r in got.collect()) == sorted(brute(wanted, range(len(others)), others, main, 8))


def test_regions_by_first_places_from_names_looked_up_once(spark):
    stations = spark.sql("select id, concat('ПОСТ ', id) as name, concat('r', id % 3) as region_code, 30.0 as lon, 50.0 as lat, false as is_main_rail_station, true as is_visible_default, string(null) as esr_user, string(null) as uic_ref from range(9)")
    stops = spark.sql("select 1L as route_id, int(10 - id) as stop_sequence, concat('ПОСТ ', id) as station_name_raw, string(null) as station_code, if(id = 4, id, null) as stored_station_id from range(9)")
    out = matching.route_regions(matching.candidates(stops, stations))
    assert "CoGroups" not in out._jdf.queryExecution().toString()
    assert [(r.route_id, list(r.strict), set(r.regions)) for r in out.collect()] == [(1, ["r1", "r2", "r0"], {"r0", "r1", "r2"})]
