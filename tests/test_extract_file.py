"""A small extract written here, read back by many tasks."""

import random
import zlib

import numpy as np
import pytest

from trackloom.sources import extract_file as x


def vi(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def zz(n):
    return (n << 1) ^ (n >> 63)


def num(k, n):
    return vi(k << 3) + vi(n)


def msg(k, data):
    return vi(k << 3 | 2) + vi(len(data)) + data


def deltas(values):
    return b"".join(vi(zz(b - a)) for a, b in zip([0, *values], values, strict=False))


def blob(kind, data, packed=True):
    body = num(2, len(data)) + msg(3, zlib.compress(data)) if packed else msg(1, data)
    header = msg(1, kind) + num(3, len(body))
    return len(header).to_bytes(4, "big") + header + body


def block(nodes=(), ways=(), dense=True):
    strings, at = [""], {}

    def s(v):
        if v not in at:
            at[v] = len(strings)
            strings.append(v)
        return at[v]

    grid = lambda v: round(v * 1e7)
    group = b""
    if nodes and dense:
        flat = b"".join(b"".join(vi(s(k)) + vi(s(v)) for k, v in t.items()) + vi(0) for *_, t in nodes) if any(t for *_, t in nodes) else b""
        group += msg(2, msg(1, deltas([i for i, *_ in nodes])) + msg(8, deltas([grid(y) for _, _, y, _ in nodes])) + msg(9, deltas([grid(v) for _, v, _, _ in nodes])) + msg(10, flat))
    elif nodes:
        for i, lon, lat, t in nodes:
            group += msg(1, num(1, zz(i)) + msg(2, b"".join(vi(s(k)) for k in t)) + msg(3, b"".join(vi(s(v)) for v in t.values())) + num(8, zz(grid(lat))) + num(9, zz(grid(lon))))
    for i, refs, t in ways:
        group += msg(3, num(1, i) + msg(2, b"".join(vi(s(k)) for k in t)) + msg(3, b"".join(vi(s(v)) for v in t.values())) + msg(8, deltas(refs)))
    return msg(1, b"".join(msg(1, v.encode()) for v in strings)) + msg(2, group)


@pytest.fixture(scope="module")
def extract(tmp_path_factory):
    rnd = random.Random(1)
    places = {k: (round(rnd.uniform(-180, 180), 7), round(rnd.uniform(-90, 90), 7)) for k in [*range(1, 3000), 5_000_000_000, -7]}
    tags = {10: {"railway": "station", "name": "Ä"}, 11: {"railway": "halt"}, 12: {"railway": "signal"}, -7: {"railway": "halt", "name": "minus"}, 2500: {"shop": "x"}}
    ways = [
        (1, [1, 2, 3, 4], {"railway": "rail", "usage": "main"}), (2, [5_000_000_000, 9], {"railway": "rail", "name": "long id"}), (3, [20, 21, 22, 20], {"railway": "station", "name": "area"}),
        (4, [30, 31], {"railway": "halt"}), (5, [40], {"railway": "rail"}), (6, [50, 999_999, 51], {"railway": "rail"}), (7, [1, 2], {"highway": "road"}), (8, [777_777, 888_888], {"railway": "rail"}),
    ]
    rows = [(k, *places[k], tags.get(k, {})) for k in places]
    parts = [blob(b"OSMHeader", msg(4, b"OsmSchema-V0.6"))]
    parts += [blob(b"OSMData", block(rows[k : k + 200], dense=k != 400), packed=k != 600) for k in range(0, len(rows), 200)]
    parts += [blob(b"OSMData", block(ways=ways[k : k + 3])) for k in range(0, len(ways), 3)]
    path = tmp_path_factory.mktemp("extract") / "region.osm.pbf"
    path.write_bytes(b"".join(parts))
    return path, places, ways, [len(p) for p in parts]


@pytest.mark.parametrize("split", [700, 5_000, 1 << 20])
def test_scan(spark, extract, split):
    path, places, ways, _ = extract
    stations, lines = x.scan(spark, str(path), split)
    got = {(r.osm_element_type, r.osm_id): r for r in stations.collect()}
    assert set(got) == {("node", "10"), ("node", "11"), ("node", "-7"), ("way", "3"), ("way", "4")}
    assert got["node", "10"].name == "Ä" and (got["node", "-7"].lon, got["node", "-7"].lat) == pytest.approx(places[-7], abs=1e-7)
    assert got["way", "4"].lon == pytest.approx((places[30][0] + places[31][0]) / 2, abs=1e-6)
    a, b, c = (np.array(places[k]) for k in (20, 21, 22))
    assert (got["way", "3"].lon, got["way", "3"].lat) == pytest.approx(tuple((a + b + c) / 3), abs=1e-6)
    line = {r.osm_id: [(p.lon, p.lat) for p in r.coords] for r in lines.collect()}
    refs = {str(i): [n for n in own if n in places] for i, own, t in ways if t.get("railway") == "rail"}
    assert set(line) == {k for k, v in refs.items() if len(v) >= 2} == {"1", "2", "6"}
    for k, points in line.items():
        assert np.array(points) == pytest.approx(np.array([places[n] for n in refs[k]]), abs=1e-7)


@pytest.mark.parametrize("split", [1, 64, 333, 4096])
def test_every_block_is_read_once(extract, split):
    path, _, _, sizes = extract
    size = path.stat().st_size
    with open(path, "rb") as f:
        whole = list(x.of_range(f, size, 0, size))
        assert len(whole) == len(sizes) - 1
        bounds = range(0, size, split)
        if split == 1:  # around the blocks' borders
            edge = np.cumsum([0, *sizes])
            bounds = sorted({0, *[int(e) + d for e in edge for d in (-1, 0, 1) if 0 < e + d < size]})
        cuts = [*bounds, size]
        assert [b for lo, hi in zip(cuts, cuts[1:], strict=False) for b in x.of_range(f, size, lo, hi)] == whole


def test_partitions(spark, extract):
    path, _, _, _ = extract
    spark.dataSource.register(x.ExtractSource)
    df = spark.read.format("map_extract").option("splitBytes", 5_000).load(str(path))
    assert df.rdd.getNumPartitions() >= 4 and df.count() == 3001


def test_numbers():
    values = np.array([0, 1, 127, 128, 300, 2**31, 2**62], dtype=np.int64)
    assert x.packed(b"".join(vi(int(v)) for v in values)).tolist() == values.tolist()
    both = [0, -1, 1, -5_000_000_000, 2**61, -(2**61)]
    assert x.signed(x.packed(b"".join(vi(zz(v)) for v in both))).tolist() == both
