"""Paths over a partitioned network, and the cells that partition it, against searches of the whole."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackloom.operators import graph, overlay, routing


def network(rng, n=140, per_part=20):
    """A random graph of two scopes, whose shortest ways wind through parts and back."""
    edges, k = [], 0
    for scope in ("a", "b"):
        for u in range(n):
            for v in rng.choice(n, 2, replace=False).tolist():
                if abs(u - v) < 30 or rng.random() < 0.15:
                    k += 1
                    edges.append((scope, k, u, v, float(rng.integers(1, 50)) / 4))
    edges += [("a", 9001, 3, 3, 1.0), ("a", 9002, 4, 5, 0.0), ("a", 9003, 500, 501, 2.0)]
    parts = [(s, u, f"p{(u + 7) // per_part}") for s in ("a", "b") for u in range(n)]
    return edges, parts


@pytest.mark.parametrize("seed", [0, 1])
def test_paths_over_parts(spark, seed):
    rng = np.random.default_rng(seed)
    edges, parts = network(rng)
    pairs = [(s, int(a), int(b)) for s in ("a", "b") for a, b in rng.integers(0, 140, (25, 2))] + [("a", 500, 501), ("a", 500, 1), ("a", 7, 7), ("c", 1, 2)]
    e = spark.createDataFrame(edges, "scope_key string, edge_id long, src long, dst long, length_km double")
    p = spark.createDataFrame(pairs, "scope_key string, source long, target long")
    of = spark.createDataFrame(parts, "scope_key string, node long, part string")
    km, ends = {k: d for _, k, _, _, d in edges}, {k: {u, v} for _, k, u, v, _ in edges}
    want = {}
    for scope, a, b in set(pairs):
        near = overlay.neighbours(pd.DataFrame([x[1:] for x in edges if x[0] == scope], columns=["edge_id", "src", "dst", "length_km"]))
        found = {a: 0.0} if a == b else overlay.search(near, a, {b})[0]
        if b in found:
            want[scope, a, b] = found[b]
    for given in (None, of, of.where("node % 5 <> 0")):
        got = overlay.paths(e, p, given).collect()
        assert {(r.scope_key, r.source, r.target) for r in got} == set(want) and len(got) == len(want)
        for r in got:
            assert r.length_km == pytest.approx(want[r.scope_key, r.source, r.target]) == pytest.approx(sum(km[i] for i in r.edge_ids))
            assert r.nodes[0] == r.source and r.nodes[-1] == r.target and len(r.nodes) == len(r.edge_ids) + 1
            assert all({u, v} == ends[i] for u, v, i in zip(r.nodes, r.nodes[1:], r.edge_ids, strict=False))
    assert any(len({dict(((s, n), x) for s, n, x in parts).get((r.scope_key, v)) for v in r.nodes}) >= 3 for r in got)


def test_no_task_holds_all_edges(spark, monkeypatch):
    """Edges that reach a task are those of its part alone."""
    rng = np.random.default_rng(2)
    edges, parts = network(rng)
    part = {(s, n): x for s, n, x in parts}
    sizes = pd.Series([(s, part.get((s, u), "")) for s, _, u, v, _ in edges if u != v and part.get((s, u)) == part.get((s, v))]).value_counts()
    assert sizes.max() < len(edges) / 8
    e = spark.createDataFrame(edges, "scope_key string, edge_id long, src long, dst long, length_km double")
    of = spark.createDataFrame(parts, "scope_key string, node long, part string")
    seen = overlay._in_parts
    held = []
    monkeypatch.setattr(overlay, "_in_parts", lambda inner, asked, ways: (held.append(inner.groupBy("scope_key", "part").count().agg(F.max("count")).first()[0]), seen(inner, asked, ways))[1])
    assert overlay.paths(e, spark.createDataFrame([("a", 1, 130), ("b", 2, 99)], "scope_key string, source long, target long"), of).count() >= 1
    assert held and max(held) <= sizes.max()


def test_one_search_for_each_source(monkeypatch):
    rng = np.random.default_rng(3)
    edges, _ = network(rng)
    asked = pd.DataFrame([(s, t, False) for s in range(4) for t in range(20, 60)] + [(s, 99, False) for s in range(4)], columns=["source", "target", "gate"])
    calls, run = [], overlay.search
    monkeypatch.setattr(overlay, "search", lambda near, s, t: (calls.append(s), run(near, s, t))[1])
    found = overlay.solve(("a", ""), pd.DataFrame([x[1:] for x in edges if x[0] == "a"], columns=["edge_id", "src", "dst", "length_km"]), asked, True)
    assert sorted(calls) == [0, 1, 2, 3] and len(found) > 80


def test_quarters(spark):
    rng = np.random.default_rng(4)
    at = [("a", float(x), float(y)) for x, y in np.concatenate([rng.normal([37.6, 55.7], 0.01, (400, 2)), rng.uniform([-180, -90], [180, 90], (300, 2))])]
    at += [("b", 10.0, 10.0)] * 50 + [("b", None, 1.0), ("b", 180.0, 90.0), ("b", -180.0, -90.0)]
    cells = overlay.quarters(spark.createDataFrame(at, "g string, lon double, lat double"), 40, ["g"]).groupBy("g", "cell").count().collect()
    assert sum(r["count"] for r in cells) == len(at)
    for r in cells:  # fifty at one spot cannot be told apart
        assert r["count"] <= 40 or (r.cell.startswith("16:") and r["count"] == 50)
    assert len({r.cell.split(":")[0] for r in cells if r.g == "a"}) > 3 and len({r.cell for r in cells if r.g == "a"}) > 15
    assert any(r.cell == "nowhere" for r in cells)


def test_alternatives_of_many_pairs(spark):
    """A thousand pairs over many tasks have what one search of the whole network finds."""
    rng = np.random.default_rng(6)
    edges = [("a", k, u, v, float(rng.integers(1, 40))) for k, (u, v) in enumerate((u, v) for u in range(120) for v in (u + 1, u + 7, u + 11) if v < 120)]
    edges += [("a", 5000, 700, 701, 1.0)]
    pairs = [("a", int(x), int(y)) for x, y in {tuple(p) for p in rng.integers(0, 120, (1100, 2)).tolist()}][:1000] + [("a", 700, 3), ("a", 700, 701)]
    e = spark.createDataFrame(edges, "scope_key string, edge_id long, src long, dst long, length_km double")
    got = graph.path_alternatives(e, spark.createDataFrame(pairs, "scope_key string, source long, target long"), most=1, attempts=4)
    near = overlay.neighbours(pd.DataFrame([x[1:] for x in edges], columns=["edge_id", "src", "dst", "length_km"]))
    want = {(s, t, k): (round(km, 9), ids) for _, s, t in pairs for k, (ids, _, km) in enumerate(graph.alternatives(near, s, t, 1, attempts=4))}
    assert {(r.source, r.target, r["rank"]): (round(r.length_km, 9), r.edge_ids) for r in got.collect()} == want


def test_alternatives_refuse_what_no_task_holds(spark, monkeypatch):
    monkeypatch.setattr(graph, "MOST_EDGES", 2)
    e = spark.createDataFrame([("a", k, k, k + 1, 1.0) for k in range(3)], "scope_key string, edge_id long, src long, dst long, length_km double")
    with pytest.raises(ValueError, match="connected network of 3 edges"):
        graph.path_alternatives(e, spark.createDataFrame([("a", 0, 3)], "scope_key string, source long, target long"))


def test_alternatives_of_a_network_of_any_size(spark):
    """A network of too many edges for one task: a pair's task holds the edges within its reach, and finds what a search of the whole does."""
    rng = np.random.default_rng(9)
    edges = [("a", 3 * k, u, v, float(rng.integers(1, 9))) for k, (u, v) in enumerate((u, v) for u in range(16) for v in (u + 1, u + 2, u + 7) if v < 16)]
    # A second edge beside another, and networks of one edge, which are searched whole.
    edges += [("a", 1, 0, 1, 1.0), ("a", 4003, 700, 701, 1.0)]
    pairs = [("a", 3, 12), ("a", 9, 4), ("a", 5, 5), ("a", 700, 3), ("a", 700, 701), ("b", 1, 2)]
    e = spark.createDataFrame(edges, "scope_key string, edge_id long, src long, dst long, length_km double")
    got = graph.near_alternatives(e, spark.createDataFrame(pairs, "scope_key string, source long, target long"), 1, 20, attempts=4)
    near = overlay.neighbours(pd.DataFrame([x[1:] for x in edges], columns=["edge_id", "src", "dst", "length_km"]).sort_values("edge_id"))
    want = {(s, t, k): (round(km, 9), ids) for scope, s, t in pairs if scope == "a" for k, (ids, _, km) in enumerate(graph.alternatives(near, s, t, 1, attempts=4))}
    assert {(r.source, r.target, r["rank"]): (round(r.length_km, 9), r.edge_ids) for r in got.collect()} == want and {(5, 5, 0), (700, 701, 0)} <= set(want)


def test_paths_of_named_nodes(spark):
    """Nodes and edges may have texts for ids, as a built topology has."""
    e = spark.createDataFrame([("a", "e1", "n1", "n2", 1.0), ("a", "e2", "n2", "n3", 2.0), ("a", "e3", "n1", "n3", 9.0)], "scope_key string, edge_id string, src string, dst string, length_km double")
    of = spark.createDataFrame([("a", "n1", "x"), ("a", "n2", "y"), ("a", "n3", "z")], "scope_key string, node string, part string")
    r = overlay.paths(e, spark.createDataFrame([("a", "n1", "n3")], "scope_key string, source string, target string"), of).first()
    assert (r.length_km, r.edge_ids, r.nodes) == (3.0, ["e1", "e2"], ["n1", "n2", "n3"])


def test_a_missing_stop_parts_a_route(spark):
    """Three stops on a line, the second without a station: no leg joins the first and the third."""
    place = [(k, k / 10, 0.0) for k in range(6)]
    stations = spark.createDataFrame(place, "id long, lon double, lat double")
    nodes = stations.selectExpr("'s' as scope_key", "id as node", "lon", "lat")
    edges = [("s", k, k, k + 1, 11.1, [(k / 10, 0.0), ((k + 1) / 10, 0.0)]) for k in range(5) if k != 3]
    edges = spark.createDataFrame(edges, "scope_key string, edge_id long, src long, dst long, length_km double, coords array<struct<lon:double,lat:double>>")
    links = stations.selectExpr("'s' as scope_key", "id as station_id", "id as node", "0.0 as link_distance_m", "true as is_primary")
    ids = {1: [0, None, 2, 3], 2: [0, 1, 2, 5], 3: [1, 1], 4: [None, 2]}
    stops = spark.createDataFrame([(r, n + 1, None if r == 1 else 11.0 * n) for r, s in ids.items() for n in range(len(s))], "route_id long, stop_sequence long, distance_km double")
    locked = spark.createDataFrame([(r, n + 1, i) for r, s in ids.items() for n, i in enumerate(s) if i is not None], "route_id long, stop_sequence long, station_id long")
    legs, steps, groups = routing.build_routes(stops, locked, stations, links, nodes, edges)
    method = {(r.route_id, r.stop_sequence): r.method for r in legs.collect()}
    missing, path = "missing_locked_station", "topology_graph_path"
    assert {k: v for k, v in method.items() if k[0] in (1, 4)} == {(1, 2): missing, (1, 3): missing, (1, 4): path, (4, 2): missing}
    # The gap between stations 3 and 4 is wider than a bridge may be; a longer one is taken.
    assert {k: v for k, v in method.items() if k[0] == 2} == {(2, 2): path, (2, 3): path, (2, 4): "missing_graph_path"}
    assert [len(g.coords) for g in groups.orderBy("route_id", "group").collect()] == [2, 3, 2]
    legs, steps, groups = routing.build_routes(stops.where("route_id = 2"), locked, stations, links, nodes, edges, bridge_km=12.0)
    assert {r.stop_sequence: r.method for r in legs.collect()} == {2: path, 3: path, 4: "topology_component_bridge"}
    taken = [(r.pos, r.edge_id, r.source) for r in steps.orderBy("stop_sequence", "pos").collect() if r.stop_sequence == 4]
    assert taken == [(1, 2, "graph_locked_station_path"), (2, None, "component_bridge_gap"), (3, 4, "graph_locked_station_path")]
    shape = groups.collect()
    assert len(shape) == 1 and [round(p.lon, 4) for p in shape[0].coords] == [0, 0.1, 0.2, 0.3, 0.4, 0.5]


def test_station_links_of_crowded_places(spark, monkeypatch):
    """Many stations and nodes at a few places: places meet, and ties of a rounded distance go to the smaller node."""
    rng = np.random.default_rng(11)
    at = [(float(x), float(y)) for x, y in rng.integers(0, 6, (200, 2)) / 100 + [37.5, 55.7]]
    nodes = [(k, *at[k]) for k in range(120)] + [(900, None, 1.0), (901, -150.0, -60.0)]
    stations = [(k, *at[k + 80]) for k in range(120)] + [(500, 179.9, 80.0), (501, None, None)]
    pairs, real = [], graph.range_join
    monkeypatch.setattr(graph, "range_join", lambda a, b, r: (pairs.append(a.count() * b.count()), real(a, b, r))[1])
    got = graph.station_links(spark.createDataFrame(stations, "station_id long, lon double, lat double"), spark.createDataFrame(nodes, "node long, lon double, lat double"), 4, 1_500.0)
    assert max(pairs) <= 38 * 38

    def metres(a, b, x, y):
        p, q = np.radians(b), np.radians(y)
        h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(x - a) / 2) ** 2
        return round(float(2 * 6371.0088 * np.arctan2(np.sqrt(h), np.sqrt(max(1e-12, 1 - h)))) * 1000, 3)

    want = set()
    for s, a, b in stations[:-1]:
        ranked = sorted((metres(a, b, x, y), n) for n, x, y in nodes if x is not None)[:4]
        want |= {(s, n, round(m, 1), j == 0) for j, (m, n) in enumerate(ranked) if j == 0 or m <= 1500}
    assert {(r.station_id, r.node, round(r.link_distance_m, 1), r.is_primary) for r in got.collect()} == want


def test_equal_lines_are_noded_once(spark, monkeypatch):
    """Copies of lines add nothing to a topology, and no pairs to its noding."""
    flags = "false as is_service_line, true as is_visible_default, true as is_main_passenger_line, 'x' as region_code"
    line = [[(37.0, 55.0), (37.4, 55.4)], [(37.0, 55.4), (37.4, 55.0)], [(37.2, 55.0), (37.2, 55.4), (37.3, 55.4)]]
    schema = "id long, coords array<struct<lon:double,lat:double>>"
    stations = spark.createDataFrame([(1, "x", 37.21, 55.21)], "id long, region_code string, lon double, lat double")
    seen, real = [], graph.node_lines
    monkeypatch.setattr(graph, "node_lines", lambda x: (seen.append(x.count()), real(x))[1])

    def built(times):
        lines = spark.createDataFrame([(k, line[k % 3]) for k in range(3 * times)], schema).selectExpr("*", *flags.split(", "))
        nodes, edges, links = graph.build_topology(lines, stations, "s", k=1)
        return [sorted(map(str, df.drop("segment").collect())) for df in (nodes, edges, links)]

    assert built(5) == built(1) and seen == [3, 3]


def test_small_networks_are_searched_whole(spark, monkeypatch):
    """With labels, a network of few edges is one search in one task; a larger one goes over its parts."""
    rng = np.random.default_rng(7)
    edges, parts = network(rng, n=60, per_part=9)
    edges += [("c", 8000 + k, 10 * k, 10 * k + 1, 1.0) for k in range(30)]
    e = spark.createDataFrame(edges, "scope_key string, edge_id long, src long, dst long, length_km double")
    pairs = [(s, int(a), int(b)) for s in ("a", "b") for a, b in rng.integers(0, 60, (15, 2))] + [("c", 10, 11), ("c", 10, 21), ("c", 20, 20)]
    p = spark.createDataFrame(pairs, "scope_key string, source long, target long")
    of = spark.createDataFrame([*parts, *[("c", v, f"p{v % 2}") for _, _, u, w, _ in edges[-30:] for v in (u, w)]], "scope_key string, node long, part string")
    km = lambda df: {(r.scope_key, r.source, r.target): round(r.length_km, 9) for r in df.collect()}
    want, labels = km(overlay.paths(e, p, of)), graph.components_by_scope(e)
    assert km(overlay.paths(e, p, of, labels=labels, whole_edges=20)) == want
    calls, run = [], overlay._in_parts
    monkeypatch.setattr(overlay, "_in_parts", lambda inner, asked, ways: (calls.append(ways), run(inner, asked, ways))[1])
    assert km(overlay.paths(e, p, of, labels=labels)) == want and calls == [True]


def test_gates_meet_those_of_their_own_piece(monkeypatch):
    """A part of many pieces: what a gate looks for grows with its piece, not with the part's gates."""
    edges = pd.DataFrame([(k, 2 * k, 2 * k + 1, 1.0) for k in range(300)], columns=["edge_id", "src", "dst", "length_km"])
    asked = pd.DataFrame([(v, v, True) for v in range(600)], columns=["source", "target", "gate"])
    sizes, run = [], overlay.search
    monkeypatch.setattr(overlay, "search", lambda near, s, t: (sizes.append(len(t)), run(near, s, t))[1])
    assert len(overlay.solve(("a", "x"), edges, asked, False)) == 600 and max(sizes) == 1


def test_bridges_of_wanted_components(spark):
    """Bridges of the pairs asked for are those that all pairs have, whichever side is the smaller one."""
    rng = np.random.default_rng(8)
    at = [("a", k, int(k**0.5) if k < 64 else 9, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(0, 1, (90, 2)))]
    nodes = spark.createDataFrame(at, "scope_key string, node long, component long, lon double, lat double")
    pairs = spark.createDataFrame([("a", 0, 9), ("a", 2, 9), ("a", 3, 4), ("a", 9, 9), ("a", 7, 8)], "scope_key string, component long, r_component long")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    for most_small in (500, 14):
        every = graph.bridge_candidates(nodes, 60.0, 3, most_small)
        assert rows(graph.bridge_candidates(nodes, 60.0, 3, most_small, pairs).select(*every.columns)) == rows(every.join(pairs, ["scope_key", "component", "r_component"], "left_semi").select(*every.columns))


def test_a_connected_pair_reaches_little_further(spark, monkeypatch):
    """Once a pair is connected its reach grows slowly: four times the length would be nearly the whole grid."""
    n, rows = 12, []
    for x in range(n):
        for y in range(n):
            rows += [("s", 2 * (n * x + y) + d, n * x + y, n * (x + dx) + y + dy, 1.0) for d, (dx, dy) in enumerate([(1, 0), (0, 1)]) if x + dx < n and y + dy < n]
    e = spark.createDataFrame(rows, "scope_key string, edge_id long, src long, dst long, length_km double")
    pairs = spark.createDataFrame([("s", 5 * n + 4, 5 * n + 7)], "scope_key string, source long, target long")
    lengths, search = [], graph._reached
    monkeypatch.setattr(graph, "_reached", lambda near, ends, km: lengths.append(km) or search(near, ends, km))
    rows = lambda df: sorted(tuple(r) for r in df.select("source", "target", "rank", "length_km", "edge_ids").collect())
    got = rows(graph.near_alternatives(e, pairs, 1, 20))
    assert got == rows(graph.path_alternatives(e, pairs, 1)) and got
    assert len(lengths) > 1 and all(b <= 1.51 * a for a, b in zip(lengths, lengths[1:], strict=False))
