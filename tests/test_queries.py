"""Every registered query of the library against its SQL, or, where SQL has none, against a brute-force version."""

import heapq
import math

import pytest
from pyspark.sql import functions as F

from trackloom.functions import text
from trackloom.operators import matching
from trackloom.plans import networks
from trackloom.plans import queries as plans
from trackloom.plans.fixtures import load

SF = "/root/testdata/sf0.001"


def _canonical(spark, names):
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.canonical_name(F.col("n")).alias("c")).collect()
    return {r.n: r.c for r in rows}


def _similar_names(spark, t, got):
    names = {r.id: (r.a, r.b) for r in t.names.collect()}
    made = _canonical(spark, {x for p in names.values() for x in p})
    assert len(got) == len(names)
    for r in got.itertuples():
        a, b = names[r.id]
        assert r.similarity == pytest.approx(text.similarity(made[a], made[b]), abs=1e-6)


def _shortest(edges, source, target):
    near = {}
    for e in edges:
        near.setdefault(e.src, []).append((e.dst, e.length_km))
        near.setdefault(e.dst, []).append((e.src, e.length_km))
    best, queue = {}, [(0.0, source)]
    while queue:
        d, node = heapq.heappop(queue)
        if node not in best:
            best[node] = d
            for other, km in near.get(node, ()):
                heapq.heappush(queue, (d + km, other))
    return best.get(target)


def _path_alternatives(spark, t, got):
    edges = t.edges.collect()
    km = {e.edge_id: e.length_km for e in edges}
    ends = t.trunk.groupBy("route_id").agg(F.min_by("station_id", "stop_sequence").alias("source"), F.max_by("station_id", "stop_sequence").alias("target")).where("source <> target").select(F.lit("all").alias("scope_key"), "source", "target")
    found = plans.graph.path_alternatives(t.edges, ends, most=3).collect()
    assert {(r.source, r.target) for r in found} == {(r.source, r.target) for r in ends.collect() if _shortest(edges, r.source, r.target) is not None}
    assert len(found) == len(got) >= 1
    for r in found:
        assert r.length_km == pytest.approx(sum(km[e] for e in r.edge_ids)) and r.nodes[0] == r.source and r.nodes[-1] == r.target
        if r["rank"] == 0:
            assert r.length_km == pytest.approx(_shortest(edges, r.source, r.target))
    assert (got.length_ratio >= 1 - 1e-9).all() and got.overlap_ratio.between(0, 1).all() and ((got.overlap_ratio + got.difference_ratio) - 1).abs().max() < 1e-9


def _stop_candidates(spark, t, got):
    stops, stations = plans._trunk_stops(t).collect(), t.stations.where("is_visible_default").collect()
    made = _canonical(spark, {s.station_name_raw for s in stops} | {s.name for s in stations})
    for s in stops:
        scored = []
        for x in stations:
            similar = text.similarity(made[s.station_name_raw], made[x.name])
            code = s.station_code is not None and s.station_code in (x.esr_user, x.uic_ref)
            anchor = s.stored_station_id == x.id
            score = min(1.0, similar + 0.03 * x.is_main_rail_station) if similar >= matching.LEAST else max(similar, matching.LEAST_SPARE)
            score = max([score] * (similar >= matching.LEAST) + [0.92] * code + [0.5] * anchor, default=None)
            if score is not None:
                full = max(score, 0.92) if code else score
                full = max(full, 0.97) if anchor else full
                scored.append((not code, not anchor, -round(min(1.0, max(0.01, full + 0.03 * x.is_main_rail_station)), 9), not x.is_main_rail_station, x.id))
        mine = got[(got.route_id == s.route_id) & (got.stop_sequence == s.stop_sequence)].sort_values("rank")
        assert list(mine.station_id) == [r[-1] for r in sorted(scored)][: matching.MOST_CANDIDATES]
        assert [round(v, 9) for v in mine.effective_score] == [-r[2] for r in sorted(scored)][: matching.MOST_CANDIDATES]


def _locked_routes(spark, t, got):
    stops = plans._trunk_stops(t).collect()
    found = matching.candidates(plans._trunk_stops(t), t.stations).collect()
    allowed = {(c.route_id, c.stop_sequence): {x.station_id for x in found if (x.route_id, x.stop_sequence) == (c.route_id, c.stop_sequence)} for c in found}
    assert {(r.route_id, r.stop_sequence) for r in got.itertuples()} == {(s.route_id, s.stop_sequence) for s in stops} and len(got) == len(stops)
    assert all(r.station_id in allowed[r.route_id, r.stop_sequence] for r in got.itertuples() if r.reason != "no_candidates")


def _route_regions(spark, t, got):
    found = matching.candidates(plans._trunk_stops(t), t.stations).where("rank = 1").collect()
    for r in got.itertuples():
        own = sorted((c for c in found if c.route_id == r.route_id), key=lambda c: c.stop_sequence)
        strict = [c.region_code for c in own if c.anchor] + [c.region_code for c in own if c.code_match] + [c.region_code for c in own if c.anchor or c.code_match or c.effective_score >= matching.HIGH]
        assert list(r.strict) == list(dict.fromkeys(strict))[:6] and set(r.regions) == {c.region_code for c in own}


def _route_shapes(spark, t, got):
    """Groups as a walk over the legs makes them."""
    legs = networks._built(t)[0].orderBy("route_id", "stop_sequence").collect()
    assert {r.method for r in legs} >= {"topology_graph_path", "missing_locked_station"}
    groups, route, current = [], None, None
    for r in legs:
        if r.route_id != route:
            route, current = r.route_id, None
        if r.coords is None:
            current = current if r.method == "missing_locked_station" else None
            continue
        line = [(p.lon, p.lat) for p in r.coords]
        if current is not None and current[-1] == line[0]:
            current += line[1:]
        else:
            current = line
            groups.append((route, current))
    length = lambda c: sum(6371.0088 * 2 * math.asin(math.sqrt(math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2)) for a, b in zip(c, c[1:], strict=False))
    mine, want = sorted((r.route_id, r.points, r.length_km) for r in got.itertuples()), sorted((i, len(c), length(c)) for i, c in groups)
    assert [x[:2] for x in mine] == [x[:2] for x in want] and [x[2] for x in mine] == pytest.approx([x[2] for x in want], rel=1e-4)


CHECKS = {"similar_names": _similar_names, "path_alternatives": _path_alternatives, "stop_candidates": _stop_candidates, "locked_routes": _locked_routes, "route_regions": _route_regions, "route_shapes": _route_shapes}


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, same_rows, name):
    got = plans.queries()[name](spark, SF).toPandas()
    if name in plans.SQL:
        same_rows(duck(SF).sql(plans.SQL[name]).df(), got)
    else:
        CHECKS[name](spark, load(spark, SF), got)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
