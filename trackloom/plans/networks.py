"""Registered queries of the network: paths, links, virtual and bridged routes, topology, each with its DuckDB text.

The ``chain`` view is a forest, so the one path between two nodes is what a recursive query finds.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import geo
from trackloom.operators import graph, matching, routing
from trackloom.plans.queries import PT, SQL, _also, km, query, seg_km
from trackloom.sources import sinks

c = F.col

WALK = """both_ways as (select edge_id, src, dst, length_km from chain union all select edge_id, dst, src, length_km from chain),
walk as (select src as source, src as node, cast(null as bigint) as came, cast(0 as double) as km, 0 as hops from both_ways
  union select w.source, b.dst, b.edge_id, w.km + b.length_km, w.hops + 1 from walk w join both_ways b on b.src = w.node where w.came is null or b.edge_id <> w.came)"""


def _parts(t):
    """The chain's nodes by region, a scope's own: most edges of the chain lead from one to another."""
    return t.stations.select(_scope("id"), c("id").alias("node"), c("region_code").alias("part"))


def _scope(node: str):
    return _scope_of(c(node))


def _scope_of(node):
    return F.when(node % 2 == 0, "even").otherwise("odd").alias("scope_key")


def _walk(parts: str, select: str, name: str | None = None):
    """A query whose SQL walks the forest."""

    def add(f):
        key = name or f.__name__
        f = _also(WALK + parts, select, key)(f)
        SQL[key] = SQL[key].replace("with ", "with recursive ", 1)
        return f

    return add


@_walk(
    ", starts as (select scope_key, min(src) as source from chain group by 1), ends as (select distinct scope_key, dst as target from chain)",
    "select s.scope_key, s.source, e.target, round(w.km, 6) as length_km, cast(w.hops as integer) as edges from starts s join ends e on e.scope_key = s.scope_key join walk w on w.source = s.source and w.node = e.target",
)
def shortest_paths(t):
    pairs = t.chain.groupBy("scope_key").agg(F.min("src").alias("source")).join(t.chain.select("scope_key", c("dst").alias("target")).distinct(), "scope_key")
    return graph.paths(t.chain, pairs, _parts(t)).select("scope_key", "source", "target", F.round("length_km", 6).alias("length_km"), F.size("edge_ids").alias("edges"))


@_walk(", starts as (select min(src) as source from chain group by scope_key)", "select w.source, w.node, round(w.km, 6) as km from walk w join starts s on s.source = w.source")
def path_distances(t):
    starts = t.chain.groupBy("scope_key").agg(F.min("src").alias("source")).select("source")
    return graph.distances(t.chain, starts).select("source", "node", F.round("km", 6).alias("km"))


@query("select node, count(*) as n, round(sum(length_km), 6) as km from (select src as node, length_km from chain union all select dst, length_km from chain) x group by 1")
def adjacent_edges(t):
    odd = t.chain.where("src % 3 = 0").select("edge_id", "scope_key", "src", c("src").alias("dst"), "length_km").unionByName(t.chain.select("edge_id", "scope_key", "src", "dst", F.lit(0.0).alias("length_km")))
    return graph.adjacency(t.chain.unionByName(odd)).groupBy(c("src").alias("node")).agg(F.count("*").alias("n"), F.round(F.sum("length_km"), 6).alias("km"))


@query("select edge_id, src, dst from chain where scope_key = 'even' order by edge_id limit 20")
def capped_edges(t):
    return graph.load_edges(t.chain, ["even"], 20).select("edge_id", "src", "dst")


@query("select l.scope_key, l.station_id, l.node, round(s.lon, 6) as node_lon from links l join stations s on s.id = l.node and (s.id % 2 = 0) = (l.scope_key = 'even')")
def linked_nodes(t):
    nodes = t.stations.select(F.when(c("id") % 2 == 0, "even").otherwise("odd").alias("scope_key"), c("id").alias("node"), "lon", "lat")
    return graph.linked_nodes(t.links, nodes).select("scope_key", "station_id", "node", F.round("node_lon", 6).alias("node_lon"))


@query("select station_id, l.node, component from links l left join (select id as node, id % 5 as component from stations where id % 4 <> 0) s on s.node = l.node")
def annotated_links(t):
    labels = t.stations.where("id % 4 <> 0").select(c("id").alias("node"), (c("id") % 5).alias("component"))
    return routing.with_components(t.links, labels).select("station_id", "node", "component")


@query("select id from lines where not is_service_line and (is_visible_default or is_main_passenger_line) and region_code in ('ASIA', 'EUROPE')")
def topology_lines(t):
    return graph.topology_input(t.lines, ["ASIA", "EUROPE"]).select("id")


# Building (GRF1, GEO12, SET1, STR22)

CUTS = """used as (select id, ax, ay, bx, by_, bx - ax as dx, by_ - ay as dy from lines where not is_service_line and (is_visible_default or is_main_passenger_line) and region_code in ('ASIA', 'EUROPE')),
pairs as (select s.id, (s.bx - s.ax) as dx, (s.by_ - s.ay) as dy, s.ax, s.ay, o.ax as oax, o.ay as oay, o.bx as obx, o.by_ as oby, o.dx as ex, o.dy as ey, s.dx * o.dy - s.dy * o.dx as det, s.dx * s.dx + s.dy * s.dy as n
  from used s join used o on o.id <> s.id and greatest(s.ax, s.bx) >= least(o.ax, o.bx) and least(s.ax, s.bx) <= greatest(o.ax, o.bx) and greatest(s.ay, s.by_) >= least(o.ay, o.by_) and least(s.ay, s.by_) <= greatest(o.ay, o.by_)),
at_ as (select id, dx, dy, n, det, ((oax - ax) * ey - (oay - ay) * ex) / nullif(det, 0) as t, ((oax - ax) * dy - (oay - ay) * dx) / nullif(det, 0) as u, oax - ax as px, oay - ay as py, obx - ax as qx, oby - ay as qy from pairs),
marks as (select id, t from at_ where t between 0 and 1 and u between 0 and 1
  union all select id, (px * dx + py * dy) / nullif(n, 0) from at_ where abs(px * dy - py * dx) <= 1e-12 * sqrt(n) and (px * dx + py * dy) / nullif(n, 0) between 0 and 1
  union all select id, (qx * dx + qy * dy) / nullif(n, 0) from at_ where abs(qx * dy - qy * dx) <= 1e-12 * sqrt(n) and (qx * dx + qy * dy) / nullif(n, 0) between 0 and 1
  union all select id, 0 from used union all select id, 1 from used),
steps as (select distinct id, round(t, 12) as t from marks), cut_ as (select id, t as a, lead(t) over (partition by id order by t) as b from steps),
pieces as (select c.id, u.ax + a * dx as x0, u.ay + a * dy as y0, u.ax + b * dx as x1, u.ay + b * dy as y1 from cut_ c join used u on u.id = c.id where b is not null),
kept as (select distinct round(x0, 9) as x0, round(y0, 9) as y0, round(x1, 9) as x1, round(y1, 9) as y1 from (select *, """ + km("x0", "y0", "x1", "y1") + """ as d from pieces) p where d > 1e-6)"""


@_also(CUTS, f"select count(*) as edges, round(sum({km('x0', 'y0', 'x1', 'y1')}), 3) as length_km from kept", name="noded_network")
def _noded_network(t):
    used = graph.topology_input(t.lines, ["ASIA", "EUROPE"]).select(F.lit("all").alias("scope_key"), "id", "coords")
    edges = graph.split_edges(graph.node_lines(used))[1]
    return edges.agg(F.count("*").alias("edges"), F.round(F.sum("length_km"), 3).alias("length_km"))


@_also(
    CUTS
    + ", nodes as (select distinct round(x0, 6) as x, round(y0, 6) as y from kept union select distinct round(x1, 6), round(y1, 6) from kept), far as (select s.id, min("
    + km("s.lon", "s.lat", "x", "y")
    + ") * 1000 as m from stations s, nodes where s.region_code in ('ASIA', 'EUROPE') group by 1)",
    "select id as station_id, round(m, 0) as m from far",
)
def topology_links(t):
    links = graph.build_topology(t.lines, t.stations, "all", ["ASIA", "EUROPE"], k=1)[2]
    return links.where("is_primary").select("station_id", F.round("link_distance_m", 0).alias("m"))


# Edge snaps and link options (GEO8, GEO9, GRF16)

SNAPS = f"""near as (select s.id, l.id as edge_id, ax, ay, bx, by_, {seg_km("s.lon", "s.lat", "ax", "ay", "bx", "by_")} as air, {PT.replace("45 -", "s.lon -").replace("57 -", "s.lat -")} as t
  from stations s join (select *, (bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) as n from lines) l on abs(s.lat - ay) < 1.5 and abs(s.lon - ax) < 3),
ranked as (select *, row_number() over (partition by id order by air, edge_id) as rank from near where air <= 15)"""


@_also(
    SNAPS,
    f"""select id, edge_id, round(air, 6) as air_km, cast(rank as integer) as rank, 'a' as node, round({km("ax", "ay", "ax + t * (bx - ax)", "ay + t * (by_ - ay)")}, 6) as along_km from ranked where rank <= 12
  union all select id, edge_id, round(air, 6), cast(rank as integer), 'b', round({km("ax + t * (bx - ax)", "ay + t * (by_ - ay)", "bx", "by_")}, 6) from ranked where rank <= 12""",
    name="edge_snaps",
)
def _edge_snaps(t):
    edges = t.lines.select(c("id").alias("edge_id"), F.lit("a").alias("src"), F.lit("b").alias("dst"), "coords")
    return routing.edge_snaps(t.stations.select("id", "lon", "lat"), edges, 15_000.0).select("id", "edge_id", F.round("air_km", 6).alias("air_km"), "rank", "node", F.round("along_km", 6).alias("along_km"))


def _placed(t):
    """The chain's edges with their ends' places, and its nodes."""
    at = lambda x: t.stations.select(c("id").alias(x), F.struct("lon", "lat").alias(f"p_{x}"))
    edges = t.chain.join(at("src"), "src").join(at("dst"), "dst").select("scope_key", "edge_id", "src", "dst", "length_km", F.array("p_src", "p_dst").alias("coords"))
    nodes = t.stations.select(_scope("id"), c("id").alias("node"), "lon", "lat")
    return edges, nodes


@_also(
    f"""edge as (select c.edge_id, c.src, c.dst, a.lon as ax, a.lat as ay, b.lon as bx, b.lat as by_ from chain c join stations a on a.id = c.src join stations b on b.id = c.dst), deg as (select node, count(*) as degree from (select src as node from edge union all select dst from edge) x group by 1),
  near as (select s.id, {km("s.lon", "s.lat", "n.lon", "n.lat")} as air, n.id as node, degree from settlements s, stations n join deg on deg.node = n.id),
  close as (select * from (select *, row_number() over (partition by id, node % 2 order by round(air, 6), degree desc, node) as k from near where air <= 60) x where k <= 16),
  snap as (select s.id, e.*, {seg_km("s.lon", "s.lat", "ax", "ay", "bx", "by_")} as air, {PT.replace("45 -", "s.lon -").replace("57 -", "s.lat -")} as t from settlements s, (select *, (bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) as n from edge) e),
  best as (select * from (select *, row_number() over (partition by id, src % 2 order by air, edge_id) as k from snap where air <= 60) x where k <= 12),
  options as (select id, node, air, air as way, degree, 0 as source from close
    union all select id, src, air, air + {km("ax", "ay", "ax + t * (bx - ax)", "ay + t * (by_ - ay)")}, degree, 1 from best join deg on deg.node = src
    union all select id, dst, air, air + {km("ax + t * (bx - ax)", "ay + t * (by_ - ay)", "bx", "by_")}, degree, 1 from best join deg on deg.node = dst),
  one as (select * from (select *, row_number() over (partition by id, node order by air, way, degree desc, source desc) as k from options) x where k = 1)""",
    "select id as station_id, case when node % 2 = 0 then 'even' else 'odd' end as scope_key, node, round(air, 5) as air_km, round(way, 5) as way_km from (select *, row_number() over (partition by id, node % 2 order by air, way, degree desc, node) as r from one) x where r <= 32",
)
def link_options(t):
    edges, nodes = _placed(t)
    none = t.links.select("scope_key", "station_id", "node", "link_distance_m", "is_primary").limit(0)
    out = routing.link_options(t.settlements.select("id", "lon", "lat"), none, nodes, edges, max_km=60.0)
    return out.select("station_id", "scope_key", "node", F.round("air_km", 5).alias("air_km"), F.round("link_distance_km", 5).alias("way_km"))


# Virtual routes, probes, bridges (GRF11, GRF12, GRF13, GRF16, GRF20, NUM15, NUM16, TOP10, SET6)

OPTIONS = """options as (select id as station_id, id as node, (id % 5) / 10.0 as air, (id % 7) / 10.0 as way, id % 3 = 0 as stored, id % 6 = 0 as prim from stations union all select id, id + 2, (id % 3) / 4.0, (id % 2) / 2.0, false, false from stations where id + 2 in (select id from stations)),
wanted as (select id as pair_id, id as origin, id + 8 as destination, cast(id % 40 as double) as delta_km, cast(20 as double) as geo_km from stations where id + 8 in (select id from stations)),
sides as (select w.*, a.node as source, b.node as target, a.air as air_a, b.air as air_b, a.way as km_a, b.way as km_b, case when not a.stored then 0.05 when not a.prim then 0.01 else 0 end + case when not b.stored then 0.05 when not b.prim then 0.01 else 0 end as sources from wanted w join options a on a.station_id = w.origin join options b on b.station_id = w.destination and b.node % 2 = a.node % 2 where a.node <> b.node),
tried as (select s.*, w.km as path_km, w.hops, w.km + km_a + km_b as total from sides s join walk w on w.source = s.source and w.node = s.target)"""


def _options(t):
    s = t.stations.select("id")
    own = s.select(_scope("id"), c("id").alias("station_id"), c("id").alias("node"), (c("id") % 5 / 10).alias("air_km"), (c("id") % 7 / 10).alias("link_distance_km"), (c("id") % 3 == 0).alias("stored"), (c("id") % 6 == 0).alias("is_primary"))
    next_ = s.select(_scope("id"), c("id").alias("station_id"), (c("id") + 2).alias("node"), (c("id") % 3 / 4).alias("air_km"), (c("id") % 2 / 2).alias("link_distance_km"), F.lit(False).alias("stored"), F.lit(False).alias("is_primary"))
    wanted = s.select(c("id").alias("pair_id"), c("id").alias("origin"), (c("id") + 8).alias("destination"), (c("id") % 40).cast("double").alias("delta_km"), F.lit(20.0).alias("geo_km"))
    here = s.select(c("id").alias("_i"))
    return own.unionByName(next_.join(here, c("node") == c("_i"), "left_semi")), wanted.join(here, c("destination") == c("_i"), "left_semi")


@_walk(
    f", {OPTIONS}, scored as (select *, total + 6 * air_a + 30 * greatest(0, air_a - 0.35) + 6 * air_b + 30 * greatest(0, air_b - 0.35) as score from tried)",
    "select pair_id, source, target, round(total, 6) as total_km, round(score, 6) as score from (select *, row_number() over (partition by pair_id order by round(score, 9), round(total, 9), hops, source, target) as n from scored) x where n = 1",
)
def virtual_routes(t):
    options, wanted = _options(t)
    return routing.virtual_routes(wanted, options, t.chain, graph.components_by_scope(t.chain), _parts(t)).select("pair_id", "source", "target", F.round("total_km", 6).alias("total_km"), F.round("score", 6).alias("score"))


@_walk(
    f", {OPTIONS}",
    """select w.pair_id, x.source, x.target, round(x.total, 6) as total_km, case when x.total is null then 'no path' else 'path found' end as result from wanted w
  left join (select *, row_number() over (partition by pair_id order by round(total, 9), source, target) as n from tried) x on x.pair_id = w.pair_id and n = 1""",
)
def scope_probe(t):
    options, wanted = _options(t)
    return routing.probe(wanted, options, t.chain, graph.components_by_scope(t.chain), _parts(t)).select("pair_id", "source", "target", F.round("total_km", 6).alias("total_km"), "result")


def _transition(delta: str, path: str, hops: str) -> str:
    return f"""case when {delta} <= 1 then case when {path} <= 2 then {path} * 0.05 + {hops} * 0.05 end when ({delta} >= 50 and {path} < {delta} * 0.2) or ({delta} >= 5 and {path} > greatest({delta} * 2, {delta} + 40)) then null
  else abs({path} - {delta}) * 0.45 + abs({path} - {delta}) / greatest({delta}, 10) * 22 + greatest(0, {hops} - 1) * 0.04 end"""


def _outlier(delta: str, geo_km: str, path: str) -> str:
    return f"""case when {delta} >= 1 then abs({path} - {delta}) * 0.65 + abs({path} - {delta}) / greatest({delta}, 1) * 28 + case when {path} > greatest({delta} * 2.5, {delta} + 55) then 80 else 0 end
  when {geo_km} >= 5 then greatest(0, {path} - {geo_km}) * 0.25 + greatest(0, {path} - {geo_km}) / greatest({geo_km}, 1) * 12 + case when {path} > greatest({geo_km} * 4, {geo_km} + 120) then 60 else 0 end else 0 end"""


DIRECT = f"""costed as (select *, {_transition("delta_km", "total", "hops")} as transition, {_outlier("delta_km", "geo_km", "total")} as outlier from tried),
direct as (select * from (select *, row_number() over (partition by pair_id order by score, total, km_a + km_b, hops, source, target) as n from (
  select *, 4 * transition + outlier + 0.15 * (km_a + km_b) + sources as score from costed where transition is not null) x) y where n = 1)"""


@_walk(f", {OPTIONS}, {DIRECT}", "select pair_id, round(total, 6) as total_km, round(score, 6) as final_score from direct")
def direct_routes(t):
    options, wanted = _options(t)
    return routing.direct_routes(wanted, options, t.chain, parts=_parts(t)).select("pair_id", F.round("total_km", 6).alias("total_km"), F.round("final_score", 6).alias("final_score"))


BRIDGED = f"""labels as (select source as node, min(node) as component from walk group by 1), named as (select o.*, component from options o join labels l on l.node = o.node),
own as (select station_id, node % 2 as scope, list(distinct component) as cs from named group by 1, 2), apart as (select w.*, a.scope from wanted w join own a on a.station_id = w.origin join own b on b.station_id = w.destination and b.scope = a.scope where len(list_intersect(a.cs, b.cs)) = 0),
sizes as (select component, count(*) as size from labels group by 1), spots as (select l.node, l.component, size, s.lon, s.lat from labels l join sizes z on z.component = l.component join stations s on s.id = l.node),
gaps as (select * from (select *, row_number() over (partition by component, other order by gap_km, leave, enter) as k from (select a.component, b.component as other, a.node as leave, b.node as enter, {km("a.lon", "a.lat", "b.lon", "b.lat")} as gap_km, least(a.size, b.size) as small
  from spots a join spots b on a.component < b.component and a.node % 2 = b.node % 2) x where gap_km <= 900 and small <= 500) y where k <= 8),
both_gaps as (select component, other, leave, enter, gap_km from gaps union all select other, component, enter, leave, gap_km from gaps),
over_ as (select a.pair_id, a.delta_km, a.geo_km, x.node as source, y.node as target, leave, enter, gap_km, x.way as km_a, y.way as km_b, u.hops + v.hops + 1 as hops, x.way + u.km + gap_km + v.km + y.way as total, case when x.stored then 0 else 1 end + case when y.stored then 0 else 1 end as weak
  from apart a join named x on x.station_id = a.origin and x.node % 2 = a.scope join named y on y.station_id = a.destination and y.node % 2 = a.scope join both_gaps g on g.component = x.component and g.other = y.component
  join walk u on u.source = x.node and u.node = leave join walk v on v.source = enter and v.node = y.node),
bridged as (select * from (select *, row_number() over (partition by pair_id order by round(score, 9), round(total, 9), hops, source, target, leave, enter) as n from (
  select *, 4 * transition + {_outlier("delta_km", "geo_km", "total")} + 0.15 * (km_a + km_b) + 0.05 * weak + 0.2 + 0.35 * gap_km as score from (select *, {_transition("delta_km", "total", "hops")} as transition from over_) o where transition is not null) x) y where n = 1)"""


def _bridged(t):
    options, wanted = _options(t)
    wanted = wanted.withColumn("delta_km", F.col("delta_km") * 30)
    labels = graph.components_by_scope(t.chain)
    spots = _placed(t)[1].join(labels, ["scope_key", "node"])
    bridges = graph.bridge_candidates(spots, 900.0, pairs=routing.bridged_components(wanted, options, labels))
    return options, wanted, routing.bridge_routes(wanted, options, t.chain, labels, bridges, _parts(t))


FAR = OPTIONS.replace("cast(id % 40 as double) as delta_km", "cast(id % 40 as double) * 30 as delta_km")


@_walk(f", {FAR}, {BRIDGED}", "select pair_id, source, target, leave, enter, round(total, 5) as total_km, round(score, 5) as final_score from bridged")
def bridge_routes(t):
    return _bridged(t)[2].select("pair_id", "source", "target", "leave", "enter", F.round("total_km", 5).alias("total_km"), F.round("final_score", 5).alias("final_score"))


@_walk(f", {FAR}, {DIRECT}, {BRIDGED}", "select pair_id, 'direct' as mode, round(score, 5) as final_score from direct union all select pair_id, 'bridge', round(score, 5) from bridged where pair_id not in (select pair_id from direct)")
def chosen_routes(t):
    options, wanted, bridged = _bridged(t)
    return routing.chosen_routes(routing.direct_routes(wanted, options, t.chain, graph.components_by_scope(t.chain), _parts(t)), bridged).select("pair_id", "mode", F.round("final_score", 5).alias("final_score"))


# Routes on the map (GRF15, GRF18, ARR6, SNK8)


@_walk(
    """, far as (select w.source, w.node as target, w.hops from walk w join (select min(src) as source from chain group by scope_key) s on s.source = w.source where w.hops >= 1)""",
    "select concat(source, ':', target) as path_id, cast(hops + 1 as integer) as points, cast(hops as integer) as parts, round(a.lon, 6) as first_lon, round(b.lon, 6) as last_lon from far join stations a on a.id = source join stations b on b.id = target where (select count(*) from stations) > 0",
)
def path_lines(t):
    # Every node of the chain is placed, also those past the last station.
    both = t.chain.select(c("src").alias("id")).union(t.chain.select(c("dst").alias("id"))).distinct().join(t.stations.select("id", "lon", "lat"), "id", "left").fillna({"lon": 0.0, "lat": 0.0})
    spot = both.select("id", F.struct(F.coalesce("lon", F.lit(0.0)).alias("lon"), (F.coalesce("lat", F.lit(0.0)) + c("id") / 1000).alias("lat")).alias("p"))
    at = lambda x: spot.select(c("id").alias(x), c("p").alias(f"p_{x}"))
    edges = t.chain.join(at("src"), "src").join(at("dst"), "dst").select("edge_id", "src", F.array("p_src", "p_dst").alias("coords"))
    starts = t.chain.groupBy("scope_key").agg(F.min("src").alias("source"))
    pairs = starts.join(t.chain.select("scope_key", F.explode(F.array("src", "dst")).alias("target")).distinct(), "scope_key").where("source <> target")
    found = graph.paths(t.chain, pairs).select(F.concat_ws(":", "source", "target").alias("path_id"), "edge_ids", "nodes", "target")
    lines = routing.path_geometry(found, edges).join(found.select("path_id", "target"), "path_id").join(t.stations.select(c("id").alias("target")), "target", "left_semi")
    return lines.select("path_id", F.size("coords").alias("points"), F.size("parts").alias("parts"), F.round(geo.start_point(c("coords"))["lon"], 6).alias("first_lon"), F.round(geo.end_point(c("coords"))["lon"], 6).alias("last_lon"))


@query(
    """select route_id, g as group_, cast(count(*) + 1 as integer) as points from (select route_id, seg, sum(case when seg % 4 = 0 then 1 else 0 end) over (partition by route_id order by seg) as g from trunk_segments) x where seg % 4 <> 0 group by 1, 2"""
)
def route_groups(t):
    s = t.spark.table("trunk_segments").select("route_id", c("seg").alias("stop_sequence"), F.when(c("seg") % 4 != 0, F.array(F.struct(c("ax").alias("lon"), c("ay").alias("lat")), F.struct(c("bx").alias("lon"), c("by_").alias("lat")))).alias("coords"))
    return routing.route_geometry(s).select("route_id", c("group").alias("group_"), F.size("coords").alias("points"))


LOCKED = "locked as (select route_id, stop_sequence, case when stop_sequence % 4 <> 0 then station_id end as station_id, 'route_lock' as reason, (stop_sequence % 13) / 12.0 as effective_score from route_stops)"


def _locked(t):
    return t.route_stops.select("route_id", "stop_sequence", F.when(c("stop_sequence") % 4 != 0, c("station_id")).alias("station_id"), F.lit("route_lock").alias("reason"), (c("stop_sequence") % 13 / 12).alias("effective_score"))


@_also(LOCKED, "select route_id, count(*) as stops, count(station_id) as matched, round(avg(greatest(0.05, least(0.99, effective_score))), 4) as confidence from locked group by 1")
def resolutions(t):
    return matching.resolution(_locked(t))


@_also(LOCKED, "select s.route_id, cast(s.stop_sequence as integer) as stop_sequence, coalesce(l.station_id, s.station_id) as station_id, case when l.station_id is not null then reason end as match_method, round(greatest(0.05, least(0.99, effective_score)), 4) as match_confidence from route_stops s join locked l on l.route_id = s.route_id and l.stop_sequence = s.stop_sequence")
def matched_stops(t):
    return sinks.with_matches(t.route_stops, _locked(t)).select("route_id", "stop_sequence", "station_id", "match_method", "match_confidence")


@_also(
    """stops as (select route_id, stop_sequence, case when stop_sequence % 7 = 0 then station_id end as given, case when stop_sequence % 3 = 0 then station_code when stop_sequence % 3 = 1 then cast(cast(2000000 + leg_km as bigint) as varchar(20)) end as code, case when stop_sequence % 2 = 0 then concat('supplier ', '#') else null end as raw from route_stops),
  map_ as (select cast(100000 + s_suppkey as varchar(20)) as code, s_suppkey + 0 as id from supplier where s_suppkey % 9 = 0), u as (select uic_ref, min(id) as id from stations where uic_ref is not null group by 1 having count(*) = 1)""",
    """select s.route_id, cast(s.stop_sequence as integer) as stop_sequence, coalesce(g.id, m.id, e.id, u.id) as matched_id, case when g.id is not null then 'explicit_station_id' when m.id is not null then 'station_match_table' when e.id is not null then 'exact_esr_code' when u.id is not null then 'exact_uic_code' end as match_method,
  case when coalesce(g.id, m.id) is not null then 1.0 when e.id is not null then 0.95 when u.id is not null then 0.9 end as match_confidence
  from stops s left join stations g on g.id = s.given left join map_ m on m.code = s.code left join stations e on e.esr_user = s.code left join u on u.uic_ref = s.code""",
)
def import_matches(t):
    r = t.route_stops
    code = F.when(c("stop_sequence") % 3 == 0, c("station_code")).when(c("stop_sequence") % 3 == 1, (F.lit(2000000) + c("leg_km").cast("int")).cast("string"))
    s = r.select("route_id", "stop_sequence", F.when(c("stop_sequence") % 7 == 0, c("station_id")).alias("station_id"), code.alias("station_code"), F.when(c("stop_sequence") % 2 == 0, "supplier #").alias("station_name_raw"))
    mapping = t.stations.where("id % 9 = 0").select((c("id") + 100000).cast("string").alias("station_code"), c("id").alias("station_id"), F.lit(True).alias("is_active"))
    return matching.import_matches(s, t.stations, mapping).select("route_id", "stop_sequence", "matched_id", "match_method", F.col("match_confidence").cast("double").alias("match_confidence"))


BUILT = f"""held as (select route_id, stop_sequence, case when station_id % 6 <> 0 then station_id end as station, case when stop_sequence % 5 <> 0 then cast(stop_sequence * 25 as double) end as km from trunk),
linked as (select id as station_id, id as node, (id % 5) / 10.0 as way, id % 4 <> 0 as prim from stations union all select id, id + 1, (id % 3) / 4.0, false from stations where id % 3 <> 0),
deg as (select distinct node from (select src as node from chain union all select dst from chain) x), placed as (select d.node, s.lon, s.lat from deg d join stations s on s.id = d.node),
near as (select * from (select s.id as station_id, p.node, {km("s.lon", "s.lat", "p.lon", "p.lat")} as way, row_number() over (partition by s.id, p.node % 2 order by {km("s.lon", "s.lat", "p.lon", "p.lat")}, p.node) as k from stations s, placed p where {km("s.lon", "s.lat", "p.lon", "p.lat")} <= 8) x where k <= 12),
both_kinds as (select l.station_id, l.node, l.way, l.prim, true as stored from linked l join placed p on p.node = l.node union all select station_id, node, way, false, false from near),
one as (select * from (select *, row_number() over (partition by station_id, node order by not stored, not prim, way) as n from both_kinds) x where n = 1),
options as (select station_id, node, way as air, way, stored, prim from (select *, row_number() over (partition by station_id, node % 2 order by not stored, not prim, way, node) as k from one) x where k <= 18),
legs as (select h.route_id, h.stop_sequence, h.station as destination, lag(h.stop_sequence) over w as from_sequence, lag(h.station) over w as origin, case when h.km is not null and lag(h.km) over w is not null then greatest(0, h.km - lag(h.km) over w) end as delta_km from held h window w as (partition by h.route_id order by h.stop_sequence)),
wanted as (select concat(l.route_id, ':', l.stop_sequence) as pair_id, l.*, {km("a.lon", "a.lat", "b.lon", "b.lat")} as geo_km from legs l join stations a on a.id = l.origin join stations b on b.id = l.destination where l.from_sequence is not null),
{OPTIONS[OPTIONS.index("sides as"):].replace(" where a.node <> b.node", "")}"""


def _nullable_delta(sql: str) -> str:
    """The costs where a stop has no distance."""
    return sql.replace("case when delta_km <= 1 then", "case when delta_km is null then total * 0.03 + hops * 0.02 when delta_km <= 1 then")


@_walk(
    f""", {BUILT}, {_nullable_delta(DIRECT)}, {_nullable_delta(BRIDGED).replace("gap_km <= 900", "gap_km <= 300")},
chosen as (select * from (select *, row_number() over (partition by pair_id order by round(score, 9), round(total, 9), way, hops, method desc) as n from (
  select pair_id, 'topology_graph_path' as method, score, total, km_a + km_b as way, hops, source, target, cast(null as double) as gap_km from direct union all select pair_id, 'topology_component_bridge', score, total, km_a + km_b, hops, source, target, gap_km from bridged) x) y where n = 1)""",
    """select l.route_id, cast(l.stop_sequence as integer) as stop_sequence, l.from_sequence, coalesce(k.method, case when l.origin is null or l.destination is null then 'missing_locked_station' else 'missing_graph_path' end) as method,
  round(k.total, 5) as total_km, round(k.score, 5) as final_score, cast(k.hops as integer) as edge_count, round(k.gap_km, 5) as gap_km, round(k.total - k.way, 5) as steps_km
  from legs l left join chosen k on k.pair_id = concat(l.route_id, ':', l.stop_sequence) where l.from_sequence is not null""",
)
def built_routes(t):
    """Routes end to end: distances or none, stops without a station, gaps that a bridge closes or nothing does."""
    legs, steps, _ = _built(t)
    walked = steps.groupBy("route_id", "stop_sequence").agg(F.sum("length_km").alias("steps_km"))
    out = legs.join(walked, ["route_id", "stop_sequence"], "left")
    rounded = [F.round(x, 5).alias(x) for x in ("total_km", "final_score", "gap_km")]
    no_steps = F.when(c("total_km").isNotNull(), F.coalesce("steps_km", F.lit(0.0)))
    return out.select("route_id", "stop_sequence", "from_sequence", "method", *rounded, "edge_count", F.round(no_steps, 5).alias("steps_km"))


def _built(t):
    stops = t.trunk.select("route_id", "stop_sequence", F.when(c("stop_sequence") % 5 != 0, (c("stop_sequence") * 25).cast("double")).alias("distance_km"))
    locked = t.trunk.where("station_id % 6 <> 0").select("route_id", "stop_sequence", "station_id")
    edges, nodes = _placed(t)
    s = t.stations
    link = lambda node, m, primary: [_scope_of(node), c("id").alias("station_id"), node.alias("node"), m.alias("link_distance_m"), primary.alias("is_primary")]
    links = s.select(*link(c("id"), c("id") % 5 * 100, c("id") % 4 != 0)).unionByName(s.where("id % 3 <> 0").select(*link(c("id") + 1, c("id") % 3 * 250, F.lit(False))))
    return routing.build_routes(stops, locked, s, links, nodes, edges, _parts(t), bridge_km=300.0)


@query()
def route_shapes(t):
    """The geometry of the built routes: each route's groups, their points and lengths."""
    _, _, groups = _built(t)
    return groups.select("route_id", c("group").alias("group_"), F.size("coords").alias("points"), F.round(geo.length_km(c("coords")), 4).alias("length_km"))
