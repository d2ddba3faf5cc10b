"""Shortest paths over a network that is dealt over many tasks.

Nodes belong to parts (regions, or cells that hold a bounded number of nodes). An edge within one
part stays there; the ends of the others are the parts' gates. A task holds one part: it finds
how far each of its gates, and each end of a wanted pair, is from its gates. These distances and
the edges between parts are a far smaller network, the overlay, on which distances from all
sources relax in rounds, each one join and one aggregation; a round goes through one part. The
best way of a pair is then known as legs, within a part or between two, and parts' tasks find
the legs' edges, each once. So no task holds more than a part, and no round more than the gates
that sources have reached.

Within a part, one search from each source settles all its targets and then stops.

A connected network of few edges needs no parts: where the labels of a scope's networks are given,
such ones are dealt over tasks whole, many to a task, and are searched at once.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators.lineage import cut

DEPTH = 16


def quarters(places: DataFrame, most: int, by: list[str] | None = None, depth: int = DEPTH) -> DataFrame:
    """places (lon, lat and others) with ``cell``: the whole map cut into quarters again and again
    until no cell of a group ``by`` holds more than ``most`` places, at most ``depth`` times.

    Places are counted by their smallest cell first, so a dense spot costs one row a level. A null
    place is in the cell 'nowhere'.
    """
    by, side = by or [], 1 << depth
    axis = lambda c, low, size: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.floor((F.col(c) - low) / size * side), F.lit(0)), F.lit(side - 1)).cast("int"))
    at = places.withColumn("_x", axis("lon", -180, 360)).withColumn("_y", axis("lat", -90, 180))
    spots = at.where("_x is not null and _y is not null").groupBy(*by, "_x", "_y").agg(F.count("*").alias("_n"))
    levels = spots.select(*by, "_x", "_y", "_n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("_l"))
    key = [*by, "_l", F.expr(f"shiftright(_x, {depth} - _l)").alias("_u"), F.expr(f"shiftright(_y, {depth} - _l)").alias("_v")]
    full = levels.groupBy(*key).agg(F.sum("_n").alias("_n")).where(F.col("_n") > most).select(*by, "_l", "_u", "_v")
    inside = levels.select("_x", "_y", *key).join(full, [*by, "_l", "_u", "_v"]).groupBy(*by, "_x", "_y").agg(F.max("_l").alias("_full"))
    return at.join(inside, [*by, "_x", "_y"], "left").select(*[at[c] for c in places.columns], _cell(depth))


def _cell(depth: int):
    level = F.least(F.coalesce(F.col("_full") + 1, F.lit(0)), F.lit(depth))
    shifted = lambda c: F.expr(f"shiftright({c}, {depth} - least(coalesce(_full + 1, 0), {depth}))")
    return F.when(F.col("_x").isNull() | F.col("_y").isNull(), "nowhere").otherwise(F.concat_ws(":", level, shifted("_x"), shifted("_y"))).alias("cell")


def search(near: dict, source, targets: set) -> tuple[dict, dict]:
    """Distances from source, exact for all targets that it reaches, and the step each node was
    reached by: Dijkstra that stops when its last target is settled; ties go to the smaller node."""
    best, came, done, left = {source: 0.0}, {}, set(), set(targets)
    queue = [(0.0, source)]
    while queue and left:
        d, node = heapq.heappop(queue)
        if node in done:
            continue
        done.add(node)
        left.discard(node)
        for other, edge, length in near.get(node, ()):
            if other not in done and (nd := d + length) < best.get(other, float("inf")):
                best[other], came[other] = nd, (node, edge)
                heapq.heappush(queue, (nd, other))
    return {t: best[t] for t in targets if t in done}, came


def neighbours(edges: pd.DataFrame) -> dict:
    near: dict = defaultdict(list)
    for e, a, b, km in zip(edges["edge_id"], edges["src"], edges["dst"], edges["length_km"], strict=True):
        if a != b and km > 0:
            near[a].append((b, e, km))
            near[b].append((a, e, km))
    return near


def pieces(near: dict) -> dict:
    """Each node's piece, by one of its nodes: what edges connect."""
    piece: dict = {}
    for start in near:
        if start in piece:
            continue
        piece[start], queue = start, [start]
        while queue:
            for other, _, _ in near[queue.pop()]:
                if other not in piece:
                    piece[other] = start
                    queue.append(other)
    return piece


def walked(came: dict, source, target) -> tuple[list, list]:
    """Edge ids and nodes of the way that a search found."""
    edges, nodes = [], [target]
    while nodes[-1] != source:
        node, edge = came[nodes[-1]]
        edges.append(edge)
        nodes.append(node)
    return edges[::-1], nodes[::-1]


def solve(key: tuple, edges: pd.DataFrame, asked: pd.DataFrame, ways: bool) -> pd.DataFrame:
    """Of one part: each source's distances to its targets, and to all gates where it asks for them
    (its target is itself); with ``ways`` the edges and nodes too."""
    near = neighbours(edges.sort_values("edge_id"))
    gates = asked.loc[asked["gate"], "source"].tolist()
    piece = pieces(near)
    reached: dict = defaultdict(set)  # gates that lie in one piece of the part are reached from there alone
    for g in gates:
        reached[piece.get(g)].add(g)
    wanted: dict = defaultdict(set)
    to_all = set()
    for s, t in zip(asked["source"].tolist(), asked["target"].tolist(), strict=True):
        if s == t:
            to_all.add(s)
        wanted[s].update((t,) if s in piece and piece[s] == piece.get(t) else ())
    rows = []
    for s, targets in wanted.items():
        if s in to_all and s in piece:
            targets = targets | reached[piece[s]]
        found, came = search(near, s, targets - {s})
        for t, km in found.items():
            rows.append((*key, s, t, km, *(walked(came, s, t) if ways else (None, None))))
    return pd.DataFrame(rows, columns=["scope_key", "part", "source", "target", "km", "edge_ids", "nodes"])


def _in_parts(inner: DataFrame, asked: DataFrame, ways: bool) -> DataFrame:
    kind = dict(inner.dtypes)
    schema = f"scope_key {kind['scope_key']}, part string, source {kind['src']}, target {kind['src']}, km double, edge_ids array<{kind['edge_id']}>, nodes array<{kind['src']}>"
    own = lambda df, *names: df.select(*[F.col(c).alias(c) for c in names]).groupBy("scope_key", "part")
    return own(inner, "scope_key", "part", "edge_id", "src", "dst", "length_km").cogroup(own(asked, "scope_key", "part", "source", "target", "gate")).applyInPandas(lambda k, e, a: solve(k, e, a, ways), schema)


WHOLE_EDGES = 20_000


def _whole(e: DataFrame, asked: DataFrame, labels: DataFrame, most: int) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame]:
    """Edges and pairs of networks with at most ``most`` edges, dealt over parts that hold about as
    many, and those of larger ones (no edges: there are none)."""
    c, node = F.col, dict(e.dtypes)["src"]
    own = labels.select(c("scope_key").alias("_scope"), c("node").cast(node).alias("_node"), F.xxhash64("component").alias("_net"))
    of = lambda df, end, name: df.join(own, (c("scope_key") == c("_scope")) & (c(end) == c("_node"))).withColumnRenamed("_net", name).drop("_scope", "_node")
    e = cut(of(e, "src", "net"))
    asked = of(of(asked, "source", "net"), "target", "_other").where("net = _other").drop("_other")
    sizes = cut(e.groupBy("scope_key", "net").agg(F.count("*").alias("n")))
    told = sizes.agg(F.sum(F.when(c("n") <= most, c("n"))).alias("few"), F.max("n").alias("most")).first()
    salt = F.pmod(c("net"), F.lit(-(-(told.few or 1) // most))).cast("string")
    if (told.most or 0) <= most:
        dealt = lambda df: df.withColumn("part", salt).drop("net")
        return dealt(e), dealt(asked), None, asked
    large = sizes.where(c("n") > most).select("scope_key", "net")
    dealt = lambda df: df.join(large, ["scope_key", "net"], "left_anti").withColumn("part", salt).drop("net")
    rest = lambda df: df.join(large, ["scope_key", "net"], "left_semi").drop("net")
    return dealt(e), dealt(asked), rest(e), rest(asked)


def paths(edges: DataFrame, pairs: DataFrame, parts: DataFrame | None = None, most_rounds: int = 500, labels: DataFrame | None = None, whole_edges: int = WHOLE_EDGES) -> DataFrame:
    """scope_key, source, target, length_km, edge_ids, nodes: the shortest path of each pair within its scope.

    edges: scope_key, edge_id, src, dst, length_km; pairs: scope_key, source, target; parts: scope_key,
    node, part. Nodes that no part names, and all without ``parts``, are one part of their scope. A
    pair of a node with itself has an empty path; pairs that nothing connects have no row. labels:
    scope_key, node, component of the same edges; where given, networks of at most ``whole_edges``
    edges are searched whole, and only larger ones over parts.
    """
    c = F.col
    kind = dict(edges.dtypes)
    node, edge = kind["src"], kind["edge_id"]

    def leg(a: str, b: str, by: str = f"cast(null as {edge})"):
        """One leg; none where it leads nowhere."""
        return F.expr(f"case when {a} = {b} then cast(array() as array<struct<a:{node},b:{node},edge:{edge}>>) else array(named_struct('a', {a}, 'b', {b}, 'edge', {by})) end")

    pairs = cut(pairs.select("scope_key", c("source").cast(node).alias("source"), c("target").cast(node).alias("target")).distinct())
    alike = pairs.where("source = target").select("scope_key", "source", "target", F.lit(0.0).alias("length_km"), F.expr(f"cast(array() as array<{edge}>)").alias("edge_ids"), F.array("source").alias("nodes"))
    asked = pairs.where("source <> target")
    e = edges.where((c("src") != c("dst")) & (c("length_km") > 0)).select("scope_key", "edge_id", "src", c("dst").cast(node).alias("dst"), c("length_km").cast("double").alias("length_km"))
    if labels is not None:
        e, asked, rest, others = _whole(e, asked, labels, whole_edges)
        found = _in_parts(e, asked.withColumn("gate", F.lit(False)), True).select("scope_key", "source", "target", c("km").alias("length_km"), "edge_ids", "nodes").unionByName(alike)
        return found if rest is None else found.unionByName(paths(rest, others, parts, most_rounds))
    if parts is None:
        whole = lambda df: df.withColumn("part", F.lit(""))
        one = _in_parts(whole(e), whole(asked).withColumn("gate", F.lit(False)), True)
        return one.select("scope_key", "source", "target", c("km").alias("length_km"), "edge_ids", "nodes").unionByName(alike)

    home = parts.select("scope_key", c("node").cast(node).alias("_node"), c("part").cast("string").alias("_part")).groupBy("scope_key", "_node").agg(F.min("_part").alias("_part"))

    def at(df: DataFrame, end: str, name: str) -> DataFrame:
        own = home.select(c("scope_key").alias("_scope"), "_node", c("_part").alias("_p"))
        return df.join(own, (c("scope_key") == c("_scope")) & (c(end) == c("_node")), "left").withColumn(name, F.coalesce("_p", F.lit(""))).drop("_scope", "_node", "_p")

    e = cut(at(at(e, "src", "part"), "dst", "part_to"))
    inner, border = e.where("part = part_to").drop("part_to"), e.where("part <> part_to")
    over = border.select("scope_key", "edge_id", "length_km", c("src").alias("u"), c("dst").alias("w"), c("part_to").alias("part"))
    over = over.unionByName(border.select("scope_key", "edge_id", "length_km", c("dst").alias("u"), c("src").alias("w"), "part"))
    over = over.groupBy("scope_key", "u", "w", "part").agg(F.min(F.struct("length_km", "edge_id")).alias("m")).select("scope_key", "u", "w", "part", "m.*")
    gates = over.select("scope_key", "part", c("w").alias("gate")).distinct()
    placed = cut(at(at(asked, "source", "part"), "target", "part_to"))

    to_gates = gates.select("scope_key", "part", c("gate").alias("source"), c("gate").alias("target"), F.lit(True).alias("gate"))
    for end, part in (("source", "part"), ("target", "part_to")):
        to_gates = to_gates.unionByName(placed.select("scope_key", c(part).alias("part"), c(end).alias("source"), c(end).alias("target"), F.lit(False).alias("gate")))
    direct = placed.where("part = part_to").select("scope_key", "part", "source", "target", F.lit(False).alias("gate"))
    legs = cut(_in_parts(inner, to_gates.unionByName(direct).distinct(), False).drop("edge_ids", "nodes"))
    to_gate = legs.join(gates.select("scope_key", c("gate").alias("target")), ["scope_key", "target"], "left_semi")
    here = gates.select("scope_key", "part", c("gate").alias("source"), c("gate").alias("target"), F.lit(0.0).alias("km"))
    to_gate = cut(to_gate.select(*here.columns).unionByName(here))

    hops = over.join(to_gate.select("scope_key", c("source").alias("w"), c("target").alias("v"), "km"), ["scope_key", "w"])
    hops = cut(hops.select("scope_key", c("u").alias("node"), "v", (c("length_km") + c("km")).alias("hop_km"), F.concat(leg("u", "w", "edge_id"), leg("w", "v")).alias("hop")).groupBy("scope_key", "node", "v").agg(F.min(F.struct("hop_km", "hop")).alias("m")).select("scope_key", "node", "v", "m.*"))
    sources = placed.select("scope_key", "source").distinct()
    best = cut(sources.join(to_gate, ["scope_key", "source"]).select("scope_key", "source", c("target").alias("node"), "km", leg("source", "target").alias("legs")))
    front = best
    for _ in range(most_rounds):
        step = front.join(hops, ["scope_key", "node"]).select("scope_key", "source", c("v").alias("node"), (c("km") + c("hop_km")).alias("km"), F.concat("legs", "hop").alias("legs"))
        step = step.groupBy("scope_key", "source", "node").agg(F.min(F.struct("km", "legs")).alias("m")).select("scope_key", "source", "node", "m.*")
        old = best.select("scope_key", "source", "node", c("km").alias("_old"))
        front = cut(step.join(old, ["scope_key", "source", "node"], "left").where(c("_old").isNull() | (c("km") < c("_old"))).drop("_old"))
        if front.isEmpty():
            break
        best = cut(best.unionByName(front).groupBy("scope_key", "source", "node").agg(F.min(F.struct("km", "legs")).alias("m")).select("scope_key", "source", "node", "m.*"))
    else:
        raise RuntimeError(f"paths over parts did not settle in {most_rounds} rounds")

    last = to_gate.select("scope_key", c("source").alias("target"), c("target").alias("node"), c("km").alias("last_km"))
    ways = asked.join(last, ["scope_key", "target"]).join(best, ["scope_key", "source", "node"])
    ways = ways.select("scope_key", "source", "target", (c("km") + c("last_km")).alias("km"), F.concat("legs", leg("node", "target")).alias("legs"))
    straight = direct.join(legs, ["scope_key", "part", "source", "target"]).select("scope_key", "source", "target", "km", leg("source", "target").alias("legs"))
    ways = cut(ways.unionByName(straight).groupBy("scope_key", "source", "target").agg(F.min(F.struct("km", "legs")).alias("m")).select("scope_key", "source", "target", "m.*"))

    steps = ways.select("scope_key", "source", "target", "km", F.posexplode("legs").alias("pos", "leg")).select("scope_key", "source", "target", "km", "pos", "leg.*")
    within = at(steps.where("edge is null").select("scope_key", c("a").alias("source"), c("b").alias("target")).distinct(), "source", "part")
    lines = _in_parts(inner, within.withColumn("gate", F.lit(False)), True).select("scope_key", c("source").alias("a"), c("target").alias("b"), "edge_ids", "nodes")
    told = steps.where("edge is null").join(lines, ["scope_key", "a", "b"]).select("scope_key", "source", "target", "km", "pos", "edge_ids", "nodes")
    told = told.unionByName(steps.where("edge is not null").select("scope_key", "source", "target", "km", "pos", F.array("edge").alias("edge_ids"), F.array("a", "b").alias("nodes")))
    joined = told.groupBy("scope_key", "source", "target").agg(F.first("km").alias("length_km"), F.array_sort(F.collect_list(F.struct("pos", "edge_ids", "nodes"))).alias("s"))
    onward = F.flatten(F.transform("s", lambda x, i: F.when(i == 0, x["nodes"]).otherwise(F.slice(x["nodes"], F.lit(2), F.size(x["nodes"])))))
    return joined.select("scope_key", "source", "target", "length_km", F.flatten(F.transform("s", lambda x: x["edge_ids"])).alias("edge_ids"), onward.alias("nodes")).unionByName(alike)
