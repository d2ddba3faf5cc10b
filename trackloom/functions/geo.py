"""Spatial functions as column expressions on lon/lat doubles and arrays of (lon, lat) structs.

Distances are great-circle ones on a sphere of mean radius unless ``method="spheroid"`` asks
for the Andoyer-Lambert correction. Nearest-neighbour order and closest points are planar in
degrees, as in planar index order; lengths and distances are then given in metres or km.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_KM = 6371.0088
WGS84_A_KM, WGS84_F = 6378.137, 1 / 298.257223563
MERCATOR_RADIUS_M = 6378137.0
POINT = "struct<lon:double,lat:double>"


def _c(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def haversine_km(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle distance (GEO1, GEO4)."""
    lon1, lat1, lon2, lat2 = map(_c, (lon1, lat1, lon2, lat2))
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * RADIUS_KM) * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(1e-12), 1 - h)))


def haversine_m(lon1, lat1, lon2, lat2) -> Column:
    return haversine_km(lon1, lat1, lon2, lat2) * 1000


def spheroid_km(lon1, lat1, lon2, lat2) -> Column:
    """Distance on the WGS84 spheroid by the Andoyer-Lambert formula (GEO2)."""
    lon1, lat1, lon2, lat2 = map(_c, (lon1, lat1, lon2, lat2))
    f, g, l = F.radians(lat1 + lat2) / 2, F.radians(lat1 - lat2) / 2, F.radians(lon1 - lon2) / 2
    sq = lambda x: F.pow(x, 2)
    s = sq(F.sin(g)) * sq(F.cos(l)) + sq(F.cos(f)) * sq(F.sin(l))
    c = sq(F.cos(g)) * sq(F.cos(l)) + sq(F.sin(f)) * sq(F.sin(l))
    w = F.atan2(F.sqrt(s), F.sqrt(c))
    r = F.sqrt(s * c) / w
    d = 2 * w * WGS84_A_KM
    h1, h2 = (3 * r - 1) / (2 * c), (3 * r + 1) / (2 * s)
    return F.when(s <= 1e-18, F.lit(0.0)).otherwise(d * (1 + WGS84_F * h1 * sq(F.sin(f)) * sq(F.cos(g)) - WGS84_F * h2 * sq(F.cos(f)) * sq(F.sin(g))))


def distance_km(lon1, lat1, lon2, lat2, method: str = "sphere") -> Column:
    return (spheroid_km if method == "spheroid" else haversine_km)(lon1, lat1, lon2, lat2)


def planar2(lon1, lat1, lon2, lat2) -> Column:
    """Squared distance in degrees: the order of nearest neighbours."""
    lon1, lat1, lon2, lat2 = map(_c, (lon1, lat1, lon2, lat2))
    return F.pow(lon1 - lon2, 2) + F.pow(lat1 - lat2, 2)


def metres_to_degrees(m, per_degree: float = 111_320.0) -> Column:
    """Metres as degrees of latitude (NUM23)."""
    return _c(m) / per_degree


def point(lon, lat) -> Column:
    return F.struct(_c(lon).cast("double").alias("lon"), _c(lat).cast("double").alias("lat"))


def valid_point(lon, lat) -> Column:
    """GEO16 for points."""
    lon, lat = _c(lon), _c(lat)
    return F.coalesce(lon.between(-180, 180) & lat.between(-90, 90) & ~F.isnan(lon) & ~F.isnan(lat), F.lit(False))


def on_surface(lon, lat) -> Column:
    """GEO17: a point stands for itself."""
    return point(lon, lat)


def valid_line(coords: Column | str) -> Column:
    """At least two points of which two differ (GEO16)."""
    return F.coalesce(F.size(F.array_distinct(_c(coords))) >= 2, F.lit(False))


def start_point(coords) -> Column:
    return F.try_element_at(_c(coords), F.lit(1))


def end_point(coords) -> Column:
    return F.try_element_at(_c(coords), F.lit(-1))


def in_box(lon, lat, box: tuple[float, float, float, float]) -> Column:
    """Point against (min lon, min lat, max lon, max lat) (GEO13)."""
    return _c(lon).between(box[0], box[2]) & _c(lat).between(box[1], box[3])


def expand_box(box: tuple[float, float, float, float], degrees: float) -> tuple[float, float, float, float]:
    return box[0] - degrees, box[1] - degrees, box[2] + degrees, box[3] + degrees


def segments(coords) -> Column:
    """Neighbouring points of a line as array<struct<a, b>>."""
    c = _c(coords)
    n = F.greatest(F.size(c) - 1, F.lit(0))
    return F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def length_km(coords, method: str = "sphere") -> Column:
    """GEO5."""
    return F.aggregate(segments(coords), F.lit(0.0), lambda s, x: s + distance_km(x["a"]["lon"], x["a"]["lat"], x["b"]["lon"], x["b"]["lat"], method))


def _mercator(p: Column) -> tuple[Column, Column]:
    return F.radians(p["lon"]) * MERCATOR_RADIUS_M, F.log(F.tan(F.lit(math.pi / 4) + F.radians(p["lat"]) / 2)) * MERCATOR_RADIUS_M


def mercator_length_m(coords) -> Column:
    """GEO6."""

    def step(s: Column, x: Column) -> Column:
        (x1, y1), (x2, y2) = _mercator(x["a"]), _mercator(x["b"])
        return s + F.sqrt(F.pow(x2 - x1, 2) + F.pow(y2 - y1, 2))

    return F.aggregate(segments(coords), F.lit(0.0), step)


def foot(px: Column, py: Column, a: Column, b: Column) -> Column:
    """Planar nearest point of a segment, its place t on it and the squared distance."""
    dx, dy = b["lon"] - a["lon"], b["lat"] - a["lat"]
    n = dx * dx + dy * dy
    t = F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - a["lon"]) * dx + (py - a["lat"]) * dy) / F.nullif(n, F.lit(0.0)))))
    x, y = a["lon"] + t * dx, a["lat"] + t * dy
    return F.struct((F.pow(px - x, 2) + F.pow(py - y, 2)).alias("d2"), x.alias("lon"), y.alias("lat"), t.alias("t"))


def closest_point(lon, lat, coords) -> Column:
    """GEO7: the planar nearest point of a line, as struct<lon, lat>."""
    px, py = _c(lon), _c(lat)
    best = F.array_min(F.transform(segments(coords), lambda s: foot(px, py, s["a"], s["b"])))
    return F.struct(best["lon"].alias("lon"), best["lat"].alias("lat"))


def segment_distance_km(lon, lat, ax, ay, bx, by) -> Column:
    """Point to segment, the foot taken in a frame scaled by the cosine of the point's latitude."""
    lon, lat, ax, ay, bx, by = map(_c, (lon, lat, ax, ay, bx, by))
    k = F.cos(F.radians(lat))
    dx, dy = bx - ax, by - ay
    # Factor by factor as in SQL: on collinear segments feet differ by their last bits only, which then decide who is nearer.
    n = dx * k * dx * k + dy * dy
    t = F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((lon - ax) * k * dx * k + (lat - ay) * dy) / F.nullif(n, F.lit(0.0)))))
    return haversine_km(lon, lat, ax + t * (bx - ax), ay + t * (by - ay))


def _once(value: Column, f) -> Column:
    """f of a value that is worked out once a row, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def locate(lon, lat, coords) -> Column:
    """The closest point's share of the line's planar length (GEO8)."""
    px, py = _c(lon), _c(lat)
    planar = lambda s: F.sqrt(F.pow(s["b"]["lon"] - s["a"]["lon"], 2) + F.pow(s["b"]["lat"] - s["a"]["lat"], 2))
    near = lambda s, i: _once(foot(px, py, s["a"], s["b"]), lambda f: F.struct(f["d2"].alias("d2"), i.alias("i"), f["t"].alias("t")))
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)

    def share(x: Column) -> Column:
        lens, best, total = x["lens"], x["best"], x["total"]
        before = add(F.slice(lens, F.lit(1), best["i"]))
        return F.when(total == 0, F.lit(0.0)).otherwise((before + best["t"] * F.element_at(lens, best["i"] + 1)) / F.nullif(total, F.lit(0.0)))

    of = lambda seg: _once(F.transform(seg, planar), lambda lens: _once(F.struct(lens.alias("lens"), F.array_min(F.transform(seg, near)).alias("best"), add(lens).alias("total")), share))
    return _once(segments(coords), of)


def substring(coords, lo, hi) -> Column:
    """The part of a line between two shares of its planar length, ends interpolated (GEO8)."""
    c, lo, hi = _c(coords), _c(lo), _c(hi)
    seg = segments(c)
    planar = lambda s: F.sqrt(F.pow(s["b"]["lon"] - s["a"]["lon"], 2) + F.pow(s["b"]["lat"] - s["a"]["lat"], 2))
    marks = F.aggregate(
        seg,
        F.struct(F.lit(0.0).alias("at"), F.array().cast("array<struct<from:double,to:double,ax:double,ay:double,bx:double,by:double>>").alias("out")),
        lambda acc, s: F.struct(
            (acc["at"] + planar(s)).alias("at"),
            F.concat(
                acc["out"],
                F.array(
                    F.struct(
                        acc["at"].alias("from"), (acc["at"] + planar(s)).alias("to"), s["a"]["lon"].alias("ax"), s["a"]["lat"].alias("ay"), s["b"]["lon"].alias("bx"), s["b"]["lat"].alias("by")
                    )
                ),
            ).alias("out"),
        ),
    )

    def at(share: Column, m: Column) -> Column:
        t = (share - m["from"]) / F.nullif(m["to"] - m["from"], F.lit(0.0))
        t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)), F.lit(0.0))
        return _once(t, lambda t: F.struct((m["ax"] + t * (m["bx"] - m["ax"])).alias("lon"), (m["ay"] + t * (m["by"] - m["ay"])).alias("lat")))

    def part(x: Column) -> Column:
        inside = F.filter(x["out"], lambda m: (m["to"] >= x["lo"]) & (m["from"] <= x["hi"]))
        return F.array_distinct(F.flatten(F.transform(inside, lambda m: F.array(at(x["lo"], m), at(x["hi"], m)))))

    return _once(marks, lambda k: _once(F.struct(k["out"].alias("out"), (lo * k["at"]).alias("lo"), (hi * k["at"]).alias("hi")), part))


def reverse(coords) -> Column:
    return F.reverse(_c(coords))


def in_ring(lon, lat, ring) -> Column:
    """Point in a closed ring by ray casting; the boundary counts as inside (GEO14)."""
    return in_segments(lon, lat, segments(ring))


def in_segments(lon, lat, parts) -> Column:
    """The same by a ring's segments, of which those that reach the point's latitude are enough."""
    px, py = _c(lon), _c(lat)

    def crosses(s: Column) -> Column:
        a, b = s["a"], s["b"]
        return ((a["lat"] > py) != (b["lat"] > py)) & (px < (b["lon"] - a["lon"]) * (py - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) + a["lon"])

    hits = F.aggregate(parts, F.lit(0), lambda n, s: n + F.coalesce(crosses(s), F.lit(False)).cast("int"))
    on = F.exists(parts, lambda s: foot(px, py, s["a"], s["b"])["d2"] <= 1e-24)
    return (hits % 2 == 1) | on


def segments_meet(s: Column, r: Column) -> Column:
    """Two segments cross or touch: each one's ends are not on one side of the other, and their boxes overlap."""

    def side(a: Column, b: Column, p: Column) -> Column:
        return F.signum((b["lon"] - a["lon"]) * (p["lat"] - a["lat"]) - (b["lat"] - a["lat"]) * (p["lon"] - a["lon"]))

    def overlap(axis: str) -> Column:
        low, high = (lambda x: F.least(x["a"][axis], x["b"][axis])), (lambda x: F.greatest(x["a"][axis], x["b"][axis]))
        return (low(s) <= high(r)) & (low(r) <= high(s))

    apart = (side(r["a"], r["b"], s["a"]) * side(r["a"], r["b"], s["b"]) > 0) | (side(s["a"], s["b"], r["a"]) * side(s["a"], s["b"], r["b"]) > 0)
    return overlap("lon") & overlap("lat") & ~apart


def line_meets_ring(coords, ring) -> Column:
    """A line touches a polygon: its first point is inside, or a segment meets the ring."""
    first = F.try_element_at(_c(coords), F.lit(1))
    return F.coalesce(in_ring(first["lon"], first["lat"], ring), F.lit(False)) | F.exists(segments(coords), lambda s: F.exists(segments(ring), lambda r: segments_meet(s, r)))


def share_inside(coords, box: tuple[Column, Column, Column, Column]) -> Column:
    """The share of a line's Mercator length inside a rectangle, by clipping each segment (GEO15)."""
    west, south, east, north = box

    def part(s: Column) -> Column:
        a, b = s["a"], s["b"]
        dx, dy = b["lon"] - a["lon"], b["lat"] - a["lat"]
        lo, hi = F.lit(0.0), F.lit(1.0)
        for d, at, least, most in ((dx, a["lon"], west, east), (dy, a["lat"], south, north)):
            t1, t2 = (least - at) / F.nullif(d, F.lit(0.0)), (most - at) / F.nullif(d, F.lit(0.0))
            outside = (d == 0) & ((at < least) | (at > most))
            lo = F.when(outside, F.lit(2.0)).otherwise(F.greatest(lo, F.coalesce(F.least(t1, t2), F.lit(0.0))))
            hi = F.least(hi, F.coalesce(F.greatest(t1, t2), F.lit(1.0)))
        (x1, y1), (x2, y2) = _mercator(a), _mercator(b)
        return F.greatest(F.lit(0.0), hi - lo) * F.sqrt(F.pow(x2 - x1, 2) + F.pow(y2 - y1, 2))

    return F.try_divide(F.aggregate(F.transform(segments(coords), part), F.lit(0.0), lambda s, x: s + x), mercator_length_m(coords))


def centroid(coords) -> Column:
    """Of a closed ring of at least four points by area, else of the line by length (GEO20)."""
    c = _c(coords)
    closed = (F.size(c) >= 4) & (F.element_at(c, 1) == F.element_at(c, -1))
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def by_area(acc: Column, s: Column) -> Column:
        a, b = s["a"], s["b"]
        k = a["lon"] * b["lat"] - b["lon"] * a["lat"]
        return F.struct((acc["w"] + k).alias("w"), (acc["x"] + (a["lon"] + b["lon"]) * k / 3).alias("x"), (acc["y"] + (a["lat"] + b["lat"]) * k / 3).alias("y"))

    def by_length(acc: Column, s: Column) -> Column:
        a, b = s["a"], s["b"]
        k = F.sqrt(F.pow(b["lon"] - a["lon"], 2) + F.pow(b["lat"] - a["lat"], 2))
        return F.struct((acc["w"] + k).alias("w"), (acc["x"] + (a["lon"] + b["lon"]) / 2 * k).alias("x"), (acc["y"] + (a["lat"] + b["lat"]) / 2 * k).alias("y"))

    line = lambda: F.aggregate(segments(c), zero, by_length)
    either = _once(F.aggregate(segments(c), zero, by_area), lambda area: F.when(F.abs(area["w"]) > 1e-15, area).otherwise(line()))
    use = F.when(F.coalesce(closed, F.lit(False)), either).otherwise(line())
    return _once(use, lambda u: F.when((F.size(c) >= 2) & (u["w"] != 0), F.struct((u["x"] / u["w"]).alias("lon"), (u["y"] / u["w"]).alias("lat"))))


# Geometry text (GEO18)


def to_geojson_point(lon, lat) -> Column:
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.array(_c(lon), _c(lat)).alias("coordinates")))


def to_geojson_line(coords) -> Column:
    return F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform(_c(coords), lambda p: F.array(p["lon"], p["lat"])).alias("coordinates")))


def line_from_geojson(text) -> Column:
    """Points of a LineString, or of a MultiLineString's parts in turn; null for anything else (ARR5)."""
    one = F.from_json(_c(text), "type string, coordinates array<array<double>>")
    many = F.from_json(_c(text), "type string, coordinates array<array<array<double>>>")
    pick = lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))
    return F.when(one["type"] == "LineString", F.transform(one["coordinates"], pick)).when(many["type"] == "MultiLineString", F.transform(F.flatten(many["coordinates"]), pick))


def to_wkt_point(lon, lat) -> Column:
    return F.concat(F.lit("POINT("), _c(lon).cast("string"), F.lit(" "), _c(lat).cast("string"), F.lit(")"))


def node_hash(lon, lat) -> Column:
    """md5 of "x,y" with six decimals (STR21)."""
    six = lambda x: F.round(_c(x).cast("decimal(18,12)"), 6).cast("decimal(18,6)").cast("string")
    return F.md5(F.concat_ws(",", six(lon), six(lat)))


def segment_hash(coords) -> Column:
    """md5 of a line's points in order: a reversed copy hashes differently (STR22)."""
    return F.md5(F.concat_ws(";", F.transform(_c(coords), lambda p: F.concat_ws(",", p["lon"].cast("string"), p["lat"].cast("string")))))
