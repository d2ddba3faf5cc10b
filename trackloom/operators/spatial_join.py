"""Range and nearest-neighbour joins on cell keys.

Points and segments meet by equi-joins on grid cells, so the work follows the number of
neighbours, not the product of the sides, and Catalyst may shuffle, broadcast or split skewed
cells as it sees fit. Nothing here broadcasts by hint.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions import geo
from trackloom.operators.lineage import cut

KM_PER_DEGREE = 111.0
HIGHEST_LATITUDE = 80.0
HALF_GLOBE_KM = 20_100.0
#: For rows that explode made: Spark takes them for as few as those before, and would collect them all on the driver.
NO_BROADCAST = "merge"


def cell(c: Column | str, size: float) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / size).cast("int")


def cell_sizes(radius_km: float, max_lat: float = HIGHEST_LATITUDE) -> tuple[float, float]:
    """Cell width and height in degrees that a radius never exceeds up to a latitude."""
    high = radius_km / KM_PER_DEGREE * 1.01
    return high / math.cos(math.radians(max_lat)), high


class Bands:
    """Cells of a sphere: bands of latitude as high as a radius, each cut in as many columns, around
    the whole circle, as the radius allows there; one column where it spans a pole."""

    def __init__(self, radius_km: float):
        self.angle = math.radians(radius_km / KM_PER_DEGREE * 1.01)
        self.height = math.degrees(self.angle)

    def band(self, lat: Column) -> Column:
        return F.floor(lat / self.height).cast("int")

    def columns(self, band: Column) -> Column:
        """How many columns a band has: points within the radius of one of its points are in the same or the next column."""
        far = F.greatest(F.abs(band * self.height), F.abs((band + 1) * self.height)) + self.height
        narrow = F.sin(F.lit(min(self.angle, math.pi) / 2)) / F.cos(F.radians(F.least(far, F.lit(89.999999))))
        n = F.floor(F.lit(math.pi) / F.asin(F.least(narrow * 1.01, F.lit(1.0)))).cast("int")
        return F.when((far >= 90) | (narrow >= 0.5) | (n < 3), F.lit(1)).otherwise(n)

    @staticmethod
    def column(lon: Column, n: Column) -> Column:
        return F.pmod(F.floor((lon + 180) / 360 * n).cast("int"), n)

    def key(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        y = self.band(lat)
        return self.column(lon, self.columns(y)), y

    def around(self, lon: Column, lat: Column) -> Column:
        """The cells in which points within the radius can be, each once."""

        def row(d: int) -> Column:
            y = self.band(lat) + d
            n = self.columns(y)
            x = self.column(lon, n)
            return F.transform(F.array_distinct(F.array(x, F.pmod(x + 1, n), F.pmod(x + n - 1, n))), lambda c: F.struct(c.alias("cx"), y.alias("cy")))

        return F.concat(row(-1), row(0), row(1))


def range_join(left: DataFrame, right: DataFrame, radius_km: float, by: list[str] | None = None, on: Column | None = None) -> DataFrame:
    """Pairs of points within a radius, with ``distance_km`` (JON1, JON4, JON18, JON21).

    Both sides have lon and lat, anywhere on the globe: cells close over the date line and the
    poles. The right side's columns are prefixed with ``r_``. ``by`` names equality keys of both
    sides.
    """
    bands, by = Bands(radius_km), by or []
    x, y = bands.key(F.col("lon"), F.col("lat"))
    a = left.withColumn("_cx", x).withColumn("_cy", y)
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    b = b.withColumn("_cell", F.explode(bands.around(F.col("r_lon"), F.col("r_lat")))).withColumn("_bx", F.col("_cell.cx")).withColumn("_by", F.col("_cell.cy")).drop("_cell")
    cond = (F.col("_cx") == F.col("_bx")) & (F.col("_cy") == F.col("_by"))
    for k in by:
        cond &= F.col(k) == F.col(f"r_{k}")
    if on is not None:
        cond &= on
    out = a.join(b, cond).withColumn("distance_km", geo.haversine_km("lon", "lat", "r_lon", "r_lat"))
    return out.where(F.col("distance_km") <= radius_km).drop("_cx", "_cy", "_bx", "_by")


def explode_segments(lines: DataFrame, coords: str = "coords") -> DataFrame:
    """A row for each segment of each line: ax, ay, bx, by (SRC lines to range joins)."""
    keep = [c for c in lines.columns if c != coords]
    return lines.select(*keep, F.explode(geo.segments(F.col(coords))).alias("s")).select(*keep, F.col("s.a.lon").alias("ax"), F.col("s.a.lat").alias("ay"), F.col("s.b.lon").alias("bx"), F.col("s.b.lat").alias("by"))


def highest_latitude(points: DataFrame, radius_km: float) -> float:
    """How far from the equator points lie, and what is within a radius of them."""
    found = points.agg(F.max(F.abs("lat")).alias("m")).first().m
    return HIGHEST_LATITUDE if found is None else min(89.0, float(found) + radius_km / KM_PER_DEGREE * 1.01)


class Grid:
    """Cells at least as large as a radius, up to a latitude, and which of them a segment is to be met in."""

    def __init__(self, radius_km: float, max_lat: float, least_cell: float = 0.05):
        self.pad_x, self.pad_y = cell_sizes(radius_km, max_lat)
        self.width, self.height = max(self.pad_x, least_cell), max(self.pad_y, least_cell)

    @staticmethod
    def _key(x: Column, y: Column) -> Column:
        return x.cast("long") * F.lit(1 << 32) + y

    def of(self, lon: str, lat: str) -> Column:
        return self._key(cell(lon, self.width), cell(lat, self.height))

    def spread(self, segments: DataFrame) -> DataFrame:
        """Segments with each ``_cell`` around them: cut in pieces no longer than a cell, so rows follow lengths."""
        n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("bx") - F.col("ax")) / self.width, F.abs(F.col("by") - F.col("ay")) / self.height)).cast("int"))

        def cells(i: Column) -> Column:
            at = lambda a, b, k: F.col(a) + (F.col(b) - F.col(a)) * k / n
            x0, x1, y0, y1 = at("ax", "bx", i), at("ax", "bx", i + 1), at("ay", "by", i), at("ay", "by", i + 1)
            xs = F.sequence(cell(F.least(x0, x1) - self.pad_x, self.width), cell(F.greatest(x0, x1) + self.pad_x, self.width))
            ys = F.sequence(cell(F.least(y0, y1) - self.pad_y, self.height), cell(F.greatest(y0, y1) + self.pad_y, self.height))
            return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: self._key(x, y))))

        # Each segment becomes many rows: they are dealt before that, however few tasks they come in.
        dealt = segments.repartition(segments.sparkSession.sparkContext.defaultParallelism)
        return dealt.withColumn("_cell", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), cells)))))


def segment_range_join(points: DataFrame, segments: DataFrame, radius_km: float, max_lat: float | None = None, least_cell: float = 0.05) -> DataFrame:
    """Points with each segment within a radius, and ``distance_km`` to it.

    A segment takes part in the cells around each of its pieces, so its rows follow its length.
    Cells are as large as the radius, at least. Distances are planar around the point, so a segment
    over the date line is to come cut there. ``max_lat`` bounds the latitudes; they are looked up
    where it is not given.
    """
    grid = Grid(radius_km, highest_latitude(points, radius_km) if max_lat is None else max_lat, least_cell)
    keyed = points.withColumn("_at", grid.of("lon", "lat"))
    out = keyed.join(grid.spread(segments).hint(NO_BROADCAST), F.col("_at") == F.col("_cell"))
    out = out.withColumn("distance_km", geo.segment_distance_km("lon", "lat", "ax", "ay", "bx", "by"))
    return out.where(F.col("distance_km") <= radius_km).drop("_cell", "_at")


CROWD = 16
#: What a row of spread segments costs, in pairs of a place and a segment that are looked at.
SPREAD = 4


def nearest_on_lines(points: DataFrame, segments: DataFrame, by: str, radius_km: float) -> DataFrame:
    """by, id, distance_km: how far each point (id, lon, lat) is from the nearest segment of each
    group ``by``, where that is within a radius.

    Points at one place are looked at once. Where a cell holds many of a group's segments, places
    are looked at in rings that grow to the radius: a place that finds any segment in a small one
    has found its nearest, and only the others go on. So a place meets a few segments of a group,
    however many lie within the radius. Small rings have small cells, in which long segments become
    many rows: rings begin no smaller than saves more pairs than it makes rows.
    """
    c, at = F.col, ["lon", "lat"]
    lat = highest_latitude(points, radius_km)
    grid, own = Grid(radius_km, lat), points.select("id", *at)
    places = cut(own.select(*at).where("lon is not null and lat is not null").distinct())
    cells = cut(grid.spread(segments).groupBy(c(by).alias("_by"), "_cell").agg(F.count("*").alias("_n")))
    here = places.withColumn("_at", grid.of(*at))
    # What a segment's cell holds on average, rows of spread segments, and pairs: three numbers.
    held = cells.agg((F.sum(c("_n") * c("_n")) / F.sum("_n")).alias("crowd"), F.sum("_n").alias("rows")).first()
    found = here.groupBy("_at").agg(F.count("*").alias("_p")).join(cells, c("_at") == c("_cell")).agg(F.sum(c("_p") * c("_n")).alias("pairs")).first()
    crowd, rows, pairs = (float(x or 0) for x in (held.crowd, held.rows, found.pairs))
    r = radius_km
    while crowd * r / radius_km > CROWD and pairs * (r / radius_km) ** 2 > SPREAD * rows and r > radius_km / 64:
        r /= 4
    if r == radius_km:
        near = _least(here.join(grid.spread(segments).hint(NO_BROADCAST), c("_at") == c("_cell")), [by, *at], radius_km)
    else:
        near = _in_rings(here.join(cells, c("_at") == c("_cell")).select("_by", *at), segments, by, r, radius_km, lat)
    return own.join(near, at).groupBy(by, "id").agg(F.min("distance_km").alias("distance_km"))


def _least(met: DataFrame, by: list[str], radius_km: float) -> DataFrame:
    """The least distance of what met, where it is within the radius: asked for afterwards, a distance is worked out once."""
    d = geo.segment_distance_km("lon", "lat", "ax", "ay", "bx", "by")
    return met.groupBy(*by).agg(F.min(d).alias("distance_km")).where(F.col("distance_km") <= radius_km)


def _in_rings(places: DataFrame, segments: DataFrame, by: str, r: float, radius_km: float, lat: float) -> DataFrame:
    """by, lon, lat, distance_km of the nearest segment of each place and group (_by, lon, lat), in rings from r to the radius."""
    c = F.col
    rest, done = cut(places), None
    while True:
        ring = Grid(r, lat)
        spread = ring.spread(segments).hint(NO_BROADCAST)
        met = rest.withColumn("_at", ring.of("lon", "lat")).join(spread, c("_by").eqNullSafe(c(by)) & (c("_at") == c("_cell")))
        found = cut(_least(met, ["_by", "lon", "lat"], r))
        done = found if done is None else done.unionByName(found)
        if r < radius_km:
            old = found.select(c("_by").alias("_b"), c("lon").alias("_x"), c("lat").alias("_y"))
            rest = cut(rest.join(old, c("_by").eqNullSafe(c("_b")) & (c("lon") == c("_x")) & (c("lat") == c("_y")), "left_anti"))
        if r >= radius_km or rest.isEmpty():
            return done.withColumnRenamed("_by", by)
        r = min(4 * r, radius_km)


WIDEST_DEGREES = 1000.0


def nearest_in_group(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, k: int = 1) -> DataFrame:
    """For each left row the k nearest right rows of its key, in planar order, with distance_m (JON2, JON3).

    Rows meet by key and cell, in growing rings: a key's first cells are as wide as its right rows
    lie apart on average, so most left rows meet a few of them and are settled in the first round;
    the others go on with four times the width. Degrees are taken as they are: nothing closes over
    the date line. Columns of the left side, r_<id>, r_lon, r_lat, rank and distance_m; left rows
    without any partner, or without a place, stay.
    """
    c, other = F.col, f"r_{right_id}"
    b = right.select(c(key).alias("_key"), c(right_id).alias(other), c("lon").alias("r_lon"), c("lat").alias("r_lat")).where("r_lon is not null and r_lat is not null")
    span = F.greatest(F.max("r_lon") - F.min("r_lon"), F.max("r_lat") - F.min("r_lat"))
    keys = cut(b.groupBy("_key").agg(F.greatest(span / F.count("*"), F.lit(0.01)).alias("_width"), F.count("*").alias("_n")))
    own = left.join(keys, c(key) == c("_key"), "left").drop("_key")
    placed = c("_n").isNotNull() & c("lon").isNotNull() & c("lat").isNotNull()
    kept = [*left.columns]
    alone = own.where(~placed).select(*kept, *[F.lit(None).cast(b.schema[x].dataType).alias(x) for x in (other, "r_lon", "r_lat")], F.lit(1).alias("rank"))
    rest, done, grown = own.where(placed), alone, 1.0
    steps = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    while True:
        width = c("_width") * grown
        spread = b.join(keys, "_key").withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
        spread = spread.select("_key", other, "r_lon", "r_lat", (F.floor(c("r_lon") / width) + c("_dx")).alias("_bx"), (F.floor(c("r_lat") / width) + c("_dy")).alias("_by"))
        near = rest.withColumn("_cx", F.floor(c("lon") / width)).withColumn("_cy", F.floor(c("lat") / width))
        pairs = near.join(spread, (c(key) == c("_key")) & (c("_cx") == c("_bx")) & (c("_cy") == c("_by"))).withColumn("_d2", geo.planar2("lon", "lat", "r_lon", "r_lat"))
        # A ring that spans all there is takes whatever it meets.
        pairs = pairs.where((c("_d2") <= width * width) | (width >= WIDEST_DEGREES))
        w = W.partitionBy(key, left_id).orderBy("_d2", other)
        ranked = pairs.withColumn("rank", F.row_number().over(w)).where(c("rank") <= k)
        enough = F.count("*").over(W.partitionBy(key, left_id)) >= F.least(F.lit(k), c("_n"))
        settled = cut(ranked.withColumn("_enough", enough).where("_enough").select(*kept, other, "r_lon", "r_lat", "rank"))
        done = done.unionByName(settled)
        rest = cut(rest.join(settled.select(key, left_id).distinct(), [key, left_id], "left_anti").select(*kept, "_width", "_n"))
        if rest.isEmpty():
            return done.withColumn("distance_m", geo.haversine_m("lon", "lat", "r_lon", "r_lat"))
        grown *= 4


def knn_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, k: int, radius_km: float, by: list[str] | None = None) -> DataFrame:
    """For each left point the k nearest right points, all where there are fewer, by growing rings of cells (JON3, GRF19).

    A round joins within a radius and settles the left points that have k partners there; the
    others go on with four times the radius, until it spans the globe. ``radius_km`` is a start
    that suits most points, no bound.
    """
    done, rest, r = None, left, radius_km
    while True:
        last = r >= HALF_GLOBE_KM
        pairs = range_join(rest, right, r, by)
        w = W.partitionBy(left_id).orderBy("distance_km", f"r_{right_id}")
        ranked = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        enough = ranked.groupBy(left_id).agg(F.count("*").alias("_n")).where(F.col("_n") >= k).select(left_id)
        part = ranked if last else ranked.join(enough, left_id, "left_semi")
        done = part if done is None else done.unionByName(part)
        if last:
            return done
        rest = cut(rest.join(enough, left_id, "left_anti"))
        if rest.isEmpty():
            return done
        r = min(4 * r, HALF_GLOBE_KM)


def dedupe_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Each unordered pair once, the smaller member first (JON14's canonical key)."""
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), *[c for c in pairs.columns if c not in (a, b)]).dropDuplicates(["a", "b"])
