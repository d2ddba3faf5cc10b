"""Lists, searches, summaries and zone queries over the core tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions import geo, scoring
from trackloom.operators.ingest import latest

Box = tuple[float, float, float, float]


def parse_box(value: str | None) -> Box | None:
    """FLT4: "min lon,min lat,max lon,max lat"; anything else is an error."""
    if not value:
        return None
    try:
        a, b, c, d = (float(x) for x in value.split(","))
    except ValueError as e:
        raise ValueError("a box has four numbers") from e
    if not (-180 <= a < c <= 180 and -90 <= b < d <= 90):
        raise ValueError("a box has its least corner first, within the world")
    return a, b, c, d


def regions_of(region: str | None, several: str | None) -> list[str]:
    """FLT6: a list wins over a single code."""
    given = several.split(",") if several else [region or ""]
    return list(dict.fromkeys(x.strip() for x in given if x.strip()))


def in_regions(codes: list[str]) -> Column:
    return F.col("region_code").isin(codes) if codes else F.lit(True)


def stations(table: DataFrame, region: str | None = None, regions: str | None = None, box: str | None = None, hidden: bool = False, limit: int = 20_000) -> DataFrame:
    """FLT1, FLT5."""
    out = table.where(in_regions(regions_of(region, regions)))
    if not hidden:
        out = out.where("is_visible_default")
    if (b := parse_box(box)) is not None:
        out = out.where(geo.in_box("lon", "lat", b))
    return out.orderBy(F.col("name").asc_nulls_last(), "id").limit(limit)


def lines(table: DataFrame, region: str | None = None, regions: str | None = None, box: str | None = None, service: bool = False, limit: int = 100_000) -> DataFrame:
    """FLT2: with ``service``, visible or service lines; a box keeps lines with a part in it."""
    shown = F.col("is_visible_default") | F.col("is_service_line") if service else F.col("is_visible_default")
    out = table.where(in_regions(regions_of(region, regions)) & shown)
    if (b := parse_box(box)) is not None:
        out = out.where(F.coalesce(geo.share_inside(F.col("coords"), tuple(F.lit(float(x)) for x in b)) > 0, F.lit(False)) | F.exists("coords", lambda p: geo.in_box(p["lon"], p["lat"], b)))
    return out.orderBy(F.col("name").asc_nulls_last(), "id").limit(limit)


def search(table: DataFrame, q: str, regions: str | None = None, limit: int = 20) -> DataFrame:
    """FLT3: % and _ in the question keep their meaning."""
    hit = F.col("is_visible_default") & F.col("name").ilike(f"%{q}%") & in_regions(regions_of(None, regions))
    return table.where(hit).orderBy(F.desc("is_main_rail_station"), F.col("name").asc_nulls_last(), "id").limit(limit)


def by_id(table: DataFrame, station_id: int, hidden: bool = False) -> DataFrame:
    """FLT7."""
    out = table.where(F.col("id") == station_id)
    return out if hidden else out.where("is_visible_default")


def region_summary(registry: DataFrame, stations: DataFrame, lines: DataFrame) -> DataFrame:
    """AGG3: visible stations and lines of every registered region, in its order."""
    s = stations.where("is_visible_default").groupBy("region_code").agg(F.count("*").alias("stations"))
    n = lines.where("is_visible_default").groupBy("region_code").agg(F.count("*").alias("lines"))
    return registry.join(s, "region_code", "left").join(n, "region_code", "left").fillna(0, ["stations", "lines"]).orderBy("position")


def routes(table: DataFrame, stops: DataFrame, q: str | None = None, active: bool = True, limit: int = 200) -> DataFrame:
    """FLT25, JON8, AGG4: routes with stop, matched and unmatched counts."""
    out = table.where("is_active") if active else table
    if q:
        out = out.where(_any([F.col(c).ilike(f"%{q}%") for c in ("train_number", "route_name", "origin_name", "destination_name")]))
    n = stops.groupBy(F.col("route_id").alias("id")).agg(F.count("*").alias("stops_count"), F.count("station_id").alias("matched_count"))
    out = out.join(n, "id", "left").fillna(0, ["stops_count", "matched_count"])
    return out.withColumn("unmatched_count", F.greatest(F.lit(0), F.col("stops_count") - F.col("matched_count"))).orderBy("id").limit(limit)


def _any(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return F.coalesce(out, F.lit(False))


def route_lines(stops: DataFrame, stations: DataFrame) -> DataFrame:
    """JON10, ARR7: each route's stations in order as a line; fewer than two points give none."""
    at = stops.join(stations.select(F.col("id").alias("station_id"), "lon", "lat"), "station_id")
    seq = F.array_sort(F.collect_list(F.struct("stop_sequence", "lon", "lat")))
    out = at.groupBy("route_id").agg(F.transform(seq, lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat"))).alias("coords"))
    return out.where(F.size("coords") >= 2)


def stop_matches(stops: DataFrame, stations: DataFrame) -> DataFrame:
    """JON9."""
    return stops.join(stations.select(F.col("id").alias("station_id"), F.col("name").alias("station_name"), F.col("region_code").alias("station_region")), "station_id", "left")


def stop_pairs(stops: DataFrame) -> DataFrame:
    """WIN6: each stop with the one before it on its route."""
    w = W.partitionBy("route_id").orderBy("stop_sequence")
    return stops.withColumn("previous_station", F.lag("station_id").over(w)).withColumn("previous_km", F.lag("distance_km").over(w)) if "distance_km" in stops.columns else stops.withColumn("previous_station", F.lag("station_id").over(w))


def endpoints(stops: DataFrame) -> DataFrame:
    """WIN7: the first and the last matched stop of each route."""
    return stops.where("station_id is not null").groupBy("route_id").agg(F.min_by("station_id", "stop_sequence").alias("first_station"), F.max_by("station_id", "stop_sequence").alias("last_station"))


def resequenced(stops: DataFrame) -> DataFrame:
    """WIN8."""
    return stops.withColumn("stop_sequence", F.row_number().over(W.partitionBy("route_id").orderBy("stop_sequence")))


def routes_of_station(stops: DataFrame, station_id: int, codes: list[str]) -> DataFrame:
    """JON11: stops by station or by code, as two equi-filters united, each stop once."""
    by_station = stops.where(F.col("station_id") == station_id)
    by_code = stops.where(F.col("station_code").isin(codes)) if codes else stops.limit(0)
    return by_station.unionByName(by_code).dropDuplicates(["route_id", "stop_sequence"])


def profile(stations: DataFrame, links: DataFrame) -> DataFrame:
    """NUM5, JON13: what a station offers for a timetable search."""
    linked = links.select(F.col("station_id").alias("id")).distinct().withColumn("_l", F.lit(True))
    s = stations.join(linked, "id", "left").withColumn("has_graph_link", F.coalesce("_l", F.lit(False))).drop("_l")
    score = scoring.profile_score(F.col("is_main_rail_station"), F.col("esr_user"), F.col("uic_ref"), F.col("has_graph_link"), F.col("is_visible_default"))
    return s.withColumn("search_score", score).withColumn(
        "recommended", scoring.recommended(F.col("is_main_rail_station"), F.col("esr_user"), F.col("uic_ref"), F.col("is_visible_default"))
    ).withColumn("code_candidates", scoring.code_candidates(F.col("esr_user"), F.col("uic_ref")))


def nearby(stations: DataFrame, links: DataFrame, lon: float, lat: float, radius_m: float, limit: int = 10) -> DataFrame:
    """TOP3, NUM6, GEO3: stations around a point, by priority."""
    pad = radius_m / 111_000 * 1.02
    width = pad / max(0.05, math.cos(math.radians(lat)))
    near = stations.where(geo.in_box("lon", "lat", (lon - width, lat - pad, lon + width, lat + pad)))
    near = near.withColumn("distance_m", geo.haversine_m("lon", "lat", lon, lat)).where(F.col("distance_m") <= radius_m)
    out = profile(near, links).withColumn("priority", scoring.nearby_priority(F.col("search_score"), F.col("distance_m")))
    return out.orderBy(F.desc("priority"), F.desc("is_main_rail_station"), "distance_m", F.col("name").asc_nulls_last(), "id").limit(limit)


def nearby_main(stations: DataFrame, lon: float, lat: float, radius_km: float, besides: int | None = None, limit: int = 4) -> DataFrame:
    """TOP5, JON17: visible main or coded stations around a point, but one; the point is literals, no join."""
    pad = radius_km / 111.0 * 1.02
    width = pad / max(0.05, abs(math.cos(math.radians(lat))))
    out = stations.where(geo.in_box("lon", "lat", (lon - width, lat - pad, lon + width, lat + pad))).where("is_visible_default and (is_main_rail_station or uic_ref is not null)")
    if besides is not None:
        out = out.where(F.col("id") != besides)
    out = out.withColumn("distance_km", geo.haversine_km("lon", "lat", lon, lat)).where(F.col("distance_km") <= radius_km)
    return out.orderBy(F.desc("is_main_rail_station"), ~scoring.present(F.col("uic_ref")), "distance_km", F.col("name").asc_nulls_last(), "id").limit(limit)


def zone_candidates(stations: DataFrame, stops: DataFrame, station_id: int, radius_km: float, limit: int = 12) -> DataFrame:
    """JON20, AGG24, TOP4: stations around one, with the number of routes that stop there."""
    from trackloom.operators.spatial_join import range_join

    here = stations.where(F.col("id") == station_id).select("id", "lon", "lat")
    near = range_join(stations, here, radius_km)
    n = stops.where("station_id is not null").groupBy(F.col("station_id").alias("id")).agg(F.countDistinct("route_id").alias("routes_count"))
    out = near.join(n, "id", "left").fillna(0, ["routes_count"])
    return out.orderBy((F.col("id") != station_id), F.desc("is_main_rail_station"), F.desc("routes_count"), "distance_km", F.col("name").asc_nulls_last(), "id").limit(limit)


def zone_routes(zone: DataFrame, stops: DataFrame, limit: int = 200) -> DataFrame:
    """JON19, WIN4: routes that stop in a zone, each with its nearest stop and the number of hits before that choice."""
    hits = stops.join(zone.select(F.col("id").alias("station_id"), F.col("distance_km").alias("zone_km")), "station_id")
    hits = hits.withColumn("route_hits", F.count("*").over(W.partitionBy("route_id")))
    return latest(hits, ["route_id"], [F.col("zone_km"), F.col("stop_sequence")]).orderBy("zone_km", "route_id").limit(limit)


def code_pairs(starts: DataFrame, ends: DataFrame, limit: int = 100) -> DataFrame:
    """JON24: pairs of codes to try, exact ones first; both sides are the few codes of two stations."""
    pairs = starts.select(F.col("code").alias("from_code"), F.col("priority").alias("p")).crossJoin(ends.select(F.col("code").alias("to_code"), F.col("priority").alias("q")))
    pairs = pairs.where("from_code <> to_code").groupBy("from_code", "to_code").agg(F.min(F.col("p") + F.col("q")).alias("priority"))
    return pairs.orderBy("priority", "from_code", "to_code").limit(limit)


def calendar(first: str, last: str, spark) -> DataFrame:
    """DAT3: the days of a range of one to thirty days."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    n = days.count()
    if not 1 <= n <= 30:
        raise ValueError("a calendar search covers 1 to 30 days")
    return days


def recommended_codes(scored: DataFrame) -> DataFrame:
    """TOP13: of each station's scored codes the first by score, priority, source and code.

    scored: station_id, code, source, base_priority, final_score.
    """
    order = [F.desc_nulls_last("final_score"), F.coalesce(F.nullif("base_priority", F.lit(0)), F.lit(999)), F.coalesce("source", F.lit("")), F.coalesce("code", F.lit(""))]
    return latest(scored, ["station_id"], order)


def calendar_status(days: DataFrame, trains: DataFrame, errors: DataFrame) -> DataFrame:
    """DAT3: each day's trains or failure; a day that failed leaves the others as they are.

    trains: as ``merge_trains`` takes them; errors: day, error.
    """
    n = merge_trains(trains).groupBy("day").agg(F.count("*").alias("trains"))
    bad = errors.groupBy("day").agg(F.min("error").alias("error"))
    out = days.join(n, "day", "left").join(bad, "day", "left")
    status = F.when(F.col("error").isNotNull() & F.col("trains").isNull(), "failed").when(F.col("trains").isNull(), "empty").when(F.col("error").isNotNull(), "partial").otherwise("ok")
    return out.select("day", status.alias("status"), F.coalesce("trains", F.lit(0)).cast("long").alias("trains"), "error")


def merge_trains(trains: DataFrame) -> DataFrame:
    """DAT3: trains found on several days and pairs once, in order of day, time and number."""
    return trains.dropDuplicates(["day", "train_number", "from_code", "to_code", "departure_time"]).orderBy("day", F.col("departure_time").asc_nulls_last(), "train_number")


def dataset_runs(runs: DataFrame, region: str | None = None, status: str | None = None, limit: int = 100) -> DataFrame:
    """FLT16."""
    out = runs
    if region:
        out = out.where(F.col("region_code") == region)
    if status:
        out = out.where(F.col("status") == status)
    return out.orderBy(F.desc("id")).limit(limit)


def latest_success(runs: DataFrame) -> DataFrame:
    """TOP15: each region's last successful run's digest."""
    ok = runs.where("status = 'success' and source_md5 is not null")
    return latest(ok, ["region_code"], [F.desc_nulls_last("finished_at"), F.desc("id")]).select("region_code", "source_md5", "finished_at")


def update_checks(registry: DataFrame, known: DataFrame, remote: DataFrame) -> DataFrame:
    """Each region's state: new, up to date, changed, or unknown without a remote digest."""
    j = registry.join(known.select("region_code", F.col("source_md5").alias("have")), "region_code", "left").join(remote.select("region_code", F.col("md5").alias("now")), "region_code", "left")
    state = F.when(F.col("now").isNull(), "unknown").when(F.col("have").isNull(), "new").when(F.col("have") == F.col("now"), "up_to_date").otherwise("update_available")
    return j.select("region_code", state.alias("status"))


def status_counts(checks: DataFrame) -> DataFrame:
    """AGG22."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return checks.agg(F.count("*").alias("total"), n("new"), n("up_to_date"), n("update_available"), n("unknown"))


def scope_status(nodes: DataFrame, edges: DataFrame, links: DataFrame, least: tuple[int, int, int] = (100, 100, 20)) -> DataFrame:
    """AGG20: counts of each scope and whether its network is ready."""
    n = nodes.groupBy("scope_key").agg(F.count("*").alias("nodes"))
    e = edges.groupBy("scope_key").agg(F.count("*").alias("edges"))
    k = links.groupBy("scope_key").agg(F.count("*").alias("links"))
    out = n.join(e, "scope_key", "full").join(k, "scope_key", "full").fillna(0)
    return out.withColumn("ready", (F.col("nodes") >= least[0]) & (F.col("edges") >= least[1]) & (F.col("links") >= least[2]))


def missing_scopes(wanted: DataFrame, scopes: DataFrame) -> DataFrame:
    """SET7."""
    return wanted.join(scopes.select("scope_key").distinct(), "scope_key", "left_anti")


def touched(table: DataFrame, started: str = "started_at", now: str = "updated_at") -> DataFrame:
    """DAT4: a start time where none is set yet, and the time of the change."""
    return table.withColumn(started, F.coalesce(started, F.current_timestamp())).withColumn(now, F.current_timestamp())


def job_states(events: DataFrame) -> DataFrame:
    """The last state of each job of an append-only log."""
    return events.groupBy("job_id").agg(F.max_by(F.struct("status", "progress", "stage"), F.struct("ts", "progress")).alias("s")).select("job_id", "s.*")
