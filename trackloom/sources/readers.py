"""Files to frames: map extracts, settlements, boundaries, routes, matches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions import geo
from trackloom.functions.text import blank_to_null

POINTS = "array<struct<lon:double,lat:double>>"
OVERPASS = (
    "elements array<struct<type:string,id:bigint,lat:double,lon:double,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>,"
    "members:array<struct<type:string,ref:bigint,role:string,geometry:array<struct<lat:double,lon:double>>>>>>"
)
FEATURES = "features array<struct<type:string,properties:map<string,string>,geometry:string>>"
ROUTE = (
    "source_system string, external_route_id string, train_number string, route_name string, snapshot_date string, is_active boolean, notes string, "
    "stops array<struct<stop_sequence:int,station_name_raw:string,station_code:string,station_id:bigint,arrival_time:string,departure_time:string,distance_km:double>>"
)
MATCH = "station_code string, station_name string, station_id bigint, match_method string, match_confidence double, notes string, is_active boolean"


def map_extract(nodes: DataFrame, ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC1: stations (as points) and rail lines of extracted nodes and ways.

    nodes: osm_id, railway, name, tags_json, lon, lat; ways: the same with coords. A way of a
    station stands for its centroid, of the area where it is closed (four points at least), else of
    the line; ways of fewer than two points go, and what is neither node nor way is not read.
    """
    c = geo.centroid("coords")
    station = F.col("railway").isin("station", "halt")
    cols = ["osm_element_type", "osm_id", "name", "railway", "tags_json"]
    points = nodes.where(station).withColumn("osm_element_type", F.lit("node")).select(*cols, "lon", "lat")
    areas = ways.where(station & (F.size("coords") >= 2)).withColumn("osm_element_type", F.lit("way")).select(*cols, c["lon"].alias("lon"), c["lat"].alias("lat"))
    lines = ways.where((F.col("railway") == "rail") & (F.size("coords") >= 2)).withColumn("osm_element_type", F.lit("way")).select(*cols, "coords")
    return points.unionByName(areas), lines


def _flip(c: Column) -> Column:
    return F.transform(c, lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))


def overpass(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """SRC2: (station features, line features) of saved map queries, a file each or, with ``lines``, a line each; a relation's place is its members' mean."""
    e = spark.read.schema(OVERPASS).option("multiLine", not lines).json(path).select(F.explode("elements").alias("e")).select("e.*")
    all_points = F.coalesce(_flip(F.flatten(F.transform("members", lambda m: m["geometry"]))), F.array().cast(POINTS))
    own = F.when(F.col("type") == "node", F.array(geo.point("lon", "lat"))).when(F.col("type") == "way", _flip(F.col("geometry"))).otherwise(all_points)
    mean = lambda k: F.aggregate(own, F.lit(0.0), lambda s, p: s + p[k]) / F.nullif(F.size(own), F.lit(0))
    kind = F.try_element_at("tags", F.lit("railway"))
    name = F.try_element_at("tags", F.lit("name")).alias("name")
    stations = e.where(kind.isin("station", "halt")).select("type", "id", name, "tags", mean("lon").alias("lon"), mean("lat").alias("lat")).where("lon is not null")
    parts = F.when(F.col("type") == "way", F.array(_flip(F.col("geometry")))).otherwise(F.filter(F.transform("members", lambda m: _flip(m["geometry"])), lambda x: x.isNotNull() & (F.size(x) >= 2)))
    lines = e.where((kind == "rail") & F.col("type").isin("way", "relation")).select("type", "id", name, "tags", parts.alias("parts")).where(F.size("parts") > 0)
    return stations, lines


def settlements(spark: SparkSession, path: str, sep: str = ";", encoding: str = "utf-8") -> DataFrame:
    """SRC3: a settlement file by its ending; every column as text."""
    if path.endswith(".csv"):
        return spark.read.option("header", True).option("sep", sep).option("encoding", encoding).csv(path)
    if path.endswith((".xlsx", ".xls")):
        return spark.createDataFrame(pd.read_excel(path, dtype=str))
    if path.endswith(".parquet"):
        df = spark.read.parquet(path)
        return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    raise ValueError(f"not a settlement file: {path}")


def features(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return spark.read.schema(FEATURES).option("multiLine", not lines).json(path).select(F.explode("features").alias("f")).select("f.properties", "f.geometry")


def boundaries(spark: SparkSession, path: str, region: str | None = None, lines: bool = False) -> DataFrame:
    """SRC4: region_code, region_name, rings; polygons and multi-polygons alike."""
    f = features(spark, path, lines).select(F.try_element_at("properties", F.lit("code")).alias("region_code"), F.try_element_at("properties", F.lit("name")).alias("region_name"), "geometry")
    one = F.from_json("geometry", "type string, coordinates array<array<array<double>>>")
    many = F.from_json("geometry", "type string, coordinates array<array<array<array<double>>>>")
    ring = lambda r: F.transform(r, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    rings = F.when(one["type"] == "Polygon", F.transform(one["coordinates"], ring)).when(many["type"] == "MultiPolygon", F.transform(F.flatten(many["coordinates"]), ring))
    out = f.select("region_code", "region_name", rings.alias("rings")).where(blank_to_null(F.col("region_code")).isNotNull() & F.col("rings").isNotNull())
    return out if region is None else out.where(F.col("region_code") == region)


def build_boundaries(registry: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC5: registered regions with a found relation, and those without, with the reason."""
    j = registry.join(found.select("relation_id", "rings"), "relation_id", "left")
    missing = j.where("rings is null").select("region_code", F.when(F.col("relation_id").isNull(), "no_relation_id").otherwise("relation_not_found").alias("reason"))
    return j.where("rings is not null"), missing


def aggregate_md5(sources: DataFrame) -> DataFrame:
    """SRC6: one digest over a region's sorted (source, md5) map."""
    pairs = F.array_sort(F.collect_set(F.struct("source", "md5")))
    return sources.groupBy("region_code").agg(F.md5(F.to_json(F.map_from_entries(pairs))).alias("md5"))


def download_decision(remote: Column, cached: Column, have_file: Column) -> Column:
    """SRC7: what a downloader does, by the digests it knows: the file's now, and the kept one's (null: not known)."""
    same = cached.isNotNull() & F.coalesce(remote == cached, F.lit(True))
    return F.when(F.coalesce(have_file, F.lit(False)) & same, "use_cached").when(remote.isNotNull(), "download_and_verify").otherwise("download_unverified")


def routes(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """SRC9: route payloads, one to a file or a list of them; with ``lines``, one to a line."""
    return spark.read.schema(ROUTE).option("multiLine", not lines).json(path)


def station_matches(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return spark.read.schema(MATCH).option("multiLine", not lines).json(path).withColumn("is_active", F.coalesce("is_active", F.lit(True)))


def tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """SRC10: parquet tables, also as views for SQL with parameters."""
    out = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}
    for n, df in out.items():
        df.createOrReplaceTempView(n)
    return out


def xml_fields(c: Column, names: list[str]) -> Column:
    """JSN5: the named children of a one-level XML answer as a struct of strings; nulls where it is no XML."""
    return F.from_xml(c, ", ".join(f"{n} string" for n in names), {"mode": "PERMISSIVE"})


# Timetable payloads nest their records at no fixed depth (JSN1, JSN2).


def walk(node, wanted: tuple[str, ...]) -> Iterator[dict]:
    """Every object, at any depth, that has one of the keys, outer ones first."""
    stack = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            if any(k in x for k in wanted):
                yield x
            stack.extend(reversed(list(x.values())))
        elif isinstance(x, list):
            stack.extend(reversed(x))


def _extract(payloads: DataFrame, wanted: tuple[str, ...], fields: dict[str, tuple[str, ...]], keys: list[str], needed: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for pid, raw in zip(df["payload_id"], df["payload"], strict=True):
                try:
                    tree = json.loads(raw)
                except (TypeError, ValueError):
                    continue
                seen = set()
                for x in walk(tree, wanted):
                    r = {k: next((str(x[n]) for n in names if x.get(n) not in (None, "")), None) for k, names in fields.items()}
                    key = tuple(r[k] for k in keys)
                    if r[needed] is not None and key not in seen:
                        seen.add(key)
                        rows.append((pid, len(seen), *r.values()))
            yield pd.DataFrame(rows, columns=["payload_id", "position", *fields])

    schema = "payload_id long, position int, " + ", ".join(f"{k} string" for k in fields)
    return payloads.select("payload_id", "payload").mapInPandas(run, schema)


def trains(payloads: DataFrame) -> DataFrame:
    """JSN1: trains of search answers, each once by number, date, time and ends."""
    number = ("number", "trainNumber", "tnum0", "TRAIN_NUM", "Number")
    fields = {"number": number, "brand": ("brand", "Brand"), "carrier": ("carrier", "Carrier"), "date0": ("date0",), "time0": ("time0",), "route0": ("route0",), "route1": ("route1",), "time_in_way": ("timeInWay",)}
    return _extract(payloads, number, fields, ["number", "date0", "time0", "route0", "route1"], "number")


def train_stops(payloads: DataFrame) -> DataFrame:
    """JSN2, STR24: stops of station-list answers, each once by name, code and times."""
    name = ("station", "stationName", "Station", "StationName", "name", "Name")
    fields = {"name": name, "code": ("code", "stationCode", "Code", "StationCode"), "arrival": ("arrivalTime", "ArrivalTime", "arvTime"), "departure": ("departureTime", "DepartureTime", "depTime"), "distance": ("distance", "Distance")}
    return _extract(payloads, name, fields, ["name", "code", "arrival", "departure"], "name")
