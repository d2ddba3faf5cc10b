"""From raw map objects, settlement files and timetable routes to core tables."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions import geo, text, values

#: Operators whose stations and lines are main-line ones.
AFFILIATIONS = [
    "ржд",
    "российские железные дороги",
    "октябрьская железная дорога",
    "калининградская железная дорога",
    "московская железная дорога",
    "горьковская железная дорога",
    "северная железная дорога",
    "северо-кавказская железная дорога",
    "юго-восточная железная дорога",
    "приволжская железная дорога",
    "куйбышевская железная дорога",
    "свердловская железная дорога",
    "южно-уральская железная дорога",
    "западно-сибирская железная дорога",
    "красноярская железная дорога",
    "восточно-сибирская железная дорога",
    "забайкальская железная дорога",
    "дальневосточная железная дорога",
    "сахалинская железная дорога",
]


def tags(c: Column | str) -> Column:
    """A JSON object of strings as a map (JSN3)."""
    return F.from_json(c, "map<string,string>")


def tag(m: Column, key: str) -> Column:
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(""))


def _low(m: Column, key: str) -> Column:
    return F.lower(tag(m, key))


def is_subway(m: Column, name: Column) -> Column:
    """FLT10."""
    return (
        (_low(m, "station") == "subway")
        | (_low(m, "railway") == "subway")
        | _low(m, "subway").isin("yes", "true", "1")
        | _low(m, "operator").rlike("метрополитен|metro")
        | _low(m, "network").rlike("метро|metro")
        | F.lower(F.coalesce(name, F.lit(""))).startswith("метро ")
    )


def affiliated(m: Column) -> Column:
    """FLT11."""
    any_of = "|".join(re.escape(x) for x in AFFILIATIONS)
    out = F.lit(False)
    for key in ("operator", "operator:branch", "network", "owner"):
        out = out | _low(m, key).rlike(any_of)
    return out


def main_rail_signs(m: Column) -> Column:
    """FLT12."""
    return affiliated(m) | (tag(m, "uic_ref") != "") | (tag(m, "esr:user") != "")


def classify_stations(raw: DataFrame, label: Column | None = None) -> DataFrame:
    """FLT14: stations and halts with flags and the reason they are hidden."""
    m = tags("tags_json")
    rows = raw.where(F.col("railway").isin("station", "halt")).withColumn("_m", m)
    m = F.col("_m")
    subway, signs = is_subway(m, F.col("name")), main_rail_signs(m)
    own = lambda key, name: F.try_element_at(m, F.lit(key)).alias(name)
    return rows.select(
        "region_code", "osm_element_type", "osm_id", "name", F.col("railway").alias("station_type"), (label if label is not None else F.col("region_code")).alias("region"),
        own("operator", "operator_name"), own("operator:branch", "operator_branch"), own("uic_ref", "uic_ref"), own("esr:user", "esr_user"),
        (~subway & signs).alias("is_main_rail_station"), (~subway & signs).alias("is_visible_default"),
        F.when(subway, "subway_or_metro").when(~signs, "missing_main_rail_signs").alias("exclude_reason"),
        *[c for c in ("lon", "lat") if c in raw.columns],
    )


def classify_lines(raw: DataFrame, label: Column | None = None) -> DataFrame:
    """FLT13, FLT15."""
    rows = raw.where(F.col("railway") == "rail").withColumn("_m", tags("tags_json"))
    m = F.col("_m")
    service, industrial, closed = F.trim(tag(m, "service")) != "", _low(m, "usage") == "industrial", _low(m, "passenger") == "no"
    main = tag(m, "usage").isin("main", "branch")
    visible = ~service & ~industrial & ~closed & main
    own = lambda key, name: F.try_element_at(m, F.lit(key)).alias(name)
    return rows.select(
        "region_code", "osm_element_type", "osm_id", "name", F.col("railway").alias("line_type"), (label if label is not None else F.col("region_code")).alias("region"),
        own("operator", "operator_name"), own("operator:branch", "operator_branch"), own("usage", "usage_type"), own("service", "service_type"),
        (service | industrial).alias("is_service_line"), visible.alias("is_main_passenger_line"), visible.alias("is_visible_default"),
        F.when(service, "service_line").when(industrial, "industrial_line").when(closed, "non_passenger_line").when(~main, "non_main_or_branch").alias("exclude_reason"),
        *[c for c in ("coords",) if c in raw.columns],
    )


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order that has no ties (WIN5, JON16, SNK4)."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def deduplicate_stage(stage: DataFrame) -> DataFrame:
    """The last loaded copy of each map object."""
    return latest(stage, ["region_code", "osm_element_type", "osm_id"], [F.desc("load_seq")])


def duplicate_groups(stage: DataFrame, keys: list[str]) -> DataFrame:
    """AGG9."""
    return stage.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def validate_stage(stations: DataFrame, lines: DataFrame, previous: DataFrame) -> DataFrame:
    """AGG10: a row per region with counts and the errors that stop its publication.

    previous: region_code, stations, lines of the published tables.
    """
    keys = ["region_code", "osm_element_type", "osm_id"]

    def measured(df: DataFrame, name: str, valid: Column) -> DataFrame:
        n = df.groupBy("region_code").agg(F.count("*").alias(name), F.count(F.when(~valid, 1)).alias(f"{name}_invalid"))
        d = duplicate_groups(df, keys).groupBy("region_code").agg(F.count("*").alias(f"{name}_duplicates"))
        return n.join(d, "region_code", "left")

    s = measured(stations, "n_stations", geo.valid_point("lon", "lat"))
    line = measured(lines, "n_lines", geo.valid_line("coords"))
    out = s.join(line, "region_code", "full").join(previous.select("region_code", F.col("stations").alias("old_stations"), F.col("lines").alias("old_lines")), "region_code", "left")
    out = out.fillna(0)
    checks = []
    for name in ("stations", "lines"):
        n, old = F.col(f"n_{name}"), F.col(f"old_{name}")
        checks += [
            F.when(n == 0, f"{name}: no rows"),
            F.when(F.col(f"n_{name}_invalid") > 0, f"{name}: invalid geometry"),
            F.when(F.col(f"n_{name}_duplicates") > 0, f"{name}: duplicates"),
            F.when((old > 0) & (n < F.greatest(F.lit(1), F.floor(old / 2))), f"{name}: fewer than half of before"),
        ]
    return out.withColumn("errors", F.array_compact(F.array(*checks))).withColumn("ok", F.size("errors") == 0)


def replace_by_key(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table with rows of equal keys replaced; rows with a null in the key are only added (SNK3)."""
    full = rows.where(" and ".join(f"{k} is not null" for k in keys)).select(*keys).distinct()
    return table.join(full, keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def upsert(table: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """Last write wins in all columns (SNK4)."""
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest(both, [key], [F.desc("_new"), F.desc_nulls_last(order)]).drop("_new")


def hide(stations: DataFrame, decisions: DataFrame) -> DataFrame:
    """Stations with the decided ones hidden and their reason set (SNK6)."""
    d = decisions.select(F.col("station_id").alias("id"), F.col("reason").alias("_reason")).dropDuplicates(["id"])
    j = stations.join(d, "id", "left")
    return j.withColumn("is_visible_default", F.when(F.col("_reason").isNotNull(), F.lit(False)).otherwise(F.col("is_visible_default"))).withColumn("exclude_reason", F.coalesce("_reason", "exclude_reason")).drop("_reason")


def cleanup_plan(service_only: DataFrame, others: DataFrame) -> DataFrame:
    """One reason for each station, service-only lines before all else (SET8)."""
    both = service_only.select("station_id", F.lit("service_only").alias("reason"), F.lit(0).alias("k")).unionByName(others.select("station_id", "reason", F.lit(1).alias("k")))
    return latest(both, ["station_id"], [F.col("k"), F.col("reason")]).drop("k")


def remove_in_zones(stations: DataFrame, zones: DataFrame, used: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, archived): halts and platforms inside a zone that no route stops at go to the archive (UDF0)."""
    from trackloom.operators.audit import point_hits

    some = stations.where(F.col("station_type").isin("halt", "platform", "stop"))
    hit = point_hits(some, zones).where(F.col("hit") == F.col("region_code")).select("id").distinct()
    gone = hit.join(used.select(F.col("station_id").alias("id")).distinct(), "id", "left_anti")
    return stations.join(gone, "id", "left_anti"), stations.join(gone, "id", "left_semi")


# Settlements

#: Names under which a column may come, as slugs.
COLUMN_NAMES = {
    "id": ["id", "settlement_id", "object_id"],
    "object_level": ["object_level", "level", "уровень"],
    "name": ["name", "settlement", "settlement_name", "название", "наименование"],
    "type": ["type", "settlement_type", "тип"],
    "federal_district": ["federal_district", "федеральный_округ"],
    "region": ["region", "region_name", "регион", "субъект"],
    "oktmo": ["oktmo", "октмо"],
    "fias_code": ["fias_code", "fias", "фиас"],
    "population": ["population", "население", "численность"],
    "lat": ["lat", "latitude", "широта"],
    "lon": ["lon", "lng", "longitude", "долгота"],
    "coords": ["coords", "coordinates", "координаты"],
    "type_full": ["settlement_type_full"],
    "city_type_full": ["city_type_full"],
    "city_type": ["city_type"],
    "municipality": ["municipality", "муниципалитет"],
    "municipality_up_name": ["municipality_up_name"],
    "municipality_down_name": ["municipality_down_name"],
}


def slug_of(name: str) -> str:
    out = re.sub("[^0-9a-zа-я_]+", "_", re.sub(r"\s+", " ", name.strip()).lower().replace("ё", "е").replace("-", "_"))
    return re.sub("_+", "_", out).strip("_")


def detect_columns(columns: list[str], given: dict[str, str] | None = None) -> dict[str, str]:
    """Which of a file's columns holds what; the population column may carry a year, the last one wins (JSN6)."""
    by = {slug_of(c): c for c in columns}
    out = {}
    for k, names in COLUMN_NAMES.items():
        if given and given.get(k):
            if slug_of(given[k]) not in by:
                raise ValueError(f"no column {given[k]}")
            out[k] = by[slug_of(given[k])]
        elif found := next((by[n] for n in names if n in by), None):
            out[k] = found
        elif k == "population":
            years = sorted((m[1], c) for s, c in by.items() if (m := re.fullmatch(r"(?:population|население|численность)\w*?_((?:19|20)\d\d)", s)))
            if years:
                out[k] = years[-1][1]
    missing = [k for k in ("name", "region", "population") if k not in out]
    if missing or not ("coords" in out or "lat" in out and "lon" in out):
        raise ValueError(f"required columns not found: {', '.join(missing) or 'coordinates'}")
    return out


@dataclass(frozen=True)
class SettlementFilter:
    districts: tuple[str, ...] = ()
    regions: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    min_population: int | None = None
    settlement_level_only: bool = True


def is_settlement_level(c: Column) -> Column:
    """FLT18: an empty level counts as a settlement's; an anonymised one never does."""
    s = F.lower(text.clean_text(c))
    marked = s.contains("населен") | s.contains("settlement") | s.contains("locality") | s.isin("нп", "np")
    return F.when(s.contains("аноним"), F.lit(False)).otherwise((s == "") | marked)


def matches(c: Column, wanted: tuple[str, ...]) -> Column:
    """FLT19."""
    return text.slug(c).isin([slug_of(x) for x in wanted]) if wanted else F.lit(True)


def normalise_settlements(raw: DataFrame, given: dict[str, str] | None = None, keep: SettlementFilter | None = None) -> DataFrame:
    """FLT17, STR18: one row for each raw row, with ``skip_reason`` of the first filter that it fails."""
    keep = keep or SettlementFilter()
    cols = detect_columns(raw.columns, given)
    get = lambda k: F.col(f"`{cols[k]}`").cast("string") if k in cols else F.lit(None).cast("string")
    pair = values.parse_coords(get("coords"))
    lat = F.coalesce(values.parse_float(get("lat")), pair["lat"])
    lon = F.coalesce(values.parse_float(get("lon")), pair["lon"])
    out = raw.select(
        get("id").alias("source_row_id"), text.optional(get("object_level")).alias("object_level"),
        text.canonical_place(get("name"), get("municipality_down_name"), get("municipality_up_name")).alias("canonical_name"),
        F.coalesce(*[text.optional(get(k)) for k in ("type", "type_full", "city_type_full", "city_type")]).alias("settlement_type"), text.optional(get("federal_district")).alias("federal_district"), text.optional(get("region")).alias("region"),
        F.coalesce(*[text.optional(get(k)) for k in ("municipality_down_name", "municipality_up_name", "municipality")]).alias("municipality"),
        text.optional(get("oktmo")).alias("oktmo"), text.optional(get("fias_code")).alias("fias_code"), values.parse_int(get("population")).alias("population"), lat.alias("lat"), lon.alias("lon"),
    )
    reason = (
        F.when(F.lit(keep.settlement_level_only) & ~is_settlement_level(F.col("object_level")), "level")
        .when(~F.coalesce(matches(F.col("federal_district"), keep.districts), F.lit(False)), "district")
        .when(~F.coalesce(matches(F.col("region"), keep.regions), F.lit(False)), "region")
        .when(F.col("canonical_name").isNull() | ~matches(F.col("canonical_name"), keep.names), "name")
        .when(F.lit(keep.min_population is not None) & (F.coalesce("population", F.lit(-1)) < (keep.min_population or 0)), "population")
        .when(~values.valid_lat_lon(F.col("lat"), F.col("lon")), "coords")
    )
    return out.withColumn("skip_reason", reason)


def _merged(rows: DataFrame, keys: list[Column], prefix: str) -> DataFrame:
    """One row a key: people added up, places averaged; a key of one row keeps its own id."""
    rows = rows.withColumn("_k", F.concat_ws(":", *[k.cast("string") for k in keys])).withColumn("_g", F.to_json(F.array(*[F.coalesce(k.cast("string"), F.lit("\0")) for k in keys])))
    first = F.min_by(F.struct(*[c for c in rows.columns if not c.startswith("_")]), F.col("source_row_id"))
    out = rows.groupBy("_g").agg(first.alias("r"), F.count("*").alias("_n"), F.max("_k").alias("_k"), F.sum("population").alias("_p"), F.avg("lat").alias("_lat"), F.avg("lon").alias("_lon"), F.sum("rows_count").alias("_rows"))
    own = {"population": F.col("_p"), "lat": F.col("_lat"), "lon": F.col("_lon"), "rows_count": F.col("_rows"), "source_row_id": F.when(F.col("_n") > 1, F.concat(F.lit(prefix), F.col("_k"))).otherwise(F.col("r.source_row_id"))}
    return out.select(*[own.get(c, F.col(f"r.{c}")).alias(c) for c in rows.columns if not c.startswith("_")])


def aggregate_settlements(rows: DataFrame) -> DataFrame:
    """AGG14, AGG15: rows of one settlement add up, then districts of one city.

    Input columns as ``normalise_settlements`` gives them; ``rows_count`` tells how many rows one stands for.
    """
    rows = rows.withColumn("rows_count", F.lit(1).cast("long"))
    c = F.col
    coded = c("fias_code").isNotNull() | c("oktmo").isNotNull()
    three = lambda x: F.when(~coded, F.round(c(x), 3))
    one = _merged(rows, [c("region"), F.when(coded, c("oktmo")), F.when(coded, c("fias_code")), c("canonical_name"), three("lat"), three("lon"), coded], "agg:")
    city = F.coalesce(c("canonical_name").startswith("г.") | text.slug(c("settlement_type")).isin("г", "город"), F.lit(False))
    cities = _merged(one.where(city), [c("region"), c("canonical_name")], "city_agg:")
    return one.where(~city).unionByName(cities)


def run_counts(stations: DataFrame, lines: DataFrame) -> DataFrame:
    """AGG27: objects and visible objects of each region."""
    s = stations.groupBy("region_code").agg(F.count("*").alias("stations"), F.count(F.when(F.col("is_visible_default"), 1)).alias("visible_stations"))
    n = lines.groupBy("region_code").agg(F.count("*").alias("lines"), F.count(F.when(F.col("is_visible_default"), 1)).alias("visible_lines"))
    return s.join(n, "region_code", "full").fillna(0)
