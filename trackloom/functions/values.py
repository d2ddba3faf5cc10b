"""Parsing of numbers, coordinates, durations and dates that arrive as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(c: Column) -> Column:
    text = F.regexp_replace(F.translate(F.trim(c.cast("string")), ",  ", "."), r"[^0-9.\-]", "")
    return text.try_cast("double")


def parse_int(c: Column) -> Column:
    """Half-even; blanks, junk and negatives are null (NUM19)."""
    n = _number(c)
    return F.when(n >= 0, F.bround(n).cast("bigint"))


def parse_float(c: Column) -> Column:
    """NUM20."""
    return _number(c)


def parse_coords(c: Column) -> Column:
    """struct<lat, lon> of a "lat, lon" text; swapped only when the first cannot be a latitude (NUM21)."""
    found = F.regexp_extract_all(c, F.lit(r"(-?\d+(?:[\.,]\d+)?)"), 1)
    a, b = (F.translate(F.try_element_at(found, F.lit(k)), ",", ".").try_cast("double") for k in (1, 2))
    swap = (F.abs(a) > 90) & (F.abs(b) <= 90)
    return F.struct(F.when(swap, b).otherwise(a).alias("lat"), F.when(swap, a).otherwise(b).alias("lon"))


def valid_lat_lon(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def parse_distance_km(c: Column) -> Column:
    """The first number of a text (NUM22)."""
    return F.translate(F.nullif(F.regexp_extract(c.cast("string"), r"(\d+(?:[.,]\d+)?)", 1), F.lit("")), ",", ".").try_cast("double")


def parse_minutes(c: Column) -> Column:
    """"n", a whole "hh:mm", "n ч m мин", or the first number of any other text (DAT1)."""
    t = F.lower(F.trim(c.cast("string")))
    part = lambda pattern, k=1: F.nullif(F.regexp_extract(t, pattern, k), F.lit("")).try_cast("int")
    hours, minutes = part(r"(\d+)\s*ч"), part(r"(\d+)\s*м")
    clock = r"^(\d{1,2}):(\d{2})$"
    return (
        F.when(t.rlike(r"^\d+$"), part(r"^(\d+)$"))
        .when(t.rlike(clock), part(clock) * 60 + part(clock, 2))
        .when(hours.isNotNull() | minutes.isNotNull(), F.coalesce(hours, F.lit(0)) * 60 + F.coalesce(minutes, F.lit(0)))
        .otherwise(part(r"(\d+)"))
    )


def iso_date(c: Column) -> Column:
    """dd.mm.yyyy or ISO to date (DAT2)."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("dd.MM.yyyy")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))).cast("date")


def dotted_date(c: Column) -> Column:
    return F.date_format(iso_date(c), "dd.MM.yyyy")


def first_number(raw: Column, keys: list[str]) -> Column:
    """The first of a JSON object's keys that is there, as a number (JSN4)."""
    return F.translate(F.coalesce(*[F.get_json_object(raw, f"$.{k}") for k in keys]), ",", ".").try_cast("double")


#: The keys that coordinates have, the likelier first.
LON_KEYS = ["lon", "lng", "longitude", "x", "X", "Longitude"]
LAT_KEYS = ["lat", "latitude", "y", "Y", "Latitude"]


def lon_lat(raw: Column) -> Column:
    """struct<lon, lat> of a JSON object with any of the usual keys; null outside the ranges."""
    lon, lat = first_number(raw, LON_KEYS), first_number(raw, LAT_KEYS)
    return F.when(valid_lat_lon(lat, lon), F.struct(lon.alias("lon"), lat.alias("lat")))
