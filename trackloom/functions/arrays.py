"""Coordinate sequences and ordered sets as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackloom.functions.geo import POINT, haversine_km


def merge_sequences(parts: Column, epsilon: float = 0.0) -> Column:
    """One sequence of several, a joint's second point left out when it equals the first (ARR1, ARR2)."""

    def add(acc: Column, p: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        same = (F.abs(last["lon"] - p["lon"]) <= epsilon) & (F.abs(last["lat"] - p["lat"]) <= epsilon)
        return F.when(F.coalesce(same, F.lit(False)), acc).otherwise(F.concat(acc, F.array(p)))

    def join(acc: Column, part: Column) -> Column:
        return F.when(F.size(part) == 0, acc).otherwise(F.concat(add(acc, part[0]), F.slice(part, F.lit(2), F.greatest(F.size(part) - 1, F.lit(0)))))

    return F.aggregate(parts, F.array().cast(f"array<{POINT}>"), join)


def simple_line(coords: Column) -> Column:
    """Neighbouring equal points once; null with fewer than two left (ARR3, ARR7)."""
    kept = F.filter(coords, lambda p, i: (i == 0) | ~p.eqNullSafe(F.get(coords, i - 1)))
    return F.when(F.size(kept) >= 2, kept)


def oriented(coords: Column, lon: Column, lat: Column) -> Column:
    """The line from its end nearer to a point (ARR4)."""
    a, b = F.try_element_at(coords, F.lit(1)), F.try_element_at(coords, F.lit(-1))
    return F.when(haversine_km(lon, lat, b["lon"], b["lat"]) < haversine_km(lon, lat, a["lon"], a["lat"]), F.reverse(coords)).otherwise(coords)


def unique_non_empty(values: Column) -> Column:
    """First places of distinct, trimmed, non-empty strings (AGG17)."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def ordered_union(*arrays: Column, most: int = 6) -> Column:
    """SET9."""
    return F.slice(unique_non_empty(F.concat(*arrays)), 1, most)


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared members over the smaller set; 0 with an empty one (SET5)."""
    small = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(small > 0, F.size(F.array_intersect(a, b)) / F.nullif(small, F.lit(0))).otherwise(F.lit(0.0))


def scope_key(codes: Column) -> Column:
    """STR19."""
    return F.concat_ws("|", F.array_sort(unique_non_empty(codes)))
