"""Scores, levels, costs and decisions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackloom.functions.text import blank_to_null, simple_name_score


def clamp(c: Column, lo: float, hi: float) -> Column:
    """NUM1."""
    return F.greatest(F.lit(lo), F.least(c, F.lit(hi)))


def attention_score(population: Column, max_population: Column, to_route_km: Column, to_station_km: Column, cost: Column, corridor_km: float, access_km: float) -> Column:
    """0 to 100: people, distance from a stop, nearness to the line, less the cost (NUM2)."""
    people = F.greatest(population.cast("double"), F.lit(0.0))
    most = F.coalesce(F.nullif(max_population.cast("double"), F.lit(0.0)), F.greatest(people, F.lit(1.0)))
    share = clamp(F.log10(people + 1) / F.log10(most + 1), 0.0, 1.0)
    far = F.when(to_station_km.isNull(), F.lit(1.0)).otherwise(clamp(to_station_km / max(access_km, 1.0) / 2, 0.0, 1.0))
    near = clamp(1 - to_route_km / max(corridor_km, 1.0), 0.0, 1.0)
    raw = 35 * share + 25 * far + 20 * near + 20 * 0.5 - F.least(F.lit(20.0), cost / 1e9 * 5)
    return F.round(clamp(raw, 0.0, 100.0), 2)


def attention_level(score: Column) -> Column:
    """NUM3."""
    return F.when(score >= 70, "high").when(score >= 40, "medium").otherwise("low")


def connection_cost(to_route_km: Column, per_km: float, station: float) -> Column:
    """NUM4."""
    return to_route_km * per_km + station


def cost_per_thousand(cost: Column, population: Column) -> Column:
    return F.try_divide(cost, population / 1000)


def present(c: Column) -> Column:
    return blank_to_null(c).isNotNull()


def profile_score(main: Column, esr: Column, uic: Column, linked: Column, visible: Column) -> Column:
    """NUM5."""
    points = lambda cond, n: F.when(cond, n).otherwise(0)
    return points(main, 100) + points(present(esr), 50) + points(present(uic), 35) + points(linked, 25) + points(visible, 10)


def nearby_priority(profile: Column, distance_m: Column) -> Column:
    """NUM6."""
    return profile - F.least(distance_m / 1000, F.lit(50.0))


def recommended(main: Column, esr: Column, uic: Column, visible: Column) -> Column:
    return F.coalesce(visible & main & (present(esr) | present(uic)), F.lit(False))


def code_candidates(esr: Column, uic: Column) -> Column:
    own = lambda source, code, k: F.when(present(code), F.struct(F.lit(source).alias("source"), code.alias("code"), F.lit(k).alias("priority")))
    return F.filter(F.array(own("esr_user", esr, 1), own("uic_ref", uic, 2)), lambda x: x.isNotNull())


def station_quality(nearby: Column, service: Column, open_: Column, passenger: Column, main: Column, uic: Column, esr: Column, kind: Column, name: Column) -> Column:
    """Eleven terms over the lines near a station and its tags (NUM7, STR25)."""
    points = lambda cond, n: F.when(cond, n).otherwise(0.0)
    has = lambda c: F.coalesce(c != "", F.lit(False))
    return (
        points(open_ > 0, 100.0)
        + points(passenger > 0, 60.0)
        + points(main, 35.0)
        + points(has(uic), 20.0)
        + points(has(esr), 12.0)
        + points(has(kind), 5.0)
        + F.coalesce(F.least(F.length(F.trim(name)) * 0.2, F.lit(8.0)), F.lit(0.0))
        + F.least(open_ * 6.0, F.lit(18.0))
        + F.least(passenger * 10.0, F.lit(20.0))
        - points((service > 0) & (open_ == 0), 40.0)
        - points(nearby == 0, 70.0)
    )


def station_action(nearby: Column, service: Column, open_: Column, uic: Column) -> Column:
    """NUM8: hide, review or keep."""
    no_uic = ~F.coalesce(uic != "", F.lit(False))
    return F.when(nearby == 0, "hide_default").when((open_ == 0) & (service > 0), "hide_default").when(no_uic & (open_ == 0), "review").otherwise("keep")


def station_reason(nearby: Column, service: Column, open_: Column) -> Column:
    return F.when(nearby == 0, "station_without_nearby_lines").when((open_ == 0) & (service > 0), "station_connected_only_to_service_lines")


def station_class(nearby: Column, service: Column, open_: Column, passenger: Column) -> Column:
    """NUM10."""
    return (
        F.when(nearby == 0, "without_nearby_lines")
        .when((open_ == 0) & (service > 0), "service_only")
        .when(passenger > 0, "main_passenger_connected")
        .when(open_ > 0, "non_service_connected")
        .otherwise("other")
    )


def code_score(name: Column, label: Column, uic: Column, code: Column, distance_km: Column, source: Column) -> Column:
    """struct<name_score, uic_match, score, confidence> of a code found for a station (NUM11)."""
    s = simple_name_score(name, label)
    match = F.coalesce(blank_to_null(uic) == blank_to_null(code), F.lit(False))
    band = (
        F.when(distance_km.isNull(), 0.0).when(distance_km <= 1, 20.0).when(distance_km <= 5, 15.0).when(distance_km <= 15, 8.0).when(distance_km <= 50, 2.0).when(distance_km <= 150, -25.0).otherwise(-60.0)
    )
    bonus = F.when(source.endswith("suggester"), 8.0).when(source == "osm_uic_ref", 5.0).when(source == "nearby_main_station", 3.0).otherwise(0.0)
    weak = F.when(s < 0.35, 35.0).when(s < 0.55, 12.0).otherwise(0.0)
    total = s * 70 + F.when(match, 30.0).otherwise(0.0) + band + F.coalesce(bonus, F.lit(0.0)) - weak
    return F.struct(F.round(s, 4).alias("name_score"), match.alias("uic_match"), F.round(total, 3).alias("score"), F.round(clamp(total / 120, 0.0, 1.0), 4).alias("confidence"))


def code_usable(confidence: Column, name_score: Column, uic_match: Column, distance_km: Column) -> Column:
    """FLT22."""
    return (confidence >= 0.30) & ((name_score >= 0.25) | uic_match) & (distance_km.isNull() | (distance_km <= 150))


def effective_score(score: Column, code_match: Column, anchor: Column, main: Column) -> Column:
    """NUM12."""
    s = F.when(code_match, F.greatest(score, F.lit(0.92))).otherwise(score)
    s = F.when(anchor, F.greatest(s, F.lit(0.97))).otherwise(s)
    return clamp(s + F.when(main, 0.03).otherwise(0.0), 0.01, 1.0)


def lock_cost(effective: Column, fit: Column, code_match: Column, anchor: Column, is_stored: Column, has_stored: Column, no_region: Column) -> Column:
    """NUM13 as columns: what a candidate costs in the route-wide lock without its neighbours.

    ``fit`` is the name's score; ``is_stored``: it is the stop's stored station; ``has_stored``:
    the stop has a visible one.
    """
    points = lambda cond, n: F.when(cond, float(n)).otherwise(0.0)
    stored = F.when(~has_stored, 0.0).when(is_stored, F.when(fit >= 0.72, -4.0).otherwise(8.0)).otherwise(points((fit < 0.72) & ~code_match, 2))
    return F.greatest(F.lit(0.0), 1 - effective) * 8 + F.greatest(F.lit(0.0), 0.85 - fit) * 10 - points(code_match, 5) - points(anchor, 2) + stored + points(no_region, 1)


def gap_confidence(distance_m: Column, most_m: float) -> Column:
    """NUM17."""
    return clamp(1 - distance_m / most_m, 0.0, 1.0)


def heat_weight(population: Column, most: Column) -> Column:
    """NUM18: on the server."""
    return clamp(F.coalesce(F.try_divide(population, most), F.lit(0.0)), 0.05, 1.0)


def client_weight(score: Column, population: Column) -> Column:
    """FE5: on the map."""
    return F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.greatest(score / 100, F.log10(F.greatest(F.lit(10.0), population.cast("double"))) / 7)))


def delta_km(previous: Column, following: Column) -> Column:
    return F.when(previous.isNotNull() & following.isNotNull(), F.greatest(F.lit(0.0), following - previous))


def lock_transition(delta: Column, geo_km: Column, same_region: Column, big_km: float = 150.0) -> Column:
    """Cost of going from one stop's candidate to the next one's; null rejects it (NUM14)."""
    step = lambda n: F.when(same_region, 0.0).otherwise(n)
    ratio = geo_km / F.greatest(delta, F.lit(1.0))
    cost = F.when(ratio > 1, (ratio - 1) * 18).when(ratio < 0.15, (0.15 - ratio) * 35).when(ratio < 0.30, (0.30 - ratio) * 10).otherwise(0.0) + step(0.4)
    rejected = (geo_km > delta * 1.35 + 35) | ((geo_km > big_km) & (delta < geo_km * 0.35))
    return F.when(delta.isNull(), geo_km * 0.02 + step(0.5)).when(delta <= 1, F.when(geo_km <= 5, geo_km * 0.1)).when(rejected, F.lit(None)).otherwise(cost)


def path_transition(delta: Column, path_km: Column, hops: Column) -> Column:
    """Cost of a graph path between two stops; null rejects it (NUM16)."""
    hops = F.coalesce(hops, F.lit(0))
    error = F.abs(path_km - delta)
    absurd = ((delta >= 50) & (path_km < delta * 0.20)) | ((delta >= 5) & (path_km > F.greatest(delta * 2.0, delta + 40)))
    cost = error * 0.45 + error / F.greatest(delta, F.lit(10.0)) * 22 + F.greatest(F.lit(0), hops - 1) * 0.04
    return (
        F.when(path_km.isNull(), F.lit(None))
        .when(delta.isNull(), path_km * 0.03 + hops * 0.02)
        .when(delta <= 1, F.when(path_km <= 2, path_km * 0.05 + hops * 0.05))
        .when(absurd, F.lit(None))
        .otherwise(cost)
    )


def path_outlier(delta: Column, geo_km: Column, path_km: Column) -> Column:
    """What a path that strays from the timetable or the straight line costs (NUM15)."""
    error, over = F.abs(path_km - delta), F.greatest(F.lit(0.0), path_km - geo_km)
    by_table = error * 0.65 + error / F.greatest(delta, F.lit(1.0)) * 28 + F.when(path_km > F.greatest(delta * 2.5, delta + 55), 80.0).otherwise(0.0)
    by_line = over * 0.25 + over / F.greatest(geo_km, F.lit(1.0)) * 12 + F.when(path_km > F.greatest(geo_km * 4, geo_km + 120), 60.0).otherwise(0.0)
    return F.when(delta >= 1, by_table).when(geo_km >= 5, by_line).otherwise(0.0)


def link_pair_score(transition: Column, outlier: Column, connector_km: Column, fallback: Column, secondary: Column) -> Column:
    """GRF13."""
    return 4 * transition + outlier + 0.15 * connector_km + F.when(fallback, 0.05).otherwise(0.0) + F.when(secondary, 0.01).otherwise(0.0)


def link_source_penalty(stored: Column, primary: Column) -> Column:
    """GRF13: what a link costs that no topology stored, or that is not its station's first."""
    return F.when(~stored, 0.05).when(~F.coalesce(primary, F.lit(False)), 0.01).otherwise(0.0)


def virtual_score(total_km: Column, *air_km: Column) -> Column:
    """GRF16: the way there, and dearly what lies between each station and the track."""
    out = total_km
    for a in air_km:
        out = out + 6 * a + 30 * F.greatest(F.lit(0.0), a - 0.35)
    return out


def bridge_score(transition: Column, outlier: Column, connector_km: Column, fallbacks: Column, gap_km: Column) -> Column:
    """GRF11: a path over a bridge between components; ``fallbacks`` counts ends without a stored link."""
    return 4 * transition + outlier + 0.15 * connector_km + 0.05 * fallbacks + 0.20 + 0.35 * gap_km


def travel_hours(length_km: Column, speed_kmh: float = 60.0) -> Column:
    """FE4."""
    return length_km / speed_kmh


def deviation_percent(length_km: Column, original_km: Column) -> Column:
    """FE7."""
    return F.round((F.try_divide(length_km, original_km) - 1) * 100, 1)
