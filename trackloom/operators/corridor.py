"""The corridor around a route: who lives within reach, how far from a stop, with what score.

Routes' segments and settlements meet by a range join on cells, all routes in one plan; the
nearest stop is looked for only among settlements in a corridor.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions import geo, scoring
from trackloom.operators.lineage import cut
from trackloom.operators.spatial_join import explode_segments, nearest_in_group, nearest_on_lines

#: Names of what is no single settlement.
AGGREGATE_NAMES = [
    "прочие сельские населенные пункты",
    "прочие сельские населённые пункты",
    "прочие городские населенные пункты",
    "сельское поселение",
    "городское поселение",
    "сельсовет",
]


@dataclass(frozen=True)
class CorridorParams:
    corridor_km: float = 10.0
    station_access_km: float = 5.0
    min_population: int = 0
    max_population: int | None = None
    exclude_aggregate_like_names: bool = True
    min_score: float = 0.0
    max_results: int = 500
    cost_per_km: float = 50_000_000.0
    station_cost: float = 100_000_000.0

    def __post_init__(self):
        if not 0 < self.corridor_km <= 200 or self.station_access_km < 0 or not 1 <= self.max_results <= 5000 or self.min_population < 0:
            raise ValueError(f"out of range: {self}")

    @classmethod
    def of(cls, given: dict) -> CorridorParams:
        """From a request's fields, also under their client names (FE8)."""
        alias = {"corridorKm": "corridor_km", "stationAccessKm": "station_access_km", "minPopulation": "min_population", "maxPopulation": "max_population", "minScore": "min_score", "maxResults": "max_results"}
        return replace(cls(), **{alias.get(k, k): v for k, v in given.items() if v is not None})


def eligible(settlements: DataFrame, p: CorridorParams) -> DataFrame:
    """FLT8, FLT9: population and place known and within bounds, names of single settlements."""
    s = settlements.where(F.col("population").isNotNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull() & (F.col("population") >= p.min_population))
    if p.max_population is not None:
        s = s.where(F.col("population") <= p.max_population)
    if p.exclude_aggregate_like_names:
        s = s.where(~F.coalesce(F.lower("canonical_name").rlike("|".join(AGGREGATE_NAMES)), F.lit(False)))
    return s


def in_corridor(settlements: DataFrame, routes: DataFrame, corridor_km: float) -> DataFrame:
    """JON1, GEO3: settlements of each route's corridor with distance_to_route_km; routes(route_id, coords)."""
    near = nearest_on_lines(settlements, explode_segments(routes), "route_id", corridor_km).withColumnRenamed("distance_km", "distance_to_route_km")
    return near.join(settlements, "id").select("route_id", *settlements.columns, "distance_to_route_km")


def population_summary(settlements: DataFrame, routes: DataFrame, p: CorridorParams) -> DataFrame:
    """AGG1 for any number of routes at once: settlements, people and people per km of each."""
    hits = in_corridor(eligible(settlements, p), routes.select("route_id", "coords"), p.corridor_km)
    sums = hits.groupBy("route_id").agg(F.count("*").alias("n"), F.sum("population").alias("people"))
    lengths = routes.select("route_id", F.round(geo.length_km(F.col("coords")), 2).alias("length_km"))
    out = lengths.join(sums, "route_id", "left").fillna(0, ["n", "people"])
    return out.select("route_id", "length_km", F.col("n").alias("settlements_count"), F.col("people").alias("total_population"), F.round(F.coalesce(F.try_divide("people", "length_km"), F.lit(0.0)), 2).alias("density_per_km"))


def analyse(settlements: DataFrame, routes: DataFrame, stops: DataFrame | None, p: CorridorParams) -> DataFrame:
    """The candidates of every route's corridor, best first in ``rank`` (flagship).

    stops: route_id, station_id, lon, lat; without it nothing is near a station. The most
    populous ``max_results`` are taken before the score's threshold, and the score is relative to
    the most populous of these.
    """
    hits = in_corridor(eligible(settlements, p), routes.select("route_id", "coords"), p.corridor_km)
    top = W.partitionBy("route_id").orderBy(F.desc("population"), "id")
    hits = cut(hits.withColumn("_n", F.row_number().over(top)).where(F.col("_n") <= p.max_results).drop("_n"))
    if stops is None:
        hits = hits.withColumn("distance_to_station_km", F.lit(None).cast("double"))
    else:
        at = stops.select("route_id", "station_id", "lon", "lat").distinct()
        near = nearest_in_group(hits.select("route_id", "id", "lon", "lat"), at, "route_id", "id", "station_id")
        hits = hits.join(near.select("route_id", "id", (F.col("distance_m") / 1000).alias("distance_to_station_km")), ["route_id", "id"], "left")
    most = F.max("population").over(W.partitionBy("route_id"))
    cost = scoring.connection_cost(F.col("distance_to_route_km"), p.cost_per_km, p.station_cost)
    out = hits.withColumn("cost", cost).withColumn(
        "score", scoring.attention_score(F.col("population"), most, F.col("distance_to_route_km"), F.col("distance_to_station_km"), F.col("cost"), p.corridor_km, p.station_access_km)
    )
    out = out.where(F.col("score") >= p.min_score)
    served = F.coalesce(F.col("distance_to_station_km") <= p.station_access_km, F.lit(False))
    order = W.partitionBy("route_id").orderBy(F.desc("score"), F.desc("population"), "id")
    return out.select(
        "route_id", "id", "canonical_name", "population",
        F.round("distance_to_route_km", 3).alias("distance_to_route_km"), F.round("distance_to_station_km", 3).alias("distance_to_station_km"),
        F.round("cost", 2).alias("cost"), F.round(scoring.cost_per_thousand(F.col("cost"), F.col("population")), 2).alias("cost_per_1000"),
        served.alias("served"), "score", scoring.attention_level(F.col("score")).alias("level"), F.row_number().over(order).alias("rank"),
    )


def summary(candidates: DataFrame) -> DataFrame:
    """AGG2 of each route: counts, people, the best and the mean of the rounded scores."""
    return candidates.groupBy("route_id").agg(
        F.count("*").alias("settlements_count"),
        F.count(F.when(~F.col("served"), 1)).alias("not_served_count"),
        F.coalesce(F.sum("population"), F.lit(0)).alias("total_population"),
        F.coalesce(F.sum(F.when(~F.col("served"), F.col("population"))), F.lit(0)).alias("not_served_population"),
        F.max("score").alias("max_score"),
        F.round(F.avg("score"), 2).alias("avg_score"),
    )


def by_population(candidates: DataFrame, least: int = 0, most: int | None = None) -> DataFrame:
    """FE6: shown candidates within a range, without a new analysis."""
    out = candidates.where(F.col("population") >= least)
    return out if most is None else out.where(F.col("population") <= most)


def heatmap(settlements: DataFrame, route: DataFrame, p: CorridorParams) -> DataFrame:
    """TOP2, NUM18: the most populous places of a corridor with a weight."""
    hits = in_corridor(eligible(settlements, p), route.select("route_id", "coords"), p.corridor_km)
    best = hits.orderBy(F.desc("population"), "distance_to_route_km", F.col("canonical_name").asc_nulls_last(), "id").limit(p.max_results)
    return best.withColumn("weight", scoring.heat_weight(F.col("population"), F.max("population").over(W.partitionBy("route_id"))))


def chart_items(routes: DataFrame) -> DataFrame:
    """FE1-FE4, FE7: lengths by precedence, density, hours and deviation from the first route."""
    known = F.coalesce(*[F.nullif(F.col(c), F.lit(0.0)) for c in ("length_km", "last_stop_km", "geometry_km")])
    base = F.first("km").over(W.partitionBy("group_id").orderBy("rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    out = routes.withColumn("km", known)
    return out.select("group_id", "rank", "km", scoring.travel_hours(F.col("km")).alias("hours"), F.round(F.coalesce(F.try_divide("total_population", "km"), F.lit(0.0)), 2).alias("density"), scoring.deviation_percent(F.col("km"), base).alias("deviation"))
