"""Registered queries of single functions and small operators, each with its DuckDB text."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import arrays, geo, scoring, text, values
from trackloom.operators import audit, catalog, corridor, graph, ingest, matching, routing
from trackloom.plans.queries import PARAMS, _also, km, query
from trackloom.sources import readers, sinks

c = F.col


def _case(on: str, *options: str | None):
    """One of several texts, by the remainder of a number."""
    out = F.lit(None).cast("string")
    for k, x in enumerate(options):
        out = F.when(c(on) % len(options) == k, F.lit(x)).otherwise(out)
    return out


def _sql_case(on: str, *options: str | None) -> str:
    return f"case {on} % {len(options)} " + " ".join(f"when {k} then " + ("null" if x is None else "'" + x.replace("'", "''") + "'") for k, x in enumerate(options)) + " end"


# Text (STR8, STR13-STR20, STR23, FLT18, FLT19, FLT24)

NAMES = ["Ёлкино-2", "  ", "нет", "NaN", "Северный округ", "Тосно   Новое", "none", "район-3", None, "Москва"]
DOWNS = ["городской округ город Тверь", "null", "Внутригородской район", None, "Сельское Ёлкино", "Город  Клин"]
UPS = [None, "область", "городской округ город  Псков", "муниципальный округ Лог", "Дно"]

SQUEEZE = lambda x: f"trim(regexp_replace(translate(coalesce({x}, ''), 'ёЁ', 'еЕ'), '\\s+', ' ', 'g'))"
SLUG = lambda x: f"regexp_replace(regexp_replace(regexp_replace(replace(lower({SQUEEZE(x)}), '-', '_'), '[^0-9a-zа-я_]+', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')"
OPTIONAL = lambda x: f"case when {SQUEEZE(x)} = '' or {SLUG(x)} in ('значение_отсутствует', 'нет', 'nan', 'none', 'null') then null else {SQUEEZE(x)} end"
ADMIN = lambda x: f"regexp_matches({SLUG(x)}, 'округ|район|внутригород|муниципальный_округ|административный_округ')"
CITY = lambda x: f"'г. ' || nullif(trim(regexp_extract({SQUEEZE(x)}, '(?i)город +(.+)$', 1)), '')"
PLAIN = lambda x: f"case when {x} is not null and not {ADMIN(x)} then {x} end"


@query(
    f"""select id, o as optional, {ADMIN('a')} as administrative, {CITY('d')} as city, coalesce({PLAIN('o')}, {PLAIN('p')}, {CITY('p')}, {CITY('q')}, {PLAIN('q')}, o) as place, nullif(trim(a), '') as trimmed
  from (select *, {OPTIONAL('a')} as o, {OPTIONAL('d')} as p, {OPTIONAL('u')} as q from (select id, {_sql_case('id', *NAMES)} as a, {_sql_case('id', *DOWNS)} as d, {_sql_case('id', *UPS)} as u from settlements) x) y"""
)
def place_names(t):
    s = t.settlements.select("id", _case("id", *NAMES).alias("a"), _case("id", *DOWNS).alias("d"), _case("id", *UPS).alias("u"))
    place = text.canonical_place(c("a"), c("d"), c("u"))
    return s.select("id", text.optional(c("a")).alias("optional"), text.administrative(c("a")).alias("administrative"), text.city_of(c("d")).alias("city"), place.alias("place"), text.blank_to_null(c("a")).alias("trimmed"))


@query(f"select id, upper(regexp_replace(translate(trim(a), 'Ёё', 'Ее'), '[^A-ZА-Я0-9]', '', 'g')) as quirk from (select id, concat({_sql_case('id', *[n or '' for n in NAMES])}, ' ', name) as a from stations) x")
def quirk_names(t):
    return t.stations.select("id", F.concat(_case("id", *[n or "" for n in NAMES]), F.lit(" "), "name").alias("a")).select("id", text.import_name_quirk(c("a")).alias("quirk"))


@query("select route_id, string_agg(r, '|' order by r) as scope_key from (select distinct route_id, region_code as r from route_stops s join stations t on t.id = s.station_id) x group by 1")
def scope_keys(t):
    s = t.route_stops.join(t.stations.select(c("id").alias("station_id"), "region_code"), "station_id")
    return s.groupBy("route_id").agg(arrays.scope_key(F.array_append(F.transform(F.collect_list("region_code"), lambda x: F.concat(x, F.lit(" "))), F.lit(" "))).alias("scope_key"))


@query(
    """select id, coalesce(nullif(trim(g), ''), case when tr is not null and d is not null then concat_ws(':', tr, d) end, case when tr is not null and n is not null then concat_ws(':', tr, n) end) as external from
  (select id, case when id % 5 = 0 then concat('X', id) else ' ' end as g, case when id % 7 <> 0 then train_number end as tr, case when id % 3 = 0 then '2026-01-01' end as d, case when id % 4 <> 0 then route_name end as n from routes) x"""
)
def route_ids(t):
    r = t.routes.select("id", F.when(c("id") % 5 == 0, F.concat(F.lit("X"), "id")).otherwise(" ").alias("g"), F.when(c("id") % 7 != 0, c("train_number")).alias("tr"), F.when(c("id") % 3 == 0, "2026-01-01").alias("d"), F.when(c("id") % 4 != 0, c("route_name")).alias("n"))
    return r.select("id", text.external_route_id(c("g"), c("tr"), c("d"), c("n")).alias("external"))


LABELS = ["[A", "B]", "A, B", "A - B", "A-B", "C", " [x ", None]


@query(f"select id, nullif(trim(k), '') is null and (n like '[%' or n like '%]' or n like '%,%' or n like '% - %') as is_label from (select id, trim(coalesce({_sql_case('id', *LABELS)}, '')) as n, case when id % 3 = 0 then ' ' when id % 3 = 1 then null else 'c' end as k from settlements) x")
def label_stops(t):
    s = t.settlements.select("id", _case("id", *LABELS).alias("n"), F.when(c("id") % 3 == 0, " ").when(c("id") % 3 == 2, "c").alias("k"))
    return s.select("id", text.route_label(c("n"), c("k")).alias("is_label"))


LEVELS = ["Населённый пункт", "НП", "np", "нпх", "city", "Locality", "Settlement", "Анонимный населенный пункт", "село", "", None, "город", "place"]


@query(
    f"""select id, case when l like '%аноним%' then false else l = '' or l like '%населен%' or l like '%settlement%' or l like '%locality%' or l in ('нп', 'np') end as is_settlement, {SLUG('r')} in ('asia', 'europe') as wanted
  from (select id, lower({SQUEEZE(_sql_case('id', *LEVELS))}) as l, federal_district as r from settlements) x"""
)
def settlement_levels(t):
    return t.settlements.select("id", ingest.is_settlement_level(_case("id", *LEVELS)).alias("is_settlement"), ingest.matches(c("federal_district"), ("Asia ", "EUROPE")).alias("wanted"))


@query(
    f"""select reason, count(*) as n from (select case when not (case when l like '%аноним%' then false else l = '' or l like '%населен%' or l like '%settlement%' or l like '%locality%' or l in ('нп', 'np') end) then 'level'
  when {SLUG('federal_district')} not in ('asia', 'africa') then 'district' when {SLUG('region')} not in ('china', 'egypt', 'kenya', 'india') then 'region' when population < 100000 then 'population' else 'kept' end as reason
  from (select *, lower({SQUEEZE(_sql_case('id', *LEVELS))}) as l from settlements) s) x group by 1"""
)
def filtered_settlements(t):
    raw = t.settlements.select(c("id").cast("string").alias("id"), _case("id", *LEVELS).alias("Уровень"), c("canonical_name").alias("Наименование"), c("region").alias("Субъект"), c("federal_district").alias("Федеральный округ"), c("population").cast("string").alias("население"), "lat", "lon")
    keep = ingest.SettlementFilter(districts=("ASIA", "africa"), regions=("China", "EGYPT", "Kenya", "India"), min_population=100_000)
    return ingest.normalise_settlements(raw, None, keep).groupBy(F.coalesce("skip_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("select id, canonical_name from settlements where population >= 1000 and id % 4 <> 0 and id % 4 <> 2")
def single_settlements(t):
    odd = F.when(c("id") % 4 == 0, F.concat(F.lit("Прочие сельские населённые пункты "), "canonical_name")).when(c("id") % 4 == 2, F.concat("canonical_name", F.lit(" сельсовет"))).otherwise(c("canonical_name"))
    return corridor.eligible(t.settlements.withColumn("canonical_name", odd), PARAMS).select("id", "canonical_name")


# Numbers and dates (NUM12, NUM20, NUM22, NUM23, DAT1, DAT3, DAT4, FLT22, FLT23, TOP13, JSN4, JSN5)

CLOCKS = ["5", "00:05", "1:20", "1 ч 20 мин", "20 мин", "2 ч", "около 7 минут", "12:345", "through 9 gates", "", None, "1:5", "abc"]
MINUTES = [5, 5, 80, 80, 20, 120, 7, 12, 9, None, None, 1, None]


@query(f"select id, case id % {len(MINUTES)} " + " ".join(f"when {k} then {'null' if m is None else m}" for k, m in enumerate(MINUTES)) + " end as minutes from settlements")
def waiting_times(t):
    return t.settlements.select("id", values.parse_minutes(_case("id", *CLOCKS)).alias("minutes"))


@query("select id, case when id % 5 = 0 then null else round(lat, 4) end as a, case when id % 5 = 0 then null else floor(lon * 10) / 10 end as km, round(lat * 100 / 111320, 8) as degrees from settlements")
def parsed_numbers(t):
    s = t.settlements
    number = F.when(c("id") % 5 == 0, "n/a").when(c("id") % 2 == 0, F.translate(F.round("lat", 4).cast("string"), ".", ",")).otherwise(F.concat(F.lit(" "), F.round("lat", 4).cast("string"), F.lit(" °")))
    way = F.when(c("id") % 5 == 0, "none").otherwise(F.concat(F.lit("about "), (F.floor(c("lon") * 10) / 10).cast("string"), F.lit(" km, 2nd")))
    return s.select("id", values.parse_float(number).alias("a"), values.parse_distance_km(way).alias("km"), F.round(geo.metres_to_degrees(c("lat") * 100), 8).alias("degrees"))


@query("select id, round(greatest(0.01, least(1, greatest(case when id % 3 = 0 then greatest(s, 0.92) else s end, case when id % 4 = 0 then 0.97 else 0 end) + case when id % 5 = 0 then 0.03 else 0 end)), 6) as score from (select id, (population % 1000) / 1000 as s from settlements) x")
def effective_scores(t):
    s = t.settlements.select("id", ((c("population") % 1000) / 1000).alias("s"))
    return s.select("id", F.round(scoring.effective_score(c("s"), c("id") % 3 == 0, c("id") % 4 == 0, c("id") % 5 == 0), 6).alias("score"))


@query(
    """select id, round(greatest(0, 1 - e) * 8 + greatest(0, 0.85 - f) * 10 - case when c then 5 else 0 end - case when a then 2 else 0 end
  + case when not h then 0 when id % 3 = 0 then case when f >= 0.72 then -4 else 8 end when f < 0.72 and not c then 2 else 0 end + case when id % 11 = 0 then 1 else 0 end, 6) as cost
  from (select id, (population % 1000) / 1000 as e, (population % 97) / 97 as f, id % 5 = 0 as c, id % 7 = 0 as a, id % 2 = 0 as h from settlements) x"""
)
def lock_costs(t):
    s = t.settlements
    cost = scoring.lock_cost(c("population") % 1000 / 1000, c("population") % 97 / 97, c("id") % 5 == 0, c("id") % 7 == 0, c("id") % 3 == 0, c("id") % 2 == 0, c("id") % 11 == 0)
    return s.select("id", F.round(cost, 6).alias("cost"))


@query("select id, (population % 100) / 100 >= 0.3 and ((population % 70) / 100 >= 0.25 or id % 6 = 0) and (id % 5 = 0 or lon * 4 <= 150) as usable, (population % 40) / 10 <= 1.5 as accepted from settlements")
def usable_codes(t):
    s = t.settlements.withColumn("air_km", (c("population") % 40) / 10)
    return routing.within_air(s).select("id", scoring.code_usable((c("population") % 100) / 100, (c("population") % 70) / 100, c("id") % 6 == 0, F.when(c("id") % 5 != 0, c("lon") * 4)).alias("usable"), "accepted")


@query("select station_id, code from (select id % 97 as station_id, concat('c', id) as code, row_number() over (partition by id % 97 order by round(km / 50) desc, case when id % 5 = 0 then 999 else id % 5 end, source, concat('c', id)) as n from names) x where n = 1")
def recommended_codes(t):
    s = t.names.select((c("id") % 97).alias("station_id"), F.concat(F.lit("c"), "id").alias("code"), "source", (c("id") % 5).alias("base_priority"), F.round(c("km") / 50).alias("final_score"))
    return catalog.recommended_codes(s).select("station_id", "code")


@query(
    """select strftime(d, '%Y-%m-%d') as day, case when n = 0 and k % 4 = 0 then 'failed' when n = 0 then 'empty' when k % 4 = 0 then 'partial' else 'ok' end as status, n as trains from (
  select d, cast(day(d) as integer) as k, (select count(distinct (user_id % 20, event_type)) from events where event_id % 40 = day(d)) as n from (select unnest(range(date '2026-01-01', date '2026-01-29', interval 1 day)) as d) x) y"""
)
def calendar_failures(t):
    days = catalog.calendar("2026-01-01", "2026-01-28", t.spark)
    e = t.spark.table("events").select(F.expr("date_add(date '2025-12-31', cast(event_id % 40 as int))").alias("day"), (c("user_id") % 20).cast("string").alias("train_number"), F.lit("a").alias("from_code"), c("event_type").alias("to_code"), F.lit("08:00").alias("departure_time"), "event_id").where("event_id % 40 between 1 and 28")
    errors = days.where("day(day) % 4 = 0").select("day", F.lit("timeout").alias("error"))
    return catalog.calendar_status(days, e, errors).select(c("day").cast("string").alias("day"), "status", "trains")


@query("select id, finished_at is not null as started, true as stamped from runs")
def stamped_runs(t):
    out = catalog.touched(t.runs.where("finished_at is not null").withColumn("started_at", c("finished_at")), "started_at").select("id", (c("started_at") == c("finished_at")).alias("started"), c("updated_at").isNotNull().alias("stamped"))
    new = catalog.touched(t.runs.where("finished_at is null").withColumn("started_at", c("finished_at")), "started_at").select("id", c("started_at").isNull().alias("started"), c("updated_at").isNotNull().alias("stamped"))
    return out.unionByName(new)


@query("select id, case when id % 4 = 3 or id % 5 = 0 then null else round(lon, 2) end as lon, case when id % 4 = 3 or id % 5 = 0 then null else round(lat, 2) end as lat from settlements")
def json_points(t):
    keys = [("lon", "lat"), ("x", "y"), ("Longitude", "Latitude"), ("east", "north")]
    pick = lambda k: _case("id", *[p[k] for p in keys])
    lat = F.when(c("id") % 5 == 0, F.lit("95.5")).otherwise(F.translate(F.round("lat", 2).cast("string"), ".", ","))
    raw = F.concat(F.lit('{"'), pick(0), F.lit('":"'), F.round("lon", 2).cast("string"), F.lit('","'), pick(1), F.lit('":"'), lat, F.lit('"}'))
    return t.settlements.select("id", values.lon_lat(raw).alias("p")).select("id", "p.lon", "p.lat")


@query("select id, case when id % 3 = 0 then null else concat('R', id) end as rid, case when id % 3 = 0 then null else name end as name from stations")
def xml_answers(t):
    raw = F.when(c("id") % 3 == 0, "<answer><RID>").otherwise(F.concat(F.lit("<answer><RID>R"), "id", F.lit("</RID><Name>"), "name", F.lit("</Name></answer>")))
    return t.stations.select("id", readers.xml_fields(raw, ["RID", "Name"]).alias("x")).select("id", c("x.RID").alias("rid"), c("x.Name").alias("name"))


@query("select event_id as payload_id, cast(1 as integer) as position, concat('T', user_id) as number, '1' as date0 from events union all select event_id, 2, '7', null from events", name="payload_trains")
def _payload_trains(t):
    p = t.spark.table("events").select(c("event_id").alias("payload_id"), F.concat(F.lit('{"tp":[{"list":[{"number":"T'), c("user_id").cast("string"), F.lit('","date0":"1","inner":{"trainNumber":7}},{"number":"T'), c("user_id").cast("string"), F.lit('","date0":"1"}]}]}')).alias("payload"))
    return readers.trains(p).select("payload_id", "position", "number", "date0")


@query("select event_id as payload_id, cast(1 as integer) as position, event_type as name, 'c1' as code from events union all select event_id, 2, 'Last', case when event_id % 2 = 0 then 'c2' end from events")
def payload_stops(t):
    last = F.when(c("event_id") % 2 == 0, F.lit('{"Station":"Last","Code":"c2"}')).otherwise(F.lit('{"name":"Last","code":""}'))
    raw = F.concat(F.lit('{"data":{"routes":[{"stops":[{"station":"'), "event_type", F.lit('","code":"c1"},{"stationName":"'), "event_type", F.lit('","StationCode":"c1"},'), last, F.lit("]}]}}"))
    return readers.train_stops(t.spark.table("events").select(c("event_id").alias("payload_id"), raw.alias("payload"))).select("payload_id", "position", "name", "code")


# Geometry (GEO2, GEO8, GEO9, GEO17, GEO18, GEO20, ARR1-ARR5, STR22, SNK10)

S = "(power(sin(g), 2) * power(cos(l), 2) + power(cos(f), 2) * power(sin(l), 2))"
C = "(power(cos(g), 2) * power(cos(l), 2) + power(sin(f), 2) * power(sin(l), 2))"


@query(
    f"""select id, round(2 * w * 6378.137 * (1 + k * ((3 * r - 1) / (2 * c)) * power(sin(f), 2) * power(cos(g), 2) - k * ((3 * r + 1) / (2 * s)) * power(cos(f), 2) * power(sin(g), 2)), 6) as km from (
  select *, sqrt(s * c) / w as r, 1 / 298.257223563 as k from (select *, {S} as s, {C} as c, atan2(sqrt({S}), sqrt({C})) as w from (
  select id, radians(lat + 55.75) / 2 as f, radians(lat - 55.75) / 2 as g, radians(lon - 37.613) / 2 as l from settlements) x) y) z"""
)
def spheroid_distances(t):
    return t.settlements.select("id", F.round(geo.distance_km("lon", "lat", 37.613, 55.75, "spheroid"), 6).alias("km"))


BENT = "bent as (select id, ax, ay, bx, by_, bx + 0.1 as cx, by_ + 0.05 as cy, sqrt(power(bx - ax, 2) + power(by_ - ay, 2)) as l1, sqrt(0.01 + 0.0025) as l2 from lines)"


@_also(
    BENT
    + """, feet as (select *, greatest(0, least(1, ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / (l1 * l1))) as t1, greatest(0, least(1, ((px - bx) * 0.1 + (py - by_) * 0.05) / (l2 * l2))) as t2 from (select *, bx + 0.03 as px, by_ - 0.02 as py from bent) b),
  away as (select *, power(px - ax - t1 * (bx - ax), 2) + power(py - ay - t1 * (by_ - ay), 2) as d1, power(px - bx - t2 * 0.1, 2) + power(py - by_ - t2 * 0.05, 2) as d2 from feet),
  placed as (select *, case when d1 <= d2 then t1 * l1 else l1 + t2 * l2 end / (l1 + l2) as share from away)""",
    """select id, round(share, 6) as share, round(case when share * (l1 + l2) <= l1 then ax + share * (l1 + l2) / l1 * (bx - ax) else bx + (share * (l1 + l2) - l1) / l2 * 0.1 end, 6) as end_lon, round(cx, 6) as first_back from placed""",
)
def located_points(t):
    a, b = t.lines["coords"][0], t.lines["coords"][1]
    bent = t.lines.select("id", F.array(a, b, F.struct((b["lon"] + 0.1).alias("lon"), (b["lat"] + 0.05).alias("lat"))).alias("line"), (b["lon"] + 0.03).alias("x"), (b["lat"] - 0.02).alias("y"))
    at = bent.withColumn("share", geo.locate("x", "y", c("line")))
    part = geo.substring(c("line"), F.lit(0.0), c("share"))
    return at.select("id", F.round("share", 6).alias("share"), F.round(geo.end_point(part)["lon"], 6).alias("end_lon"), F.round(geo.start_point(geo.reverse(c("line")))["lon"], 6).alias("first_back"))


@query("select id, round(ax, 6) as a, round(by_, 6) as b, concat('POINT(', cast(cast(id as double) / 2 as varchar), ' ', cast(cast(id % 7 as double) as varchar), ')') as wkt, cast(2 as integer) as points, cast(4 as integer) as many, round(ax, 6) as surface from lines")
def geometry_texts(t):
    line = geo.line_from_geojson(geo.to_geojson_line(c("coords")))
    two = F.to_json(F.struct(F.lit("MultiLineString").alias("type"), F.array(F.transform("coords", lambda p: F.array(p["lon"], p["lat"])), F.transform("coords", lambda p: F.array(p["lat"], p["lon"]))).alias("coordinates")))
    point = F.from_json(geo.to_geojson_point(c("coords")[0]["lon"], c("coords")[0]["lat"]), "type string, coordinates array<double>")
    return t.lines.select(
        "id", F.round(point["coordinates"][0], 6).alias("a"), F.round(geo.end_point(line)["lat"], 6).alias("b"), geo.to_wkt_point(c("id").cast("double") / 2, (c("id") % 7).cast("double")).alias("wkt"),
        F.size(line).alias("points"), F.size(geo.line_from_geojson(two)).alias("many"), F.round(geo.on_surface(c("coords")[0]["lon"], c("coords")[0]["lat"])["lon"], 6).alias("surface"),
    )


@query("select id, round((ax + bx) / 2, 6) as box_lon, round((ay + by_) / 2, 6) as box_lat, round((ax + bx) / 2, 6) as line_lon, round((2 * ax + bx) / 3, 4) as corner_lon from lines where ax <> bx and ay <> by_")
def centroids(t):
    a, b = c("coords")[0], c("coords")[1]
    p = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    box = F.array(a, p(b["lon"], a["lat"]), b, p(a["lon"], b["lat"]), a)
    corner = F.array(a, p(b["lon"], a["lat"]), p(a["lon"], b["lat"]), a)
    return t.lines.where((a["lon"] != b["lon"]) & (a["lat"] != b["lat"])).select("id", F.round(geo.centroid(box)["lon"], 6).alias("box_lon"), F.round(geo.centroid(box)["lat"], 6).alias("box_lat"), F.round(geo.centroid(c("coords"))["lon"], 6).alias("line_lon"), F.round(geo.centroid(corner)["lon"], 4).alias("corner_lon"))


@query(
    f"""select id, cast(3 as integer) as merged, cast(4 as integer) as apart, cast(3 as integer) as near, cast(case when ax = bx and ay = by_ then null else 2 end as integer) as simple,
  round(case when {km('45.0', '57.0', 'bx', 'by_')} < {km('45.0', '57.0', 'ax', 'ay')} then bx else ax end, 6) as first_lon from lines"""
)
def sequences(t):
    a, b = c("coords")[0], c("coords")[1]
    p = lambda x, d: F.struct((x["lon"] + d).alias("lon"), x["lat"].alias("lat"))
    n = lambda x: F.size(x).cast("int")
    return t.lines.select(
        "id", n(arrays.merge_sequences(F.array(F.array(p(a, 9), b), F.array(b, p(b, 1))))).alias("merged"), n(arrays.merge_sequences(F.array(F.array(p(a, 9), b), F.array(p(b, 1e-11), p(b, 1))))).alias("apart"),
        n(arrays.merge_sequences(F.array(F.array(p(a, 9), b), F.array(p(b, 1e-11), p(b, 1))), 1e-10)).alias("near"), n(arrays.simple_line(F.array(a, a, b, b))).alias("simple"), F.round(geo.start_point(arrays.oriented(c("coords"), F.lit(45.0), F.lit(57.0)))["lon"], 6).alias("first_lon"),
    )


@query("select count(*) as lines, count(distinct (ax, ay, bx, by_)) as segments, count(*) filter (where ax <> bx or ay <> by_) as turned from lines")
def segment_hashes(t):
    h, back = geo.segment_hash(c("coords")), geo.segment_hash(F.reverse("coords"))
    return t.lines.agg(F.count("*").alias("lines"), F.countDistinct(h).alias("segments"), F.count(F.when(h != back, 1)).alias("turned"))


@query("select region_code, count(*) as features, round(sum(ax), 4) as lon, count(distinct name) as names from lines group by 1", name="line_collections")
def _line_collections(t):
    kind = "type string, features array<struct<type:string,geometry:struct<type:string,coordinates:array<array<double>>>,properties:struct<id:long,name:string>>>"
    g = sinks.line_collection(t.lines, "region_code", ["id", "name"]).select("region_code", F.explode(F.from_json("geojson", kind)["features"]).alias("f"))
    return g.groupBy("region_code").agg(F.count("*").alias("features"), F.round(F.sum(c("f.geometry.coordinates")[0][0]), 4).alias("lon"), F.countDistinct("f.properties.name").alias("names"))


# Sets and regions (SET4, SET6, SET7, SET9, JON12, JON15, JON23, AGG15, AGG16, AGG23, AGG26, TOP14, WIN3, UDF0, FE6, FE8)


@query("select edge_id, src, dst, round(length_km, 6) as length_km, 'rail_graph_edge' as edge_source from chain union all select null, dst, src, round(length_km / 10, 6), 'connector' from chain where src % 4 = 0")
def edges_and_connectors(t):
    extra = t.chain.where("src % 4 = 0").select("scope_key", c("dst").alias("src"), c("src").alias("dst"), (c("length_km") / 10).alias("length_km"), F.lit(15.0).alias("cost_multiplier"))
    return graph.with_connectors(t.chain, extra).select("edge_id", "src", "dst", F.round("length_km", 6).alias("length_km"), "edge_source")


@query("select distinct r_name as scope_key from region where r_name not in (select region_code from stations where id % 37 = 0)")
def missing_scopes(t):
    return catalog.missing_scopes(t.boxes.select(c("region_code").alias("scope_key")), t.stations.where("id % 37 = 0").select(c("region_code").alias("scope_key")))


@query("select a.route_id as a, b.route_id as b, len(list_intersect(a.s, b.s)) > 0 as shared from (select route_id, list(distinct station_id) as s from route_stops where station_id is not null group by 1) a join (select route_id, list(distinct station_id) as s from route_stops where station_id is not null group by 1) b on b.route_id = a.route_id + 1")
def shared_sets(t):
    s = t.route_stops.where("station_id is not null").groupBy("route_id").agg(F.collect_set("station_id").alias("s"))
    b = s.select((c("route_id") - 1).alias("route_id"), c("route_id").alias("b"), c("s").alias("u"))
    return s.join(b, "route_id").select(c("route_id").alias("a"), "b", graph.shares_component(c("s"), c("u")).alias("shared"))


@_also(
    f"deg as (select node, count(*) as degree from (select src as node from chain union all select dst from chain) x group by 1), near as (select p.id, s.id as node, degree, {km('p.lon', 'p.lat', 's.lon', 's.lat')} as d from settlements p, stations s join deg on deg.node = s.id)",
    "select id, node, degree, cast(rank as integer) as rank from (select *, row_number() over (partition by id order by round(d, 6), degree desc, node) as rank from near where d <= 300) x where rank <= 4",
)
def nearest_nodes(t):
    nodes = t.stations.select(c("id").alias("node"), "lon", "lat").join(graph.degrees(t.chain), "node")
    return routing.nearest_nodes(t.settlements.select("id", "lon", "lat"), nodes, 300.0, 4).select("id", "node", "degree", "rank")


@query(
    """select pair_id, source, target, round(start_km + end_km, 6) as km from (select *, row_number() over (partition by pair_id, source, target order by start_km + end_km, p desc, q desc) as n from (
  select a.station_id as pair_id, a.node as source, b.node as target, a.link_distance_m / 1000 as start_km, b.link_distance_m / 1000 as end_km, a.is_primary as p, b.is_primary as q from links a join links b on b.station_id = a.station_id + 1 where a.node % 40 = 0 and b.node % 40 = 1) x where source <> target) y where n = 1"""
)
def link_pairs(t):
    a = t.links.where("node % 40 = 0").select(c("station_id").alias("pair_id"), "node", (c("link_distance_m") / 1000).alias("link_distance_km"), "is_primary")
    b = t.links.where("node % 40 = 1").select((c("station_id") - 1).alias("pair_id"), "node", (c("link_distance_m") / 1000).alias("link_distance_km"), "is_primary")
    return routing.link_pairs(a, b).select("pair_id", "source", "target", F.round(c("start_km") + c("end_km"), 6).alias("km"))


TOUCHED = """touched as (select l.id, l.region_code, b.region_code as hit from lines l left join boxes b on case when bx = ax then (ax between west and east) else true end and case when by_ = ay then (ay between south and north) else true end
  and greatest(0, case when bx = ax then 0 else least((west - ax) / (bx - ax), (east - ax) / (bx - ax)) end, case when by_ = ay then 0 else least((south - ay) / (by_ - ay), (north - ay) / (by_ - ay)) end)
   <= least(1, case when bx = ax then 1 else greatest((west - ax) / (bx - ax), (east - ax) / (bx - ax)) end, case when by_ = ay then 1 else greatest((south - ay) / (by_ - ay), (north - ay) / (by_ - ay)) end))"""


@_also(TOUCHED, "select id, count(distinct hit) as regions from touched group by 1 having count(distinct hit) > 1")
def multi_region_lines(t):
    return audit.multi_region(audit.line_hits(t.lines, t.polygons))


@_also(
    TOUCHED
    + """, classified as (select *, case when n = 0 then 'outside_all' when n = 1 and own then 'own_region_only' when n = 1 then 'other_region_only' when own then 'own_and_others' else 'several_others' end as category from
  (select id, region_code, count(hit) as n, coalesce(bool_or(hit = region_code), false) as own from touched group by 1, 2) x)""",
    "select id, category, cast(rn as integer) as rn from (select *, row_number() over (partition by category order by region_code, id) as rn from classified) x where rn <= 7",
)
def line_samples(t):
    return audit.samples(audit.classify_hits(audit.line_hits(t.lines, t.polygons)), 7).select("id", "category", "rn")


@query("select region, canonical_name, sum(n) as rows_count, cast(sum(p) as bigint) as population from (select region, concat('г. ', settlement_type) as canonical_name, id % 6 as k, count(*) as n, sum(population) as p from settlements group by 1, 2, 3) x group by 1, 2")
def city_settlements(t):
    rows = t.settlements.select(c("id").cast("string").alias("source_row_id"), F.concat(F.lit("г. "), "settlement_type").alias("canonical_name"), F.when(c("id") % 2 == 0, "Город").alias("settlement_type"), "region", (c("id") % 6).cast("string").alias("oktmo"), F.lit(None).cast("string").alias("fias_code"), "population", "lat", "lon")
    return ingest.aggregate_settlements(rows).select("region", "canonical_name", "rows_count", c("population").cast("bigint").alias("population"))


FIRST = "first_ as (select r.route_id, r.stop_sequence, s.region_code, (r.station_id * 37 % 100) / 100.0 as e, r.station_id % 6 = 0 as code_match, r.station_id % 10 = 0 as anchor from route_stops r join stations s on s.id = r.station_id)"


def _first(t):
    s = t.route_stops.join(t.stations.select(c("id").alias("station_id"), "region_code"), "station_id")
    return s.select("route_id", "stop_sequence", F.lit(1).alias("rank"), "region_code", (c("station_id") * 37 % 100 / 100).alias("effective_score"), (c("station_id") % 6 == 0).alias("code_match"), (c("station_id") % 10 == 0).alias("anchor"))


WEIGHED = FIRST + ", weighed as (select route_id, region_code, round(sum(greatest(0.1, e) * 3 + case when code_match then 2 else 0 end + case when anchor then 2.5 else 0 end + case when e >= 0.88 then 0.8 else 0 end), 4) as weight, min(stop_sequence) as seen from first_ group by 1, 2)"


@_also(WEIGHED, "select route_id, region_code, cast(weight as double) as weight, cast(row_number() over (partition by route_id order by weight desc, seen, region_code) as integer) as rank from weighed")
def region_weights(t):
    return matching.region_weights(_first(t)).select("route_id", "region_code", "weight", "rank")


@_also(
    WEIGHED
    + """, hints as (select route_id, region_code, 1 as k, stop_sequence as o from first_ where anchor union all select route_id, region_code, 2, stop_sequence from first_ where code_match
  union all select route_id, region_code, 3, stop_sequence from first_ where anchor or code_match or e >= 0.88 union all select route_id, region_code, 4, stop_sequence from first_
  union all select route_id, region_code, 5, row_number() over (partition by route_id order by weight desc, seen, region_code) from weighed), firsts as (
  select route_id, region_code, min((k, o)) as place_ from hints group by 1, 2), strict_ as (select route_id, region_code, min((k, o)) as place_ from hints where k <= 3 group by 1, 2)""",
    """select f.route_id, coalesce(any_value(s.r), '') as strict, string_agg(f.region_code, ',' order by f.place_) as regions from firsts f left join (select route_id, string_agg(region_code, ',' order by place_) as r from strict_ group by 1) s on s.route_id = f.route_id group by 1""",
)
def region_hints(t):
    return matching.route_regions(_first(t)).select("route_id", F.array_join("strict", ",").alias("strict"), F.array_join("regions", ",").alias("regions"))


@query("select id, case when station_type = 'halt' and id not in (select station_id from trunk where station_id % 2 = 0) and lon < 30 + 8.0 * region_id + 8.005 and lon >= 30 + 8.0 * region_id and lat <= 62.505 then 'archived' else 'kept' end as state from stations")
def archived_stations(t):
    kept, gone = ingest.remove_in_zones(t.stations, t.polygons, t.trunk.where("station_id % 2 = 0"))
    return kept.select("id", F.lit("kept").alias("state")).unionByName(gone.select("id", F.lit("archived").alias("state")))


@query("select id from settlements where population between 5000 and 400000")
def shown_candidates(t):
    p = corridor.CorridorParams.of({"minPopulation": 5000, "maxPopulation": 400_000, "corridorKm": None, "max_results": 7})
    return corridor.by_population(t.settlements, p.min_population, p.max_population).select("id")
