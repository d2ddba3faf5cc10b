"""Transport views of the driver's tables: one SQL text that both engines run."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

VIEWS = {
    "stations": """
select s.s_suppkey as id, r.r_name as region_code, s.s_name as name,
  case when s.s_suppkey % 3 <> 0 then cast(2000000 + s.s_suppkey % 40 as varchar(20)) end as uic_ref,
  case when s.s_suppkey % 4 = 0 then cast(100000 + s.s_suppkey as varchar(20)) end as esr_user,
  case when s.s_suppkey % 5 = 0 then 'halt' else 'station' end as station_type,
  s.s_suppkey % 5 = 0 as is_main_rail_station, s.s_suppkey % 7 <> 0 as is_visible_default, r.r_regionkey as region_id,
  30 + cast((s.s_suppkey * 7919) % 4000 as double) / 100 as lon,
  50 + cast((s.s_suppkey * 104729) % 1500 as double) / 100 as lat
from supplier s join nation n on n.n_nationkey = s.s_nationkey join region r on r.r_regionkey = n.n_regionkey""",
    "settlements": """
select c.c_custkey as id, c.c_name as canonical_name, c.c_mktsegment as settlement_type,
  n.n_name as region, r.r_name as federal_district, cast(floor(abs(c.c_acctbal) * 100) as bigint) as population,
  30 + cast((c.c_custkey * 6151) % 4000 as double) / 100 as lon,
  50 + cast((c.c_custkey * 3571) % 1500 as double) / 100 as lat
from customer c join nation n on n.n_nationkey = c.c_nationkey join region r on r.r_regionkey = n.n_regionkey""",
    "route_stops": """
select l_orderkey as route_id,
  row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as stop_sequence,
  case when l_suppkey % 11 <> 0 then l_suppkey end as station_id, l_quantity as leg_km, cast(100000 + l_suppkey as varchar(20)) as station_code
from lineitem""",
    "routes": """
select o_orderkey as id, o_orderpriority as route_name, cast(o_custkey as varchar(20)) as train_number, o_orderstatus <> 'P' as is_active,
  o_orderpriority as origin_name, o_orderstatus as destination_name from orders""",
    "trunk": """
select region_id as route_id, row_number() over (partition by region_id order by lon, id) as stop_sequence, id as station_id, lon, lat from stations""",
    "trunk_segments": """
select route_id, stop_sequence as seg, lon as bx, lat as by_, ax, ay, station_id as dst, src from (
  select *, lag(lon) over (partition by route_id order by stop_sequence) as ax, lag(lat) over (partition by route_id order by stop_sequence) as ay,
    lag(station_id) over (partition by route_id order by stop_sequence) as src from trunk) t where ax is not null""",
    "edges": """
select cast(src * 1000000000 + dst as bigint) as edge_id, 'all' as scope_key, src, dst, n as n, cast(km as double) as length_km from (
  select least(a.station_id, b.station_id) as src, greatest(a.station_id, b.station_id) as dst, count(*) as n, min(b.leg_km) as km
  from route_stops a join route_stops b on b.route_id = a.route_id and b.stop_sequence = a.stop_sequence + 1
  where a.station_id <> b.station_id group by 1, 2) e""",
    "chain": """
select cast(s_suppkey as bigint) as edge_id, case when s_suppkey % 2 = 0 then 'even' else 'odd' end as scope_key, cast(s_suppkey as bigint) as src,
  cast(case when s_suppkey % 10 = 1 then s_suppkey + 12 else s_suppkey + 2 end as bigint) as dst, cast(1 + s_suppkey % 9 as double) as length_km
from supplier where s_suppkey % 13 <> 0""",
    "lines": """
select p_partkey as id, r_name as region_code, p_name as name, case when p_size % 4 = 0 then 'yard' end as service_type,
  p_size % 4 = 0 or p_size % 9 = 0 as is_service_line, p_size % 4 <> 0 and p_size % 9 <> 0 and p_size % 5 <> 0 as is_main_passenger_line,
  p_size % 4 <> 0 and p_size % 9 <> 0 and p_size % 5 <> 0 as is_visible_default,
  30 + cast((p_partkey * 7919) % 4000 as double) / 100 as ax, 50 + cast((p_partkey * 104729) % 1500 as double) / 100 as ay,
  30 + cast((p_partkey * 7919) % 4000 as double) / 100 + cast(p_size as double) / 200 as bx,
  50 + cast((p_partkey * 104729) % 1500 as double) / 100 + cast(p_size % 7 as double) / 100 as by_
from part join region on r_regionkey = p_partkey % 5""",
    "boxes": """
select r_name as region_code, 30 + 8.0e0 * r_regionkey as west, cast(50 as double) as south, 38.005e0 + 8.0e0 * r_regionkey as east, cast(62.505 as double) as north from region""",
    "runs": """
select event_id as id, r_name as region_code, case when event_type in ('view', 'purchase') then 'success' when event_type = 'error' then 'failed' else 'running' end as status,
  case when event_id % 6 <> 0 then md5(cast(event_id % 100 as varchar(20))) end as source_md5, case when event_id % 7 <> 0 then ts end as finished_at
from events join region on r_regionkey = user_id % 5""",
    "stage": """
select r_name as region_code, case when event_id % 3 = 0 then 'way' else 'node' end as osm_element_type, cast(user_id as varchar(20)) as osm_id,
  case when event_id % 8 = 0 then concat('Метро ', event_type) when event_id % 9 = 0 then null else event_type end as name,
  case when event_id % 5 = 0 then 'halt' when event_id % 11 = 0 then 'yard' else 'station' end as railway, event_id as load_seq,
  concat('{"operator":"', case when event_id % 4 = 0 then 'ОАО РЖД' when event_id % 7 = 0 then 'Metro Ltd' else 'X' end, '","uic_ref":"', case when event_id % 6 = 0 then cast(event_id as varchar(20)) else '' end,
    '","usage":"', case when event_id % 2 = 0 then 'main' when event_id % 3 = 0 then 'industrial' else 'branch' end, '","service":"', case when event_id % 10 = 0 then 'yard' else '' end,
    '","passenger":"', case when event_id % 13 = 0 then 'no' else 'yes' end, '"}') as tags_json,
  30 + cast((event_id * 7919) % 4000 as double) / 100 as lon, case when event_id % 997 = 0 then cast(95 as double) else 50 + cast((event_id * 104729) % 1500 as double) / 100 end as lat
from events join region on r_regionkey = user_id % 5""",
    "links": """
select case when l_linenumber % 2 = 0 then 'even' else 'odd' end as scope_key, l_suppkey as station_id, l_partkey as node, min(l_quantity) * 40 as link_distance_m, min(l_linenumber) = 1 as is_primary
from lineitem group by 1, 2, 3""",
    "names": """
select p_partkey as id, concat('станция ', p_brand, ' ', p_type) as a, concat(p_type, '-', p_name) as b,
  cast(p_partkey as varchar(20)) as code, cast(case when p_partkey % 3 = 0 then p_partkey else 0 end as varchar(20)) as uic, cast((p_partkey * 37) % 2000 as double) / 10 as km,
  case when p_partkey % 4 = 0 then 'suggester' when p_partkey % 4 = 1 then 'osm_uic_ref' when p_partkey % 4 = 2 then 'nearby_main_station' else 'other' end as source
from part""",
}


def load(spark: SparkSession, sf_dir: str) -> SimpleNamespace:
    """All views as frames; lines and trunk also carry ``coords``."""
    for name in BASE:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    out = {}
    for name, sql in VIEWS.items():
        out[name] = spark.sql(sql)
        out[name].createOrReplaceTempView(name)
    t = SimpleNamespace(spark=spark, **out)
    end = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    t.lines = t.lines.withColumn("coords", F.array(end("ax", "ay"), end("bx", "by_"))).drop("ax", "ay", "bx", "by_")
    pts = F.array_sort(F.collect_list(F.struct("stop_sequence", "lon", "lat")))
    t.trunk_lines = t.trunk.groupBy("route_id").agg(F.transform(pts, lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("coords"))
    box = [("west", "south"), ("east", "south"), ("east", "north"), ("west", "north"), ("west", "south")]
    t.polygons = t.boxes.select("region_code", F.array(F.array(*[end(x, y) for x, y in box])).alias("rings"))
    return t


ROWS_A_TASK = 400_000


def dealt_links(spark: SparkSession) -> tuple[DataFrame, int]:
    """The view ``links`` over line items that are dealt by station, and to how many tasks: a task's share does not grow with them."""
    items = spark.table("lineitem")
    tasks = max(spark.sparkContext.defaultParallelism, -(-items.count() // ROWS_A_TASK))
    try:
        items.repartition(tasks, "l_suppkey").createOrReplaceTempView("lineitem")
        return spark.sql(VIEWS["links"]), tasks
    finally:
        items.createOrReplaceTempView("lineitem")


def with_views(select: str) -> str:
    """A DuckDB query over the views."""
    return "with " + ",\n".join(f"{n} as ({sql})" for n, sql in VIEWS.items()) + "\n" + select


