"""Alignment, as-of, schedule and matching queries."""

from pyspark.sql import functions as F

from hydroloom.operators import joins, network
from hydroloom.plans.registry import query

MAPS = """select l_partkey as cell_id, year(l_shipdate) * 12 + month(l_shipdate) - 1 as slot, sum(l_quantity) as map_value
  from lineitem where l_shipdate < timestamp '1999-07-01' group by 1, 2"""


def _maps(v):
    return v.sql(MAPS).withColumn("slot", F.col("slot").cast("int"))


@query("asof_period_map", f"""with m as ({MAPS}), e as (select max(slot) as hi from m),
k as (select cell_id, date, value, case when year(date) * 12 + month(date) - 1 > hi then hi - 11 + (year(date) * 12 + month(date) - 1 - hi - 1) % 12
  else year(date) * 12 + month(date) - 1 end as slot from cell_day, e)
select cell_id, date, value, map_value from k left join m using (cell_id, slot)""")
def _(v):
    return joins.asof_period_map(v.cell_day, _maps(v), ["cell_id"]).select("cell_id", "date", "value", "map_value")


YEARMAPS = """select l_partkey as cell_id, year(l_shipdate) as slot, max(l_quantity) as map_value
  from lineitem where l_shipdate >= timestamp '1997-01-01' and l_shipdate < timestamp '1999-01-01' group by 1, 2"""


@query("asof_period_map_year", f"""with m as ({YEARMAPS}) select d.cell_id, date, value, map_value from cell_day d left join m
  on m.cell_id = d.cell_id and m.slot = greatest(1997, least(1998, year(date)))""")
def _(v):
    return joins.asof_period_map(v.cell_day, v.sql(YEARMAPS), ["cell_id"], "year").select("cell_id", "date", "value", "map_value")


@query("asof_nearest_day", """with s as (select l_suppkey as station_id, l_shipdate::date as date, sum(l_extendedprice) as map_value from lineitem where l_linestatus = 'F' group by 1, 2),
r as (select station_id, date from pairs),
j as (select r.station_id, r.date, arg_min(s.date, (abs(datediff('day', s.date, r.date)), s.date)) as slice_date from r join s using (station_id) group by 1, 2)
select j.station_id, j.date, slice_date, round(map_value, 3) as map_value from j join s on s.station_id = j.station_id and s.date = slice_date""")
def _(v):
    # Slices exist only for the days with shipped items.
    slices = v.table("lineitem").filter("l_linestatus = 'F'").groupBy(F.col("l_suppkey").alias("station_id"), F.to_date("l_shipdate").alias("date")).agg(
        F.sum("l_extendedprice").alias("map_value")
    )
    rows = v.pairs.select("station_id", "date")
    return joins.asof_nearest_day(rows, slices, ["station_id"]).withColumn("map_value", F.round("map_value", 3))


PLANTS = """select o_custkey as plant_id, o_orderkey as ord, year(o_orderdate) as from_year,
  case when o_orderstatus = 'O' then cast(null as int) else cast(year(o_orderdate) + o_orderkey % 3 as int) end as to_year, o_totalprice as volume from orders"""


@query("active_version", f"""with p as ({PLANTS}), y as (select range::int as year from range(1995, 2002)),
r as (select plant_id, year, volume, ord, row_number() over (partition by plant_id, year order by ord) as n from p join y
  on from_year <= year and (to_year is null or to_year >= year))
select plant_id, year, ord, volume from r where n = 1""")
def _(v):
    plants = v.sql(PLANTS).withColumn("from_year", F.col("from_year").cast("int"))
    years = v.spark.range(1995, 2002).select(F.col("id").cast("int").alias("year"))
    return joins.active_version(plants, years).select("plant_id", "year", "ord", "volume")


def _tree(v):
    nearest = network.subcatchment(v.ldd, v.gauge)
    return network.gauge_tree(v.ldd, v.gauge, nearest)


TREE = """path(cell_id, pos, n) as (select cell_id, cell_id, 0::bigint from ldd
  union all select p.cell_id, l.down_id, n + 1 from path p join ldd l on l.cell_id = p.pos where l.down_id is not null),
near as (select path.cell_id, arg_min(g.gauge_id, n) as gauge_id from path join gauge g on g.cell_id = path.pos group by 1),
tree as (select g.gauge_id, near.gauge_id as parent_id from gauge g join ldd using (cell_id) left join near on near.cell_id = ldd.down_id),
link as (select parent_id as gauge_id, gauge_id as inflow_id from tree where parent_id is not null)"""


@query("join_inflow_series", f"""with recursive {TREE}, s as (select station_id as inflow_id, date, sum(q) as q from runs group by 1, 2),
f as (select gauge_id, min(inflow_id) as inflow_id from link group by 1),
d as (select f.gauge_id, s.date from f join s using (inflow_id))
select l.gauge_id, l.inflow_id, d.date, round(s.q, 3) as q from link l join d using (gauge_id) left join s on s.inflow_id = l.inflow_id and s.date = d.date""")
def _(v):
    series = v.runs.groupBy("station_id", "date").agg(F.sum("q").alias("q"))
    out = joins.join_inflow_series(network.direct_links(_tree(v), v.gauge), series)
    return out.select("gauge_id", "inflow_id", "date", F.round("q", 3).alias("q"))


@query("inflow_table", f"""with recursive {TREE}, s as (select station_id as inflow_id, date, sum(q) as q from runs group by 1, 2),
f as (select gauge_id, min(inflow_id) as inflow_id from link group by 1), d as (select f.gauge_id, s.date from f join s using (inflow_id)),
r as (select l.gauge_id, l.inflow_id, d.date, s.q from link l join d using (gauge_id) left join s on s.inflow_id = l.inflow_id and s.date = d.date)
select gauge_id, date, string_agg(inflow_id::varchar, ' ' order by inflow_id) as names,
  string_agg(coalesce(printf('%.3f', q), '1e31'), ' ' order by inflow_id) as line from r group by 1, 2""")
def _(v):
    series = v.runs.groupBy("station_id", "date").agg(F.sum("q").alias("q"))
    return joins.inflow_lines(joins.inflow_table(network.direct_links(_tree(v), v.gauge), series))


@query("merge_inflow_files", """select name, count(distinct f) as n_files from (select l_linestatus as f, l_suppkey as name from lineitem) group by 1 having count(distinct f) > 1""")
def _(v):
    rows = v.table("lineitem").select(F.col("l_linestatus").alias("file"), F.col("l_suppkey").alias("name"))
    parts = [rows.filter(F.col("file") == s) for s in ("F", "O")]
    return joins.merge_inflow_files(parts)[1]


@query("run_compare_join", """select cell_id, round(a - b, 6) as value from (select l_partkey as cell_id, sum(l_quantity) filter (l_linenumber = 1) as a,
  sum(l_quantity) filter (l_linenumber = 2) as b from lineitem group by 1) where a is not null and b is not null""")
def _(v):
    def run(n):
        rows = v.table("lineitem").filter(F.col("l_linenumber") == n)
        return rows.groupBy(F.col("l_partkey").alias("cell_id")).agg(F.sum("l_quantity").alias("value"))

    return joins.compare_maps(run(1), run(2))


@query("variable_compare_join", """select a.cell_id, a.date, a.value + b.value as value from cell_series a join cell_series b
  on a.cell_id = b.cell_id and a.date = b.date and a.variable = 'NO' and b.variable = 'RF'""")
def _(v):
    a, b = (v.cell_series.filter(F.col("variable") == n) for n in ("NO", "RF"))
    return joins.compare_maps(a, b, difference=False, keys=["cell_id", "date"])


@query("station_conflicts", """with s as (select s_suppkey, s_suppkey % 9 as row, s_nationkey as col from supplier)
select a.row, a.col, count(*) as n_pairs from s a join s b on a.row = b.row and a.col = b.col and a.s_suppkey <> b.s_suppkey group by 1, 2""")
def _(v):
    s = v.table("supplier").select((F.col("s_suppkey") % 9).alias("row"), F.col("s_nationkey").alias("col"))
    return joins.station_conflicts(s)


@query("missing_stations", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus <> 'P')")
def _(v):
    # Orders in progress have no series yet.
    series = v.table("orders").filter("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.missing_stations(v.table("customer").select("c_custkey"), series, "c_custkey")


DONE = "select s_suppkey as gauge_id from supplier where s_acctbal > 2000"


@query("ready_stations", f"""with recursive {TREE}, done as ({DONE}),
w as (select l.gauge_id, bool_and(d.gauge_id is not null) as ok from link l left join done d on d.gauge_id = l.inflow_id group by 1)
select g.gauge_id from gauge g left join w using (gauge_id) where coalesce(ok, true) and g.gauge_id not in (select gauge_id from done)""")
def _(v):
    return joins.ready_stations(v.gauge, network.direct_links(_tree(v), v.gauge), v.sql(DONE))


@query("grid_align_check", """select (select min(row) = min(l_partkey // 50) and max(row) = max(l_partkey // 50) and min(col) = min(l_partkey % 50)
  and max(col) = max(l_partkey % 50) from cell, (select distinct l_partkey from lineitem)) as aligned""")
def _(v):
    a = v.cell.select(F.col("row").cast("double").alias("lat"), F.col("col").cast("double").alias("lon"))
    b = v.table("lineitem").select(
        F.expr("cast(l_partkey div 50 as double)").alias("lat"), (F.col("l_partkey") % 50).cast("double").alias("lon")
    )
    return joins.grid_align_check(a, b)


# Two entries a month for every station: 24 days of the year, spread by the station's number.
# The schedule covers all 366 days but every 61st; dates of these keep their row.
@query("doy_schedule_join", """with s as (select s_suppkey as station_id, doy, s_acctbal / 10 + doy as release from supplier, range(1, 367) t(doy) where (doy + s_suppkey) % 61 <> 0)
select p.station_id, p.date, s.release from (select station_id, date from pairs) p left join s on s.station_id = p.station_id and s.doy = dayofyear(p.date)""")
def _(v):
    days = F.explode(F.sequence(F.lit(1), F.lit(366))).alias("doy")
    s = v.table("supplier").select(F.col("s_suppkey").alias("station_id"), "s_acctbal", days).filter((F.col("doy") + F.col("station_id")) % 61 != 0).select(
        "station_id", "doy", (F.col("s_acctbal") / 10 + F.col("doy")).alias("release")
    )
    return joins.doy_schedule_join(v.pairs.select("station_id", "date"), s, ["station_id"]).select("station_id", "date", "release")


STAGES = """select l_partkey as crop, cast(l_linenumber * 2 - 1 as int) as stage_start, cast(l_linenumber * 2 as int) as stage_end,
  max(l_discount) as kc, max(l_tax) as ky from lineitem group by 1, 2, 3"""


@query("growth_stage_join", f"""with s as ({STAGES}), m as (select cell_id as crop, date, month(date) as counter from cell_day)
select m.crop, m.date, kc, ky from m left join s on s.crop = m.crop and m.counter between stage_start and stage_end""")
def _(v):
    stages = v.sql(STAGES).withColumnRenamed("stage_start", "start").withColumnRenamed("stage_end", "end")
    months = v.cell_day.select(F.col("cell_id").alias("crop"), "date", F.month("date").alias("counter"))
    return joins.growth_stage_join(months, stages).select("crop", "date", "kc", "ky")


@query("inflow_delta", """with q as (select station_id, date, sum(q) as q from runs group by 1, 2),
l as (select *, coalesce(lag(q) over (partition by station_id order by date), q) as old from q)
select station_id, date, sub_step::int as sub_step, round((q - old) / 4, 6) as delta, round((old + sub_step * (q - old) / 4) / 4, 6) as inflow
  from l, range(1, 5) t(sub_step)""")
def _(v):
    q = v.runs.groupBy("station_id", "date").agg(F.sum("q").alias("q"))
    return joins.inflow_delta(q, ["station_id"], 4).withColumn("delta", F.round("delta", 6)).withColumn("inflow", F.round("inflow", 6))
