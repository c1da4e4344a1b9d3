"""Zone statistics and allocation queries."""

from pyspark.sql import functions as F

from hydroloom.operators import zonal
from hydroloom.plans.registry import query

Z = "zone % 7"


def _zoned(v):
    return v.cell.select("cell_id", "row", "col", "area", (F.col("zone") % 7).alias("z"))


@query("zone_total", f"select cell_id, round(sum(area) over (partition by {Z}), 4) as zone_total from cell")
def _(v):
    return zonal.zone_total(_zoned(v), ["z"], "area").select("cell_id", F.round("zone_total", 4).alias("zone_total"))


@query("zone_average", f"select cell_id, round(avg(area) over (partition by {Z}), 6) as zone_average from cell")
def _(v):
    return zonal.zone_average(_zoned(v), ["z"], "area").select("cell_id", F.round("zone_average", 6).alias("zone_average"))


@query("zone_maximum", f"select cell_id, greatest(0, round(max(950 - area) over (partition by {Z}), 6)) as zone_maximum from cell")
def _(v):
    c = _zoned(v).withColumn("x", 950 - F.col("area"))
    return zonal.zone_maximum(c, ["z"], "x").select("cell_id", F.round("zone_maximum", 6).alias("zone_maximum"))


@query("zone_majority", """with n as (select zone, cell_id % 5 as k, count(*) as n from cell group by 1, 2),
b as (select zone, k from (select *, row_number() over (partition by zone order by n desc, k) as r from n) where r = 1)
select cell_id, k as zone_majority from cell join b using (zone)""")
def _(v):
    c = v.cell.withColumn("k", F.col("cell_id") % 5)
    return zonal.zone_majority(c, ["zone"], "k").select("cell_id", "zone_majority")


@query("month_quota", """with q as (select zone as segment, avg(value) as quota from cell_day join cell using (cell_id) group by 1),
d as (select zone as segment, date, sum(value) as value from cell_day join cell using (cell_id) group by 1, 2),
t as (select *, sum(value) over (partition by segment, date_trunc('month', date) order by date) as month_to_date from d)
select segment, date, value, month_to_date, case when segment % 7 = 3 then true else month_to_date - value <= round(quota, 3) * 8 end as open,
  case when segment % 7 <> 3 then round(month_to_date / (round(quota, 3) * 8), 6) end as ratio from t join q using (segment)""")
def _(v):
    w = v.cell_day.join(v.cell.select("cell_id", F.col("zone").alias("segment")), "cell_id")
    quota = w.groupBy("segment").agg((F.round(F.avg("value"), 3) * 8).alias("quota"))
    quota = quota.filter("segment % 7 <> 3")  # every seventh segment has no quota
    return zonal.month_quota(w, quota).withColumn("ratio", F.round("ratio", 6))


PRIORITY = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2, "4-NOT SPECIFIED": 3, "5-LOW": 4}


# Every fifth region has no amount; every region has an amount of 7 in a month without demand.
@query("priority_cascade", """with a as (select region, month, case when region % 5 = 2 then 0 else 0.6 * sum(mm3) end as amount from demand group by 1, 2),
c as (select d.*, a.amount, sum(mm3) over (partition by region, month order by sector) as cum from demand d join a using (region, month)),
g as (select region, month, sector, greatest(0, least(mm3, amount - (cum - mm3))) as given, amount from c)
select region, month, sector, round(given, 9) as given from g
union all select region, month, 'other', round(greatest(any_value(amount) - sum(given), 0), 9) from g where region % 5 <> 2 group by 1, 2
union all select distinct region, date '2050-01-01', 'other', 7 from demand""")
def _(v):
    demand = v.demand.withColumnRenamed("mm3", "demand")
    amount = demand.filter("region % 5 <> 2").groupBy("region", "month").agg((0.6 * F.sum("demand")).alias("amount"))
    idle = demand.select("region").distinct().select("region", F.lit("2050-01-01").cast("date").alias("month"), F.lit(7.0).alias("amount"))
    amount = amount.unionByName(idle)
    out = zonal.priority_cascade(demand, amount, ["region", "month"], PRIORITY)
    return out.withColumn("given", F.round(F.greatest("given", F.lit(0.0)), 9))


ALLOC = """select c.zone, d.date, c.cell_id, d.value as demand, (c.cell_id % 11) * 4e0 as available, c.area
  from cell c join cell_day d on d.cell_id = c.cell_id"""


@query("zone_allocation", f"""with a as ({ALLOC}), t as (select *, sum(demand * area) over z as d, sum(available * area) over z as s
  from a window z as (partition by zone, date))
select zone, date, cell_id, round(greatest(0, case when d < s then available / nullif(s, 0) * d else available end), 6) as abstraction,
  round(greatest(0, coalesce(demand / nullif(d, 0), 0) * least(d, s)), 6) as allocation,
  round(greatest(0, demand - greatest(0, coalesce(demand / nullif(d, 0), 0) * least(d, s))), 6) as unmet from t""")
def _(v):
    out = zonal.zone_allocation(v.sql(ALLOC), ["zone", "date"])
    return out.select("zone", "date", "cell_id", *[F.round(c, 6).alias(c) for c in ("abstraction", "allocation", "unmet")])


SOURCES = """select l_partkey as cell_id, l_shipmonth, sector, source_order, fraction, demand, served from (
  select l_partkey, cast(date_trunc('month', l_shipdate) as date) as l_shipmonth, l_returnflag as sector, l_linenumber as source_order,
    0.2e0 + 0.1e0 * l_linenumber as fraction, 50e0 as demand, cast(sum(least(l_quantity, 6)) as double) as served
  from lineitem group by 1, 2, 3, 4)"""


@query("source_potential", f"""with s as ({SOURCES}) select cell_id, l_shipmonth as month, sector, source_order,
  round(least(fraction * demand, demand - coalesce(sum(served) over (partition by cell_id, l_shipmonth, sector order by source_order
    rows between unbounded preceding and 1 preceding), 0)), 6) as potential,
  round(demand - sum(served) over (partition by cell_id, l_shipmonth, sector), 6) as unmet from s""")
def _(v):
    rows = v.sql(SOURCES).withColumnRenamed("l_shipmonth", "month")
    out = zonal.source_potential(rows, ["cell_id", "month"])
    return out.select("cell_id", "month", "sector", "source_order", F.round("potential", 6).alias("potential"), F.round("unmet", 6).alias("unmet"))


@query("zone_single_supply", """with n as (select zone, date, cell_id, value as need from cell_day join cell using (cell_id)),
s as (select zone, max(area) / 21 as store from cell group by 1),
z as (select zone, date, sum(need) as total from n group by 1, 2)
select zone, date, cell_id, case when zone % 6 = 1 then 0 else round(least(0.98 * store, total / 0.9), 9) end as take,
  case when zone % 6 = 1 then 0 else round(need * least(0.98 * store, total / 0.9) / nullif(total, 0), 9) end as share
  from n join z using (zone, date) join s using (zone)""")
def _(v):
    need = v.cell_day.join(v.cell.select("cell_id", "zone"), "cell_id").withColumnRenamed("value", "need")
    days = need.select("zone", "date").distinct()
    stores = v.cell.select("zone", (F.col("area") / 21).alias("store")).groupBy("zone").agg(F.max("store").alias("store"))
    stores = stores.filter("zone % 6 <> 1")  # every sixth zone has no store
    out = zonal.zone_single_supply(need, days.join(stores, "zone"), ["zone", "date"], efficiency=0.9)
    return out.select("zone", "date", "cell_id", F.round("take", 9).alias("take"), F.round("share", 9).alias("share"))


LINKS = """select l_suppkey as plant_id, cast(date_trunc('month', l_shipdate) as date) as month, l_linenumber as reservoir,
  cast(sum(l_quantity) as double) as left_volume from lineitem group by 1, 2, 3"""
TREATED = "select s_suppkey as plant_id, 20 + (s_suppkey % 7) * 30e0 as treated from supplier"


def _fill(v):
    links = v.sql(LINKS).withColumnRenamed("left_volume", "left")
    months = links.select("plant_id", "month").distinct()
    return zonal.capacity_fill(links, months.join(v.sql(TREATED), "plant_id"), ["plant_id", "month"])


@query("capacity_fill", f"""with l as ({LINKS}), t as ({TREATED}), r as (select plant_id, month, sum(left_volume) as room from l group by 1, 2)
select plant_id, month, reservoir, round(left_volume * least(1, treated / nullif(room, 0)), 6) as sent
  from l join r using (plant_id, month) join t using (plant_id)""")
def _(v):
    return _fill(v)[0].select("plant_id", "month", "reservoir", F.round("sent", 6).alias("sent"))


@query("capacity_overflow", f"""with l as ({LINKS}), t as ({TREATED}), r as (select plant_id, month, sum(left_volume) as room from l group by 1, 2)
select plant_id, month, round(greatest(0, treated - room), 6) as overflow from r join t using (plant_id)""")
def _(v):
    return _fill(v)[1].select("plant_id", "month", F.round("overflow", 6).alias("overflow"))


@query("grid_coarsen", "select (row // 4)::int as row, (col // 5)::int as col, round(avg(area), 6) as area from cell group by 1, 2")
def _(v):
    # n x n blocks of the library; the 4 x 5 fixture uses a stretched column.
    c = v.cell.withColumn("col", F.expr("cast(col div 5 * 4 as int)"))
    return zonal.grid_coarsen(c, 4, "area").withColumn("area", F.round("area", 6))


@query("column_profile", """select variable, count(value) as n_valid, (select count(*) from cell) - count(value) as n_missing,
  count(*) filter (value = 0) as n_zero, count(*) filter (value <> 0) as n_nonzero, min(value) as min, round(avg(value), 6) as mean, max(value) as max
  from (select variable, cell_id, sum(value) as value from cell_series group by 1, 2) group by 1""")
def _(v):
    layers = v.cell_series.groupBy("variable", "cell_id").agg(F.sum("value").alias("value"))
    out = zonal.column_profile(layers, ["variable"], cells=v.cell.select(F.count("*")).scalar())
    return out.withColumn("mean", F.round("mean", 6))


@query("zone_difference", """select distinct zone from cell where zone > 0 and zone not in (select n_nationkey from nation)""")
def _(v):
    plants = v.table("nation").select(F.col("n_nationkey").alias("zone"))
    return zonal.zone_difference(v.cell, plants, "zone")


@query("remove_zone_zero", "select distinct body from water_body where body > 0")
def _(v):
    return zonal.remove_zone_zero(v.water_body, "body")


@query("zone_intersection", """with c as (select cell_id, zone, (cell_id % 50 + 1) as canal from cell),
a as (select zone, bool_or(zone = canal) as has_own from c group by 1)
select cell_id, zone from c join a using (zone) where zone > 0 and (zone = canal or not has_own)""")
def _(v):
    c = v.cell.withColumn("canal", F.col("cell_id") % 50 + 1)
    return zonal.zone_intersection(c, "zone", "canal").select("cell_id", "zone")


@query("forward_fill_year", """with y as (select range::int as year from range(1990, 2006)),
c as (select year(o_orderdate)::int as year, max(o_totalprice) as capacity from orders group by 1)
select y.year, coalesce(arg_max(c.capacity, c.year), 0) as capacity from y left join c on c.year <= y.year group by 1""")
def _(v):
    caps = v.table("orders").groupBy(F.year("o_orderdate").alias("year")).agg(
        F.max("o_totalprice").alias("capacity")
    )
    return zonal.forward_fill(caps, 1990, 2005)


@query("month_counter", """with d as (select cell_id, date, zone % 12 + 1 as p, 3 + zone % 8 as season from cell_day join cell using (cell_id)),
n as (select *, (month(date) - p + 12) % 12 + 1 as n from d)
select cell_id, date, (case when n > season then 0 else n end)::int as counter from n""")
def _(v):
    d = v.cell_day.join(v.cell.select("cell_id", "zone"), "cell_id")
    n = zonal.month_counter(F.col("date"), F.col("zone") % 12 + 1, 3 + F.col("zone") % 8)
    return d.select("cell_id", "date", n.cast("int").alias("counter"))
