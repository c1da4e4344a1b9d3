"""Water-demand queries on sector and plant inputs derived from orders and line items."""

from pyspark.sql import functions as F

from hydroloom.operators import demand, joins
from hydroloom.plans.registry import query

C = F.col
ALLOC = """select l_partkey as cell_id, cast(date_trunc('month', l_shipdate) as date) as month, l_returnflag as sector, l_linenumber as source, l_quantity as value from lineitem"""


@query("demand_to_depth", """select region, month, sector, round(case when mm3 * 1.2 > 0.5 then mm3 * 1.2 else 0 end * 1e6 / 2 / day(last_day(month)), 3) as depth from demand""")
def _(v):
    from hydroloom.functions.dates import days_in_month

    d = demand.demand_to_depth(C("mm3"), F.lit(2.0), days_in_month(C("month")), F.lit(1.2))
    return v.demand.select("region", "month", "sector", F.round(d, 3).alias("depth"))


COVERVALUES = """select c.cell_id, d.date, 'runoff' as variable, k.cover, d.value * (k.cover + 1) as value from cell_day d join cell c on c.cell_id = d.cell_id
  join (select distinct cast(zone % 6 as int) as cover from cell) k on k.cover >= 0"""
COVERFRAC = """select c.cell_id, k.cover, (k.cover + 1) / 2.1e1 as fraction from cell c join (select distinct cast(zone % 6 as int) as cover from cell) k on k.cover >= 0"""


@query("cover_weighted_sum", f"""with x as ({COVERVALUES}), f as ({COVERFRAC}) select cell_id, date, variable, round(sum(fraction * value), 7) as value
  from x join f using (cell_id, cover) group by 1, 2, 3""")
def _(v):
    # Classes 0..5 are an array on the row, not a join of cells with classes.
    classes = F.array(*[F.lit(i) for i in range(6)])
    values = v.cell_day.select("cell_id", "date", F.lit("runoff").alias("variable"), F.explode(classes).alias("cover"), C("value")).withColumn("value", C("value") * (C("cover") + 1))
    cover = v.cell.select("cell_id", F.explode(classes).alias("cover")).withColumn("fraction", (C("cover") + 1) / F.lit(21.0))
    return demand.cover_weighted_sum(cover, values).withColumn("value", F.round("value", 7))


CROPS = """select l.l_partkey as cell_id, c.zone as segment, l.l_linenumber as crop, l.l_discount as irr, l.l_tax as nonirr, l.l_quantity / 1e3 as rain, l.l_quantity / 7e3 as pet
  from lineitem l join cell c on c.cell_id = l.l_partkey"""


@query("segment_crop_area", f"""with c as ({CROPS}) select segment, crop, round(sum(irr * area), 5) as irr_area, round(sum(nonirr * area), 5) as nonirr_area,
  round(sum(rain * area), 5) as rain_volume, round(avg(pet), 9) as mean_pet from c join cell using (cell_id) group by 1, 2""")
def _(v):
    out = demand.segment_crop_area(v.sql(CROPS), v.cell)
    return out.select("segment", "crop", *[F.round(n, 5).alias(n) for n in ("irr_area", "nonirr_area", "rain_volume")], F.round("mean_pet", 9).alias("mean_pet"))


@query("sector_totals", f"""with a as ({ALLOC}) select month, sector, source, sum(value) as withdrawal from a
  group by grouping sets ((month, sector, source), (month, sector), (month, source), (month))""")
def _(v):
    return demand.sector_totals(v.sql(ALLOC), ["month"])


@query("sector_consumption", f"""with a as ({ALLOC}), e as (select l_returnflag as sector, avg(l_discount) * 10 as efficiency from lineitem where l_returnflag <> 'N' group by 1)
select month, sector, sum(value) as withdrawal, round(sum(value) * any_value(efficiency), 5) as consumption from a left join e using (sector) group by 1, 2""")
def _(v):
    # One sector has no efficiency and keeps its row.
    eff = v.table("lineitem").filter("l_returnflag <> 'N'").groupBy(C("l_returnflag").alias("sector")).agg((F.avg("l_discount") * 10).alias("efficiency"))
    out = demand.sector_consumption(demand.sector_totals(v.sql(ALLOC), ["month"]), eff)
    return out.select("month", "sector", "withdrawal", F.round("consumption", 5).alias("consumption"))


SECTORS = """select region, month, case sector when '1-URGENT' then 'domestic' when '2-HIGH' then 'industry' else 'livestock' end as name,
  sum(mm3) as need, sum(mm3) * case when region % 2 = 0 then 0.37e0 else 1.4e0 end as used from demand group by 1, 2, 3"""


@query("nonirr_demand", f"""with s as ({SECTORS}), t as (select region, month, sum(need) as n, sum(used) as u, coalesce(sum(need) filter (name = 'domestic'), 0) as d,
  coalesce(sum(need) filter (name = 'industry'), 0) as i, coalesce(sum(need) filter (name = 'livestock'), 0) as l from s group by 1, 2)
select region, month, round(n, 10) as nonirr_demand, round(least(n, u), 10) as nonirr_consumption, round((n - least(n, u)) / n, 10) as return_fraction,
  round(d / n, 10) as frac_domestic, round(i / n, 10) as frac_industry, round(l / n, 10) as frac_livestock from t""")
def _(v):
    rows = v.sql(SECTORS).withColumnRenamed("name", "sector").withColumnRenamed("need", "demand").withColumnRenamed("used", "consumption")
    out = demand.nonirr_demand(rows, ["region", "month"])
    return out.select("region", "month", *[F.round(c, 10).alias(c) for c in out.columns[2:]])


@query("return_flow", """with m as (select l_orderkey, l_linenumber, l_quantity as w, l_quantity * (0.5 + l_discount) as c, l_tax * 70 as nr, l_discount * 300 as un from lineitem),
s as (select *, 1 - least(1, coalesce(un / nullif(w + un, 0), 0)) as sh, 0.6 * (w - c) as irr, 0.4 * (w - c) as evap from m)
select l_orderkey, l_linenumber, round(irr * sh, 10) as return_irr, round(evap * sh, 10) as evap_loss, round(nr * sh, 10) as return_nonirr,
  round((irr + evap + nr) * (1 - sh), 10) as unmet_lost, round((irr + nr) * sh, 10) as return_total from s""")
def _(v):
    q = C("l_quantity")
    o = demand.return_flow(q, q * (0.5 + C("l_discount")), C("l_tax") * 70, F.lit(0.6), C("l_discount") * 300, q)
    return v.table("lineitem").select("l_orderkey", "l_linenumber", *[F.round(c, 10).alias(n) for n, c in o.items()])


SEWAGE = "select d.cell_id, cast(c.zone as bigint) as plant_id, d.date, d.value / 1e2 as value from cell_day d join cell c on c.cell_id = d.cell_id"
# A plant for every zone but each tenth, which exports; two thirds of the plants close in 1996, some open after 1995.
PLANTS = """select cast(zone as bigint) as plant_id, cast(zone as bigint) as ord, cast(1990 + zone % 8 as int) as from_year,
  cast(case when zone % 3 = 0 then null else 1996 end as int) as to_year, 900e0 + zone * 20 as volume, 2e0 as min_hrt
  from (select distinct zone from cell) z where zone % 10 <> 0"""
ACTIVE = f"""p as ({PLANTS}), y as (select range::int as year from range(1990, 2002)), act as (select plant_id, year, volume, min_hrt from p join y on from_year <= year and (to_year is null or to_year >= year))"""


@query("plant_collection", f"""with s as ({SEWAGE}), {ACTIVE}, c as (select plant_id, date, sum(value * area) as collected from s join cell using (cell_id) where plant_id in (select plant_id from p) group by 1, 2),
o as (select c.*, volume, greatest(collected - coalesce(volume / min_hrt, 0), 0) as overflow from c left join act on act.plant_id = c.plant_id and act.year = year(date))
select plant_id, date, round(collected, 5) as collected, round(overflow, 5) as overflow, round(collected - overflow, 5) as treated,
  round(case when collected - overflow > 0 then least(volume / (collected - overflow), 1) end, 7) as residence from o""")
def _(v):
    years = v.spark.range(1990, 2002).select(C("id").cast("int").alias("year"))
    active = joins.active_version(v.sql(PLANTS), years).select("plant_id", "year", "volume", "min_hrt")
    out = demand.plant_collection(v.sql(SEWAGE), v.cell, active, v.sql(PLANTS))
    return out.select("plant_id", "date", *[F.round(n, 5).alias(n) for n in ("collected", "overflow", "treated")], F.round("residence", 7).alias("residence"))


@query("exported_collection", f"""with s as ({SEWAGE}) select date, round(sum(value * area), 5) as exported from s join cell using (cell_id)
  where plant_id > 0 and plant_id % 10 = 0 group by 1""")
def _(v):
    return demand.exported_collection(v.sql(SEWAGE), v.cell, v.sql(PLANTS)).withColumn("exported", F.round("exported", 5))


@query("treated_water_split", """with t as (select l_orderkey, l_linenumber, l_quantity as q, case when l_linenumber = 1 then -1 else l_discount * 5 end as r, l_returnflag = 'R' as has from lineitem),
u as (select *, case when r = -1 then 0 else q * r end as ex from t)
select l_orderkey, l_linenumber, round(ex, 7) as exported, round(case when r <> -1 and has then q - ex else 0 end, 7) as to_reservoir,
  round(q - ex - case when r <> -1 and has then q - ex else 0 end, 7) as discharged from u""")
def _(v):
    rule = F.when(C("l_linenumber") == 1, -1.0).otherwise(C("l_discount") * 5)
    o = demand.treated_water_split(C("l_quantity"), rule, C("l_returnflag") == "R")
    return v.table("lineitem").select("l_orderkey", "l_linenumber", *[F.round(c, 7).alias(n) for n, c in o.items()])


CAPACITY = "select year(o_orderdate) as year, sum(o_totalprice) / 3e2 as capacity from orders group by 1"
NEED = "select d.cell_id, d.date, d.value / 7 as need, c.area from cell_day d join cell c on c.cell_id = d.cell_id"


@query("desalination_limit", f"""with n as ({NEED}), cap as ({CAPACITY}), t as (select date, sum(need * area) as total from n group by 1),
s as (select date, coalesce(least(total, coalesce(capacity, 0) / 365) / nullif(total, 0), 0) as share from t left join cap on cap.year = year(date))
select cell_id, date, round(need * share, 7) as supplied from n join s using (date)""")
def _(v):
    return demand.desalination_limit(v.sql(NEED), v.sql(CAPACITY)).withColumn("supplied", F.round("supplied", 7))


TRANSFER = """select l_suppkey as from_id, l_partkey % 100 as to_id, dayofyear(l_shipdate) as doy, avg(case when l_linenumber < 3 then l_discount * 10 else l_quantity end) as release
  from lineitem where l_suppkey <> l_partkey % 100 group by 1, 2, 3"""
BODIES = """select l_suppkey as body, cast(l_shipdate as date) as date, 7e1 as volume, sum(l_quantity) / 9 as storage, cast(1990 + l_suppkey % 9 as int) as year_built from lineitem where l_suppkey > 0 group by 1, 2, 5"""


@query("scheduled_transfer", f"""with s as ({TRANSFER}), b as ({BODIES}), d as (select distinct date from b),
j as (select s.from_id, s.to_id, d.date, release, f.storage as fs, f.year_built as fb, t.volume as tv, t.storage as ts, t.year_built as tb
  from s join d on dayofyear(d.date) = s.doy left join b f on f.body = s.from_id and f.date = d.date left join b t on t.body = s.to_id and t.date = d.date),
k as (select *, case when to_id > 0 then tv - ts else 10e12 end * 0.95 as room, case when release <= 1 then case when from_id = 0 then tv else fs end * release else release end as amount from j)
select from_id, to_id, date, round(case when room is not null and amount is not null then least(room, amount) end, 6) as transfer
  from k where coalesce((from_id = 0 or fb <= year(date)) and (to_id = 0 or tb <= year(date)), true)""")
def _(v):
    bodies = v.sql(BODIES)
    out = demand.scheduled_transfer(v.sql(TRANSFER), bodies, bodies.select("date").distinct())
    return out.withColumn("transfer", F.round("transfer", 6))
