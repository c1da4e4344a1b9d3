"""River-network queries: heap trees and the grid network of direction codes."""

from pyspark.sql import functions as F

from hydroloom.operators import network
from hydroloom.plans.registry import query

MEMBER = """up(gauge_id, cell_id) as (select gauge_id, cell_id from gauge
  union all select u.gauge_id, l.cell_id from up u join ldd l on l.down_id = u.cell_id)"""
# Path of each cell downwards: one row per step.
PATH = """path(cell_id, pos, n) as (select cell_id, cell_id, 0::bigint from ldd
  union all select p.cell_id, l.down_id, n + 1 from path p join ldd l on l.cell_id = p.pos where l.down_id is not null)"""
NEAREST = f"""{PATH}, near as (select path.cell_id, arg_min(g.gauge_id, n) as gauge_id
  from path join gauge g on g.cell_id = path.pos group by 1),
tree as (select g.gauge_id, near.gauge_id as parent_id from gauge g join ldd using (cell_id) left join near on near.cell_id = ldd.down_id)"""


def _gauges(v):
    nearest = network.subcatchment(v.ldd, v.gauge)
    tree = network.gauge_tree(v.ldd, v.gauge, nearest)
    return nearest, tree


@query("ldd_edges", "select * from river")
def _(v):
    return network.ldd_edges(v.flow_code)


@query("downstream_step", """select cell_id, (row + case when code in (7,8,9) then -1 when code in (1,2,3) then 1 else 0 end)::int as down_row,
  (col + case when code in (3,6,9) then 1 when code in (1,4,7) then -1 else 0 end)::int as down_col from any_code""")
def _(v):
    return network.downstream_step(v.any_code).select("cell_id", "down_row", "down_col")


RAW = """raw as (select a.cell_id, b.cell_id as down_id from (
    select cell_id, row, col, code, row + case when code in (7,8,9) then -1 when code in (1,2,3) then 1 else 0 end as tr,
      col + case when code in (3,6,9) then 1 when code in (1,4,7) then -1 else 0 end as tc from any_code) a
  left join any_code b on b.row = tr and b.col = tc and b.code between 1 and 9 and a.code not in (0, 5))"""


@query("ldd_repair", f"""with recursive {RAW},
reach(cell_id, pos) as (select cell_id, down_id from raw where down_id is not null
  union select r.cell_id, l.down_id from reach r join raw l on l.cell_id = r.pos where l.down_id is not null),
cyc as (select cell_id from reach where cell_id = pos),
label as (select r.cell_id, least(min(r.pos), r.cell_id) as cycle_id from reach r join cyc on cyc.cell_id = r.cell_id group by r.cell_id),
stuck as (select distinct r.cell_id, label.cycle_id from reach r join label on label.cell_id = r.pos),
firsts as (select cycle_id, min(cell_id) as cell_id from stuck group by 1),
entry as (select f.cell_id as entry_id from firsts f where f.cell_id in (select cell_id from cyc)
  union select l.down_id from firsts f join raw l on (l.cell_id = f.cell_id or l.cell_id in (select pos from reach where cell_id = f.cell_id))
  where f.cell_id not in (select cell_id from cyc) and l.cell_id not in (select cell_id from cyc) and l.down_id in (select cell_id from cyc)),
cuts as (select c.cell_id from cyc c join raw l on l.cell_id = c.cell_id where l.down_id in (select entry_id from entry))
select cell_id, case when cell_id in (select cell_id from cuts) then null else down_id end as down_id,
  cell_id in (select cell_id from cuts) as cut from raw""")
def _(v):
    return network.ldd_repair(network.ldd_edges(v.any_code))


@query("upstream_accumulate", f"""with recursive {PATH}
  select pos as cell_id, count(*)::double as n_up, round(sum(area), 4) as area_up from path join cell on cell.cell_id = path.cell_id group by 1""")
def _(v):
    w = v.cell.select("cell_id", F.lit(1.0).alias("n_up"), F.col("area").alias("area_up"))
    return network.upstream_accumulate(v.ldd, w, ["n_up", "area_up"]).withColumn("area_up", F.round("area_up", 4))


RIVER_PATH = """path(cell_id, pos, n) as (select cell_id, cell_id, 0::bigint from river
  union all select p.cell_id, l.down_id, n + 1 from path p join river l on l.cell_id = p.pos where l.down_id is not null)"""


@query("upstream_accumulate_river", f"""with recursive {RIVER_PATH}
  select pos as cell_id, count(*)::double as n_up from path group by 1""")
def _(v):
    return network.upstream_accumulate(v.river, v.cell.select("cell_id", F.lit(1.0).alias("n_up")), ["n_up"])


@query("upstream_one", """select l.cell_id, round(coalesce(sum(c.area), 0), 4) as area
  from ldd l left join ldd u on u.down_id = l.cell_id left join cell c on c.cell_id = u.cell_id group by 1""")
def _(v):
    return network.upstream_one(v.ldd, v.cell, "area").withColumn("area", F.round("area", 4))


@query("downstream_one", """select l.cell_id, coalesce(b.area, c.area) as area from ldd l join cell c using (cell_id)
  left join cell b on b.cell_id = l.down_id""")
def _(v):
    return network.downstream_one(v.ldd, v.cell, "area")


FOREST_PATH = PATH.replace("ldd", "ldd_forest")


@query("basin_label", f"""with recursive {FOREST_PATH}, root as (select path.cell_id, pos as root_id from path
  join ldd_forest f on f.cell_id = path.pos and f.down_id is null)
  select cell_id, dense_rank() over (order by root_id) as basin from root""")
def _(v):
    return network.basin_label(v.ldd_forest)


@query("basin_label_river", f"""with recursive {RIVER_PATH}, root as (select path.cell_id, pos as root_id from path
  join river f on f.cell_id = path.pos and f.down_id is null)
  select cell_id, dense_rank() over (order by root_id) as basin from root""")
def _(v):
    return network.basin_label(v.river)


@query("topological_level", f"with recursive {RIVER_PATH} select cell_id, max(n) as level from path group by 1")
def _(v):
    return network.topological_level(v.river)


@query("subcatchment", f"with recursive {NEAREST} select * from near")
def _(v):
    return network.subcatchment(v.ldd, v.gauge)


@query("gauge_membership", f"with recursive {MEMBER} select cell_id, gauge_id from up")
def _(v):
    nearest, tree = _gauges(v)
    return network.gauge_membership(nearest, network.gauge_closure(tree), v.gauge)


@query("catchment", f"""with recursive {PATH} select path.cell_id, arg_max(g.gauge_id, n) as gauge_id
  from path join gauge g on g.cell_id = path.pos group by 1""")
def _(v):
    return network.catchment(*_gauges(v))


@query("interstation_regions", f"""with recursive {NEAREST} select l.cell_id, coalesce(near.gauge_id, 0) as region
  from ldd l left join near using (cell_id)""")
def _(v):
    return network.interstation_regions(v.ldd, network.subcatchment(v.ldd, v.gauge))


@query("sampling_frequency", f"""with recursive {MEMBER} select l.cell_id, count(up.gauge_id) as frequency
  from ldd l left join up using (cell_id) group by 1""")
def _(v):
    return network.sampling_frequency(v.ldd, *_gauges(v), v.gauge)


@query("catchment_area_cells", f"with recursive {MEMBER} select gauge_id, count(*) as n_cells from up group by 1")
def _(v):
    return network.catchment_area_cells(*_gauges(v), v.gauge).select("gauge_id", F.col("n_cells").cast("long").alias("n_cells"))


@query("direct_links", f"""with recursive {NEAREST} select g.gauge_id, count(t.gauge_id) as inflow,
  coalesce(string_agg(t.gauge_id::varchar, ' ' order by t.gauge_id), '') as inflow_ids
  from gauge g left join tree t on t.parent_id = g.gauge_id group by 1""")
def _(v):
    nearest = network.subcatchment(v.ldd, v.gauge)
    return network.link_lists(network.gauge_tree(v.ldd, v.gauge, nearest), v.gauge)


@query("walk_downstream", f"""with recursive {PATH} select g.gauge_id as start_id, n::int as step, pos as cell_id
  from path join gauge g on g.cell_id = path.cell_id where n between 1 and 5""")
def _(v):
    return network.walk_downstream(v.ldd, v.gauge.withColumnRenamed("gauge_id", "start_id"), 5)


def _inlets(v):
    nearest = network.subcatchment(v.ldd, v.gauge)
    links = network.direct_links(network.gauge_tree(v.ldd, v.gauge, nearest), v.gauge)
    return network.distinct_inlet_cells(v.ldd, links, v.gauge)


# Served one by one in id order: the k-th inflow of a gauge takes the first free cell of its path.
@query("distinct_inlet_cells", f"""with recursive {NEAREST},
link as (select parent_id as gauge_id, gauge_id as inflow_id, row_number() over (partition by parent_id order by gauge_id) as k
  from tree where parent_id is not null),
steps as (select l.gauge_id, l.inflow_id, l.k, p.n as step, p.pos as cell_id from link l join gauge g on g.gauge_id = l.inflow_id
  join path p on p.cell_id = g.cell_id where p.n >= 1),
served(k, gauge_id, taken, inflow_id, step, cell_id) as (
  select 0::bigint, gauge_id, []::bigint[], null::bigint, null::bigint, null::bigint from (select distinct gauge_id from link)
  union all
  select s.k + 1, s.gauge_id, list_append(s.taken, c.cell_id), c.inflow_id, c.step, c.cell_id from served s
  join (select * from steps) c on c.gauge_id = s.gauge_id and c.k = s.k + 1 and not list_contains(s.taken, c.cell_id)
  and not exists (select 1 from steps e where e.inflow_id = c.inflow_id and e.gauge_id = c.gauge_id and e.step < c.step
    and not list_contains(s.taken, e.cell_id)))
select gauge_id, inflow_id, step::int as step, cell_id from served where k > 0""")
def _(v):
    return _inlets(v)


# Chains of 64 cells that run down to a multiple of 64; the last 16 ids of a chain are inflows on one cell, 12 steps above the
# pit: the k-th takes the k-th cell below, four find none.
@query("distinct_inlet_cells_shared", """select cell_id // 64 as gauge_id, cell_id as inflow_id,
  least(cell_id % 64 - 47, 12)::int as step, case when cell_id % 64 - 47 <= 12 then cell_id // 64 * 64 + 12 - (cell_id % 64 - 47) end as cell_id
  from cell where cell_id % 64 >= 48 order by 1, 2""")
def _(v):
    c = F.col("cell_id")
    chain = v.cell.select("cell_id", F.when(c % 64 > 0, c - 1).alias("down_id"))
    inflow = v.cell.filter(c % 64 >= 48)
    links = inflow.select(F.expr("cell_id div 64").alias("gauge_id"), c.alias("inflow_id"))
    at = inflow.select(c.alias("gauge_id"), (c - c % 64 + 12).alias("cell_id"))
    return network.distinct_inlet_cells(chain, links, at)


# Two gauges on every gauge cell: each has the whole basin.
@query("catchment_area_cells_shared", f"""with recursive {MEMBER}, n as (select gauge_id, count(*) as n_cells from up group by 1)
  select gauge_id, n_cells from n union all select gauge_id + 1000000, n_cells from n""")
def _(v):
    twice = v.gauge.unionByName(v.gauge.withColumn("gauge_id", F.col("gauge_id") + 1_000_000))
    nearest = network.subcatchment(v.ldd, twice)
    return network.catchment_area_cells(nearest, network.gauge_tree(v.ldd, twice, nearest), twice)


@query("sampling_frequency_shared", f"""with recursive {MEMBER} select l.cell_id, 2 * count(up.gauge_id) as frequency
  from ldd l left join up using (cell_id) group by 1""")
def _(v):
    twice = v.gauge.unionByName(v.gauge.withColumn("gauge_id", F.col("gauge_id") + 1_000_000))
    nearest = network.subcatchment(v.ldd, twice)
    return network.sampling_frequency(v.ldd, nearest, network.gauge_tree(v.ldd, twice, nearest), twice)


BODY = f"""{RIVER_PATH}, ups as (select pos as cell_id, count(*) as ups from path group by 1),
b as (select cell_id, body, ups from water_body join ups using (cell_id) where body > 0),
out1 as (select * from (select *, max(ups) over (partition by body) as m from b) where ups = m),
near as (select path.cell_id, arg_min(o.body, n) as sub from path join out1 o on o.cell_id = path.pos group by 1),
kept as (select b.* from b join near using (cell_id) where sub = body),
out2 as (select body, cell_id from (select *, max(ups) over (partition by body) as m from kept) where ups = m)"""


@query("waterbody_outlet", f"with recursive {BODY} select body, cell_id from out2")
def _(v):
    return network.waterbody_outlet(v.river, v.water_body)[1]


@query("waterbody_cells", f"with recursive {BODY} select cell_id, body from kept")
def _(v):
    return network.waterbody_outlet(v.river, v.water_body)[0]


@query("zone_first_outlet", f"with recursive {BODY} select body, cell_id, ups::double as ups from out1")
def _(v):
    ups = network.upstream_accumulate(v.river, v.cell.select("cell_id", F.lit(1.0).alias("ups")), ["ups"])
    return network.largest_upstream(v.water_body.join(ups, "cell_id"), "body").select("body", "cell_id", "ups")


@query("cut_network_at_bodies", """select r.cell_id, case when body > 0 then null else down_id end as down_id
  from river r join water_body using (cell_id)""")
def _(v):
    return network.cut_network_at_bodies(v.river, v.water_body)


@query("buffer_zone", """with o as (select unnest([-1, 0, 1]) as d), near as (
  select row + a.d as row, col + b.d as col, min(body) as near from water_body, o a, o b where body > 0 group by 1, 2)
select w.cell_id, w.row, w.col, case when body > 0 then body else coalesce(near, 0) end as buffer
  from water_body w left join near using (row, col)""")
def _(v):
    return network.buffer_zone(v.water_body, 3)


@query("mask_from_point", f"""with recursive {MEMBER} select gauge_id, min(row) as row0, max(row) as row1, min(col) as col0, max(col) as col1
  from up join cell using (cell_id) group by 1""")
def _(v):
    return network.mask_from_point(v.ldd, v.cell, v.gauge)[1]


@query("flow_distance_factor", """select cell_id, round(case when code in (1,3,7,9) then 1.414214 * sqrt(area) else sqrt(area) end, 6) as length
  from flow_code join (select cell_id, area from cell) using (cell_id)""")
def _(v):
    t = v.flow_code.join(v.cell.select("cell_id", "area"), "cell_id")
    return t.select("cell_id", F.round(network.flow_distance_factor(F.col("code"), F.sqrt("area")), 6).alias("length"))


@query("lake_inflow_sum", f"""with recursive {BODY}, f as (
  select body, date, value * 86400 as volume from river r join kept k on k.cell_id = r.down_id join cell_day d on d.cell_id = r.cell_id
  union all select body, date, value * area / 1000 from kept join cell_day using (cell_id) join (select cell_id, area from cell) using (cell_id)),
t as (select body, date, sum(volume) as inflow from f group by 1, 2)
select t.body, date, round(inflow, 5) as inflow, outlet_id from t join (select body, min(cell_id) as outlet_id from out2 group by 1) o using (body)""")
def _(v):
    bodies, outlets = network.waterbody_outlet(v.river, v.water_body)
    flows = v.cell_day.select("cell_id", "date", F.col("value").alias("discharge"), (F.col("value") / 1000).alias("runoff"))
    out = network.lake_inflow_sum(v.river, flows, v.cell, bodies, outlets)
    return out.select("body", "date", F.round("inflow", 5).alias("inflow"), "outlet_id")
