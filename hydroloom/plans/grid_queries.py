"""Clip, mask, resampling and map queries on the part grid."""

from pyspark.sql import functions as F

from hydroloom.functions import clean
from hydroloom.grid import GridSpec
from hydroloom.operators import gridops, joins
from hydroloom.plans.registry import query

ROWS = "(select max(row) + 1 from cell)"
# One coarse value per block of 4 x 4 fine cells, from the cells' daily values.
COARSE = """select cast(floor(c.row / 4e0) as int) as row, cast(floor(c.col / 4e0) as int) as col, avg(d.value) as value
  from cell c join cell_day d on d.cell_id = c.cell_id group by 1, 2"""
SHAPE = f"""sh as (select (max(row) + 1) as nr, (max(col) + 1) as nc from coarse)"""


@query("clip_to_box", "select cell_id, row - 2 as row, col - 5 as col, area from cell where row >= 2 and row < 30 and col >= 5 and col < 45")
def _(v):
    return gridops.clip_to_box(v.cell, 2, 30, 5, 45).select("cell_id", "row", "col", "area")


@query("clip_ldd_edges", """with b as (select cell_id, row - 2 as row, col - 5 as col, case when code > 9 or code < 0 then 0 else code end as code
  from any_code where row >= 2 and row < 30 and col >= 5 and col < 45)
select cell_id, row, col, (case when row = 0 and code in (7,8,9) or row = 27 and code in (1,2,3) or col = 0 and code in (1,4,7)
  or col = 39 and code in (3,6,9) then 5 else code end)::int as code from b""")
def _(v):
    return gridops.clip_ldd_edges(gridops.clip_to_box(v.any_code, 2, 30, 5, 45), 28, 40)


@query("mask_cells", """select cell_id, code from any_code where code > 0 and cell_id in (select cell_id from water_body where body > 0)""")
def _(v):
    return gridops.mask_cells(v.any_code, v.water_body.filter("body > 0")).select("cell_id", "code")


@query("semi_mask_join", "select * from cell_day where cell_id in (select cell_id from water_body where body > 0)")
def _(v):
    return joins.semi_mask(v.cell_day, v.water_body.filter("body > 0")).select("cell_id", "date", "value")


@query("mask_from_rectangle", """select cell_id, row, col, count(d.date) as n_days from cell left join cell_day d using (cell_id) group by 1, 2, 3""")
def _(v):
    g = v.grid
    mask = gridops.mask_from_rectangle(v.spark, f"{g.cols} {g.rows} {g.cellsize} {g.xul} {g.yul}")
    days = v.cell_day.groupBy("cell_id").agg(F.count("date").alias("n_days"))
    return mask.join(days, "cell_id", "left").na.fill(0, ["n_days"])


@query("cell_of_point", f"""with g as (select {ROWS}::double as yul), p as (select station_id, floor(yul - (lat + 0.25))::int as row,
  floor(lon + 0.75)::int as col, yul from station, g)
select station_id, row, col, row between 0 and yul - 1 and col between 0 and 49 as in_grid,
  case when row between 0 and yul - 1 and col between 0 and 49 then row::bigint * 50 + col end as cell_id from p""")
def _(v):
    p = v.station.select("station_id", (F.col("lat") + 0.25).alias("lat"), (F.col("lon") + 0.75).alias("lon"))
    return gridops.cell_of_point(p, v.grid).select("station_id", "row", "col", "in_grid", "cell_id")


@query("coord_of_cell", f"select cell_id, {ROWS} - (row + 0.5::double) as lat, col + 0.5::double as lon from cell")
def _(v):
    return gridops.coord_of_cell(v.cell, v.grid).select("cell_id", "lat", "lon")


@query("compact_box", f"""select body, min(row) as row0, max(row) as row1, min(col) as col0, max(col) as col1, min(col)::double as xul,
  {ROWS}::double - min(row) as yul from water_body where body > 0 group by 1""")
def _(v):
    return gridops.compact_box(v.water_body.filter("body > 0"), "body", v.grid)


@query("move_to_box", """select cell_id, body, row - min(row) over (partition by body) as row, col - min(col) over (partition by body) as col
  from water_body where body > 0""")
def _(v):
    inside = v.water_body.filter("body > 0")
    return gridops.move_to_box(inside, gridops.compact_box(inside, "body", v.grid), "body").select("cell_id", "body", "row", "col")


@query("grid_refine", f"""with coarse as ({COARSE}) select cell_id, round(value, 6) as value from cell c join coarse k
  on k.row = c.row // 4 and k.col = c.col // 4""")
def _(v):
    out = gridops.grid_refine(v.cell.select("cell_id", "row", "col"), v.sql(COARSE), 4)
    return out.select("cell_id", F.round("value", 6).alias("value"))


def _fine(v):
    return v.cell.select("cell_id", "row", "col", (F.col("area") - 890).alias("climate"))


BLOCK = f"""coarse as ({COARSE}), f as (select cell_id, row, col, area - 890 as climate,
  avg(area - 890) over (partition by row // 4, col // 4) as m from cell)"""


@query("delta_temperature", f"""with {BLOCK} select cell_id, round(climate - m + value, 6) as value from f
  join coarse k on k.row = f.row // 4 and k.col = f.col // 4""")
def _(v):
    return gridops.delta_temperature(_fine(v), v.sql(COARSE), 4).select("cell_id", F.round("value", 6).alias("value"))


@query("delta_precip", f"""with {BLOCK} select cell_id, round(value * climate / m, 6) as value from f
  join coarse k on k.row = f.row // 4 and k.col = f.col // 4""")
def _(v):
    return gridops.delta_precip(_fine(v), v.sql(COARSE), 4).select("cell_id", F.round("value", 6).alias("value"))


def _bilinear_sql(kind, alignment):
    delta = "m - value" if kind == "temperature" else "value / m"
    y, x = (
        ("(f.row + 0.5::double) / 4 - 0.5", "(f.col + 0.5::double) / 4 - 0.5") if alignment == "centre"
        else ("f.row * (nr - 1) / (4 * nr - 1)::double", "f.col * (nc - 1) / (4 * nc - 1)::double")
    )
    result = "climate - d" if kind == "temperature" else "climate * d"
    corner = lambda a, b: f"join q q{a}{b} on q{a}{b}.row = greatest(0, least(nr - 1, r0 + {a})) and q{a}{b}.col = greatest(0, least(nc - 1, c0 + {b}))"
    return f"""with coarse as ({COARSE}), {SHAPE}, mean as (select row // 4 as row, col // 4 as col, avg(area - 890) as m from cell group by 1, 2),
q as (select k.row, k.col, {delta} as d from coarse k join mean using (row, col)),
f as (select f.cell_id, area - 890 as climate, {y} as y, {x} as x, nr, nc from cell f, sh),
g as (select *, floor(y)::int as r0, floor(x)::int as c0 from f),
i as (select g.cell_id, climate, (q00.d * (1 - (x - c0)) + q01.d * (x - c0)) * (1 - (y - r0)) + (q10.d * (1 - (x - c0)) + q11.d * (x - c0)) * (y - r0) as d
  from g {corner(0, 0)} {corner(0, 1)} {corner(1, 0)} {corner(1, 1)})
select cell_id, round({result}, 6) as value from i"""


def _interpolated(v, kind, alignment):
    rows, cols = -(-v.grid.rows // 4), -(-v.grid.cols // 4)
    out = gridops.delta_interpolated(_fine(v), v.sql(COARSE), 4, rows, cols, kind, alignment)
    return out.select("cell_id", F.round("value", 6).alias("value"))


@query("delta_bilinear_temperature", _bilinear_sql("temperature", "centre"))
def _(v):
    return _interpolated(v, "temperature", "centre")


@query("delta_bilinear_precip", _bilinear_sql("precip", "centre"))
def _(v):
    return _interpolated(v, "precip", "centre")


@query("delta_spline", _bilinear_sql("temperature", "zoom"))
def _(v):
    return _interpolated(v, "temperature", "zoom")


DAILYCOARSE = """select d.date, cast(floor(c.row / 4e0) as int) as row, cast(floor(c.col / 4e0) as int) as col, avg(d.value) / 7 as value
  from cell c join cell_day d on d.cell_id = c.cell_id group by 1, 2, 3"""


# A coarse cell without a value on a day leaves its share of the patches around it unknown.
@query("delta_bilinear_daily", f"""with coarse as ({COARSE}), {SHAPE}, daily as ({DAILYCOARSE}), mean as (select row // 4 as row, col // 4 as col, avg(area - 890) as m from cell group by 1, 2),
q as (select date, k.row, k.col, m - value as d from daily k join mean using (row, col)),
f as (select c.cell_id, area - 890 as climate, (c.row + 0.5::double) / 4 - 0.5 as y, (c.col + 0.5::double) / 4 - 0.5 as x, nr, nc from cell c, sh),
g as (select *, floor(y)::int as r0, floor(x)::int as c0 from f),
n as (select cell_id, climate, y - r0 as fy, x - c0 as fx, a, b, greatest(0, least(nr - 1, r0 + a)) as row, greatest(0, least(nc - 1, c0 + b)) as col from g, (select unnest([0, 1]) as a), (select unnest([0, 1]) as b)),
w as (select cell_id, date, any_value(climate) as climate, sum(d * case when a = 1 then fy else 1 - fy end * case when b = 1 then fx else 1 - fx end) as delta, count(*) as k
  from n join q using (row, col) group by 1, 2)
select cell_id, date, round(climate - delta, 6) as value from w where k = 4""")
def _(v):
    rows, cols = -(-v.grid.rows // 4), -(-v.grid.cols // 4)
    out = gridops.delta_interpolated(_fine(v), v.sql(DAILYCOARSE), 4, rows, cols, "temperature", keys=["date"])
    return out.filter(F.col("value").isNotNull()).select("cell_id", "date", F.round("value", 6).alias("value"))


@query("map_step", "select cell_id, value from cell_day where date = (select max(date) from cell_day) - 19")
def _(v):
    return gridops.map_step(v.cell_day, -20)


@query("map_delta", """with e as (select min(date) as a, max(date) as b from cell_day), z as (select zone, date, sum(value) as value
  from cell_day join cell using (cell_id) group by 1, 2)
select zone, sum(value) filter (date = b - 9) - sum(value) filter (date = a + 10) as value from z, e group by 1
  having sum(value) filter (date = b - 9) is not null and sum(value) filter (date = a + 10) is not null""")
def _(v):
    z = v.cell_day.join(v.cell.select("cell_id", "zone"), "cell_id").groupBy("zone", "date").agg(F.sum("value").alias("value"))
    return gridops.map_delta(z, -10, 10, ["zone"])


@query("map_sum", "select cell_id, sum(value) as value from cell_day group by 1")
def _(v):
    return gridops.map_sum(v.cell_day)


@query("valid_cell_filters", """select cell_id, least(value * 1e6, 5e8) as value, greatest(1, least(value * 1e6, 5e8) / 100) as radius, 100 - value as inverted
  from (select cell_id, sum(value) as value from cell_day group by 1) where value <> 1200""")
def _(v):
    kept = gridops.valid_cells(gridops.map_sum(v.cell_day))
    big = clean.cap_display(F.col("value") * 1e6)
    return kept.select("cell_id", big.alias("value"), clean.display_radius(big).alias("radius"), (100 - F.col("value")).alias("inverted"))


@query("map_points", f"""select cell_id, {ROWS} - (row + 0.5::double) as lat, col + 0.5::double as lon, value, greatest(1, value / 100) as radius
  from (select cell_id, sum(value) as value from cell_day group by 1) join cell using (cell_id) where value > 0""")
def _(v):
    return gridops.map_points(gridops.map_sum(v.cell_day), v.cell, v.grid)


@query("nearest_cell", f"""with p as (select station_id, lat + 0.3 as lat, lon + 0.7 as lon from station),
r as (select station_id, arg_min(row, (abs(y - lat), row)) as row from p, (select distinct row, {ROWS} - (row + 0.5::double) as y from cell) group by 1),
c as (select station_id, arg_min(col, (abs(x - lon), col)) as col from p, (select distinct col, col + 0.5::double as x from cell) group by 1)
select station_id, row, col from r join c using (station_id)""")
def _(v):
    g = v.grid
    p = v.station.withColumn("lat", F.col("lat") + 0.3).withColumn("lon", F.col("lon") + 0.7)
    row = joins.nearest_on_grid(F.lit(g.yul) - F.col("lat"), 0.0, g.cellsize, g.rows)
    col = joins.nearest_on_grid(F.col("lon"), g.xul, g.cellsize, g.cols)
    return p.select("station_id", row.alias("row"), col.alias("col"))


@query("nearest_on_axis", """select q.key, arg_min(a.i, (abs(a.x - q.v), a.i)) as i from (select o_orderkey as key, 895 + o_totalprice / 5000 as v from orders) q, (select area as x, min(cell_id) as i from cell group by 1) a group by 1""")
def _(v):
    points = v.table("orders").select(F.col("o_orderkey").alias("key"), (895 + F.col("o_totalprice") / 5000).alias("v"))
    return joins.nearest_on_axis(points, v.cell, "key", "v", "area", "cell_id").select("key", F.col("cell_id").alias("i"))


@query("extract_point_series", f"""with s as (select station_id, greatest(0, least({ROWS} - 1, ceil({ROWS} - (lat + 0.3) - 1)))::bigint * 50 + greatest(0, least(49, ceil(lon + 0.7 - 1)))::bigint as cell_id from station)
select station_id, cell_id, date, value from cell_day join s using (cell_id)""")
def _(v):
    p = v.station.select("station_id", (F.col("lat") + 0.3).alias("lat"), (F.col("lon") + 0.7).alias("lon"))
    return gridops.point_series(v.cell_day, p, v.grid).select("station_id", "cell_id", "date", "value")


@query("resolution_ratio", "select cell_id, ((row + 2) // 4)::int as coarse_row, ((col + 3) // 4)::int as coarse_col from cell")
def _(v):
    fine = v.grid
    coarse = GridSpec(rows=fine.rows // 4 + 1, cols=fine.cols // 4 + 1, cellsize=4.0, xul=fine.xul - 3, yul=fine.yul + 2)
    return gridops.coarse_cell(v.cell, fine.ratio_to(coarse)).select("cell_id", "coarse_row", "coarse_col")
