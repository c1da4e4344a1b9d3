"""Source and sink queries: write driver data in a format, read it back, compare."""

from functools import reduce

from pyspark.sql import functions as F

from hydroloom.functions.dates import date_schedule
from hydroloom.operators import network
from hydroloom.plans.registry import query
from hydroloom.session import scratch_path
from hydroloom.sources import readers, writers

C = F.col
START = "1995-01-01"


def _start():
    return F.lit(START).cast("date")


TSS = """select l_suppkey as station, l_linenumber as name, (datediff('day', date '1995-01-01', l_shipdate::date) + 1)::int as step, sum(l_quantity) as value
  from lineitem group by 1, 2, 3"""


def _tss_rows(v):
    return (
        v.table("lineitem")
        .groupBy(C("l_suppkey").cast("string").alias("file"), C("l_linenumber").cast("string").alias("name"), (F.datediff("l_shipdate", _start()) + 1).alias("step"))
        .agg(F.sum("l_quantity").alias("value"))
    )


NAMES = [str(i) for i in range(1, 8)]


# Every (station, step) line holds all names; absent ones are written as 1e31 and read as 0.
@query("read_tss", f"""with t as ({TSS}), s as (select distinct station, step from t), n as (select unnest(range(1, 8)) as name)
select s.station, 'gauge ' || n.name as name, s.step, (date '1995-01-01' + s.step - 1)::date as date, coalesce(t.value, 0) as value
  from s cross join n left join t on t.station = s.station and t.step = s.step and t.name = n.name""")
def _(v):
    # A title that starts with a number and names with blanks must not be taken for data.
    path = scratch_path(v.spark, "tss")
    named = _tss_rows(v).withColumn("name", F.concat(F.lit("gauge "), C("name")))
    writers.write_tss(named, path, [f"gauge {n}" for n in NAMES], "2024 run of gauges")
    out = readers.read_tss(v.spark, path, _start())
    return out.select(F.regexp_extract("file", r"file=(\d+)", 1).cast("long").alias("station"), "name", "step", "date", "value")


@query("write_tss", f"""with t as ({TSS}) select station, count(distinct step) + 10 as n_lines from t group by 1""")
def _(v):
    path = scratch_path(v.spark, "tss")
    writers.write_tss(_tss_rows(v), path, NAMES)
    return v.spark.read.text(path).groupBy(C("file").cast("long").alias("station")).agg(F.count("*").alias("n_lines"))


def _csv_rows(v, kind="daily"):
    from hydroloom.operators.temporal import agg_monthtot

    rows = v.table("lineitem").groupBy(C("l_suppkey").cast("string").alias("file"), C("l_returnflag").alias("name"), F.to_date("l_shipdate").alias("date")).agg(
        F.sum("l_quantity").alias("value")
    )
    return rows if kind == "daily" else agg_monthtot(rows, ["file", "name"])


POINTS = [("A", 17.25, 48.5), ("N", 17.75, 48.25), ("R", 18.0, 49.125)]


@query("read_series_csv", """with t as (select l_suppkey as station, l_returnflag as name, l_shipdate::date as date, sum(l_quantity) as value from lineitem group by 1, 2, 3),
s as (select distinct station, date from t), n as (select * from (values ('A', 17.25::double, 48.5::double), ('N', 17.75, 48.25), ('R', 18.0, 49.125)) p(name, x, y))
select s.station, n.name, n.x, n.y, s.date, t.value from s cross join n left join t on t.station = s.station and t.date = s.date and t.name = n.name""")
def _(v):
    path = scratch_path(v.spark, "csv")
    writers.write_series_csv(_csv_rows(v), path, POINTS)
    out = readers.read_series_csv(v.spark, path)
    return out.select(F.regexp_extract("file", r"file=(\d+)", 1).cast("long").alias("station"), "name", "x", "y", "date", "value")


@query("write_series_csv", """with t as (select l_suppkey as station, l_returnflag as name, date_trunc('month', l_shipdate)::date as date, sum(l_quantity) as value from lineitem group by 1, 2, 3),
u as (select * from t where last_day(date) <= (select max(l_shipdate)::date from lineitem))
select station, name, date, value from u""")
def _(v):
    path = scratch_path(v.spark, "csv")
    writers.write_series_csv(_csv_rows(v, "monthtot"), path, POINTS, "monthtot")
    out = readers.read_series_csv(v.spark, path).filter(C("value").isNotNull())
    return out.select(F.regexp_extract("file", r"file=(\d+)", 1).cast("long").alias("station"), "name", "date", "value")


@query("read_observations_wide", """with t as (select l_shipdate::date as date, l_linenumber as k, sum(l_quantity) - 100 as q from lineitem group by 1, 2)
select 'S' || k as station_id, date, case when q < 0 then null else q end as q from (select * from (select distinct date from t) cross join (select unnest(range(1, 8)) as k)) left join t using (date, k)""")
def _(v):
    path = scratch_path(v.spark, "wide")
    wide = v.table("lineitem").groupBy(F.date_format("l_shipdate", "d/M/yyyy").alias("Date")).pivot("l_linenumber", list(range(1, 8))).agg(F.sum("l_quantity") - 100)
    wide.toDF("Date", *[f"S{i}" for i in range(1, 8)]).write.option("header", "true").csv(path)
    return readers.read_observations_wide(v.spark, path)


@query("read_stations", "select s_suppkey::int as ID_numeric, 'G' || s_suppkey as ID, s_name as Station, (s_suppkey % 40)::double as lat, (s_suppkey % 50)::double as lon from supplier")
def _(v):
    path = scratch_path(v.spark, "stations")
    v.station.select(
        C("station_id").alias("ID_numeric"), F.concat(F.lit("G"), C("station_id")).alias("ID"), C("name").alias("Station"), "lat", "lon"
    ).write.option("header", "true").csv(path)
    return readers.read_stations(v.spark, path)


def _folder(v):
    path = scratch_path(v.spark, "folder")
    # One folder `station=<id>.csv` per station; the reader takes the station from the name.
    rows = v.pairs.filter("o is not null").select(
        F.concat(C("station_id").cast("string"), F.lit(".csv")).alias("station"), C("date").alias("position"), F.concat_ws(",", F.date_format("date", "yyyy-MM-dd"), F.format_string("%.4f", "o")).alias("line")
    )
    writers.write_lines(rows, path, "station")
    stations = v.table("supplier").select(F.concat(F.lit("station="), C("s_suppkey")).alias("station_id")).unionByName(
        v.table("nation").select(F.concat(F.lit("nation="), C("n_nationkey")).alias("station_id"))
    )
    return readers.read_observation_folder(v.spark, path, stations)


@query("read_observation_folder", """select 'station=' || s_suppkey as station_id, n, first_date, last_date from (select s_suppkey, count(o) as n, min(date) filter (o is not null) as first_date,
  max(date) filter (o is not null) as last_date from supplier left join pairs on station_id = s_suppkey group by 1)
union all select 'nation=' || n_nationkey, 0, null, null from nation""")
def _(v):
    obs, _ = _folder(v)
    return obs.groupBy("station_id").agg(F.count("q").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("missing_observation_files", "select 'nation=' || n_nationkey as station_id from nation")
def _(v):
    return _folder(v)[1]


def _stack(v):
    path = scratch_path(v.spark, "stack")
    series = v.cell_series.join(v.cell.select("cell_id", "row", "col"), "cell_id")
    writers.write_cell_series(series, path)
    return path


@query("scan_cell_series", """select variable, date, cell_id, value from cell_series join cell using (cell_id)
  where variable in ('NO', 'RF') and date between date '1996-03-01' and date '1998-06-30' and row >= 2 and row < 30 and col >= 5 and col < 45""")
def _(v):
    out = readers.scan_cell_series(v.spark, _stack(v), ["NO", "RF"], "1996-03-01", "1998-06-30", (2, 30, 5, 45), zeros=0.0)
    return out.select("variable", "date", "cell_id", "value")


@query("write_cell_series", "select variable, year(date)::int as year, count(*) as n, sum(value) as total from cell_series group by 1, 2")
def _(v):
    return v.spark.read.parquet(_stack(v)).groupBy("variable", "year").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


SLOT_OF = {"month": "month({d})", "10day": "floor((dayofyear({d}) - 1) / 10)", "day": "dayofyear({d})", "year": "year({d})"}


def _keyed(kind):
    # Slices of every cell from its shipped items; a date whose slot has none keeps its row.
    slots = f"""select l_partkey as cell_id, cast({SLOT_OF[kind].format(d="l_shipdate")} as int) as slot, sum(l_quantity) as map_value
      from lineitem where l_linestatus = 'F' group by 1, 2"""

    @query(f"scan_keyed_maps_{kind}", f"""with m as ({slots}) select d.cell_id, d.date, value, map_value from cell_day d
      left join m on m.cell_id = d.cell_id and m.slot = {SLOT_OF[kind].format(d="date")}""")
    def _(v):
        return readers.scan_keyed_maps(v.cell_day, v.sql(slots), kind).select("cell_id", "date", "value", "map_value")


for _kind in ("month", "10day", "day", "year"):
    _keyed(_kind)


@query("scan_static", "select cell_id, area as map, 0.25::double as constant from cell")
def _(v):
    out = readers.scan_static(readers.scan_static(v.cell, "map", "area"), "constant", 0.25)
    return out.select("cell_id", "map", "constant")


@query("catalog_files", """select variable, min(date) as first_date, max(date) as last_date from cell_series where year(date) between 1997 and 1999 group by 1""")
def _(v):
    files = readers.catalog_files(v.spark, _stack(v), "1997-01-01", "1999-12-31")
    return files.groupBy("variable").agg(F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"))


@query("write_clip_catalog", "select variable, count(*) as n from cell_series group by 1")
def _(v):
    path = scratch_path(v.spark, "clip")
    half = v.cell_series.filter(C("variable").startswith("N"))
    writers.write_clip_catalog(half, path)
    named = v.cell_series.unionByName(v.cell_series.withColumn("variable", F.lit("RCP_CO2_x")))
    writers.write_clip_catalog(named, path)
    return v.spark.read.parquet(path).groupBy("variable").agg(F.count("*").alias("n"))


SNAP = "(select unnest(generate_series(timestamp '1995-04-01', timestamp '2002-01-01', interval 3 month))::date)"


@query("snapshot_state", f"select variable, cell_id, value, date as snapshot_date from cell_series where date in {SNAP}")
def _(v):
    path = scratch_path(v.spark, "snapshot")
    schedule = date_schedule(F.lit("1995-04-01").cast("date"), F.lit("2002-01-01").cast("date"), 3, "m")
    days = v.spark.range(1).select(F.explode(schedule).alias("date"))
    writers.snapshot_state(v.cell_series, days, path)
    return v.spark.read.parquet(path).select("variable", "cell_id", "value", C("snapshot_date").cast("date").alias("snapshot_date"))


@query("load_state", """with last as (select variable, cell_id, arg_max(value, date) as value from cell_series group by 1, 2),
v as (select distinct variable from cell_series)
select v.variable, c.cell_id, coalesce(l.value, 0.5) as store from cell c cross join v left join last l on l.cell_id = c.cell_id and l.variable = v.variable""")
def _(v):
    # The last state of every variable is stored under the run's last day and loaded again.
    end = v.cell_series.select(F.max("date").alias("date"))
    last = v.cell_series.groupBy("variable", "cell_id").agg(F.max_by("value", "date").alias("value")).withColumn("date", end.scalar())
    path = scratch_path(v.spark, "state")
    writers.snapshot_state(last, end, path)
    stored = v.spark.read.parquet(path)
    names = sorted(r[0] for r in stored.select("variable").distinct().collect())
    loaded = [
        readers.load_state(v.cell, stored, name, 0.5).select(F.lit(name).alias("variable"), "cell_id", C(f"`{name}`").alias("store")) for name in names
    ]
    return reduce(lambda a, b: a.unionByName(b), loaded)


@query("dump_total_map", "select printf('%.3f', value * 1000) as line from (select cell_id, sum(value) as value from cell_day group by 1)")
def _(v):
    path = scratch_path(v.spark, "total-map")
    writers.dump_total_map(v.cell_day.groupBy("cell_id").agg(F.sum("value").alias("value")), path)
    return v.spark.read.text(path).withColumnRenamed("value", "line")


@query("write_point_series", "select gauge_id, variable, date, value from cell_series join gauge using (cell_id)")
def _(v):
    from hydroloom.operators.temporal import agg_gauge_point

    path = scratch_path(v.spark, "points")
    writers.write_point_series(agg_gauge_point(v.cell_series, v.gauge, ["variable", "date"]), path)
    return v.spark.read.option("header", "true").schema("gauge_id long, variable string, date date, value double").csv(path)


NEAR = """path(cell_id, pos, n) as (select cell_id, cell_id, 0::bigint from ldd
  union all select p.cell_id, l.down_id, n + 1 from path p join ldd l on l.cell_id = p.pos where l.down_id is not null),
near as (select path.cell_id, arg_min(g.gauge_id, n) as gauge_id from path join gauge g on g.cell_id = path.pos group by 1),
tree as (select g.gauge_id, near.gauge_id as parent_id from gauge g join ldd using (cell_id) left join near on near.cell_id = ldd.down_id)"""


@query("write_links_csv", f"""with recursive {NEAR}, l as (select g.gauge_id, count(t.gauge_id) as n, string_agg(',' || t.gauge_id, '' order by t.gauge_id) as ids
  from gauge g left join tree t on t.parent_id = g.gauge_id group by 1)
select gauge_id || coalesce(ids, '') || repeat(',', greatest(20 - n, 0)::int) as line from l""")
def _(v):
    path = scratch_path(v.spark, "links")
    nearest = network.subcatchment(v.ldd, v.gauge)
    writers.write_links_csv(network.direct_links(network.gauge_tree(v.ldd, v.gauge, nearest), v.gauge), v.gauge, path)
    return v.spark.read.text(path).withColumnRenamed("value", "line")


@query("write_param_maps", "select variable as parameter, cell_id, max(value) as value from cell_series group by 1, 2")
def _(v):
    path = scratch_path(v.spark, "params")
    writers.write_param_maps(v.cell_series.groupBy(C("variable").alias("name"), "cell_id").agg(F.max("value").alias("value")), path)
    return v.spark.read.parquet(path).select("parameter", "cell_id", "value")


WIDE = """select dayofyear(l_shipdate) as doy, sum(case when l_returnflag = 'A' then l_quantity end) as ra,
  sum(case when l_returnflag = 'N' then l_quantity end) as rb, sum(case when l_returnflag = 'R' then l_quantity end) as rc from lineitem group by 1"""


@query("read_schedule_366", f"""with w as ({WIDE}) select 3 as from_id, 8 as to_id, doy::int as doy, ra as release from w union all select 0, 5, doy::int, rb from w
  union all select 2, 7, doy::int, rc from w""")
def _(v):
    return readers.read_schedule_366(v.sql(WIDE), {"ra": (3, 8), "rb": (0, 5), "rc": (2, 7)})


@query("read_release_schedule", f"""with w as ({WIDE}), d as (select distinct body, unnest(range(1, 367))::int as doy from water_body where body > 0)
select body, d.doy, coalesce(case when body = 1 then ra when body = 4 then rb end, -1) as release, coalesce(case when body = 4 then ra when body = 1 then rc end, -1) as supply from d left join w on w.doy = d.doy""")
def _(v):
    wide = v.sql(WIDE)
    bodies = v.water_body.filter("body > 0").select(C("body").alias("body"))
    release = wide.select("doy", C("ra").alias("1"), C("rb").alias("4"), C("rb").alias("9999"))
    supply = wide.select("doy", C("ra").alias("4"), C("rc").alias("1"))
    out = readers.read_release_schedule(bodies, release, supply)
    return out.select(C("body").cast("int").alias("body"), "doy", "release", "supply")
