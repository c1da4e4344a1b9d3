"""Calendar and output-aggregation queries."""

from pyspark.sql import functions as F

from hydroloom.functions import dates
from hydroloom.functions.clean import round_double
from hydroloom.operators import incremental, network, temporal
from hydroloom.plans.registry import query
from hydroloom.session import cut_lineage, scratch_path

KEYS = ["variable", "cell_id"]
SPIN = "1996-01-01"
END = "(select max(date) from cell_series)"


def _spin():
    return F.lit(SPIN).cast("date")


def _r(df, digits=6):
    return df.withColumn("value", F.round("value", digits))


@query("agg_daily", "select variable, cell_id, date, value from cell_series")
def _(v):
    return temporal.agg_daily(v.cell_series, KEYS)


MONTH = f"""m as (select variable, cell_id, date_trunc('month', date)::date as date, sum(value) as value
  from cell_series group by 1, 2, 3), mm as (select * from m where last_day(date) <= {END})"""
YEAR = f"""y as (select variable, cell_id, date_trunc('year', date)::date as date, sum(value) as value
  from cell_series group by 1, 2, 3), yy as (select * from y where make_date(year(date), 12, 31) <= {END})"""


@query("agg_monthtot", f"with {MONTH} select * from mm")
def _(v):
    return temporal.agg_monthtot(v.cell_series, KEYS)


@query("agg_monthavg", f"with {MONTH} select variable, cell_id, date, round(value / day(last_day(date)), 6) as value from mm")
def _(v):
    return _r(temporal.agg_monthavg(v.cell_series, KEYS))


@query("agg_monthend", """select variable, cell_id, date_trunc('month', date)::date as date, value
  from cell_series where date = last_day(date)""")
def _(v):
    return temporal.agg_monthend(v.cell_series, KEYS)


@query("agg_annualtot", f"with {YEAR} select * from yy")
def _(v):
    return temporal.agg_annualtot(v.cell_series, KEYS)


@query("agg_annualavg", f"""with {YEAR} select variable, cell_id, date,
  round(value / dayofyear(make_date(year(date), 12, 31)), 6) as value from yy""")
def _(v):
    return _r(temporal.agg_annualavg(v.cell_series, KEYS))


@query("agg_annualend", """select variable, cell_id, date_trunc('year', date)::date as date, value
  from cell_series where month(date) = 12 and day(date) = 31""")
def _(v):
    return temporal.agg_annualend(v.cell_series, KEYS)


@query("agg_totaltot", f"""select variable, cell_id, sum(value) as value from cell_series
  where date >= date '{SPIN}' group by 1, 2""")
def _(v):
    return temporal.agg_totaltot(v.cell_series, KEYS, _spin())


@query("agg_totalavg", f"""select variable, cell_id, round(sum(value) / (datediff('day', date '{SPIN}', {END}) + 1), 6) as value
  from cell_series where date >= date '{SPIN}' group by 1, 2""")
def _(v):
    return _r(temporal.agg_totalavg(v.cell_series, KEYS, _spin()))


@query("agg_totalend", "select variable, cell_id, arg_max(value, date) as value from cell_series group by 1, 2")
def _(v):
    return temporal.agg_totalend(v.cell_series, KEYS)


@query("agg_once", "select cell_id, area as value from cell")
def _(v):
    return temporal.agg_once(v.cell, ["cell_id"], "area")


@query("agg_12month", f"""select variable, cell_id, make_date(year({END}), month(date), 1) as date, round(avg(value), 6) as value
  from cell_series group by 1, 2, 3""")
def _(v):
    return _r(temporal.agg_12month(v.cell_series, KEYS))


MEMBER = """up(gauge_id, cell_id) as (select gauge_id, cell_id from gauge
  union all select u.gauge_id, l.cell_id from up u join ldd l on l.down_id = u.cell_id)"""


def _gauges(v):
    nearest = network.subcatchment(v.ldd, v.gauge)
    return nearest, network.gauge_tree(v.ldd, v.gauge, nearest), v.gauge


@query("agg_gauge_point", "select gauge_id, variable, date, value from cell_series join gauge using (cell_id)")
def _(v):
    return temporal.agg_gauge_point(v.cell_series, v.gauge, ["variable", "date"])


@query("agg_gauge_sum", f"""with recursive {MEMBER} select gauge_id, date, round(sum(value * area), 3) as value
  from cell_day join up using (cell_id) join cell using (cell_id) group by 1, 2""")
def _(v):
    return _r(temporal.agg_gauge_area(v.cell_day, v.cell, *_gauges(v)), 3)


@query("agg_gauge_avg", f"""with recursive {MEMBER}, a as (select gauge_id, sum(area) as total from up join cell using (cell_id) group by 1)
  select gauge_id, date, round(sum(value * area) / any_value(total), 6) as value
  from cell_day join up using (cell_id) join cell using (cell_id) join a using (gauge_id) group by 1, 2""")
def _(v):
    return _r(temporal.agg_gauge_area(v.cell_day, v.cell, *_gauges(v), average=True))


@query("aggregate_outputs", f"""with recursive {MEMBER}, e as (select max(date) as e from cell_series),
g as (select variable, gauge_id, date, sum(value * area) as value from cell_series join up using (cell_id)
  join cell using (cell_id) where variable in ('AF', 'AO') group by 1, 2, 3)
select variable, 'monthtot' as temporal, 'map' as spatial, cell_id as target_id, date_trunc('month', date)::date as date,
  round(sum(value), 3) as value from cell_series, e where variable in ('NO', 'NF') group by 1, 4, 5
  having last_day(date_trunc('month', any_value(date))) <= any_value(e)
union all select variable, 'daily', 'tss', gauge_id, date, value from cell_series join gauge using (cell_id) where variable = 'RF'
union all select variable, 'annualtot', 'areasum', gauge_id, date_trunc('year', date)::date, round(sum(value), 3) from g, e
  group by 1, 4, 5 having make_date(year(any_value(date)), 12, 31) <= any_value(e)
union all select variable, 'totaltot', 'map', cell_id, null, round(sum(value), 3) from cell_series
  where variable = 'RO' and date >= date '{SPIN}' group by 1, 4""")
def _(v):
    nearest, tree, gauge = _gauges(v)
    requests = [
        ("NO", "monthtot", "map"), ("NF", "monthtot", "map"), ("RF", "daily", "tss"),
        ("AF", "annualtot", "areasum"), ("AO", "annualtot", "areasum"), ("RO", "totaltot", "map"),
    ]
    series = cut_lineage(v.cell_series, "cell-series")
    return _r(temporal.aggregate_outputs(series, requests, _spin(), v.cell, gauge, nearest, tree), 3)


# Each kind of period over a table t(variable, target_id, date, value); E is the end of the run.
PERIODS = {
    "daily": "select variable, target_id, date, value from {t}",
    "monthtot": "select variable, target_id, date_trunc('month', date)::date, sum(value) from {t}, e group by 1, 2, 3 having last_day(any_value(date)) <= any_value(e)",
    "monthavg": "select variable, target_id, date_trunc('month', date)::date, sum(value) / day(last_day(any_value(date))) from {t}, e group by 1, 2, 3 having last_day(any_value(date)) <= any_value(e)",
    "monthend": "select variable, target_id, date_trunc('month', date)::date, value from {t} where date = last_day(date)",
    "annualtot": "select variable, target_id, date_trunc('year', date)::date, sum(value) from {t}, e group by 1, 2, 3 having make_date(year(any_value(date)), 12, 31) <= any_value(e)",
    "annualavg": "select variable, target_id, date_trunc('year', date)::date, sum(value) / dayofyear(make_date(year(any_value(date)), 12, 31)) from {t}, e group by 1, 2, 3 having make_date(year(any_value(date)), 12, 31) <= any_value(e)",
    "annualend": "select variable, target_id, date_trunc('year', date)::date, value from {t} where date = make_date(year(date), 12, 31)",
    "totaltot": "select variable, target_id, null::date, sum(value) from {t} where date >= date '{spin}' group by 1, 2",
    "totalavg": "select variable, target_id, null::date, sum(value) / (datediff('day', date '{spin}', any_value(e)) + 1) from {t}, e where date >= date '{spin}' group by 1, 2",
    "totalend": "select variable, target_id, null::date, arg_max(value, date) from {t} group by 1, 2",
    "once": "select variable, target_id, null::date, arg_max(value, date) from {t} group by 1, 2",
    "12month": "select variable, target_id, make_date(year(any_value(e)), month(date), 1), avg(value) from {t}, e group by variable, target_id, month(date)",
}
PAIRS = [(t, "map") for t in temporal.MAP_KINDS] + [(t, s) for s in temporal.GAUGE_KINDS for t in temporal.SERIES_KINDS]
ALL_PAIRS = " union all ".join(
    f"select variable, '{t}' as temporal, '{s}' as spatial, target_id, date, round(value, 5) as value from ({PERIODS[t].format(t=s, spin=SPIN)}) x(variable, target_id, date, value)"
    for t, s in PAIRS
)


@query("aggregate_outputs_all", f"""with recursive {MEMBER}, e as (select max(date) as e from cell_series),
map as (select variable, cell_id as target_id, date, value from cell_series),
tss as (select variable, gauge_id as target_id, date, value from cell_series join gauge using (cell_id)),
areasum as (select variable, gauge_id as target_id, date, sum(value * area) as value from cell_series join up using (cell_id) join cell using (cell_id) group by 1, 2, 3),
total as (select gauge_id as target_id, sum(area) as total from up join cell using (cell_id) group by 1),
areaavg as (select variable, target_id, date, value / total as value from areasum join total using (target_id))
{ALL_PAIRS}""")
def _(v):
    nearest, tree, gauge = _gauges(v)
    series = cut_lineage(v.cell_series, "cell-series")
    names = [r["variable"] for r in series.select("variable").distinct().orderBy("variable").collect()]
    requests = [(name, t, s) for name in names for t, s in PAIRS]
    out = temporal.aggregate_outputs(series, requests, _spin(), v.cell, gauge, nearest, tree)
    return out.withColumn("value", round_double(F.col("value"), 5))


MONTH_KINDS = [t for t in temporal.MAP_KINDS if t != "daily"]
FOLDED = " union all ".join(
    f"select '{t}' as temporal, variable, target_id, date, round(value, 5) as value from ({PERIODS[t].format(t='map', spin=SPIN)}) x(variable, target_id, date, value)"
    for t in MONTH_KINDS
)


@query("incremental_outputs", f"""with e as (select max(date) as e from cell_series),
map as (select variable, cell_id as target_id, date, value from cell_series) {FOLDED}""")
def _(v):
    # Two runs over the same store: the second one reads the days behind the first one's last, in the middle of a month.
    store, keys = scratch_path(v.spark, "month-store"), ["variable", "target_id"]
    series = v.cell_series.select("variable", F.col("cell_id").alias("target_id"), "date", "value")
    incremental.fold_days(series.filter("date <= date'1997-05-14'"), store, keys, _spin())
    incremental.fold_days(series, store, keys, _spin())
    return _r(incremental.outputs(v.spark, store, MONTH_KINDS, keys, _spin()), 5)


@query("env_flow_stats", "select cell_id, round(avg(value), 6) as maf, round(quantile_cont(value, 0.1), 6) as q90 from cell_day group by 1")
def _(v):
    return temporal.env_flow_stats(v.cell_day).select("cell_id", F.round("maf", 6).alias("maf"), F.round("q90", 6).alias("q90"))


@query("env_flow_monthly", """select cell_id, month(date)::int as month, round(avg(value), 6) as mmf,
  round(quantile_cont(value, 0.1), 6) as mq90 from cell_day group by 1, 2""")
def _(v):
    return temporal.env_flow_monthly(v.cell_day).select(
        "cell_id", "month", F.round("mmf", 6).alias("mmf"), F.round("mq90", 6).alias("mq90")
    )


@query("env_flow_vmf", """with f as (select cell_id, avg(value) as maf from cell_day group by 1),
m as (select cell_id, month(date)::int as month, avg(value) as mmf from cell_day group by 1, 2)
select cell_id, month, round(case when mmf <= 0.4 * maf then 0.6 * mmf when mmf > 0.8 * maf then 0.3 * mmf else 0.45 * mmf end, 6) as vmf
from m join f using (cell_id)""")
def _(v):
    months = temporal.env_flow_monthly(v.cell_day).select("cell_id", "month", "mmf")
    year = v.cell_day.groupBy("cell_id").agg(F.avg("value").alias("maf"))
    return months.join(year, "cell_id").select(
        "cell_id", "month", F.round(temporal.env_flow_vmf(F.col("mmf"), F.col("maf")), 6).alias("vmf")
    )


@query("date_features", """select o_orderkey, dayofyear(d)::int as doy, ((dayofyear(d) - 1) // 10)::int as slot10,
  ((dayofyear(d) - 1) // 30)::int as slot30, day(d) = 1 as new_month, dayofyear(d) = 1 as new_year,
  day(last_day(d))::int as days_in_month, dayofyear(make_date(year(d), 12, 31))::int as days_in_year,
  (case when month(d) = 12 and day(d) = 31 then 2 when d = last_day(d) then 1 else 0 end)::int as period_end
  from (select o_orderkey, o_orderdate::date as d from orders)""")
def _(v):
    d = F.to_date("o_orderdate")
    return v.table("orders").select("o_orderkey", *[c.alias(n) for n, c in dates.date_features(d).items()])


@query("period_end_flag", """select date, (case when month(date) = 12 and day(date) = 31 then 2
  when date = last_day(date) then 1 else 0 end)::int as flag from (select distinct date from cell_day)""")
def _(v):
    return v.cell_day.select("date").distinct().withColumn("flag", dates.period_end_flag(F.col("date")))


@query("parse_date", "select o_orderkey, o_orderdate::date as date from orders")
def _(v):
    k = F.col("o_orderkey") % 5
    d = F.col("o_orderdate")
    text = (
        F.when(k == 0, F.date_format(d, "dd/MM/yyyy")).when(k == 1, F.date_format(d, "d.M.yyyy"))
        .when(k == 2, F.date_format(d, "yyyy-MM-dd"))
        .when(k == 3, F.date_format(d, "d-M-yyyy"))
        .otherwise((F.datediff(d, F.lit("1990-01-01").cast("date")) + 1).cast("string"))
    )
    return v.table("orders").select("o_orderkey", dates.parse_date(text, F.lit("1990-01-01").cast("date")).alias("date"))


@query("date_schedule", """select station_id, unnest(generate_series(date_trunc('month', min(date)), max(date)::timestamp, interval 3 month))::date as date
  from runs group by 1""")
def _(v):
    span = v.runs.groupBy("station_id").agg(F.trunc(F.min("date"), "MM").alias("a"), F.max("date").alias("b"))
    return span.select("station_id", F.explode(dates.date_schedule(F.col("a"), F.col("b"), 3, "m")).alias("date"))


@query("calendar_convert", """with n as (select o_orderkey, datediff('day', date '1990-01-01', o_orderdate::date) as n from orders),
m as (select *, n // 365 as y, n % 365 as k from n)
select o_orderkey, (y + 1990)::int as year_noleap, month(date '2001-01-01' + k::int)::int as month_noleap,
  day(date '2001-01-01' + k::int)::int as day_noleap, (n // 360 + 1990)::int as year_360,
  ((n % 360) // 30 + 1)::int as month_360, ((n % 360) % 30 + 1)::int as day_360, n::int as back from m""")
def _(v):
    n = F.datediff("o_orderdate", F.lit("1990-01-01").cast("date"))
    out = {}
    for name, cal in (("noleap", "noleap"), ("360", "360_day")):
        for part, col in zip(("year", "month", "day"), dates.calendar_ymd(n, cal, 1990)):
            out[f"{part}_{name}"] = col
    back = dates.calendar_number(*dates.calendar_ymd(n, "noleap", 1990), "noleap", 1990)
    return v.table("orders").select("o_orderkey", *[c.alias(k) for k, c in out.items()], back.alias("back"))


@query("step_index", """select station_id, date, (datediff('day', (select min(date) from runs), date) + 1)::int as step
  from runs""")
def _(v):
    start = v.runs.select(F.min("date")).scalar()
    return v.runs.select("station_id", "date", dates.step_index(F.col("date"), start).alias("step"))


@query("period_slice", """with p as (select station_id, (min(date) + 365)::date as a, (max(date) - 365)::date as b from runs group by 1)
select r.station_id, r.run_id, r.date, round(r.q, 3) as q from runs r join p using (station_id) where r.date between a and b""")
def _(v):
    period = v.runs.groupBy("station_id").agg(
        F.date_add(F.min("date"), 365).alias("start"), F.date_sub(F.max("date"), 365).alias("end")
    )
    from hydroloom.operators.joins import period_slice

    return period_slice(v.runs, period).select("station_id", "run_id", "date", F.round("q", 3).alias("q"))
