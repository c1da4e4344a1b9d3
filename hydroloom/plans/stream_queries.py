"""Streaming queries over the events as a file stream, run to the end of what is available."""

from pyspark.sql import functions as F

from hydroloom import schemas
from hydroloom.functions.dates import date_schedule
from hydroloom.plans.registry import query
from hydroloom.session import scratch_path
from hydroloom.streaming import months, readings

C = F.col
# A window is closed once the latest reading minus the allowed lateness has passed its end.
CLOSED = "(select max(ts) - interval 2 day from reading)"
DAYS = f"""d as (select gauge_id, variable, ts::date as date, count(*) as n, sum(value) as total, avg(value) as mean from reading
  group by 1, 2, 3 having ts::date + interval 1 day <= {CLOSED})""".replace("having ts::date", "having any_value(ts)::date")


def _readings(v):
    raw = readings.read_stream(v.spark, v.sf_dir, schemas.READING, "events.parquet")
    return raw.select(C("user_id").alias("gauge_id"), "ts", C("event_type").alias("variable"), "value")


def _run(v, stream, label, run=readings.run_to_table):
    return run(stream, scratch_path(v.spark, label), scratch_path(v.spark, f"{label}-state"))


@query("stream_daily", f"with {DAYS} select gauge_id, variable, date, n, round(total, 6) as total, round(mean, 6) as mean from d")
def _(v):
    out = _run(v, readings.stream_daily(_readings(v)), "daily")
    return out.withColumn("total", F.round("total", 6)).withColumn("mean", F.round("mean", 6))


@query("stream_slots", f"""with {DAYS} select gauge_id, variable, (make_date(year(date), 1, 1) + (((dayofyear(date) - 1) // 10) * 10)::int)::date as slot,
  sum(n)::bigint as n, round(sum(total), 6) as total from d group by 1, 2, 3""")
def _(v):
    out = readings.slot_totals(_run(v, readings.stream_slots(_readings(v), 10), "slots"))
    return out.withColumn("total", F.round("total", 6))




def _stretched(v):
    # The events cover one month; a day of the stream stands for six, so that months close.
    r = _readings(v)
    start = F.lit(1_704_067_200_000_000)  # 2024-01-01 00:00 UTC
    return r.withColumn("ts", F.timestamp_micros(start + (F.unix_micros("ts") - start) * 6))


def _closed_days(v):
    path = scratch_path(v.spark, "days")
    months.commit_days(readings.stream_daily(_stretched(v)), path, scratch_path(v.spark, "days-state"))
    return months.closed_days(v.spark, path)


STRETCH = """r as (select gauge_id, make_timestamp(epoch_us(timestamp '2024-01-01') + (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) * 6) as ts, variable, value from reading),
e as (select max(ts) - interval 2 day as closed from r),
d as (select gauge_id, variable, ts::date as date, count(*) as n, sum(value) as total from r group by 1, 2, 3)"""


@query("stream_month_total", f"""with {STRETCH} select gauge_id, variable, date_trunc('month', date)::date as month, sum(n)::bigint as n, round(sum(total), 6) as total
  from d, e where date_trunc('month', date) + interval 1 month + interval 1 day <= closed group by 1, 2, 3""")
def _(v):
    stream = months.stream_month_total(_closed_days(v))
    return _run(v, stream, "months", months.run).withColumn("total", F.round("total", 6))


@query("stream_quota_alarm", f"""with {STRETCH}, g as (select gauge_id, date_trunc('month', date)::date as month, date, sum(total) as total from d, e
    where date + interval 1 day <= closed group by 1, 2, 3),
c as (select *, sum(total) over (partition by gauge_id, month order by date) as month_to_date from g)
select gauge_id, month, min(date) as date, round(arg_min(month_to_date, date), 6) as month_to_date from c where month_to_date > 123.456 group by 1, 2""")
def _(v):
    stream = months.stream_quota_alarm(_closed_days(v), 123.456)
    return _run(v, stream, "alarm", months.run).withColumn("month_to_date", F.round("month_to_date", 6))


@query("stream_snapshot", f"""with {DAYS} select gauge_id, variable, date, n, round(total, 6) as total from d
  where date in (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-12-31', interval 7 day))::date)""")
def _(v):
    path, state = scratch_path(v.spark, "snap"), scratch_path(v.spark, "snap-state")
    schedule = date_schedule(F.lit("2024-01-01").cast("date"), F.lit("2024-12-31").cast("date"), 7, "d")
    days = v.spark.range(1).select(F.explode(schedule).alias("date"))
    stream = readings.stream_daily(_readings(v))
    readings.snapshot_batches(stream, days, path, state)
    return v.spark.read.parquet(path).select("gauge_id", "variable", "date", "n", F.round("total", 6).alias("total"))


# A station for every gauge that reads: its name is derived from the readings' own ids.
@query("stream_static_join", """select case when gauge_id % 7 > 0 then 'station ' || (gauge_id % 50) end as n_name, variable, count(*) as n, round(sum(value), 6) as total from reading group by 1, 2""")
def _(v):
    name = F.concat(F.lit("station "), (C("user_id") % 50).cast("string")).alias("n_name")
    # A seventh of the gauges is unknown; their readings keep their rows.
    station = v.table("events").filter("user_id % 7 > 0").select(C("user_id").cast("long").alias("gauge_id"), name).distinct()
    rows = _run(v, readings.stream_static_join(_readings(v), station), "static")
    return rows.groupBy("n_name", "variable").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
