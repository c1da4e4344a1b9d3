"""Water-balance report queries."""

from pyspark.sql import functions as F

from hydroloom.operators import balance
from hydroloom.operators.keyed import lookup, tasks_for
from hydroloom.plans.registry import query

DAILY = """d as (select variable, date, sum(value * area) as dv, sum(value) as ps, arg_min(value, cell_id) as fc
  from cell_series join cell using (cell_id) group by 1, 2),
daily as (select section, role, variable, label, date,
  case unit_class when 'M' then dv when 'M3' then ps when 'MS' then ps * 86400 else fc end as volume
  from d join flux_catalog using (variable)),
lagged as (select *, row_number() over w as n,
  case when role = 'Storage' then volume - lag(volume) over w else volume end as amount
  from daily window w as (partition by section, role, variable, label order by date)),
flows as (select * from lagged where n > 2)"""

BAL = DAILY + """, per as (select section, role, label, sum(amount) as amount from flows group by 1, 2, 3),
sec as (select section, coalesce(sum(amount) filter (role = 'Input'), 0) as inputs,
  coalesce(sum(amount) filter (role = 'Output'), 0) as outputs,
  coalesce(sum(amount) filter (role = 'Storage'), 0) as storage_change,
  coalesce(sum(abs(amount)) filter (role = 'Storage'), 0) as magnitude from per group by 1),
bal as (select *, inputs - outputs - storage_change as balance,
  100 * (inputs - outputs - storage_change) / nullif(0.5 * inputs + 0.5 * abs(storage_change) + 0.5 * outputs, 0) as percent
  from sec)"""


def _daily(v):
    return balance.basin_daily_sum(v.cell_series, v.cell, v.flux_catalog)


def _flows(v):
    return balance.day_flows(_daily(v))


@query("water_balance", f"""with {BAL} select item, round(value / case when item = 'percent' then 1 else 1e6 end, 6) as value
  from (unpivot bal on inputs, outputs, storage_change, balance, percent into name item value value)
  where section = 'Basin'""")
def _(v):
    out = balance.water_balance(_flows(v))
    scale = F.when(F.col("item") == "percent", 1.0).otherwise(1e6)
    return out.select("item", F.round(F.col("value") / scale, 6).alias("value"))


@query("basin_daily_sum", f"with {DAILY} select section, role, variable, label, date, round(volume, 3) as volume from daily")
def _(v):
    return _daily(v).withColumn("volume", F.round("volume", 3))


@query("unit_to_volume", """select variable, section, role, date, cell_id, round(case unit_class when 'M' then value * area
  when 'M3' then value when 'MS' then value * 86400 end, 4) as volume
  from cell_series join cell using (cell_id) join flux_catalog using (variable)""")
def _(v):
    joined = lookup(v.cell_series, v.cell, ["cell_id"], ["area"]).join(v.flux_catalog, "variable")
    volume = balance.unit_to_volume(F.col("value"), F.col("area"), F.col("unit_class"))
    return joined.select("variable", "section", "role", "date", "cell_id", F.round(volume, 4).alias("volume"))


@query("broadcast_catalog", """select section, role, label, count(*) as n, sum(value) as total
  from cell_series join flux_catalog using (variable) group by 1, 2, 3""")
def _(v):
    return v.cell_series.join(v.flux_catalog, "variable").groupBy("section", "role", "label").agg(
        F.count("*").alias("n"), F.sum("value").alias("total")
    )


@query("join_cell_area", """select cell_id, round(sum(value * area), 4) as weighted
  from cell_series join cell using (cell_id) group by 1""")
def _(v):
    joined = lookup(v.cell_series, v.cell, ["cell_id"], ["area"])
    return joined.groupBy("cell_id").agg(F.round(F.sum(F.col("value") * F.col("area")), 4).alias("weighted"))


@query("storage_change", f"""with {DAILY} select section, label, date, round(amount, 3) as change
  from flows where role = 'Storage'""")
def _(v):
    return _flows(v).filter("role = 'Storage'").select("section", "label", "date", F.round("amount", 3).alias("change"))


@query("role_totals", f"""with {DAILY} select section, role, date, round(sum(amount), 3) as amount,
  grouping(date)::int as is_total from flows group by grouping sets ((section, role, date), (section, role))""")
def _(v):
    return balance.role_totals(_flows(v)).select(
        "section", "role", "date", F.round("amount", 3).alias("amount"), "is_total"
    )


@query("section_balance", f"""with {BAL} select section, round(inputs / 1e6, 6) as inputs, round(outputs / 1e6, 6) as outputs,
  round(storage_change / 1e6, 6) as storage_change, round(magnitude / 1e6, 6) as magnitude,
  round(balance / 1e6, 6) as balance, round(percent, 6) as percent from bal""")
def _(v):
    names = ["inputs", "outputs", "storage_change", "magnitude", "balance"]
    return balance.section_balance(_flows(v)).select(
        "section", *[F.round(F.col(n) / 1e6, 6).alias(n) for n in names], F.round("percent", 6).alias("percent")
    )


@query("flow_hierarchy", f"""with {BAL}, nodes as (
  select label, role as parent, case when role = 'Storage' then abs(amount) else amount end as value,
    case when role = 'Input' then 'positive' when role = 'Storage' and amount > 0 then 'positive' else 'negative' end as sign
  from per where section = 'Basin'
  union all select 'Input', 'Total', inputs, 'positive' from bal where section = 'Basin'
  union all select 'Output', 'Total', outputs, 'negative' from bal where section = 'Basin'
  union all select 'Storage', 'Total', magnitude, 'storage' from bal where section = 'Basin'
  union all select 'Balance', 'Total', abs(balance), 'white' from bal where section = 'Basin')
select label, parent, sign, round(value / 1e6, 6) as value,
  round(value / sum(value) over (partition by parent), 6) as share from nodes""")
def _(v):
    return balance.flow_hierarchy(_flows(v)).select(
        "label", "parent", "sign", F.round(F.col("value") / 1e6, 6).alias("value"), F.round("share", 6).alias("share")
    )


@query("share_of_parent", """with t as (select zone, row, sum(area) as value from cell group by 1, 2)
select zone, row, round(value, 4) as value, printf('%.1f%%', round(100 * value / sum(value) over (partition by row), 9)) as share_text from t""")
def _(v):
    t = v.cell.groupBy("zone", "row").agg(F.sum("area").alias("value"))
    out = balance.share_of_parent(t, "value", "row")
    text = F.format_string("%.1f%%", F.round(F.col("share") * 100, 9))
    return out.select("zone", "row", F.round("value", 4).alias("value"), text.alias("share_text"))


@query("depth_table", f"""with {DAILY} select section, role, label,
  round(sum(amount) / (select sum(area) from cell), 3) + 0 as depth from flows group by 1, 2, 3""")
def _(v):
    totals = _flows(v).groupBy("section", "role", "label").agg(F.sum("amount").alias("amount"))
    return balance.depth_table(totals, v.cell).select("section", "role", "label", "depth")


@query("pumping_gap", """with p as (select variable, date, sum(value * area) as dv, sum(value) as ps
  from cell_series join cell using (cell_id) where variable in ('NO', 'RF') group by 1, 2),
days as (select date, coalesce(sum(dv) filter (variable = 'NO'), 0) as want,
  coalesce(sum(dv) filter (variable = 'RF'), 0) as got, coalesce(sum(ps) filter (variable = 'RF'), 0) as leak,
  row_number() over (order by date) as n from p group by date)
select round(abs(sum(want - (got + leak))) / 1e3, 6) as pumping_gap from days where n > 2""")
def _(v):
    return balance.pumping_gap(v.cell_series, v.cell, "NO", "RF").select(
        F.round(F.col("pumping_gap") / 1e3, 6).alias("pumping_gap")
    )


@query("excel_day_table", f"""with {DAILY} select date, {', '.join(
    f"round(sum(volume) filter (variable = '{x}'), 3) as {x}" for x in ('NO', 'NF', 'AF', 'AO', 'RF', 'RO'))}
  from daily where section = 'Basin' group by date""")
def _(v):
    names = ["NO", "NF", "AF", "AO", "RF", "RO"]
    table = balance.day_table(_daily(v).filter("section = 'Basin'"), names)
    return table.select("date", *[F.round(n, 3).alias(n) for n in names])


COVER = """cover as (select cell_id, (zone % 6)::int as cover, date_trunc('month', date)::date as month, count(*) / 31.0 as fraction
  from cell_day join cell using (cell_id) group by 1, 2, 3)"""


def _cover(v):
    return (
        v.cell_day.join(v.cell.select("cell_id", "zone"), "cell_id")
        .groupBy("cell_id", (F.col("zone") % 6).alias("cover"), F.trunc("date", "MM").alias("month"))
        .agg((F.count("*") / 31.0).alias("fraction"))
    )


@query("land_class_area", f"""with {COVER} select cover, month, round(sum(fraction * area), 5) as class_area
  from cover join cell using (cell_id) group by 1, 2""")
def _(v):
    return balance.land_class_area(_cover(v), v.cell).withColumn("class_area", F.round("class_area", 5))


@query("land_output_table", f"""with {DAILY} select label, round(sum(volume) / 1e9, 6) as billion_m3
  from daily where variable not like '%Demand%' group by 1""")
def _(v):
    return balance.land_output_table(_daily(v)).withColumn("billion_m3", F.round("billion_m3", 6))


WIDE = """wide as (select date, cell_id, sum(value) filter (variable = 'NO') as rain, sum(value) filter (variable = 'NF') as snow,
  sum(value) filter (variable = 'AF') as et, sum(value) filter (variable = 'RF') as before,
  sum(value) filter (variable = 'RO') as after from cell_series group by 1, 2),
res as (select date, cell_id, coalesce(rain, 0) + coalesce(snow, 0) + coalesce(before, 0) - coalesce(after, 0)
  - coalesce(et, 0) as residual from wide)"""


def _residuals(v):
    names = {"NO": "rain", "NF": "snow", "AF": "et", "RF": "before", "RO": "after"}
    wide = v.cell_series.groupBy("date", "cell_id").agg(
        *[F.sum(F.when(F.col("variable") == k, F.col("value"))).alias(n) for k, n in names.items()]
    )
    return balance.balance_residual(wide, ["date", "cell_id"], ["rain", "snow"], ["before"], ["after"], ["et"])


@query("balance_residual", f"""with {WIDE} select max(abs(residual)) as max_residual,
  count(*) filter (abs(residual) > 1e-7) as n_alarm from res""")
def _(v):
    return balance.balance_residual_max(_residuals(v))


@query("balance_residual_basin", f"""with {WIDE} select zone as basin, date, round(sum(residual * area), 4) as residual
  from res join cell using (cell_id) group by 1, 2""")
def _(v):
    label = v.cell.select("cell_id", F.col("zone").alias("basin"))
    out = balance.balance_residual_basin(_residuals(v), label, v.cell, ["date"])
    return out.withColumn("residual", F.round("residual", 4))


@query("total_water_storage", """select cell_id, date, round(value + tavg + value * 3 / area + value * 2 / area + precip, 6) as tws
  from cell_day join meteo using (cell_id, date) join (select cell_id, area from cell) using (cell_id)""")
def _(v):
    # Sums and weather of a cell and day meet in tasks of a bounded number of rows, whatever the bytes of their shuffles.
    tasks, day = tasks_for(v.table("lineitem").count()), ["cell_id", "date"]
    t = v.cell_day.repartition(tasks, *day).join(v.meteo.select(*day, "tavg", "precip").repartition(tasks, *day), day).join(v.cell.select("cell_id", "area"), "cell_id")
    c = F.col
    tws = balance.total_water_storage(c("value"), c("tavg"), c("value") * 3, c("value") * 2, c("area"), c("precip"))
    return t.select("cell_id", "date", F.round(tws, 6).alias("tws"))
