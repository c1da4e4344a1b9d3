"""Skill scores and calibration periods on station pairs."""

from pyspark.sql import functions as F

from hydroloom.operators import keyed, periods, skill
from hydroloom.plans.registry import query

K = ["station_id"]
VALID = "p as (select * from pairs where s is not null and o is not null)"
# Expressions over valid pairs, written the same way as the engine's one-pass moments.
SQL = {
    "rsr": "sqrt(sum((s-o)*(s-o))) / nullif(sqrt(count(o) * var_pop(o)), 0)",
    "br": "1 - abs(avg(s) / nullif(avg(o), 0) - 1)",
    "pc_bias": "100 * sum(s-o) / nullif(sum(o), 0)",
    "pc_bias2": "100 * (avg(s) - avg(o)) / nullif(avg(o), 0)",
    "apb": "100 * sum(abs(s-o)) / nullif(sum(o), 0)",
    "apb2": "100 * abs(avg(s) - avg(o)) / nullif(avg(o), 0)",
    "rmse": "sqrt(avg((s-o)*(s-o)))",
    "mae": "avg(abs(s-o))",
    "bias": "avg(s-o)",
    "nse": "1 - sum((s-o)*(s-o)) / nullif(count(o) * var_pop(o), 0)",
    "nse_log": "1 - sum((ln(s)-ln(o))*(ln(s)-ln(o))) / nullif(count(o) * var_pop(ln(o)), 0)",
    "correlation": "covar_pop(s, o) / nullif(stddev_pop(s) * stddev_pop(o), 0)",
    "kge": """1 - sqrt(pow(covar_pop(s, o) / nullif(stddev_pop(s) * stddev_pop(o), 0) - 1, 2) + pow(avg(s) / nullif(avg(o), 0) - 1, 2)
      + pow((stddev_pop(s) / avg(s)) / nullif(stddev_pop(o) / avg(o), 0) - 1, 2))""",
    "vr": "1 - abs((stddev_pop(s) / avg(s)) / nullif(stddev_pop(o) / avg(o), 0) - 1)",
}
WARM = 29


def _register(name):
    honours = skill.fn.SCORES[name][1]
    late = f", q as (select *, row_number() over (partition by station_id order by date) as n from pairs), w as (select * from q where n > {WARM + 1} and s is not null and o is not null)"
    source = "w" if honours else "p"
    extra = late if honours else ""

    @query(name, f"with {VALID}{extra} select station_id, round({SQL[name]}, 6) as {name} from {source} group by 1")
    def _(v):
        out = skill.score(v.pairs, K, [name], warmup=WARM if honours else None)
        return out.select("station_id", F.round(name, 6).alias(name))


for _name in SQL:
    _register(_name)


@query("filter_pairs", f"with {VALID} select station_id, date, round(s, 8) as s, round(o, 8) as o from p")
def _(v):
    return skill.filter_pairs(v.pairs).select("station_id", "date", F.round("s", 8).alias("s"), F.round("o", 8).alias("o"))


@query("drop_warmup", """select station_id, date, round(s, 8) as s from (
  select *, row_number() over (partition by station_id order by date) as n from pairs) where n > 30""")
def _(v):
    return skill.drop_warmup(v.pairs, K, 30).select("station_id", "date", F.round("s", 8).alias("s"))


@query("all_scores", f"with {VALID} select station_id, {', '.join(f'round({e}, 6) as {n}' for n, e in SQL.items())} from p group by 1")
def _(v):
    out = skill.score(v.pairs, K)
    return out.select("station_id", *[F.round(n, 6).alias(n) for n in SQL])


@query("index_agreement", f"""with {VALID}, c as (select *, avg(o) over (partition by station_id) as m from p)
  select station_id, round(1 - sum((o-s)*(o-s)) / nullif(sum(pow(abs(s-m) + abs(o-m), 2)), 0), 6) as index_agreement from c group by 1""")
def _(v):
    return skill.index_agreement(v.pairs, K).withColumn("index_agreement", F.round("index_agreement", 6))


@query("mse_by_column", f"with {VALID} select station_id, round(avg((s-o)*(s-o)), 6) as mse from p group by 1")
def _(v):
    return skill.mse_by_column(v.pairs, K).withColumn("mse", F.round("mse", 6))


@query("kge_by_column", f"""with {VALID}, r as (select station_id, covar_pop(s, o) / nullif(stddev_pop(s) * stddev_pop(o), 0) as r,
    sum((s-o)*(s-o)) as sse from p group by 1),
  m as (select station_id, avg(s) as ms, avg(o) as mo, stddev_pop(s) as ds, stddev_pop(o) as dd, count(o) * var_pop(o) as sst from pairs group by 1)
  select station_id, round(1 - sqrt(pow(r-1, 2) + pow(ms/mo - 1, 2) + pow((ds/ms)/(dd/mo) - 1, 2)), 6) as kge,
    round(1 - sse / nullif(sst, 0), 6) as nse, round(r, 6) as r, round(ms / mo, 6) as pbias from m join r using (station_id)""")
def _(v):
    return skill.kge_by_column(v.pairs, K).select("station_id", *[F.round(c, 6).alias(c) for c in ("kge", "nse", "r", "pbias")])


# A simulated series with gaps: the shipped half of the line items.
SIM = "sim as (select l_suppkey as station_id, l_shipdate::date as date, sum(l_extendedprice) as q from lineitem where l_linestatus = 'F' group by 1, 2)"


def _gappy(v):
    shipped = v.table("lineitem").filter("l_linestatus = 'F'")
    sim = shipped.groupBy(F.col("l_suppkey").alias("station_id"), F.to_date("l_shipdate").alias("date")).agg(F.sum("l_extendedprice").alias("q"))
    return sim, v.pairs.filter("o is not null").select("station_id", "date", "o")


@query("align_sim_obs", f"""with {SIM} select station_id, date, round(q, 3) as q, round(o, 8) as o from sim
  full join (select station_id, date, o from pairs where o is not null) b using (station_id, date)""")
def _(v):
    return skill.align_sim_obs(*_gappy(v)).select("station_id", "date", F.round("q", 3).alias("q"), F.round("o", 8).alias("o"))


@query("length_mismatch", f"""with {SIM} select coalesce(a.station_id, b.station_id) as station_id, n_sim, n_obs from
  (select station_id, count(*) as n_sim from sim group by 1) a full join
  (select station_id, count(*) as n_obs from pairs where o is not null group by 1) b on a.station_id = b.station_id
  where n_sim is distinct from n_obs""")
def _(v):
    return skill.length_mismatch(*_gappy(v))


RUN = """j as (select r.run_id, r.station_id, r.q / 777 + 1e-5 as s, p.o from runs r left join pairs p using (station_id, date)),
m as (select run_id, max(s) as ms, max(o) as mo from j group by 1),
p as (select * from j where o is not null)"""


@query("run_score", f"""with {RUN} select run_id, round(case when any_value(ms) / any_value(mo) > 10 then -100 else {SQL['kge']} end, 6) as kge,
  round({SQL['correlation']}, 6) as r, round({SQL['nse']}, 6) as nse from p join m using (run_id) group by 1""")
def _(v):
    sim = v.runs.withColumn("q", F.col("q") / 777)
    out = skill.run_score(sim, v.pairs.select("station_id", "date", "o"))
    return out.select("run_id", *[F.round(c, 6).alias(c) for c in ("kge", "r", "nse")])


OBS = "select station_id, date, o as q from pairs"
VALID_DAYS = """d as (select station_id, date, row_number() over (partition by station_id order by date) as valid
  from pairs where o is not null and o >= 0 and date >= date '1995-06-01' and date < date '2001-06-01')"""


def _obs(v):
    return v.pairs.select("station_id", "date", F.col("o").alias("q"))


def _window():
    return F.lit("1995-06-01").cast("date"), F.lit("2001-06-01").cast("date")


@query("valid_count", f"with {VALID_DAYS} select station_id, date, valid from d")
def _(v):
    return periods.valid_count(_obs(v), *_window()).select("station_id", "date", "valid")


SPLIT = f"""{VALID_DAYS}, t as (select station_id, max(valid) as n, min(date) as first_day, max(date) as last_day from d group by 1),
k as (select *, round_even(n * least(0.5, 1 - 365.0 / n), 0)::bigint as k_split from t where n > 365)
, sp as (select k.station_id, n as n_valid, first_day as val_start, (d.date - 1)::date as val_end, d.date as cal_start,
  make_date(year(last_day), 12, 31) as cal_end from k join d on d.station_id = k.station_id and d.valid = k_split)"""


@query("split_periods", f"with {SPLIT} select * from sp")
def _(v):
    return periods.split_periods(_obs(v), *_window(), min_years=1)


@query("period_scores", f"""with {SPLIT}, f as (select station_id, min(date) as f from pairs where s is not null group by 1),
u as (select station_id, 'calibration' as period, cal_start as a, cal_end as b from sp
  union all select station_id, 'validation', greatest(val_start, f), val_end from sp join f using (station_id)),
x as (select pairs.*, period from pairs join u using (station_id) where date between a and b and o is not null)
select station_id, period, count(o) as n_obs, round({SQL['kge']}, 6) as kge, round({SQL['nse']}, 6) as nse,
  round({SQL['correlation']}, 6) as r, round({SQL['pc_bias2']}, 6) as bias from x group by 1, 2
  having period = 'calibration' or count(o) > 180""")
def _(v):
    spans = periods.split_periods(_obs(v), *_window(), min_years=1)
    out = skill.period_scores(v.pairs, spans, min_days=180)
    return out.select("station_id", "period", "n_obs", *[F.round(c, 6).alias(c) for c in ("kge", "nse", "r", "bias")])


@query("monthly_climatology", f"""with {VALID}, g as (select station_id, month(date)::int as month, avg(s) as s_mean, stddev_pop(s) as s_std,
  avg(o) as o_mean, stddev_pop(o) as o_std from p group by 1, 2)
select station_id, month, round(s_mean, 6) as s_mean, round(s_std, 6) as s_std, round(o_mean, 6) as o_mean, round(o_std, 6) as o_std,
  round(greatest(0, s_mean - s_std / 2), 6) as s_low, round(s_mean + s_std / 2, 6) as s_high,
  round(greatest(0, o_mean - o_std / 2), 6) as o_low, round(o_mean + o_std / 2, 6) as o_high from g""")
def _(v):
    out = skill.monthly_climatology(v.pairs, K)
    names = ["s_mean", "s_std", "o_mean", "o_std", "s_low", "s_high", "o_low", "o_high"]
    return out.select("station_id", "month", *[F.round(n, 6).alias(n) for n in names])


@query("climatology_order", f"""with {VALID}, g as (select station_id, month(date)::int as month, avg(s) as s_mean from p group by 1, 2),
o as (select unnest([9,10,11,12,1,2,3,4,5,6,7,8,9,10])::int as month, unnest(range(14))::int as position)
select station_id, position, month, round(s_mean, 6) as s_mean from g join o using (month)""")
def _(v):
    out = skill.with_display_order(skill.monthly_climatology(v.pairs, K))
    return out.select("station_id", "position", "month", F.round("s_mean", 6).alias("s_mean"))


RANKS = [0.0, 0.5, 0.6, 0.7, 0.8, 0.9]
WEIGHTS = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
BIAS_RANKS = [100.0, 20.0, 10.0, 5.0, 2.5, 1.0]


@query("rank_score", f"""with {VALID}, k as (select station_id, {SQL['kge']} as kge from p group by 1),
c as (select count(*) filter (kge >= 0.0 and kge < 0.5)::double as class_0, count(*) filter (kge >= 0.5 and kge < 0.6)::double as class_1,
  count(*) filter (kge >= 0.6 and kge < 0.7)::double as class_2, count(*) filter (kge >= 0.7 and kge < 0.8)::double as class_3,
  count(*) filter (kge >= 0.8 and kge < 0.9)::double as class_4, 0::double as class_5 from k)
select *, class_0 + 2 * class_1 + 3 * class_2 + 4 * class_3 + 5 * class_4 as rank_sum from c""")
def _(v):
    return skill.rank_score(skill.score(v.pairs, K, ["kge"]), "kge", RANKS, WEIGHTS)


@query("rank_bias", f"""with {VALID}, k as (select station_id, abs({SQL['pc_bias2']}) as b, 1 + station_id % 3 as w from p group by 1),
c as (select coalesce(sum(w) filter (b <= 100 and b > 20), 0)::double as class_0, coalesce(sum(w) filter (b <= 20 and b > 10), 0)::double as class_1,
  coalesce(sum(w) filter (b <= 10 and b > 5), 0)::double as class_2, coalesce(sum(w) filter (b <= 5 and b > 2.5), 0)::double as class_3,
  coalesce(sum(w) filter (b <= 2.5 and b > 1), 0)::double as class_4, 0::double as class_5 from k)
select *, class_0 + 2 * class_1 + 3 * class_2 + 4 * class_3 + 5 * class_4 as rank_sum from c""")
def _(v):
    scores = skill.score(v.pairs, K, ["pc_bias2"]).withColumn("b", F.col("pc_bias2") / 100).withColumn("w", 1 + F.col("station_id") % 3)
    return skill.rank_bias(scores, "b", BIAS_RANKS, WEIGHTS, "w")


@query("running_max", """select cell_id, date, sum(value) over w as total, max(value) over w as peak from cell_day
  window w as (partition by cell_id order by date)""")
def _(v):
    out = keyed.running_by_block(
        v.cell_day, ["cell_id"], "date", F.year("date"), {"total": ("sum", F.col("value")), "peak": ("max", F.col("value"))}
    )
    return out.select("cell_id", "date", "total", "peak")


@query("running_sum", """select gauge_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts, round(sum(value) over (partition by gauge_id order by ts), 6) as total from reading""")
def _(v):
    # Readings of a busy gauge are added up day by day.
    out = keyed.running_by_block(v.reading, ["gauge_id"], "ts", F.to_date("ts"), {"total": ("sum", F.col("value"))})
    return out.select("gauge_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), F.round("total", 6).alias("total"))


@query("max_over_time", """with m as (select cell_id, date_trunc('month', date)::date as month, count(*) / 31.0::double as fraction from cell_day group by 1, 2)
select cell_id, month, max(fraction) over (partition by cell_id order by month) as fraction_max from m""")
def _(v):
    m = v.cell_day.groupBy("cell_id", F.trunc("date", "MM").alias("month")).agg((F.count("*") / F.lit(31.0)).alias("fraction"))
    out = keyed.running_by_block(m, ["cell_id"], "month", F.year("month"), {"fraction_max": ("max", F.col("fraction"))})
    return out.select("cell_id", "month", "fraction_max")
