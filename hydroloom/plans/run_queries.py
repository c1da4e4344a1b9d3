"""Run, parameter, ordering and fold queries."""

from pyspark.sql import functions as F

from hydroloom.operators import balance, catalog, network, runs, skill
from hydroloom.plans.registry import query
from hydroloom.plans.skill_queries import SQL as SCORE

C = F.col
MEMBER = """up(gauge_id, cell_id) as (select gauge_id, cell_id from gauge
  union all select u.gauge_id, l.cell_id from up u join ldd l on l.down_id = u.cell_id)"""
# Scores of every (station, run); a run number belongs to generation run_id // 3.
SCORES = f"""j as (select r.run_id, r.station_id, r.q / 777 + 1e-5 as s, p.o from runs r left join pairs p using (station_id, date)),
mx as (select station_id, run_id, max(s) as ms, max(o) as mo from j group by 1, 2), v as (select * from j where o is not null),
sc as (select station_id, run_id, (run_id // 3)::int as gen, case when any_value(ms) / any_value(mo) > 10 then -100 else {SCORE['kge']} end as kge
  from v join mx using (station_id, run_id) group by 1, 2)"""


def _scores(v):
    sim = v.runs.withColumn("q", C("q") / 777)
    out = skill.run_score(sim, v.pairs.select("station_id", "date", "o"), ["station_id", "run_id"])
    return out.select("station_id", "run_id", F.expr("cast(run_id div 3 as int)").alias("gen"), "kge")


@query("station_run_score", f"with {SCORES} select station_id, run_id, gen, round(kge, 6) as kge from sc")
def _(v):
    return _scores(v).withColumn("kge", F.round("kge", 6))


@query("best_run", f"""with {SCORES}, e as (select *, 1 - sqrt((1 - kge) * (1 - kge)) as effover from sc),
r as (select *, row_number() over (partition by station_id order by effover desc, run_id) as n from e)
select station_id, run_id, gen, round(kge, 6) as kge, round(effover, 6) as effover from r where n = 1""")
def _(v):
    return runs.best_run(_scores(v)).select("station_id", "run_id", "gen", F.round("kge", 6).alias("kge"), F.round("effover", 6).alias("effover"))


@query("select_best_k", f"""with {SCORES}, r as (select *, row_number() over (partition by station_id order by kge desc, run_id) as n from sc)
select station_id, run_id, round(kge, 6) as kge, n::int as place from r where n <= 3""")
def _(v):
    return runs.select_best_k(_scores(v), 3).select("station_id", "run_id", F.round("kge", 6).alias("kge"), "place")


@query("generation_best", f"""with {SCORES}, g as (select station_id, gen, max(kge) as best from sc group by 1, 2)
select station_id, gen, round(best, 6) as best, round(max(best) over (partition by station_id order by gen), 6) as best_so_far from g""")
def _(v):
    return runs.generation_best(_scores(v)).select("station_id", "gen", F.round("best", 6).alias("best"), F.round("best_so_far", 6).alias("best_so_far"))


RANGES = """select p_brand as name, 1e0 + min(p_size) as min, 5e1 + max(p_size) as max, 1e1 + avg(p_size) as start from part group by 1"""
CANDIDATES = """select l_suppkey as station_id, l_linenumber as run_id, p_brand as name, avg(l_discount) * 9.7e0 as value
  from lineitem join part on p_partkey = l_partkey group by 1, 2, 3"""


@query("denormalise_params", f"""with r as ({RANGES}), c as ({CANDIDATES}) select station_id, run_id, name, round(value * (max - min) + min, 6) as param,
  round(case when max = min then 0 else (start - min) / (max - min) end, 6) as start01 from c join r using (name)""")
def _(v):
    out = runs.denormalise_params(v.sql(CANDIDATES), v.sql(RANGES))
    s = runs.normalise_start(C("start"), C("min"), C("max"))
    return out.select("station_id", "run_id", "name", F.round("param", 6).alias("param"), F.round(s, 6).alias("start01"))


BRANDS = [f"Brand#{i}" for i in range(1, 26)]


@query("front_table", f"""with {SCORES}, r as ({RANGES}), c as ({CANDIDATES}), d as (select station_id, run_id, name, value * (max - min) + min as param from c join r using (name)),
w as (select station_id, run_id, {', '.join(f"round(max(param) filter (name = '{b}'), 6) as p_{i}" for i, b in enumerate(BRANDS))} from d group by 1, 2),
e as (select sc.*, 1 - sqrt((1 - kge) * (1 - kge)) as effover from sc)
select station_id, run_id, round(effover, 6) as effover, {', '.join(f'p_{i}' for i in range(len(BRANDS)))},
  row_number() over (partition by station_id order by effover desc, run_id)::int as place from e join w using (station_id, run_id)""")
def _(v):
    out = runs.front_table(_scores(v), v.sql(CANDIDATES), v.sql(RANGES), BRANDS)
    return out.select(
        "station_id", "run_id", F.round("effover", 6).alias("effover"), *[F.round(f"`{b}`", 6).alias(f"p_{i}") for i, b in enumerate(BRANDS)], C("place").cast("int").alias("place")
    )


def _uniform(*parts):
    text = " || '|' || ".join(f"({p})::varchar" for p in parts)
    return f"(('0x' || substr(md5({text}), 1, 12))::bigint / 281474976710656.0::double)"


@query("sample_params", f"""with r as ({RANGES}), k as (select s_suppkey as station_id, unnest(range(12))::int as candidate from supplier)
select station_id, candidate, (case when candidate = 0 then 0 else 2000 + candidate + 1 end)::int as run_id, name,
  round(case when candidate = 0 then case when max = min then 0 else (start - min) / (max - min) end else {_uniform("'7'", "'2'", 'station_id', 'candidate', 'name')} end, 9) as value from k, r""")
def _(v):
    stations = v.table("supplier").select(C("s_suppkey").alias("station_id"))
    return runs.sample_params(stations, v.sql(RANGES), 12, 2, 7).withColumn("value", F.round("value", 9))


POPULATION = """select l_suppkey as station_id, l_linenumber - 1 as candidate, l_returnflag as name, avg(l_discount) * 9.3e0 as value
  from lineitem group by 1, 2, 3"""
KID = "station_id", "child"
GENE = "station_id", "child", "name"


@query("vary_params", f"""with pop as ({POPULATION}), k as (select distinct station_id, unnest(range(10))::int as child from pop),
p as (select *, floor({_uniform("'5'", "'3'", "'parent'", *KID)} * 7)::int as a, floor({_uniform("'5'", "'3'", "'other'", *KID)} * 6)::int as o,
  {_uniform("'5'", "'3'", "'kind'", *KID)} < 0.7 as blend from k),
g as (select p.station_id, child, x.name, x.value as va, y.value as vb, blend from p join pop x on x.station_id = p.station_id and x.candidate = a
  join pop y on y.station_id = p.station_id and y.candidate = (a + 1 + o) % 7 and y.name = x.name),
m as (select *, 1.3 * {_uniform("'5'", "'3'", "'gamma'", *GENE)} - 0.15 as gamma,
  sqrt(-2 * ln(1 - {_uniform("'5'", "'3'", "'u1'", *GENE)})) * cos(2 * pi() * {_uniform("'5'", "'3'", "'u2'", *GENE)}) as z, {_uniform("'5'", "'3'", "'hit'", *GENE)} < 0.3 as hit from g)
select station_id, child, 3000 + child + 1 as run_id, name, round(greatest(0, least(1, case when blend then (1 - gamma) * va + gamma * vb
  when hit then va + 0.3 * z else va end)), 9) as value from m""")
def _(v):
    return runs.vary_params(v.sql(POPULATION), 7, 10, 3, 5).withColumn("value", F.round("value", 9))


@query("union_population", f"""with pop as ({POPULATION}) select station_id, name, count(*) as n, round(sum(value), 6) as total
  from (select * from pop union all select station_id, candidate + 7, name, value / 2 from pop) group by 1, 2""")
def _(v):
    pop = v.sql(POPULATION)
    kids = pop.withColumn("candidate", C("candidate") + 7).withColumn("value", C("value") / 2)
    return runs.union_population(pop, kids).groupBy("station_id", "name").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("run_label", "select o_orderkey, printf('%02d_%03d', o_orderkey // 1000, o_orderkey % 1000) as label from orders")
def _(v):
    return v.table("orders").select("o_orderkey", runs.run_label(C("o_orderkey")).alias("label"))


def _gauges(v):
    nearest = network.subcatchment(v.ldd, v.gauge)
    return nearest, network.gauge_tree(v.ldd, v.gauge, nearest)


@query("order_by_area", f"""with recursive {MEMBER} select gauge_id, round(sum(area), 4) as catchment_area from up join cell using (cell_id) group by 1
  order by catchment_area, gauge_id""")
def _(v):
    from hydroloom.operators.temporal import catchment_area

    area = network.for_all_gauges(catchment_area(v.cell, *_gauges(v)), v.gauge).withColumn("catchment_area", F.round("catchment_area", 4))
    return runs.order_by_area(area)


@query("first_gauge", "select date, min(gauge_id) as gauge_id, arg_min(value, gauge_id) as value from cell_day join gauge using (cell_id) group by 1")
def _(v):
    from hydroloom.operators.temporal import agg_gauge_point

    return runs.first_gauge(agg_gauge_point(v.cell_day, v.gauge))


TYPES = ["ECONOMY", "SMALL", "LARGE", "MEDIUM", "PROMO", "STANDARD"]


@query("closest_name", f"""with c as (select unnest({TYPES!r}) as n), w as (select distinct p_name, upper(substr(p_type, 2)) as word from part)
select p_name, word, arg_min(n, (levenshtein(word, n), n)) as name from w, c group by 1, 2""")
def _(v):
    w = v.table("part").select("p_name", F.upper(F.expr("substring(p_type, 2)")).alias("word")).distinct()
    return w.withColumn("name", runs.closest_name(C("word"), TYPES))


REGIONS = "select p_partkey as cell_id, cast(case when p_size % 11 = 0 then -1 else p_size end as bigint) as region from part"
BESTPARAM = """select s_suppkey as region, p_brand as name, 2e0 + avg(p_retailprice) / 7 + s_suppkey as param from supplier join part on p_size = s_suppkey % 31 group by 1, 2"""


def _bestparam(v):
    # The rows of BESTPARAM: all stations of a size share its means, so parts are averaged before they meet stations.
    mean = v.table("part").groupBy("p_size", C("p_brand").alias("name")).agg(F.avg("p_retailprice").alias("mean"))
    station = v.table("supplier").select(C("s_suppkey").alias("region")).distinct()
    both = station.join(mean, C("p_size") == C("region") % 31)
    return both.select("region", "name", (2.0 + C("mean") / 7 + C("region")).alias("param"))


@query("zone_param_assign", f"""with g as ({REGIONS}), b as ({BESTPARAM}), r as ({RANGES})
select r.name, g.cell_id, round(case when g.region = -1 then start else coalesce(param, 0) end, 6) as value
  from g cross join r left join b on b.region = g.region and b.name = r.name""")
def _(v):
    return runs.zone_param_assign(v.sql(REGIONS), _bestparam(v), v.sql(RANGES)).withColumn("value", F.round("value", 6))


@query("run_counts", f"""with g as ({REGIONS}), b as ({BESTPARAM}) select count(*) filter (region in (select region from b)) as n_with,
  count(*) filter (region not in (select region from b)) as n_without from (select distinct region from g)""")
def _(v):
    return runs.run_counts(v.sql(REGIONS), _bestparam(v))


@query("union_files", """select cell_id, date, arg_min(value, f) as value from (select l_partkey as cell_id, l_shipdate::date as date, case l_linestatus when 'F' then 1 else 2 end as f,
  sum(l_quantity) as value from lineitem group by 1, 2, 3) group by 1, 2""")
def _(v):
    rank = F.when(C("l_linestatus") == "F", 1).otherwise(2)
    rows = v.table("lineitem").groupBy(C("l_partkey").alias("cell_id"), F.to_date("l_shipdate").alias("date"), rank.alias("file_rank")).agg(
        F.sum("l_quantity").alias("value")
    )
    return runs.union_files(rows, ["cell_id"])


# Variables of the line items renamed to catalogue names, so the report's own catalogue applies.
NAMES = {"NO": "Rain", "NF": "Snow", "AF": "totalET", "AO": "dis_outlet", "RF": "totalSto", "RO": "channelStorage"}


@query("union_catalog", """with n as (select case variable when 'NO' then 'Rain' when 'NF' then 'Snow' when 'AF' then 'totalET' when 'AO' then 'dis_outlet'
    when 'RF' then 'totalSto' else 'channelStorage' end as variable, sum(value) as total from cell_series group by 1),
c as (select * from (values ('Rain', 'Rain', 'M', 'Basin', 'Input'), ('Snow', 'Snow', 'M', 'Basin', 'Input'), ('totalET', 'Evapotranspiration', 'M', 'Basin', 'Output'),
  ('dis_outlet', 'Downstream', 'MS', 'Basin', 'Output'), ('totalSto', 'Soil*', 'M', 'Basin', 'Storage'), ('channelStorage', 'Rivers', 'M3', 'Basin', 'Storage'),
  ('Rain', 'Rain', 'M', 'Soil', 'Input'), ('Snow', 'Snow', 'M', 'Soil', 'Input'), ('totalSto', 'Soil*', 'M', 'Soil', 'Storage')) t(variable, label, unit_class, section, role))
select variable, label, unit_class, section, role, total from c join n using (variable)""")
def _(v):
    name = C("variable")
    for old, new in NAMES.items():
        name = F.when(C("variable") == old, new).otherwise(name)
    series = v.cell_series.withColumn("variable", name)
    chosen = catalog.for_variables(catalog.flux_catalog(v.spark, {"consumption", "withdrawals"}), series)
    totals = series.groupBy("variable").agg(F.sum("value").alias("total"))
    return totals.join(chosen, "variable").select("variable", "label", "unit_class", "section", "role", "total")
