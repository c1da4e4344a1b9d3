"""Balances, periods, allocation, columns and keyed helpers on small fixtures."""

import datetime as dt
import time

import pytest
from helpers import rows
from pyspark.sql import functions as F

from hydroloom.functions import channel, clean, dates, evaporation, land
from hydroloom.grid import GridSpec
from hydroloom.operators import balance, catalog, demand, gridops, joins, keyed, periods, runs, skill, temporal, zonal


def day(n, start=dt.date(2000, 1, 1)):
    return start + dt.timedelta(days=n)


def test_closed_balance_has_no_residual(spark):
    data = []
    for cell in (1, 2):
        store = 10.0 * cell
        for d in range(4):
            rain, et = 3.0 + d, 1.0 * cell
            data.append((cell, day(d), rain, et, store, store + rain - et))
            store += rain - et
    df = spark.createDataFrame(data, "cell_id long, date date, rain double, et double, before double, after double")
    out = balance.balance_residual(df, ["cell_id", "date"], ["rain"], ["before"], ["after"], ["et"])
    assert balance.balance_residual_max(out).first().asDict() == {"max_residual": 0.0, "n_alarm": 0}
    broken = df.withColumn("et", F.when(F.col("cell_id") == 2, F.col("et") + 1e-5).otherwise(F.col("et")))
    out = balance.balance_residual(broken, ["cell_id", "date"], ["rain"], ["before"], ["after"], ["et"])
    assert balance.balance_residual_max(out).first()["n_alarm"] == 4


def test_storage_change_lags_before_days_drop(spark):
    daily = spark.createDataFrame(
        [("Basin", "Storage", "v", "Soil", day(i), float(i * i)) for i in range(5)],
        "section string, role string, variable string, label string, date date, volume double",
    )
    got = [r["amount"] for r in balance.day_flows(daily).orderBy("date").collect()]
    assert got == [3.0, 5.0, 7.0]


def test_hierarchy_with_nested_level_and_adjustment(spark):
    flows = spark.createDataFrame(
        [("Basin", "Input", "Rain", 10.0), ("Basin", "Output", "ET", 6.0), ("Basin", "ET", "Soil evap.", 2.0), ("Basin", "ET", "Transpiration", 4.0), ("Basin", "Storage", "Soil", -1.0)],
        "section string, role string, label string, amount double",
    )
    gap = spark.createDataFrame([(0.5,)], "pumping_gap double")
    out = {r["label"]: r for r in balance.flow_hierarchy(flows, nested=[("ET", "ET")], adjustment=gap).collect()}
    assert out["Transpiration"]["parent"] == "ET" and out["Transpiration"]["share"] == pytest.approx(4 / 6)
    assert out["Soil"]["value"] == 1.0 and out["Soil"]["sign"] == "negative"
    assert out["Adjusted pumping"]["parent"] == "Input"


@pytest.mark.parametrize("years, expected", [
    (4, None),
    (9, ("half", 9)),
    (20, ("sixteen", 20)),
])
def test_split_periods(spark, years, expected):
    first = dt.date(1990, 1, 1)
    n = 365 * years
    obs = spark.createDataFrame([("A", first + dt.timedelta(days=i), 1.0) for i in range(n)], "station_id string, date date, q double")
    out = periods.split_periods(obs, F.lit("1980-01-01").cast("date"), F.lit("2030-01-01").cast("date"), 5).collect()
    if expected is None:
        assert out == []
        return
    (r,) = out
    last = first + dt.timedelta(days=n - 1)
    assert r["cal_end"] == dt.date(last.year, 12, 31)
    if expected[0] == "half":
        share = min(0.5, 1 - 365 * 5 / n)
        assert r["cal_start"] == first + dt.timedelta(days=round(n * share) - 1)
        assert r["val_start"] == first
    else:
        assert r["cal_start"] == dt.date((first + dt.timedelta(days=n - 365 * 8 - 1)).year, 1, 1)
        assert r["val_start"] == dt.date((first + dt.timedelta(days=n - 365 * 16 - 1)).year, 1, 1)
    assert r["val_end"] == r["cal_start"] - dt.timedelta(days=1)


def test_allocation_cases(spark):
    data = [
        ("less", 1, 1.0, 4.0, 1.0), ("less", 2, 3.0, 4.0, 2.0),
        ("equal", 3, 2.0, 1.0, 1.0), ("equal", 4, 0.0, 1.0, 1.0),
        ("more", 5, 5.0, 1.0, 1.0), ("more", 6, 5.0, 2.0, 1.0),
        ("dry", 7, 5.0, 0.0, 1.0),
    ]
    df = spark.createDataFrame(data, "zone string, cell_id long, demand double, available double, area double")
    out = zonal.zone_allocation(df, ["zone"]).collect()
    for zone in ("less", "equal", "more", "dry"):
        part = [r for r in out if r["zone"] == zone]
        taken = sum(r["abstraction"] * r["area"] for r in part)
        given = sum(r["allocation"] * r["area"] for r in part)
        need = sum(r["demand"] * r["area"] for r in part)
        have = sum(r["available"] * r["area"] for r in part)
        assert taken == pytest.approx(min(need, have)) and given == pytest.approx(min(need, have))
        assert all(r["abstraction"] <= r["available"] + 1e-12 for r in part)


def test_priority_cascade_keeps_the_amount(spark):
    need = spark.createDataFrame([(1, "a", 3.0), (1, "b", 3.0), (1, "c", 3.0), (2, "a", 1.0)], "k long, sector string, demand double")
    have = spark.createDataFrame([(1, 5.0), (2, 4.0)], "k long, amount double")
    got = {(k, s): g for k, s, g in rows(zonal.priority_cascade(need, have, ["k"], {"b": 0, "a": 1, "c": 2}))}
    assert got == {(1, "b"): 3.0, (1, "a"): 2.0, (1, "c"): 0.0, (1, "other"): 0.0, (2, "a"): 1.0, (2, "other"): 3.0}


def test_capacity_fill_matches_repeated_sharing(spark):
    links = spark.createDataFrame([(1, 10, 4.0), (1, 11, 1.0), (1, 12, 0.0), (2, 13, 0.0)], "plant long, reservoir long, left double")
    treated = spark.createDataFrame([(1, 2.5), (2, 3.0)], "plant long, treated double")
    sent, over = zonal.capacity_fill(links, treated, ["plant"])
    assert {r["reservoir"]: r["sent"] for r in sent.collect()} == {10: 2.0, 11: 0.5, 12: 0.0, 13: 0.0}
    assert dict(rows(over)) == {1: 0.0, 2: 3.0}


def test_lag_weights_sum_to_one(spark):
    peaks = spark.createDataFrame([(0.5,), (1.7,), (3.0,)], "peak double")
    lags = peaks.select("peak", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("lag"))
    sums = lags.groupBy("peak").agg(F.sum(channel.lag_weight(F.col("lag"), F.col("peak"))).alias("w")).collect()
    assert all(r["w"] == pytest.approx(1.0) for r in sums)


def test_sentinels(spark):
    values = [float("nan"), 1e31, 1e20, -9999.0, -901.0, -5.0, 3.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")

    def kept(rule):
        return [r["i"] for r in df.filter(clean.null_sentinels(F.col("v"), rule).isNotNull()).orderBy("i").collect()]

    assert kept("meteo") == [3, 4, 5, 6]
    assert kept("run") == [1, 2, 5, 6]
    assert kept("observed") == [1, 2, 6]
    assert kept("map") == [2, 3, 4, 5, 6]


def test_unit_guard_stops_on_kelvin(spark):
    df = spark.createDataFrame([(290.0,)], "t double")
    ok = evaporation.meteo_units(temperature=F.col("t"), kelvin=True, strict=True)["temperature"]
    assert df.select(ok).first()[0] == pytest.approx(16.85)
    bad = evaporation.meteo_units(temperature=F.col("t"), strict=True)["temperature"]
    with pytest.raises(Exception, match="temperature outside"):
        df.select(bad).collect()


def test_treated_water_rule_is_checked(spark):
    df = spark.createDataFrame([(1.0, 1.5, True)], "q double, r double, has boolean")
    out = demand.treated_water_split(F.col("q"), F.col("r"), F.col("has"))
    with pytest.raises(Exception, match="unexpected rule"):
        df.select(out["exported"]).collect()


def test_cover_fractions_stay_whole(spark):
    df = spark.createDataFrame([(0.2, 0.1, 0.1, 0.1, 0.05, 0.2, 0.3), (0.0, 0.1, 0.1, 0.5, 0.1, 0.2, 1.0)], "a double, b double, c double, d double, e double, f double, g double")
    f = land.cover_normalise([F.col(x) for x in "abcdef"])
    total = sum(f[1:], f[0])
    assert all(r[0] == pytest.approx(1.0) for r in df.select(total).collect())
    cut = land.cover_remove_glacier(f, F.col("g"))
    left = df.select((sum(cut[1:], cut[0]) + F.col("g")).alias("t"), *[c.alias(f"c{i}") for i, c in enumerate(cut)]).collect()
    assert all(r["t"] == pytest.approx(1.0) for r in left)
    assert all(r[f"c{i}"] >= -1e-12 for r in left for i in range(6))


def test_running_by_block_on_a_hot_key(spark):
    data = [("hot", day(i % 900), float(i % 900 % 7), i) for i in range(900)] + [("cold", day(3), 2.0, 0)]
    df = spark.createDataFrame(data, "k string, date date, v double, i int")
    out = keyed.running_by_block(df, ["k"], "date", F.year("date"), {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "n": ("count", F.lit(1))})
    got = out.orderBy("k", "date").toPandas()
    hot = got[got.k == "hot"]
    assert hot.s.tolist() == hot.v.cumsum().tolist() and hot.m.tolist() == hot.v.cummax().tolist() and hot.n.tolist() == list(range(1, 901))
    lag = keyed.lag_by_block(df, ["k"], "date", F.year("date"), "v", "p").orderBy("k", "date").toPandas()
    assert lag[lag.k == "hot"].p.dropna().tolist() == hot.v.tolist()[:-1]


def test_running_sum_skips_missing(spark):
    df = spark.createDataFrame([("a", day(0), 1.0), ("a", day(400), None), ("a", day(401), 2.0)], "k string, date date, v double")
    out = keyed.running_by_block(df, ["k"], "date", F.year("date"), {"s": ("sum", F.col("v"))}).orderBy("date").collect()
    assert [r["s"] for r in out] == [1.0, 1.0, 3.0]


def test_with_group_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), (1, 5.0)], "z int, v double")
    got = rows(keyed.with_group(df, ["z"], t=F.sum("v")))
    assert got == [(1, 5.0, 5.0), (None, 1.0, 3.0), (None, 2.0, 3.0)]


def test_lookup_beyond_the_limit_still_joins(spark):
    big = spark.range(100).withColumnRenamed("id", "k")
    side = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    spark.conf.set(keyed.LOOKUP_SETTING, "10")
    try:
        plan = keyed.lookup(big, side, ["k"], ["x"])
        assert plan.count() == 50
    finally:
        spark.conf.unset(keyed.LOOKUP_SETTING)
    assert keyed.lookup(big, side, ["k"], ["x"], how="left").count() == 100


def test_uniform_does_not_depend_on_partitions(spark):
    df = spark.range(200)
    one = rows(df.repartition(1).select("id", runs.uniform(5, F.col("id")).alias("u")))
    many = rows(df.repartition(7).select("id", runs.uniform(5, F.col("id")).alias("u")))
    assert one == many and all(0 <= u < 1 for _, u in one)


def test_score_with_missing_and_constant_sides(spark):
    pairs = spark.createDataFrame(
        [("a", day(i), float(i), float(i) * 2 if i != 2 else None) for i in range(6)] + [("flat", day(i), 1.0, 1.0) for i in range(4)],
        "station_id string, date date, s double, o double",
    )
    out = {r["station_id"]: r for r in skill.score(pairs, ["station_id"]).collect()}
    assert out["a"]["correlation"] == pytest.approx(1.0)
    assert out["a"]["br"] == pytest.approx(0.5)
    assert out["flat"]["correlation"] is None and out["flat"]["nse"] is None and out["flat"]["rmse"] == 0.0


def test_run_score_marks_wild_runs(spark):
    obs = spark.createDataFrame([("a", day(i), 1.0 + i) for i in range(4)], "station_id string, date date, o double")
    sim = spark.createDataFrame(
        [(1, "a", day(i), 1.0 + i) for i in range(4)] + [(2, "a", day(i), 1.0 + i) for i in range(4)] + [(2, "a", day(9), 99.0)],
        "run_id long, station_id string, date date, q double",
    )
    got = {r["run_id"]: r["kge"] for r in skill.run_score(sim, obs).collect()}
    assert got[1] == pytest.approx(1.0, abs=1e-4) and got[2] == -100.0


def test_requests_are_checked():
    with pytest.raises(ValueError, match="temporal kind"):
        temporal.check_request("rain", "weekly", "map")
    with pytest.raises(ValueError, match="spatial kind"):
        temporal.check_request("rain", "daily", "zone")
    with pytest.raises(ValueError, match="closest name is 'rain'"):
        temporal.check_request("rian", "daily", "map", known=["rain", "snow"])
    with pytest.raises(ValueError, match="temporal kind"):
        temporal.check_request("rain", "12month", "tss")


def test_partial_periods(spark):
    start, n = dt.date(2001, 1, 20), 60
    s = spark.createDataFrame([(1, start + dt.timedelta(days=i), 1.0) for i in range(n)], "cell_id long, date date, value double")
    got = {r["date"]: r["value"] for r in temporal.agg_monthavg(s, ["cell_id"]).collect()}
    # The first month is divided by its calendar days, the unfinished last one is not emitted.
    assert got == {dt.date(2001, 1, 1): pytest.approx(12 / 31), dt.date(2001, 2, 1): 1.0}


def test_dates(spark):
    texts = ["1/2/2003", "1.2.03", "2003-02-01", "01-02-2003", "4", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(dates.parse_date(F.col("t"), F.lit("2003-01-29").cast("date"))).collect()]
    want = dt.date(2003, 2, 1)
    assert got == [want] * 5 + [None]
    y, m, d = dates.calendar_ymd(F.lit(59), "360_day", 2000)
    assert spark.range(1).select(y, m, d).first() == (2000, 2, 30)


def test_nearest_on_axis_against_brute_force(spark):
    axis = [0.0, 0.4, 1.0, 5.5, 5.7, 30.0]
    points = [-50.0, 0.2, 0.7, 0.7000001, 3.25, 5.6, 17.75, 29.0, 400.0]
    a = spark.createDataFrame([(i, x) for i, x in enumerate(axis)], "i long, x double")
    p = spark.createDataFrame([(k, v) for k, v in enumerate(points)], "k long, v double")
    got = dict(rows(joins.nearest_on_axis(p, a, "k", "v", "x", "i")))
    assert got == {k: min(range(len(axis)), key=lambda i: (abs(axis[i] - v), i)) for k, v in enumerate(points)}


def test_grid_ratio():
    fine, coarse = GridSpec(8, 8, 0.25, 10.5, 49.5), GridSpec(4, 4, 1.0, 10.0, 50.0)
    r = fine.ratio_to(coarse)
    assert (r.ratio, r.row_offset, r.col_offset) == (4, 2, 2)
    with pytest.raises(ValueError):
        GridSpec(8, 8, 0.3, 0, 0).ratio_to(coarse)
    assert GridSpec.parse("4 3 0.5 10 50") == GridSpec(3, 4, 0.5, 10.0, 50.0)


def test_catalog_options(spark):
    base = catalog.flux_catalog(spark).toPandas()
    assert "unmetDemand" in set(base.variable) and "leakage" not in set(base.variable)
    coupled = catalog.flux_catalog(spark, {"coupled"}).toPandas()
    assert "storGroundwater" not in set(coupled.variable) and "leakage" in set(coupled.variable)
    both = catalog.flux_catalog(spark, {"withdrawals", "crops"}, crops=2).toPandas()
    assert (both.section == "Withdrawal").sum() == 18 and "irr_crop[1]" in set(both.variable)
    second = catalog.flux_catalog(spark, edition=2).toPandas()
    assert second[second.variable == "EvapoChannel"].unit_class.tolist() == ["M3"]
    labels = dict(zip(second.variable, second.label, strict=True))
    assert labels["act_nonIrrConsumption"] == "non-Irrigation consumption"
    assert labels["dis_outlet"] == "Downstream outflow" and labels["addtoevapotrans"] == "Evap. application loss"
    first = dict(zip(base.variable, base.label, strict=True))
    assert {v for v in first if v in labels and first[v] != labels[v]} == {"act_nonIrrConsumption", "dis_outlet", "addtoevapotrans"}
    assert "unmetDemand" not in set(second.variable)
    assert "unmetDemand" in set(catalog.flux_catalog(spark, {"unlimited"}, edition=2).toPandas().variable)
    with pytest.raises(ValueError):
        catalog.flux_catalog(spark, {"nothing"})


def _broadcasts(df):
    return "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()


def test_an_unrolled_schedule_is_not_broadcast(spark):
    """A schedule unrolled from few bodies looks as small as they are; it is shuffled like the days it meets."""
    days = F.explode(F.sequence(F.lit(1), F.lit(366))).alias("doy")
    schedule = spark.range(3).select(F.col("id").alias("body"), days).filter("doy <> 60").withColumn("release", F.col("doy") / 2)
    dated = spark.sql("select 1L as body, date'1996-02-29' as date union all select 2L, date'1996-12-31' union all select 7L, date'1996-01-01'")
    out = joins.doy_schedule_join(dated, schedule, ["body"])
    assert not _broadcasts(out)
    assert rows(out.select("body", "doy", "release")) == [(1, 60, None), (2, 366, 183.0), (7, 1, None)]


def test_a_lookup_beyond_its_limit_is_shuffled(spark, monkeypatch):
    spark.conf.set("spark.hydroloom.lookupBytes", "100")
    try:
        out = keyed.lookup(spark.range(20), spark.range(20).withColumn("v", F.col("id") * 2), ["id"], ["v"])
    finally:
        spark.conf.unset("spark.hydroloom.lookupBytes")
    assert not _broadcasts(out) and out.filter("v = 2 * id").count() == 20


def test_region_parameters_leave_out_regions_without_cells(spark):
    cells = spark.createDataFrame([(1, 5), (2, -1), (3, 6), (4, None)], "cell_id long, region long")
    best = spark.range(5, 4000).select(F.col("id").alias("region"), F.lit("a").alias("name"), F.col("id").cast("double").alias("param"))
    ranges = spark.createDataFrame([("a", 1.5), ("b", 2.5)], "name string, start double")
    got = rows(runs.zone_param_assign(cells, best.filter("region <> 6"), ranges))
    assert got == [("a", 1, 5.0), ("a", 2, 1.5), ("a", 3, 0.0), ("a", 4, 0.0), ("b", 1, 0.0), ("b", 2, 2.5), ("b", 3, 0.0), ("b", 4, 0.0)]
    plan = runs.zone_param_assign(cells, best, ranges)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_best_parameters_do_not_pair_stations_with_parts(spark, tmp_path):
    """300 stations and 3,000 parts of one size were 900,000 rows; a doubled station changes nothing."""
    from hydroloom.plans import run_queries
    from hydroloom.plans.views import Views

    spark.range(3000).select(F.lit(3).alias("p_size"), F.concat(F.lit("B"), F.col("id") % 2).alias("p_brand"), F.col("id").cast("double").alias("p_retailprice")).write.parquet(str(tmp_path / "part.parquet"))
    stations = spark.range(300).select((F.col("id") * 31 + 3).alias("s_suppkey"))
    stations.unionByName(stations.limit(1)).write.parquet(str(tmp_path / "supplier.parquet"))
    v = Views(spark, str(tmp_path))
    got, want = run_queries._bestparam(v), v.sql(run_queries.BESTPARAM)
    key = lambda df: [(a, b, round(c, 6)) for a, b, c in rows(df, "region", "name")]
    assert key(got) == key(want) and got.count() == 600
    assert "avg" in got._jdf.queryExecution().optimizedPlan().toString().split("Join")[1]


def test_long_coordinate_lists_are_split_once(spark):
    from hydroloom.sources.text import coord_pairs

    text = " ".join(f"{i}.5 {i}.25" for i in range(30_000))
    frame = spark.createDataFrame([(1, text), (2, "7.5 8.5 9"), (3, None)], "nation int, coords string")
    started = time.monotonic()
    got = coord_pairs(frame, "coords").agg(F.count("*"), F.sum("lon"), F.max("pos")).first()
    assert tuple(got) == (30_001, sum(i + 0.5 for i in range(30_000)) + 7.5, 29_999)
    assert time.monotonic() - started < 60


def test_transfers_keep_every_day_and_repeated_rows(spark):
    d = [dt.date(1996, 2, 29), dt.date(1997, 2, 28), dt.date(1998, 2, 28), dt.date(1997, 3, 1)]
    schedule = spark.createDataFrame([(1, 2, 59, 0.5), (1, 2, 60, 3.0), (0, 2, 59, 0.25), (9, 2, 59, 0.5), (1, 0, 59, 0.5)], "from_id long, to_id long, doy int, release double")
    bodies = spark.createDataFrame(
        [(1, d[1], 50.0, 8.0, 1990), (1, d[1], 50.0, 9.0, 1990), (1, d[2], 50.0, 10.0, 1998), (1, d[0], 50.0, 6.0, 1990), (2, d[1], 20.0, 4.0, 1990), (2, d[2], 20.0, 19.0, 1990), (2, d[0], 20.0, 5.0, 2000)],
        "body long, date date, volume double, storage double, year_built int",
    )
    days = spark.createDataFrame([(x,) for x in d], "date date")
    got = rows(demand.scheduled_transfer(schedule, bodies, days))
    want = [
        (0, 2, d[1], 5.0), (0, 2, d[2], 0.95), (1, 0, d[1], 4.0), (1, 0, d[1], 4.5), (1, 0, d[2], 5.0), (1, 2, d[1], 4.0), (1, 2, d[1], 4.5),
        (1, 2, d[3], None), (1, 2, d[2], 0.95), (9, 2, d[1], None), (9, 2, d[2], None),
    ]
    assert got == want
    # The unrolled days are not shuffled: only the schedule, its givers and the receivers are.
    plan = demand.scheduled_transfer(schedule, bodies, days)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 2


def test_cover_sums_keep_a_cell_in_one_task(spark):
    """Values of all classes of a cell meet in one shuffle; a class that is listed twice counts twice, one without a share not."""
    cover = spark.createDataFrame([(1, 0, 0.25), (1, 1, 0.5), (1, 1, 0.125), (2, 0, None), (3, 5, 1.0)], "cell_id long, cover int, fraction double")
    values = spark.createDataFrame([(c, day(n), "q", k, 8.0) for c in (1, 2, 3) for k in (0, 1) for n in range(10)], "cell_id long, date date, variable string, cover int, value double")
    out = demand.cover_weighted_sum(cover, values)
    assert rows(out.select("cell_id", "value")) == [(1, 7.0)] * 10 + [(2, None)] * 10
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(cell_id" in plan and ", date" not in "".join(x for x in plan.splitlines() if "Exchange" in x)


def test_lagged_shares_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(keyed, "TASK_ROWS", 10)
    flows = spark.range(20).select(F.col("id").alias("cell_id"), F.lit(day(0)).alias("date"), F.lit(2.0).alias("flow"), F.lit(2.0).alias("peak"))
    out = channel.triangular_lag(flows, 3.0)
    assert out.rdd.getNumPartitions() == 12
    assert sum(r["flow"] for r in out.collect()) == pytest.approx(40.0)


def test_nearest_days_are_dealt_by_rows_and_lose_no_row(spark, monkeypatch):
    monkeypatch.setattr(keyed, "TASK_ROWS", 10)
    day = lambda n: dt.date(2000, 1, 1) + dt.timedelta(days=n)
    points = [(k, day(n)) for k in ("a", None) for n in range(0, 2000, 40)] + [("a", None), ("b", day(5))]
    marks = [(k, day(n), float(n)) for k in ("a", None) for n in (100, 130, 1500)] + [("a", day(130), -1.0)]
    out = joins.asof_nearest_day(
        spark.createDataFrame(points, "k string, date date"), spark.createDataFrame(marks, "k string, date date, map_value double"), ["k"]
    )
    assert out.rdd.getNumPartitions() >= 11
    got = rows(out.select("k", "date", "slice_date"))
    want = [(k, d, min((m for q, m, _ in marks if q == k), key=lambda m: (abs((m - d).days), m), default=None) if d else None) for k, d in points]
    assert [g for g in got if g[1]] == sorted((w for w in want if w[1]), key=lambda r: tuple((x is None, x) for x in r))
    assert len(got) == len(points)


def test_patches_are_dealt_by_corners(spark, monkeypatch):
    monkeypatch.setattr(keyed, "TASK_ROWS", 10)
    coarse = spark.range(100).select(
        (F.col("id") % 5).cast("int").alias("date"), F.expr("cast(id div 5 div 4 as int)").alias("row"), F.expr("cast(id div 5 % 4 as int)").alias("col"), F.col("id").cast("double").alias("v")
    )
    patches = gridops._patches(coarse, 5, 4, "v", ["date"])
    assert patches.rdd.getNumPartitions() >= 40
    got = {(r["date"], r["_r0"], r["_c0"]): r["_v11"] for r in patches.collect()}
    assert len(got) == 5 * 6 * 5 and got[(2, 0, 0)] == 27.0 and got[(0, -1, -1)] == 0.0


def test_water_storage_is_joined_in_tasks_of_bounded_rows(spark, tmp_path, monkeypatch):
    import __spark_entry__

    lines = [(c, c % 5, dt.datetime(2000, 1, 1 + d), float(c), 0.1, 0.2) for c in range(20) for d in range(30)]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_shipdate timestamp, l_quantity double, l_discount double, l_tax double").write.parquet(
        f"{tmp_path}/lineitem.parquet"
    )
    spark.range(20).select(F.col("id").alias("p_partkey"), F.lit(900.0).alias("p_retailprice"), F.lit(1).alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(keyed, "TASK_ROWS", 10)
    out = __spark_entry__.queries()["total_water_storage"](spark, str(tmp_path))
    assert out.rdd.getNumPartitions() >= 60
    assert out.count() == 600
