"""Manifests of map stacks, outputs that run on over new days, and walks by powers of two."""

import datetime as dt

import pytest
from helpers import rows
from pyspark.sql import functions as F

from hydroloom.functions.clean import round_double
from hydroloom.operators import demand, incremental, joins, network, temporal
from hydroloom.sources import manifest, readers, writers

KEYS = ["variable", "cell_id"]


def _spin():
    return F.lit(dt.date(2000, 2, 10))


def _series(spark, first, last, cells=3, scale=1.0):
    days = (last - first).days + 1
    frame = spark.range(days * cells).select(
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("variable"), F.date_add(F.lit(first), (F.col("id") % days).cast("int")).alias("date"),
        F.expr(f"id div {days}").alias("cell_id"), ((F.col("id") % 97) * scale).alias("value"),
    )
    return frame


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_manifest_follows_the_files(spark, tmp_path):
    path = f"file://{tmp_path}/stack"
    writers.write_cell_series(_series(spark, dt.date(2000, 1, 1), dt.date(2001, 6, 30)), path)
    files = readers.catalog_files(spark, path, "2001-01-01", "2001-12-31")
    assert "_manifest" in _plan(files) and f"{tmp_path}/stack]" not in _plan(files)  # no data file is in the plan
    spans = files.groupBy("variable").agg(F.min("first_date"), F.max("last_date"), F.sum("rows"))
    whole = spark.read.parquet(path).filter("year = 2001").groupBy("variable").agg(F.min("date"), F.max("date"), F.count("*"))
    assert rows(spans) == rows(whole) and len(rows(spans)) == 2

    def equal():
        got = manifest.read(spark, path).filter("file is not null").select("file", "variable", "year", "rows")
        return rows(got) == rows(spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file"), "variable", "year").count())

    before = {r["file"] for r in manifest.read(spark, path).filter("year = 2000").collect()}
    writers.write_cell_series(_series(spark, dt.date(2001, 7, 1), dt.date(2001, 8, 1)), path, mode="append")
    assert equal() and {r["file"] for r in manifest.read(spark, path).filter("year = 2000").collect()} == before
    writers.write_cell_series(_series(spark, dt.date(2000, 1, 1), dt.date(2000, 1, 9)), path, mode="overwrite", partitions="dynamic")
    assert equal() and not {r["file"] for r in manifest.read(spark, path).filter("year = 2000").collect()} & before
    manifest.refresh(spark, path)
    assert equal()
    with pytest.raises(FileNotFoundError, match="refresh"):
        manifest.read(spark, f"file://{tmp_path}/none")


def test_a_start_is_checked_by_variable(spark, tmp_path):
    path = f"file://{tmp_path}/late"
    early = _series(spark, dt.date(2000, 1, 1), dt.date(2001, 12, 31), 1).withColumn("variable", F.lit("early"))
    late = _series(spark, dt.date(2000, 3, 1), dt.date(2001, 12, 31), 1).withColumn("variable", F.lit("late"))
    writers.write_cell_series(early.unionByName(late), path)
    assert readers.scan_cell_series(spark, path, ["early"], start="2000-01-01", late_start="raise").count() == 731
    with pytest.raises(ValueError, match="2000-03-01"):
        readers.scan_cell_series(spark, path, start="2000-01-01", late_start="raise")
    back = readers.scan_cell_series(spark, path, start="2000-01-01", end="2000-03-31", late_start="extend")
    assert rows(back.groupBy("variable").count()) == [("early", 91), ("late", 91)]


def test_folding_days_equals_a_full_run(spark, tmp_path):
    first, last = dt.date(2000, 1, 5), dt.date(2001, 3, 20)
    stack, store = f"file://{tmp_path}/stack", str(tmp_path / "store")
    whole = _series(spark, first, last)
    writers.write_cell_series(whole, stack)
    series = spark.read.parquet(stack)
    assert incremental.frontier(spark, store) is None
    for upto in (dt.date(2000, 2, 29), dt.date(2000, 3, 11), dt.date(2000, 3, 30), dt.date(2000, 12, 31), last, last):
        assert incremental.fold_days(series.filter(F.col("date") <= F.lit(upto)), store, KEYS, _spin()) == upto
    kinds = [t for t in temporal.MAP_KINDS if t != "daily"]
    months = temporal.month_parts(whole, KEYS, _spin())
    for kind in kinds:
        want = temporal.from_months(months, kind, KEYS, _spin(), F.lit(last)).withColumn("temporal", F.lit(kind)).select("temporal", *KEYS, "date", F.round("value", 6))
        got = incremental.outputs(spark, store, [kind], KEYS, _spin()).withColumn("value", F.round("value", 6))
        assert rows(got) == rows(want), kind


def test_a_second_run_reads_new_days_only(spark, tmp_path):
    store = str(tmp_path / "store")
    whole = _series(spark, dt.date(2000, 1, 1), dt.date(2000, 12, 31))
    writers.write_cell_series(whole, f"file://{tmp_path}/stack")
    series = spark.read.parquet(f"file://{tmp_path}/stack")
    incremental.fold_days(series.filter("date <= date'2000-11-30'"), store, KEYS, _spin())
    late = _plan(incremental._after(series, dt.date(2000, 11, 30)))
    assert "PartitionFilters" in late and "year" in late.split("PartitionFilters")[1].split("]")[0] and "GreaterThan(date,2000-11-30)" in late

    kept = {p: p.stat().st_mtime_ns for p in (tmp_path / "store/parts").rglob("*.parquet")}
    # A run that failed after its parts were replaced: the frontier still says November, December is there in part.
    parts = temporal.month_parts(series.filter("date > date'2000-11-30' and date <= date'2000-12-10'"), KEYS, _spin())
    incremental._write(parts, store)
    assert incremental.fold_days(series, store, KEYS, _spin()) == dt.date(2000, 12, 31)
    assert all(p.stat().st_mtime_ns == at for p, at in kept.items())  # closed months are not written again
    got = incremental.outputs(spark, store, ["annualtot"], KEYS, _spin())
    assert rows(got.select(*KEYS, "value")) == rows(whole.groupBy(*KEYS).agg(F.sum("value")))
    incremental.refold_months(_series(spark, dt.date(2000, 1, 1), dt.date(2000, 12, 31), scale=2.0), store, KEYS, _spin(), [dt.date(2000, 5, 1)])
    may = incremental.outputs(spark, store, ["monthtot"], KEYS, _spin()).filter("date = date'2000-05-01'")
    assert rows(may.select(*KEYS, "value")) == rows(whole.filter("month(date) = 5").groupBy(*KEYS).agg(F.sum("value") * 2))


def test_a_failure_inside_the_open_month_is_not_folded_twice(spark, tmp_path):
    store = str(tmp_path / "store")
    series = _series(spark, dt.date(2000, 1, 1), dt.date(2000, 1, 31))
    incremental.fold_days(series.filter("date <= date'2000-01-10'"), store, KEYS, _spin())
    incremental._write(temporal.month_parts(series.filter("date <= date'2000-01-20'"), KEYS, _spin()), store)
    assert incremental.fold_days(series, store, KEYS, _spin()) == dt.date(2000, 1, 31)
    got = incremental.outputs(spark, store, ["monthtot"], KEYS, _spin())
    assert rows(got.select(*KEYS, "value")) == rows(series.groupBy(*KEYS).agg(F.sum("value")))


def test_a_thousand_steps_are_ten_joins(spark):
    ldd = spark.range(3000).select(F.col("id").alias("cell_id"), F.when(F.col("id") < 2999, F.col("id") + 1).alias("down_id"))
    powers = network.down_powers(ldd, 1000)
    starts = spark.createDataFrame([(1, 0), (2, 2500)], "start_id long, cell_id long")
    assert len(powers) == 10
    got = rows(network.walk_downstream(ldd, starts, 1000, powers))
    assert got == [(1, k, k) for k in range(1, 1001)] + [(2, k, 2500 + k) for k in range(1, 500)]
    assert rows(network.walk_downstream(ldd, starts, 1)) == [(1, 1, 1), (2, 1, 2501)]


@pytest.mark.parametrize("size", [1, 2, 3, 6])
def test_buffers_reach_across_cells_that_are_absent(spark, size):
    cells = [(r * 20 + c, r, c, {(3, 4): 7, (5, 9): 2, (9, 1): 5}.get((r, c), 0)) for r in range(12) for c in range(13) if (r + c) % 3 or (r, c) in ((3, 4), (5, 9), (9, 1))]
    offsets = [(-(j // 2) if j % 2 else j // 2) for j in range(1, size + 1)]
    near = {}
    for _, r, c, body in cells:
        for a in offsets if body else ():
            for b in offsets:
                near[r + a, c + b] = min(body, near.get((r + a, c + b), body))
    want = [(i, r, c, body or near.get((r, c), 0)) for i, r, c, body in cells]
    frame = spark.createDataFrame(cells, "cell_id long, row int, col int, body long")
    assert rows(network.buffer_zone(frame, size)) == sorted(want)
    assert network.buffer_zone(frame.limit(0), size).count() == 0


def test_cells_that_lead_into_a_cycle_keep_their_row(spark):
    ldd = spark.createDataFrame([(1, 2), (2, None), (3, 4), (4, 5), (5, 4)], "cell_id long, down_id long")
    assert rows(network.basin_label(ldd)) == [(1, 1), (2, 1), (3, None), (4, None), (5, None)]


def test_a_lake_with_two_outlets_counts_once(spark):
    day = dt.date(2000, 1, 1)
    ldd = spark.createDataFrame([(1, 2), (2, None), (3, None), (4, 3)], "cell_id long, down_id long")
    flows = spark.createDataFrame([(1, day, 2.0, None), (2, day, 1.0, 3.0), (3, day, 1.0, 4.0), (4, day, None, 1.0)], "cell_id long, date date, discharge double, runoff double")
    cell = spark.createDataFrame([(k, 10.0) for k in range(1, 5)], "cell_id long, area double")
    bodies = spark.createDataFrame([(2, 9), (3, 9)], "cell_id long, body long")
    outlets = spark.createDataFrame([(9, 2), (9, 3)], "body long, cell_id long")
    got = rows(network.lake_inflow_sum(ldd, flows, cell, bodies, outlets))
    assert got == [(9, day, 2 * 86400 + 30.0 + 40.0, 2)]


def test_joins_keep_rows_without_a_partner(spark):
    days = spark.createDataFrame([(1, dt.date(2000, 1, 1)), (1, dt.date(2000, 1, 2))], "body long, date date")
    schedule = spark.createDataFrame([(1, 1, 5.0)], "body long, doy int, release double")
    assert rows(joins.doy_schedule_join(days, schedule, ["body"]).select("date", "release")) == [(dt.date(2000, 1, 1), 5.0), (dt.date(2000, 1, 2), None)]
    with pytest.raises(Exception, match="no schedule entry"):
        joins.doy_schedule_join(days, schedule, ["body"], strict=True).collect()
    stages = spark.createDataFrame([("x", 1, 2, 0.5, 0.1)], "crop string, start int, end int, kc double, ky double")
    months = spark.createDataFrame([("x", 2), ("x", 3)], "crop string, counter int")
    assert rows(joins.growth_stage_join(months, stages).select("counter", "kc")) == [(2, 0.5), (3, None)]
    totals = spark.createDataFrame([("a", None, 4.0), ("b", None, 2.0)], "sector string, source string, withdrawal double")
    efficiency = spark.createDataFrame([("a", 0.5)], "sector string, efficiency double")
    assert rows(demand.sector_consumption(totals, efficiency).select("sector", "consumption")) == [("a", 2.0), ("b", None)]


def test_a_transfer_without_its_bodies_is_null(spark):
    day = dt.date(2000, 1, 1)
    schedule = spark.createDataFrame([(1, 2, 1, 3.0), (1, 3, 1, 3.0), (0, 2, 1, 0.5), (2, 1, 1, 2.0)], "from_id long, to_id long, doy int, release double")
    bodies = spark.createDataFrame([(1, day, 10.0, 9.0, 1990), (2, day, 20.0, 4.0, 1995)], "body long, date date, volume double, storage double, year_built int")
    got = rows(demand.scheduled_transfer(schedule, bodies, bodies.select("date").distinct()).select("from_id", "to_id", "transfer"))
    assert got == [(0, 2, 10.0), (1, 2, 3.0), (1, 3, None), (2, 1, 0.95)]


def test_kinds_of_a_period_share_a_pass(spark):
    first, last = dt.date(2000, 1, 5), dt.date(2001, 3, 31)
    series = _series(spark, first, last)
    kinds = [t for t in temporal.MAP_KINDS if t != "daily"]
    requests = [(name, t, "map") for name in "ab" for t in kinds] + [("a", "daily", "map")]
    got = temporal.aggregate_outputs(series, requests, _spin())
    # Years, whole runs and the twelve months have a shuffle each, not one a kind.
    assert _plan(got).count("hashpartitioning(variable") == 3
    months = temporal.month_parts(series, KEYS, _spin())
    want = [temporal.from_months(months, k, KEYS, _spin(), F.lit(last)).select("variable", F.lit(k).alias("temporal"), "cell_id", "date", F.round("value", 6)) for k in kinds]
    want.append(series.filter("variable = 'a'").select("variable", F.lit("daily").alias("temporal"), "cell_id", "date", F.round("value", 6)))
    for each in want:
        kind = each.first()["temporal"]
        own = got.filter(F.col("temporal") == kind).select("variable", "temporal", "target_id", "date", F.round("value", 6))
        assert rows(own) == rows(each), kind


def test_sums_and_averages_of_gauges_are_given_as_asked(spark):
    series = _series(spark, dt.date(2000, 1, 5), dt.date(2000, 12, 31))
    cell = spark.createDataFrame([(0, 2.0), (1, 3.0), (2, 5.0)], "cell_id long, area double")
    ldd = spark.createDataFrame([(0, None), (1, 0), (2, 1)], "cell_id long, down_id long")
    gauge = spark.createDataFrame([(7, 0), (8, 1)], "gauge_id long, cell_id long")
    nearest = network.subcatchment(ldd, gauge)
    tree = network.gauge_tree(ldd, gauge, nearest)
    requests = [("a", "monthtot", "areasum"), ("a", "monthtot", "areaavg"), ("b", "totaltot", "areasum"), ("b", "daily", "areaavg")]
    got = temporal.aggregate_outputs(series, requests, _spin(), cell, gauge, nearest, tree)
    area, above, want = {0: 2.0, 1: 3.0, 2: 5.0}, {7: (0, 1, 2), 8: (1, 2)}, {}
    for v, date, c, value in series.collect():
        for g in above:
            if c not in above[g]:
                continue
            size = sum(area[x] for x in above[g])
            for t, s, d in [("monthtot", "areasum", date.replace(day=1)), ("monthtot", "areaavg", date.replace(day=1)), ("totaltot", "areasum", None), ("daily", "areaavg", date)]:
                if (v, t, s) in requests and (t != "totaltot" or date >= dt.date(2000, 2, 10)):
                    want[v, t, s, g, d] = want.get((v, t, s, g, d), 0.0) + value * area[c] / (size if s == "areaavg" else 1)
    made = {r[:5]: r[5] for r in map(tuple, got.collect())}
    assert made.keys() == want.keys() and all(made[k] == pytest.approx(want[k]) for k in want)
    # An area that comes twice gives its averages twice, not its sums, as a join of the averages alone would.
    twice = temporal.aggregate_outputs(series, requests, _spin(), cell, gauge.union(gauge.filter("gauge_id = 8")), nearest, tree)
    count = dict(rows(twice.groupBy("spatial").count()))
    days, whole = 181, 12  # gauge 8 has two areas, and two rows a day that month sums add up
    assert count == {"areasum": (whole + 1) * 2, "areaavg": whole * (1 + 2) + days * (1 + 2 * 2)}


def test_round_double_is_round(spark):
    values = [0.0, -0.0, 1e-9, -1e-9, 5e-6, -5e-6, 1.000005, 2.5e-5, 1.005, -1.005, 123456789.123455, 1e11, 1e300, -1e18, None]
    values += [float("nan"), float("inf"), float("-inf")] + [k / 31 for k in range(-4000, 4000)] + [k / 10**6 for k in range(-40005, 40005, 7)]
    frame = spark.createDataFrame([(x,) for x in values], "x double")
    for digits in (0, 3, 5):
        both = frame.select(F.round("x", digits).cast("string").alias("a"), round_double(F.col("x"), digits).cast("string").alias("b"))
        assert both.filter(~F.col("a").eqNullSafe(F.col("b"))).count() == 0


def test_areas_are_made_ready_once_a_gauge(spark):
    series = _series(spark, dt.date(2000, 1, 5), dt.date(2000, 1, 31))
    cell = spark.createDataFrame([(0, 2.0), (1, 3.0)], "cell_id long, area double")
    ldd = spark.createDataFrame([(0, None), (1, 0)], "cell_id long, down_id long")
    gauge = spark.createDataFrame([(7, 0), (8, 1)], "gauge_id long, cell_id long")
    nearest = network.subcatchment(ldd, gauge)
    tree = network.gauge_tree(ldd, gauge, nearest)
    requests = [("a", "daily", s) for s in ("areasum", "areaavg")]
    plan = _plan(temporal.aggregate_outputs(series, requests, _spin(), cell, gauge, nearest, tree))
    # Rows of the series only unroll the array that comes with their gauge.
    assert "Generate inline(coalesce(_given" in plan and "Generate inline(concat(" not in plan
