"""Alignment, as-of, nearest and schedule joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hydroloom.operators.keyed import counted, lag_by_block, tasks_for
from hydroloom.session import cut_lineage


def period_slice(series: DataFrame, periods: DataFrame, key: str = "station_id") -> DataFrame:
    """Rows of each station inside its period, both ends included."""
    inside = series.join(periods, key).filter(F.col("date").between(F.col("start"), F.col("end")))
    return inside.drop("start", "end")


def semi_mask(df: DataFrame, mask: DataFrame, key: str = "cell_id") -> DataFrame:
    return df.join(mask.select(key), key, "left_semi")


def nearest_on_axis(
    points: DataFrame, axis: DataFrame, point_key: str, value: str, coordinate: str, index: str, width: float = 1.0
) -> DataFrame:
    """Index of the nearest coordinate of an irregular axis, the smaller index on a tie.

    Each coordinate owns the interval up to half way to its neighbours. Intervals are cut into
    blocks of `width`, points carry their block, and the two meet by an equality join: neither a
    busy block nor the axis has to be sorted together with the points, and no task orders the whole axis.
    """
    x, i = F.col("_x"), F.col("_i")
    own = axis.groupBy(F.col(coordinate).cast("double").alias("_x")).agg(F.min(F.col(index).cast("long")).alias("_i"))
    own = own.withColumn("_me", F.struct("_x", "_i")).withColumn("_back", -x)
    block = F.floor(x / width)
    # Neighbours are found block by block and once; all that follows reads this table.
    both = lag_by_block(lag_by_block(own, [], "_x", block, "_me", "_p"), [], "_back", -block, "_me", "_n")
    side = cut_lineage(
        both.select(
            "_x", "_i", F.col("_p._x").alias("_px"), F.col("_p._i").alias("_pi"), F.col("_n._x").alias("_nx"), F.col("_n._i").alias("_ni")
        ),
        "axis",
    )
    own = side
    # Points beyond the axis fall into the blocks just outside it.
    low, high = (own.select(F.floor(f("_x") / width) + d).scalar() for f, d in ((F.min, -1), (F.max, 1)))
    start = F.coalesce(F.floor((F.col("_px") + x) / 2 / width), low)
    end = F.coalesce(F.floor((F.col("_nx") + x) / 2 / width), high)
    side = side.withColumn("_b", F.explode(F.sequence(start, end)))
    v = F.col("_v")
    placed = points.select(F.col(point_key), F.col(value).alias("_v")).withColumn(
        "_b", F.least(F.greatest(F.floor(v / width), low), high)
    )
    here = F.abs(v - x)
    before, after = F.abs(v - F.col("_px")), F.abs(v - F.col("_nx"))
    wins = (F.col("_px").isNull() | (here < before) | ((here == before) & (i < F.col("_pi")))) & (
        F.col("_nx").isNull() | (here < after) | ((here == after) & (i < F.col("_ni")))
    )
    return placed.join(side, "_b").filter(wins).select(point_key, i.alias(index))


def nearest_on_grid(x: Column, origin: float, cellsize: float, n: int) -> Column:
    """Index of the nearest cell centre of a regular axis, clamped to the grid; the lower one on a tie."""
    index = F.ceil((x - origin) / cellsize - 0.5 - 0.5)
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), index)).cast("int")


def clamp_period_key(date: Column, first: Column, last: Column, unit: str) -> Column:
    """Month or year index of a stored slice for a date.

    Months after the last stored one use the same month of the last stored year; years clamp at
    both ends. Months are counted as year * 12 + month - 1.
    """
    if unit == "year":
        return F.greatest(F.least(F.year(date), last), first)
    if unit == "month":
        key = F.year(date) * 12 + F.month(date) - 1
        return F.when(key > last, last - 11 + F.pmod(key - last - 1, F.lit(12))).otherwise(key)
    raise ValueError(f"unknown unit {unit!r}")


def require_slices(joined: DataFrame, marker: str) -> DataFrame:
    """Stop the query at the first row that found no slice (`marker` is NULL)."""
    told = F.raise_error(F.concat(F.lit("no stored slice for "), F.coalesce(F.col("date").cast("string"), F.lit("a missing date"))))
    return joined.withColumn(marker, F.when(F.col(marker).isNull(), told.cast("boolean")).otherwise(F.col(marker)))


def asof_period_map(
    series: DataFrame, maps: DataFrame, keys: list[str], unit: str = "month", strict: bool = False
) -> DataFrame:
    """Join dated rows with the stored month or year slice that stands for their date.

    `maps(keys, slot, map_value)`; the stored range is one small aggregate. A row before the first slice or in a gap keeps
    a NULL value; with `strict` it stops the query.
    """
    first, last = (maps.select(f("slot")).scalar() for f in (F.min, F.max))
    keyed = series.withColumn("slot", clamp_period_key(F.col("date"), first, last, unit))
    if not strict:
        return keyed.join(maps, [*keys, "slot"], "left")
    return require_slices(keyed.join(maps.withColumn("_stored", F.lit(True)), [*keys, "slot"], "left"), "_stored").filter("_stored").drop("_stored")


def asof_nearest_day(series: DataFrame, slices: DataFrame, keys: list[str]) -> DataFrame:
    """Join each dated row with the slice of the nearest date, the earlier one on a tie.

    Both tables are merged per key; positions before and after come from running aggregates that
    work year by year, so a long series is never ordered in one task. What other years hand to a year is one more row of it,
    and years are dealt over tasks by the number of rows.
    """
    rows = series.withColumn("_row", F.lit(True)).withColumn("_at", F.lit(None).cast("struct<d:date,v:double>"))
    marks = slices.select(*keys, "date", F.struct(F.col("date").alias("d"), F.col("map_value").cast("double").alias("v")).alias("_at"))
    both, n = counted(rows.unionByName(marks, allowMissingColumns=True).withColumn("_b", F.year("date")))
    group, tasks = [*keys, "_b"], tasks_for(n)
    ends = both.select(*group, "_at").repartition(tasks, *group).groupBy(*group).agg(F.max("_at").alias("_last"), F.min("_at").alias("_head"))
    years = W.partitionBy(*keys).orderBy("_b")
    ends = ends.select(
        *group, F.max("_last").over(years.rowsBetween(W.unboundedPreceding, -1)).alias("_low"),
        F.min("_head").over(years.rowsBetween(1, W.unboundedFollowing)).alias("_high"),
    )
    # Frames by date: a slice of the same day is before and after alike.
    whole, inside = W.partitionBy(*group), W.partitionBy(*group).orderBy("date")
    near = both.unionByName(ends, allowMissingColumns=True).repartition(tasks, *group).withColumn(
        "_low", F.coalesce(F.max("_at").over(inside.rangeBetween(W.unboundedPreceding, 0)), F.max("_low").over(whole))
    ).withColumn("_high", F.coalesce(F.min("_at").over(inside.rangeBetween(0, W.unboundedFollowing)), F.max("_high").over(whole)))
    d_low = F.datediff("date", F.col("_low.d"))
    d_high = F.datediff(F.col("_high.d"), "date")
    take_low = F.col("_high").isNull() | (F.col("_low").isNotNull() & (d_low <= d_high))
    return near.filter("_row").select(
        *series.columns, F.when(take_low, F.col("_low.d")).otherwise(F.col("_high.d")).alias("slice_date"),
        F.when(take_low, F.col("_low.v")).otherwise(F.col("_high.v")).alias("map_value"),
    )


def active_version(definitions: DataFrame, years: DataFrame, key: str = "plant_id") -> DataFrame:
    """First definition row of each plant that covers the year; open-ended rows have NULL `to_year`."""
    open_end = F.coalesce("to_year", F.lit(9999))
    spans = definitions.select(*definitions.columns, F.explode(F.sequence(F.col("from_year"), F.greatest(F.col("from_year"), F.least(open_end, years.select(F.max("year")).scalar())))).alias("year"))
    # Each row is unrolled over its own years and meets the wanted years by equality.
    valid = spans.filter((F.col("year") >= F.col("from_year")) & (F.col("year") <= open_end)).join(years, "year", "left_semi")
    names = [c for c in definitions.columns if c not in (key, "ord")]
    best = valid.groupBy(key, "year").agg(F.min_by(F.struct("ord", *names), "ord").alias("b"))
    return best.select(key, "year", "b.*")


def latest_by_year(capacities: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Capacity of the latest year <= y for each y of the run, 0 before the first entry.

    Only entries of the run's own years count; the table has one row per year.
    """
    spark = capacities.sparkSession
    spine = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
    merged = spine.join(capacities.filter(F.col("year").between(first_year, last_year)), "year", "left")
    return merged.select(
        "year", F.coalesce(F.last("capacity", ignorenulls=True).over(W.orderBy("year").rowsBetween(W.unboundedPreceding, 0)), F.lit(0.0)).alias("capacity")
    )


def _known(joined: DataFrame, what: str, strict: bool) -> DataFrame:
    """Rows with their partner's mark `_met`, which goes; without a partner a strict join stops."""
    if strict:
        joined = joined.filter(F.coalesce("_met", F.raise_error(F.lit(f"a row has no {what}")).cast("boolean")))
    return joined.drop("_met")


def doy_schedule_join(df: DataFrame, schedule: DataFrame, keys: list[str], date: str = "date", strict: bool = False) -> DataFrame:
    """Attach the entry of a 366-day schedule `(keys, doy, release)` by body and day of year, NULL (or an error if `strict`) without one.

    A schedule is often unrolled from a short table of bodies, whose size Spark takes for that of the 366 times longer
    schedule; so both sides are shuffled whatever the estimate says.
    """
    entries = schedule.withColumn("_met", F.lit(True)).hint("merge")
    return _known(df.withColumn("doy", F.dayofyear(date)).join(entries, [*keys, "doy"], "left"), "schedule entry", strict)


def growth_stage_join(months: DataFrame, stages: DataFrame, strict: bool = False) -> DataFrame:
    """KC and KY of the stage that holds the month counter; NULL (or an error if `strict`) outside all stages.

    Stages `(crop, start, end, kc, ky)` are unrolled over their months (a season has few), so the
    range test becomes an equality join.
    """
    unrolled = stages.select("crop", F.explode(F.sequence("start", "end")).alias("counter"), "kc", "ky", F.lit(True).alias("_met"))
    return _known(months.join(unrolled, ["crop", "counter"], "left"), "growth stage", strict)


def join_inflow_series(links: DataFrame, series: DataFrame) -> DataFrame:
    """Inflow rows (gauge_id, inflow_id, date, q): the series of every direct inflow.

    The dates of the first inflow (smallest id) of a gauge drive, as in a left join.
    """
    first = links.groupBy("gauge_id").agg(F.min("inflow_id").alias("inflow_id"))
    driver = first.join(series.withColumnRenamed("station_id", "inflow_id"), "inflow_id").select("gauge_id", "date")
    rows = links.join(driver, "gauge_id")
    return rows.join(series.withColumnRenamed("station_id", "inflow_id"), ["inflow_id", "date"], "left")


def inflow_table(links: DataFrame, series: DataFrame) -> DataFrame:
    """One row per gauge and date with the values of all its direct inflows, side by side by id:
    arrays `inflow_ids` and `q`, as many entries as the gauge has inflows."""
    entry = F.struct("inflow_id", "q")
    wide = join_inflow_series(links, series).groupBy("gauge_id", "date").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return wide.select(
        "gauge_id", "date", F.transform("e", lambda x: x["inflow_id"]).alias("inflow_ids"), F.transform("e", lambda x: x["q"]).alias("q")
    )


def inflow_lines(table: DataFrame) -> DataFrame:
    """The inflow table as text: names and values of a line, 1e31 for a missing value."""
    text = F.transform("q", lambda x: F.when(x.isNull(), "1e31").otherwise(F.format_string("%.3f", x)))
    return table.select(
        "gauge_id", "date", F.array_join(F.transform("inflow_ids", lambda x: x.cast("string")), " ").alias("names"), F.array_join(text, " ").alias("line")
    )


def merge_inflow_files(parts: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(all rows, names that occur in more than one file) of tables (file, name, date, q)."""
    rows = reduce(DataFrame.unionByName, parts)
    return rows, rows.groupBy("name").agg(F.count_distinct("file").alias("n_files")).filter("n_files > 1")


def compare_maps(a: DataFrame, b: DataFrame, difference: bool = True, keys: list[str] = ("cell_id",)) -> DataFrame:
    """Sum or difference of two maps by key, never by position."""
    joined = a.select(*keys, F.col("value").alias("_a")).join(b.select(*keys, F.col("value").alias("_b")), list(keys))
    value = F.col("_a") - F.col("_b") if difference else F.col("_a") + F.col("_b")
    return joined.select(*keys, value.alias("value"))


def station_conflicts(stations: DataFrame) -> DataFrame:
    """Number of ordered pairs of stations per shared cell: n * (n - 1), without building pairs."""
    return stations.groupBy("row", "col").agg(F.count("*").alias("n")).filter("n > 1").select(
        "row", "col", (F.col("n") * (F.col("n") - 1)).alias("n_pairs")
    )


def missing_stations(stations: DataFrame, series: DataFrame, key: str = "station_id") -> DataFrame:
    return stations.join(series.select(key).distinct(), key, "left_anti")


def ready_stations(stations: DataFrame, links: DataFrame, done: DataFrame) -> DataFrame:
    """Stations with no result yet whose direct inflows all have one."""
    flag = done.select(F.col("gauge_id").alias("inflow_id"), F.lit(True).alias("_done"))
    waiting = links.join(flag, "inflow_id", "left").groupBy("gauge_id").agg(F.bool_and(F.coalesce("_done", F.lit(False))).alias("_all"))
    return (
        stations.join(waiting, "gauge_id", "left").filter(F.coalesce("_all", F.lit(True)))
        .join(done, "gauge_id", "left_anti").select("gauge_id")
    )


def grid_align_check(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """One row: do two grids share all four corners."""
    def corners(df: DataFrame, p: str) -> DataFrame:
        return df.agg(*[f(c).alias(f"{p}_{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))])

    left, right = corners(a, "a"), corners(b, "b")
    names = [f"{n}_{c}" for c in ("lat", "lon") for n in ("min", "max")]
    one = left.select(*[F.col(f"a_{n}") for n in names], *[right.select(f"b_{n}").scalar().alias(f"b_{n}") for n in names])
    same = F.lit(True)
    for n in names:
        same = same & (F.abs(F.col(f"a_{n}") - F.col(f"b_{n}")) <= tolerance)
    return one.select(same.alias("aligned"))


def inflow_delta(series: DataFrame, keys: list[str], steps: int) -> DataFrame:
    """Inflow of each sub-step, moving linearly from the previous day's value; day one starts at its own."""
    lagged = lag_by_block(series, keys, "date", F.year("date"), "q", "_old")
    old = F.coalesce("_old", "q")
    delta = (F.col("q") - old) / steps
    return lagged.select(*keys, "date", delta.alias("delta"), old.alias("_from"), F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("sub_step")).select(
        *keys, "date", "sub_step", "delta", ((F.col("_from") + F.col("sub_step") * F.col("delta")) / steps).alias("inflow")
    )
