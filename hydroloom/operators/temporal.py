"""Temporal and spatial aggregation of series, driven by a table of output requests."""

from __future__ import annotations

import difflib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroloom.functions import dates
from hydroloom.functions.clean import safe_divide
from hydroloom.operators import network
from hydroloom.operators.keyed import lookup
from hydroloom.session import cut_lineage

# Kinds of output a request may name.
MAP_KINDS = (
    "daily", "monthtot", "monthavg", "monthend", "annualtot", "annualavg", "annualend",
    "totaltot", "totalavg", "totalend", "once", "12month",
)
SERIES_KINDS = (
    "daily", "monthtot", "monthavg", "monthend", "annualtot", "annualavg", "annualend", "totaltot", "totalavg",
)
GAUGE_KINDS = ("tss", "areasum", "areaavg")


def run_end(series: DataFrame) -> Column:
    """Last date of the run as a scalar subquery (one small aggregate, no join)."""
    return series.select(F.max("date")).scalar()


def _period_sum(series: DataFrame, keys: list[str], start: Column, last: Column, end: Column | None) -> DataFrame:
    """Sum per period; a period is emitted once the run reaches its last day."""
    end = run_end(series) if end is None else end
    grouped = series.groupBy(*keys, start.alias("date")).agg(F.sum("value").alias("value"))
    return grouped.filter(last <= end)


def agg_daily(series: DataFrame, keys: list[str]) -> DataFrame:
    return series.select(*keys, "date", "value")


def agg_monthtot(series: DataFrame, keys: list[str], end: Column | None = None) -> DataFrame:
    return _period_sum(series, keys, dates.month_start(F.col("date")), F.last_day("date"), end)


def agg_monthavg(series: DataFrame, keys: list[str], end: Column | None = None) -> DataFrame:
    """Month sum over the calendar days of the month, also when the first month is partial."""
    return agg_monthtot(series, keys, end).withColumn("value", F.col("value") / dates.days_in_month(F.col("date")))


def agg_monthend(series: DataFrame, keys: list[str]) -> DataFrame:
    d = F.col("date")
    return series.filter(d == F.last_day(d)).select(*keys, dates.month_start(d).alias("date"), "value")


def agg_annualtot(series: DataFrame, keys: list[str], end: Column | None = None) -> DataFrame:
    return _period_sum(series, keys, dates.year_start(F.col("date")), dates.year_end(F.col("date")), end)


def agg_annualavg(series: DataFrame, keys: list[str], end: Column | None = None) -> DataFrame:
    return agg_annualtot(series, keys, end).withColumn("value", F.col("value") / dates.days_in_year(F.col("date")))


def agg_annualend(series: DataFrame, keys: list[str]) -> DataFrame:
    d = F.col("date")
    return series.filter(d == dates.year_end(d)).select(*keys, dates.year_start(d).alias("date"), "value")


def agg_totaltot(series: DataFrame, keys: list[str], spin: Column) -> DataFrame:
    return series.filter(F.col("date") >= spin).groupBy(*keys).agg(F.sum("value").alias("value"))


def agg_totalavg(series: DataFrame, keys: list[str], spin: Column, end: Column | None = None) -> DataFrame:
    """Sum since the spin-up over the number of days of the run."""
    days = F.datediff(run_end(series) if end is None else end, spin) + 1
    return agg_totaltot(series, keys, spin).withColumn("value", F.col("value") / days)


def agg_totalend(series: DataFrame, keys: list[str]) -> DataFrame:
    return series.groupBy(*keys).agg(F.max_by("value", "date").alias("value"))


def agg_once(static: DataFrame, keys: list[str], column: str) -> DataFrame:
    return static.select(*keys, F.col(column).alias("value"))


def agg_12month(series: DataFrame, keys: list[str], end: Column | None = None) -> DataFrame:
    """Twelve climatology values per key, stamped at day 1 of the months of the end year."""
    stamp = F.make_date(F.year(run_end(series) if end is None else end), F.month("date"), F.lit(1))
    return series.groupBy(*keys, stamp.alias("date")).agg(F.avg("value").alias("value"))


def agg_gauge_point(series: DataFrame, gauge: DataFrame, keys: list[str] = ("date",)) -> DataFrame:
    return lookup(series, gauge, ["cell_id"], ["gauge_id"]).select("gauge_id", *keys, "value")


def agg_gauge_area(
    series: DataFrame, cell: DataFrame, nearest: DataFrame, tree: DataFrame, gauge: DataFrame,
    keys: list[str] = ("date",), average: bool = False,
) -> DataFrame:
    """Area-weighted sum (or mean) over everything upstream of each gauge; nested gauges overlap.

    `nearest` labels each cell by its nearest downstream gauge, `tree` gives each gauge the next one below. Cells are summed
    once per nearest gauge; these sums go down the tree by doubling, so overlap multiplies gauges by log(depth) at most.
    """
    labelled = nearest.join(cell.select("cell_id", "area"), "cell_id")
    local = (
        lookup(series, labelled, ["cell_id"], ["gauge_id", "area"])
        .groupBy("gauge_id", *keys)
        .agg(F.sum(F.col("value") * F.col("area")).alias("value"))
    )
    total = network.down_tree(tree, local, {"value": "sum"}, list(keys))
    if average:
        area = catchment_area(cell, nearest, tree)
        total = total.join(area, "gauge_id").withColumn("value", safe_divide(F.col("value"), F.col("catchment_area"))).drop("catchment_area")
    return network.for_all_gauges(total, gauge)


def catchment_area(cell: DataFrame, nearest: DataFrame, tree: DataFrame) -> DataFrame:
    """(gauge_id, catchment_area) of each representative gauge."""
    local = nearest.join(cell.select("cell_id", "area"), "cell_id").groupBy("gauge_id").agg(F.sum("area").alias("catchment_area"))
    return network.down_tree(tree, local, {"catchment_area": "sum"})


def check_request(variable: str, temporal: str, spatial: str, known: list[str] | None = None) -> None:
    """Reject unknown kinds, and variables outside `known` with the closest name."""
    allowed = MAP_KINDS if spatial == "map" else SERIES_KINDS
    if spatial != "map" and spatial not in GAUGE_KINDS:
        raise ValueError(f"spatial kind {spatial!r} is not one of map, {', '.join(GAUGE_KINDS)}")
    if temporal not in allowed:
        raise ValueError(f"temporal kind {temporal!r} is not one of {', '.join(allowed)}")
    if known is not None and variable not in known:
        close = difflib.get_close_matches(variable, known) or ["- no match -"]
        raise ValueError(f"variable {variable!r} is not defined; the closest name is {close[0]!r}")


def month_parts(series: DataFrame, keys: list[str], spin: Column) -> DataFrame:
    """What all temporal kinds but the daily one need, per key and month: sums, counts and the last values."""
    d = F.col("date")
    after = d >= spin
    return series.groupBy(*keys, dates.month_start(d).alias("month")).agg(
        F.sum("value").alias("total"),
        F.count("value").alias("n"),
        F.sum(F.when(after, F.col("value"))).alias("since"),
        F.count_if(after).alias("n_since"),
        F.max_by("value", "date").alias("last"),
        F.max("date").alias("last_date"),
    )


def from_months(parts: DataFrame, kind: str, keys: list[str], spin: Column, end: Column) -> DataFrame:
    """`keys, date, value` of a temporal kind from its month parts; `date` is NULL for the whole run."""
    month = F.col("month")
    year = dates.year_start(month)
    none = F.lit(None).cast("date")
    at_end = parts.filter(F.col("last_date") == F.last_day(month))

    def whole_months() -> DataFrame:
        return parts.filter(F.last_day(month) <= end)

    def years() -> DataFrame:
        sums = parts.groupBy(*keys, year.alias("date")).agg(F.sum("total").alias("value"))
        return sums.filter(dates.year_end(F.col("date")) <= end)

    def run() -> DataFrame:
        return parts.filter("n_since > 0").groupBy(*keys).agg(F.sum("since").alias("value"))

    make = {
        "monthtot": lambda: whole_months().select(*keys, month.alias("date"), F.col("total").alias("value")),
        "monthavg": lambda: whole_months().select(*keys, month.alias("date"), (F.col("total") / dates.days_in_month(month)).alias("value")),
        "monthend": lambda: at_end.select(*keys, month.alias("date"), F.col("last").alias("value")),
        "annualtot": years,
        "annualavg": lambda: years().withColumn("value", F.col("value") / dates.days_in_year(F.col("date"))),
        "annualend": lambda: at_end.filter(F.month(month) == 12).select(*keys, year.alias("date"), F.col("last").alias("value")),
        "totaltot": run,
        "totalavg": lambda: run().withColumn("value", F.col("value") / (F.datediff(end, spin) + 1)),
        "totalend": lambda: parts.groupBy(*keys).agg(F.max_by("last", "last_date").alias("value")),
        "once": lambda: parts.groupBy(*keys).agg(F.max_by("last", "last_date").alias("value")),
        "12month": lambda: parts.groupBy(*keys, F.make_date(F.year(end), F.month(month), F.lit(1)).alias("date")).agg(
            (F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("value")
        ),
    }
    out = make[kind]()
    return out.select(*keys, F.col("date") if "date" in out.columns else none.alias("date"), "value")


def _period_rows(parts: DataFrame, kinds: list[str], keys: list[str], spin: Column, end: Column) -> list[DataFrame]:
    """`keys, temporal, date, value` of several kinds at once, as `from_months` makes them one by one.

    Kinds of the same length of period share a pass over the parts, and years and whole runs a shuffle.
    """
    month, year = F.col("month"), F.col("date")
    none = F.lit(None).cast("date")
    made = []

    def long(table: DataFrame, values: dict[str, Column], flags: list[str], kept: Column) -> None:
        asked = {kind: value for kind, value in values.items() if kind in kinds}
        if asked:
            wide = table.select(*keys, "date", *flags, *[value.alias(kind) for kind, value in asked.items()])
            made.append(wide.unpivot([*keys, "date", *flags], list(asked), "temporal", "value").filter(kept).drop(*flags))

    kind = F.col("temporal")
    monthly = parts.select(
        "*", month.alias("date"), (F.last_day(month) <= end).alias("_whole"), (F.col("last_date") == F.last_day(month)).alias("_at_end")
    )
    sums = {"monthtot": F.col("total"), "monthavg": F.col("total") / dates.days_in_month(month)}
    lasts = {"monthend": F.col("last"), "annualend": F.col("last")}
    long(monthly, sums, ["_whole"], F.col("_whole"))
    at_end = monthly.filter("_at_end")
    long(at_end, {"monthend": lasts["monthend"]}, [], F.lit(True))
    long(at_end.filter(F.month(month) == 12).withColumn("date", dates.year_start(month)), {"annualend": lasts["annualend"]}, [], F.lit(True))
    yearly = parts.groupBy(*keys, dates.year_start(month).alias("date")).agg(F.sum("total").alias("_sum")).filter(dates.year_end(year) <= end)
    long(yearly, {"annualtot": F.col("_sum"), "annualavg": F.col("_sum") / dates.days_in_year(year)}, [], F.lit(True))
    runs = parts.groupBy(*keys).agg(
        F.sum("since").alias("_since"), (F.sum("n_since") > 0).alias("_any"), F.max_by("last", "last_date").alias("_last")
    )
    days = F.datediff(end, spin) + 1
    whole = {"totaltot": F.col("_since"), "totalavg": F.col("_since") / days, "totalend": F.col("_last"), "once": F.col("_last")}
    long(runs.withColumn("date", none), whole, ["_any"], F.col("_any") | kind.isin("totalend", "once"))
    if "12month" in kinds:
        made.append(from_months(parts, "12month", keys, spin, end).select(*keys, "date", F.lit("12month").alias("temporal"), "value"))
    return made


def aggregate_outputs(
    series: DataFrame,
    requests: list[tuple[str, str, str]],
    spin: Column,
    cell: DataFrame | None = None,
    gauge: DataFrame | None = None,
    nearest: DataFrame | None = None,
    tree: DataFrame | None = None,
    known: list[str] | None = None,
) -> DataFrame:
    """Outputs for requests `(variable, temporal kind, spatial kind)`, as one long table.

    The series is read once for the month parts of each place (cells, gauge cells, gauge basins), written as a table that
    all kinds of periods read, and once more for daily maps; so the number of passes does not grow with the number of
    requests. Sums and averages over basins share one pass, as every kind is linear over cells, and so do kinds
    of the same length of period. A series that is costly to make should be written before.
    """
    for request in requests:
        check_request(*request, known=known)
    end = run_end(series)
    keys = ["variable", "target_id"]
    parts = []

    def place(names: list[str], spatial: str) -> DataFrame:
        chosen = series.filter(F.col("variable").isin(*names))
        if spatial == "map":
            return chosen.select("variable", F.col("cell_id").alias("target_id"), "date", "value")
        if spatial == "tss":
            placed = agg_gauge_point(chosen, gauge, ["variable", "date"])
        else:
            placed = agg_gauge_area(chosen, cell, nearest, tree, gauge, ["variable", "date"])
        return cut_lineage(placed.select("variable", F.col("gauge_id").alias("target_id"), "date", "value"), "gauge-series")

    for place_kinds in (("map",), ("tss",), ("areasum", "areaavg")):
        asked = [r for r in requests if r[2] in place_kinds]
        if not asked:
            continue
        placed = place(sorted({v for v, _, _ in asked}), place_kinds[0])
        months = None
        if any(t != "daily" for _, t, _ in asked):
            months = cut_lineage(month_parts(placed, keys, spin), "month-parts")
        area = None
        if any(s == "areaavg" for _, _, s in asked):
            area = network.for_all_gauges(catchment_area(cell, nearest, tree), gauge).withColumnRenamed("gauge_id", "target_id")
            area = cut_lineage(area, "gauge-areas")
        pairs: dict[tuple[str, str], set[str]] = {}
        for name, temporal, spatial in asked:
            pairs.setdefault((temporal, spatial), set()).add(name)
        kinds = list(dict.fromkeys(t for t, _ in pairs))
        made = [] if months is None else _period_rows(months, kinds, keys, spin, end)
        if "daily" in kinds:
            made.append(placed.select(*keys, "date", F.lit("daily").alias("temporal"), "value"))
        out = reduce(DataFrame.unionByName, made)
        if area is None:
            out = out.withColumn("spatial", F.lit(place_kinds[0]))
        else:
            # A value stands for the sum, and once more, over each area of its gauge, for the average.
            kind = area.schema["catchment_area"].dataType
            areas = area.groupBy("target_id").agg(F.collect_list(F.struct("catchment_area")).alias("_areas"))
            rest = F.array().cast(f"array<struct<spatial:string,_area:{kind.simpleString()}>>")
            own = F.transform("_areas", lambda a: F.struct(F.lit("areaavg").alias("spatial"), a["catchment_area"].alias("_area")))
            total = F.array(F.struct(F.lit("areasum").alias("spatial"), F.lit(None).cast(kind).alias("_area")))
            alone = total if any(s == "areasum" for _, s in pairs) else rest
            # The array is made once a gauge, not once a row of the series.
            out = lookup(out, areas.select("target_id", F.concat(alone, own).alias("_given")), ["target_id"], ["_given"], how="left")
            out = out.select(*keys, "date", "temporal", "value", F.inline(F.coalesce("_given", alone))).withColumn(
                "value", F.when(F.col("spatial") == "areaavg", safe_divide(F.col("value"), F.col("_area"))).otherwise(F.col("value"))
            )
        names = {v for v, _, _ in asked}
        every = {s for _, s in pairs}
        if any(chosen != names for chosen in pairs.values()) or len(pairs) < len(kinds) * len(every):
            alike: dict[tuple[str, ...], list[tuple[str, str]]] = {}
            for pair, chosen in pairs.items():
                alike.setdefault(tuple(sorted(chosen)), []).append(pair)
            wanted = [
                F.col("variable").isin(*chosen) & F.concat_ws(" ", "temporal", "spatial").isin(*[" ".join(pair) for pair in group])
                for chosen, group in alike.items()
            ]
            out = out.filter(reduce(Column.__or__, wanted))
        parts.append(out.select("variable", "temporal", "spatial", "target_id", "date", "value"))
    return reduce(DataFrame.unionByName, parts)


def env_flow_stats(series: DataFrame, keys: list[str] = ("cell_id",)) -> DataFrame:
    """Mean flow and its exact 10th percentile; a key holds one value per day, so its size is bounded."""
    return series.groupBy(*keys).agg(F.avg("value").alias("maf"), F.percentile("value", F.lit(0.1)).alias("q90"))


def env_flow_monthly(series: DataFrame, keys: list[str] = ("cell_id",), drop_last_day: bool = False) -> DataFrame:
    """Mean and 10th percentile by calendar month. `drop_last_day` leaves out the run's last day."""
    if drop_last_day:
        series = series.filter(F.col("date") < run_end(series))
    return series.groupBy(*keys, F.month("date").alias("month")).agg(
        F.avg("value").alias("mmf"), F.percentile("value", F.lit(0.1)).alias("mq90")
    )


def env_flow_vmf(mmf: Column, maf: Column) -> Column:
    """Variable monthly flow: 60 % of low, 30 % of high, 45 % of intermediate months."""
    return F.when(mmf <= 0.4 * maf, 0.6 * mmf).when(mmf > 0.8 * maf, 0.3 * mmf).otherwise(0.45 * mmf)
