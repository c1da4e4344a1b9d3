"""Zone statistics written back to cells, and allocation between demand and supply.

Zone totals are grouped aggregates joined back (see `keyed`), so a zone that holds a third of all
cells is summed in parallel. Windows appear only where a group is bounded by its nature: sectors or
sources of one cell and day, days of one month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hydroloom.functions.clean import safe_divide
from hydroloom.operators.keyed import attach, with_group


def zone_total(cells: DataFrame, zone: list[str], value: str, name: str = "zone_total") -> DataFrame:
    return with_group(cells, zone, **{name: F.sum(value)})


def zone_average(cells: DataFrame, zone: list[str], value: str, name: str = "zone_average") -> DataFrame:
    return with_group(cells, zone, **{name: F.avg(value)})


def zone_maximum(cells: DataFrame, zone: list[str], value: str, name: str = "zone_maximum") -> DataFrame:
    """Largest value of the zone, never below 0."""
    return with_group(cells, zone, **{name: F.greatest(F.lit(0.0), F.max(value))})


def zone_majority(cells: DataFrame, zone: list[str], value: str, name: str = "zone_majority") -> DataFrame:
    """Most frequent value of the zone, the smallest on a tie; counted before values are compared."""
    counts = cells.groupBy(*zone, value).agg(F.count("*").alias("_n"))
    best = counts.groupBy(*zone).agg(F.max_by(value, F.struct(F.col("_n"), -F.col(value))).alias(name))
    return attach(cells, best, zone)


def month_quota(withdrawals: DataFrame, quota: DataFrame, segment: str = "segment") -> DataFrame:
    """Month-to-date withdrawal against the quota of its segment and month.

    `withdrawals(segment, date, value)`, `quota(segment, quota)`. A day is `open` while the total
    of the days before it has not passed the quota; a segment without quota is always open, its ratio
    NULL. Days are summed first, so a window holds at most one month.
    """
    daily = withdrawals.groupBy(segment, "date").agg(F.sum("value").alias("value"))
    so_far = W.partitionBy(segment, F.trunc("date", "MM")).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    total = daily.withColumn("month_to_date", F.sum("value").over(so_far)).join(quota, segment, "left")
    return total.select(
        segment, "date", "value", "month_to_date",
        F.coalesce(F.col("month_to_date") - F.col("value") <= F.col("quota"), F.lit(True)).alias("open"),
        safe_divide(F.col("month_to_date"), F.col("quota")).alias("ratio"),
    )


def priority_cascade(demand: DataFrame, amount: DataFrame, keys: list[str], priority: dict[str, int], sector: str = "sector") -> DataFrame:
    """Give the amount of each key to its sectors in order of priority; the rest comes out as `other`.

    `demand(keys, sector, demand)`, `amount(keys, amount)`. A sector without an amount is given 0; an amount without
    demand goes to `other` whole. Sectors are summed first: a window holds one row per sector.
    """
    order = F.lit(len(priority))
    for name, rank in priority.items():
        order = F.when(F.col(sector) == name, rank).otherwise(order)
    rows = demand.groupBy(*keys, sector).agg(F.sum("demand").alias("demand")).withColumn("_p", order)
    upto = W.partitionBy(*keys).orderBy("_p", sector).rowsBetween(W.unboundedPreceding, 0)
    served = rows.withColumn("_cum", F.sum("demand").over(upto)).join(amount, keys, "left").na.fill(0.0, ["amount"])
    given = F.greatest(F.lit(0.0), F.least(F.col("demand"), F.col("amount") - (F.col("_cum") - F.col("demand"))))
    served = served.select(*keys, sector, given.alias("given"))
    wanted = demand.groupBy(*keys).agg(F.sum("demand").alias("_wanted"))
    rest = amount.join(wanted, keys, "left").withColumn(
        "given", F.greatest(F.lit(0.0), F.col("amount") - F.coalesce("_wanted", F.lit(0.0)))
    )
    return served.select(*keys, sector, "given").unionByName(rest.select(*keys, F.lit("other").alias(sector), "given"))


def zone_allocation(cells: DataFrame, zone: list[str]) -> DataFrame:
    """Meet the demand of a zone from the water of all its cells.

    `cells(zone keys, demand, available, area)` in depths, weighted by area. Each cell gives
    `abstraction` in proportion to what it has, and gets `allocation` in proportion to its need.
    """
    totals = with_group(
        cells, zone,
        _d=F.sum(F.col("demand") * F.col("area")), _a=F.sum(F.col("available") * F.col("area")),
    )
    take = F.least("_d", "_a")
    give = F.when(F.col("_d") < F.col("_a"), safe_divide(F.col("available"), F.col("_a")) * F.col("_d")).otherwise(F.col("available"))
    get = safe_divide(F.col("demand"), F.col("_d")) * take
    return totals.withColumn("abstraction", F.greatest(F.lit(0.0), give)).withColumn(
        "allocation", F.greatest(F.lit(0.0), get)
    ).withColumn("unmet", F.greatest(F.lit(0.0), F.col("demand") - F.col("allocation"))).drop("_d", "_a")


def source_potential(rows: DataFrame, keys: list[str]) -> DataFrame:
    """What each source may still serve of a sector's demand, and what stays unmet.

    `rows(keys, sector, source, source_order, fraction, demand, served)`; a window holds the
    sources of one key and sector.
    """
    earlier = W.partitionBy(*keys, "sector").orderBy("source_order").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys, "sector")
    before = F.coalesce(F.sum("served").over(earlier), F.lit(0.0))
    return rows.withColumn("potential", F.least(F.col("fraction") * F.col("demand"), F.col("demand") - before)).withColumn(
        "unmet", F.col("demand") - F.sum("served").over(whole)
    )


def zone_single_supply(cells: DataFrame, stores: DataFrame, zone: list[str], max_fraction: float = 0.98, efficiency: float = 1.0) -> DataFrame:
    """One store serves a zone: the largest of the zone's stores, up to a fraction of it.

    `cells(zone keys, need)` and `stores(zone keys, store)` as volumes. Cells of a zone without a store stay, with 0.
    """
    largest = stores.groupBy(*zone).agg(F.max("store").alias("store"))
    need = cells.groupBy(*zone).agg(F.sum("need").alias("_need"))
    # `least` skips NULL: a zone without a store must not take its whole need.
    take = F.when(F.col("store").isNull(), 0.0).otherwise(F.least(F.col("store") * max_fraction, F.col("_need") / efficiency))
    per_zone = need.join(largest, zone, "left").select(*zone, "_need", take.alias("take"))
    return attach(cells, per_zone, zone, "inner").withColumn(
        "share", F.col("need") * safe_divide(F.col("take"), F.col("_need"))
    ).drop("_need")


def capacity_fill(links: DataFrame, treated: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Share treated water over the free volume of linked reservoirs: (sent per link, overflow per key).

    `links(keys, reservoir, left)`, `treated(keys, treated)`. Repeated sharing in proportion to
    free volume ends at `left * min(1, treated / sum(left))`.
    """
    room = links.groupBy(*keys).agg(F.sum("left").alias("_room"))
    per_key = treated.join(room, keys, "left").na.fill(0.0, ["_room"])
    filled = attach(links, per_key, keys, "inner")
    sent = F.col("left") * F.least(F.lit(1.0), safe_divide(F.col("treated"), F.col("_room")))
    overflow = per_key.select(*keys, F.greatest(F.lit(0.0), F.col("treated") - F.col("_room")).alias("overflow"))
    return filled.withColumn("sent", sent).drop("_room", "treated"), overflow


def grid_coarsen(cells: DataFrame, n: int, value: str, keys: list[str] = ()) -> DataFrame:
    """Block mean of n x n cells; missing values are skipped."""
    return cells.groupBy(*keys, F.expr(f"row div {n}").cast("int").alias("row"), F.expr(f"col div {n}").cast("int").alias("col")).agg(
        F.avg(F.nanvl(F.col(value), F.lit(None).cast("double"))).alias(value)
    )


def column_profile(series: DataFrame, keys: list[str], value: str = "value", cells: Column | None = None) -> DataFrame:
    """Per layer: present, missing, zero and non-zero counts, minimum, mean, maximum."""
    v = F.col(value)
    missing = v.isNull() | F.isnan(v)
    clean = F.when(~missing, v)
    out = series.groupBy(*keys).agg(
        F.count(clean).alias("n_valid"), F.count_if(missing).alias("n_missing"), F.count_if(clean == 0).alias("n_zero"),
        F.count_if(clean != 0).alias("n_nonzero"), F.min(clean).alias("min"), F.avg(clean).alias("mean"), F.max(clean).alias("max"),
    )
    # Rows that a mask leaves out are absent; with the cell count they are reported as missing too.
    return out if cells is None else out.withColumn("n_missing", cells - F.col("n_valid"))


def zone_difference(zones: DataFrame, others: DataFrame, zone: str) -> DataFrame:
    """Zones of the first table that the second does not have; zone 0 is none."""
    return remove_zone_zero(zones, zone).join(others.select(zone).distinct(), zone, "left_anti")


def remove_zone_zero(cells: DataFrame, zone: str) -> DataFrame:
    return cells.filter(F.col(zone) > 0).select(zone).distinct()


def zone_intersection(cells: DataFrame, zone: str, canal: str) -> DataFrame:
    """Canal cells whose canal id is their zone; a zone without any keeps all its cells."""
    own = (F.col(canal) == F.col(zone)) & (F.col(zone) > 0)
    marked = with_group(cells.filter(F.col(zone) > 0), [zone], _any=F.bool_or(own))
    return marked.filter(own | ~F.col("_any")).drop("_any")


def forward_fill(capacities: DataFrame, first_year: int, last_year: int) -> DataFrame:
    from hydroloom.operators.joins import latest_by_year

    return latest_by_year(capacities, first_year, last_year)


def month_counter(date: Column, planting_month: Column, season: Column) -> Column:
    """Months since planting, 1 in the planting month, 0 once the season is over."""
    n = F.pmod(F.month(date) - planting_month, F.lit(12)) + 1
    return F.when(n > season, 0).otherwise(n)
