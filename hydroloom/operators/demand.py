"""Water-demand tables: sectors, sources, return flows, plants, transfers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroloom.functions.clean import safe_divide
from hydroloom.operators.keyed import dealt, lookup


def demand_to_depth(mcm: Column, area: Column, days: Column, scale: Column | None = None) -> Column:
    """Million m3 per period to m/day; amounts not above 1 / area count as none."""
    scaled = mcm if scale is None else mcm * scale
    return F.when(scaled > 1 / area, scaled).otherwise(0.0) * 1e6 / area / days


def demand_efficiency(consumption: Column, demand: Column) -> Column:
    return safe_divide(consumption, demand)


def pin_demand_year(date: Column, year: int) -> Column:
    """Day 1 of the month in a fixed year."""
    return F.make_date(F.lit(year), F.month(date), F.lit(1))


def cover_weighted_sum(cover: DataFrame, values: DataFrame) -> DataFrame:
    """Sum over cover classes of fraction x value: `cover(cell_id, cover, fraction)`,
    `values(cell_id, date, variable, cover, value)`.

    The classes of a cell come as a list, so that all values of a cell and day are in one task: its sums hold one entry for
    them, not one per class, and need no second shuffle.
    """
    classes = cover.groupBy("cell_id").agg(F.collect_list(F.struct("cover", "fraction")).alias("_classes"))
    own = F.explode(F.filter("_classes", lambda k: k["cover"] == F.col("cover"))).alias("_k")
    return (
        dealt(values.select("cell_id", "date", "variable", "cover", "value"), ["cell_id"]).join(classes.hint("merge"), "cell_id").select("cell_id", "date", "variable", "value", own)
        .groupBy("cell_id", "date", "variable")
        .agg(F.sum(F.col("_k.fraction") * F.col("value")).alias("value"))
    )


def segment_crop_area(crops: DataFrame, cell: DataFrame) -> DataFrame:
    """Per segment and crop: irrigated and rain-fed area, rain volume, mean potential evaporation.

    `crops(cell_id, segment, crop, irr, nonirr, rain, pet)`.
    """
    joined = lookup(crops, cell, ["cell_id"], ["area"])
    a = F.col("area")
    return joined.groupBy("segment", "crop").agg(
        F.sum(F.col("irr") * a).alias("irr_area"), F.sum(F.col("nonirr") * a).alias("nonirr_area"),
        F.sum(F.col("rain") * a).alias("rain_volume"), F.avg("pet").alias("mean_pet"),
    )


def sector_totals(alloc: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Withdrawal by sector, by source, by both and in total, in one pass.

    `alloc(keys, sector, source, value)`; a NULL sector or source stands for all of them.
    """
    return alloc.groupingSets(
        [[*keys, "sector", "source"], [*keys, "sector"], [*keys, "source"], list(keys)], *keys, "sector", "source"
    ).agg(F.sum("value").alias("withdrawal"))


def sector_consumption(totals: DataFrame, efficiency: DataFrame) -> DataFrame:
    """Consumption = efficiency x withdrawal, per sector, NULL without an efficiency; sectors are few, so AQE broadcasts them."""
    return totals.filter(F.col("sector").isNotNull() & F.col("source").isNull()).join(efficiency, "sector", "left").withColumn(
        "consumption", F.col("withdrawal") * F.col("efficiency")
    )


def nonirr_demand(demand: DataFrame, keys: list[str]) -> DataFrame:
    """Domestic, industry and livestock demand with shares, consumption and return-flow fraction.

    `demand(keys, sector, demand, consumption)`.
    """
    d, c, s = F.col("demand"), F.col("consumption"), F.col("sector")
    g = demand.groupBy(*keys).agg(
        F.sum(d).alias("nonirr_demand"), F.sum(c).alias("_consumption"),
        *[F.coalesce(F.sum(F.when(s == n, d)), F.lit(0.0)).alias(f"_{n}") for n in ("domestic", "industry", "livestock")],
    )
    total = F.col("nonirr_demand")
    used = F.least(total, F.col("_consumption"))
    return g.select(
        *keys, "nonirr_demand", used.alias("nonirr_consumption"), safe_divide(total - used, total).alias("return_fraction"),
        *[safe_divide(F.col(f"_{n}"), total).alias(f"frac_{n}") for n in ("domestic", "industry", "livestock")],
    )


def return_flow(irr_withdrawal: Column, irr_consumption: Column, nonirr_return: Column, fraction: Column, unmet: Column, withdrawal: Column) -> dict[str, Column]:
    """Split of what is withdrawn but not consumed; the unmet share of it is lost."""
    loss = irr_withdrawal - irr_consumption
    share = 1 - F.least(F.lit(1.0), safe_divide(unmet, withdrawal + unmet))
    irr, evap = fraction * loss, (1 - fraction) * loss
    return {
        "return_irr": irr * share,
        "evap_loss": evap * share,
        "return_nonirr": nonirr_return * share,
        "unmet_lost": (irr + evap + nonirr_return) * (1 - share),
        "return_total": (irr + nonirr_return) * share,
    }


def plant_collection(sewage: DataFrame, cell: DataFrame, plants: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Sewage by treatment area and day against the plant's capacity (volume / shortest time).

    `sewage(cell_id, plant_id, date, value)`, `plants(plant_id, year, volume, min_hrt)` from
    `joins.active_version`. `known(plant_id)` lists all plants of the basin (by default those of `plants`): what reaches one
    of them in a year without a valid version overflows whole; other areas are `exported_collection`'s.
    """
    ids = (plants if known is None else known).select("plant_id").distinct()
    collected = (
        lookup(sewage.join(ids, "plant_id", "left_semi"), cell, ["cell_id"], ["area"])
        .groupBy("plant_id", "date").agg(F.sum(F.col("value") * F.col("area")).alias("collected"))
        .withColumn("year", F.year("date"))
    )
    joined = collected.join(plants, ["plant_id", "year"], "left")
    capacity = F.coalesce(F.col("volume") / F.col("min_hrt"), F.lit(0.0))
    over = F.greatest(F.col("collected") - capacity, F.lit(0.0))
    kept = F.col("collected") - over
    return joined.select(
        "plant_id", "date", "collected", over.alias("overflow"), kept.alias("treated"),
        F.when(kept > 0, F.least(F.col("volume") / F.nullif(kept, F.lit(0.0)), F.lit(1.0))).alias("residence"),
    )


def exported_collection(sewage: DataFrame, cell: DataFrame, plants: DataFrame) -> DataFrame:
    """Sewage of areas whose plant is outside the basin; area 0 is none."""
    outside = sewage.filter(F.col("plant_id") > 0).join(plants.select("plant_id").distinct(), "plant_id", "left_anti")
    return lookup(outside, cell, ["cell_id"], ["area"]).groupBy("date").agg(
        F.sum(F.col("value") * F.col("area")).alias("exported")
    )


def treated_water_split(treated: Column, rule: Column, has_reservoir: Column, bodies: bool = True) -> dict[str, Column]:
    """-1 discharges all; 0..1 exports a share, the rest goes to reservoirs or, without one, is discharged."""
    if bodies:
        wrong = (rule > 1) | ((rule < 0) & (rule != -1))
        share = F.when(wrong, F.raise_error(F.lit("unexpected rule for treated water"))).otherwise(rule)
        all_out = share == -1
    else:
        share, all_out = rule, F.lit(True)
    exported = F.when(all_out, 0.0).otherwise(treated * share)
    rest = treated - exported
    to_reservoir = F.when(~all_out & has_reservoir, rest).otherwise(0.0)
    return {"exported": exported, "to_reservoir": to_reservoir, "discharged": rest - to_reservoir}


def desalination_limit(need: DataFrame, capacity: DataFrame) -> DataFrame:
    """Daily supply limited to annual capacity / 365, the same share for every cell.

    `need(cell_id, date, need, area)`, `capacity(year, capacity)`.
    """
    daily = need.groupBy("date").agg(F.sum(F.col("need") * F.col("area")).alias("_need"))
    share = daily.withColumn("year", F.year("date")).join(capacity, "year", "left").select(
        "date", safe_divide(F.least(F.col("_need"), F.coalesce("capacity", F.lit(0.0)) / 365), F.col("_need")).alias("_share")
    )
    return need.join(share, "date").select("cell_id", "date", (F.col("need") * F.col("_share")).alias("supplied"))


def scheduled_transfer(schedule: DataFrame, bodies: DataFrame, days: DataFrame) -> DataFrame:
    """Planned volume per day and pair of bodies, limited to 95 % of the receiver's free volume.

    `schedule(from_id, to_id, doy, release)`, id 0 = outside the basin; releases up to 1 are
    shares of the giver's store (of the receiver's volume when the giver is outside).
    `bodies(body, date, volume, storage, year_built)`; `days(date)`. A pair with a body that is not built yet has no row; one with a
    body that has no row for the day keeps it, with a NULL transfer.

    The schedule meets the givers before it is unrolled over the days: a day of the year brings the list of its dates, one per
    year. Receivers are those the schedule names, and few of them spare the unrolled rows a shuffle.
    """
    dated = days.withColumn("doy", F.dayofyear("date"))
    given = F.struct("date", F.col("storage").alias("from_storage"), F.col("year_built").alias("from_built"))
    givers = bodies.select(F.col("body").alias("from_id"), F.dayofyear("date").alias("doy"), given.alias("_g")).groupBy("from_id", "doy").agg(
        F.collect_list("_g").alias("_given")
    )
    planned = lookup(schedule.join(givers, ["from_id", "doy"], "left"), dated, ["doy"], ["date"])
    own = F.explode_outer(F.filter("_given", lambda g: g["date"] == F.col("date")))
    planned = planned.select("from_id", "to_id", "date", "release", own.alias("_g")).select(
        "from_id", "to_id", "date", "release", "_g.from_storage", "_g.from_built"
    )
    receivers = bodies.select(
        F.col("body").alias("to_id"), "date", F.col("volume").alias("to_volume"), F.col("storage").alias("to_storage"), F.col("year_built").alias("to_built")
    ).join(schedule.select("to_id").distinct(), "to_id", "left_semi")
    joined = lookup(planned, receivers, ["to_id", "date"], ["to_volume", "to_storage", "to_built"], how="left")
    year = F.year("date")
    built = ((F.col("from_id") == 0) | (F.col("from_built") <= year)) & ((F.col("to_id") == 0) | (F.col("to_built") <= year))
    unused = F.when(F.col("to_id") > 0, F.col("to_volume") - F.col("to_storage")).otherwise(F.lit(10e12))
    store = F.when(F.col("from_id") == 0, F.col("to_volume")).otherwise(F.col("from_storage"))
    amount = F.when(F.col("release") <= 1, store * F.col("release")).otherwise(F.col("release"))
    unknown = unused.isNull() | amount.isNull()
    return joined.filter(F.coalesce(built, F.lit(True))).select(
        "from_id", "to_id", "date", F.when(~unknown, F.least(unused * 0.95, amount)).alias("transfer")
    )
