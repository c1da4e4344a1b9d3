"""Water balances: volumes per day, totals by role, balances, hierarchies, residuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hydroloom.functions.clean import safe_divide
from hydroloom.operators.keyed import lookup, with_group
from hydroloom.session import cut_lineage

SECONDS_PER_DAY = 86400
LITERAL_LIMIT = 10_000


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A broadcast table from literal rows; its size is known here, so the hint is safe."""
    if len(rows) > LITERAL_LIMIT:
        raise ValueError(f"{len(rows)} literal rows; write a table instead")
    return F.broadcast(spark.createDataFrame(rows, schema))


def unit_to_volume(value: Column, area: Column, unit_class: Column) -> Column:
    """`M` depth x area, `M3` volume as is, `MS` flow x seconds of a day; NULL for other classes."""
    return (
        F.when(unit_class == "M", value * area)
        .when(unit_class == "M3", value)
        .when(unit_class == "MS", value * SECONDS_PER_DAY)
    )


def daily_sums(series: DataFrame, cell: DataFrame) -> DataFrame:
    """Per variable and day, the sums every unit class needs, in one pass over the cells."""
    weighted = lookup(series, cell, ["cell_id"], ["area"])
    return weighted.groupBy("variable", "date").agg(
        F.sum(F.col("value") * F.col("area")).alias("depth_volume"),
        F.sum("value").alias("plain_sum"),
        F.min_by("value", "cell_id").alias("first_cell"),
    )


def basin_daily_sum(series: DataFrame, cell: DataFrame, catalog: DataFrame) -> DataFrame:
    """Basin volume per catalogue row and day.

    The catalogue is joined after the cells are summed: a variable with several roles costs rows
    of the small daily table, not of the grid.
    """
    unit = F.col("unit_class")
    volume = (
        F.when(unit == "M", F.col("depth_volume"))
        .when(unit == "M3", F.col("plain_sum"))
        .when(unit == "MS", F.col("plain_sum") * SECONDS_PER_DAY)
        .otherwise(F.col("first_cell"))
    )
    return (
        daily_sums(series, cell)
        .join(catalog, "variable")
        .select("section", "role", "variable", "label", "date", volume.alias("volume"))
    )


def day_flows(daily: DataFrame, skip_days: int = 2) -> DataFrame:
    """Flows as they are, storages as change since the day before; the first days drop after the lag.

    The window holds one row per day of a catalogue entry, so its size is bounded by the calendar.
    """
    entry = W.partitionBy("section", "role", "variable", "label").orderBy("date")
    change = F.col("volume") - F.lag("volume").over(entry)
    return (
        daily.withColumn("_n", F.row_number().over(entry))
        .withColumn("amount", F.when(F.col("role") == "Storage", change).otherwise(F.col("volume")))
        .filter(F.col("_n") > skip_days)
        .drop("_n")
    )


def role_totals(flows: DataFrame) -> DataFrame:
    """Totals by section and role, per day and over the whole time, in one pass by grouping sets."""
    return (
        flows.groupingSets([["section", "role", "date"], ["section", "role"]], "section", "role", "date")
        .agg(F.sum("amount").alias("amount"), F.grouping("date").cast("int").alias("is_total"))
    )


def _percent(balance: Column, inflow: Column, outflow: Column, change: Column) -> Column:
    return safe_divide(100 * balance, 0.5 * inflow + 0.5 * F.abs(change) + 0.5 * outflow)


def section_balance(flows: DataFrame) -> DataFrame:
    """One row per section: inputs, outputs, storage change, magnitude, balance and its percentage."""
    per_entry = flows.groupBy("section", "role", "label").agg(F.sum("amount").alias("amount"))
    role = F.col("role")

    def total(name: str, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(role == name, value)), F.lit(0.0))

    sums = per_entry.groupBy("section").agg(
        total("Input", F.col("amount")).alias("inputs"),
        total("Output", F.col("amount")).alias("outputs"),
        total("Storage", F.col("amount")).alias("storage_change"),
        total("Storage", F.abs("amount")).alias("magnitude"),
    )
    balance = F.col("inputs") - F.col("outputs") - F.col("storage_change")
    return sums.withColumn("balance", balance).withColumn(
        "percent", _percent(F.col("balance"), F.col("inputs"), F.col("outputs"), F.col("storage_change"))
    )


def water_balance(flows: DataFrame, section: str = "Basin", adjustment: DataFrame | None = None) -> DataFrame:
    """Five rows: inputs (pumping adjustment included), outputs, storage change, balance, percent."""
    row = section_balance(flows.filter(F.col("section") == section))
    if adjustment is None:
        extra = F.lit(0.0)
    else:
        extra = adjustment.select(F.first("pumping_gap")).scalar()
    row = row.withColumn("inputs", F.col("inputs") + F.coalesce(extra, F.lit(0.0)))
    row = row.withColumn("balance", F.col("inputs") - F.col("outputs") - F.col("storage_change")).withColumn(
        "percent", _percent(F.col("balance"), F.col("inputs"), F.col("outputs"), F.col("storage_change"))
    )
    return row.unpivot([], ["inputs", "outputs", "storage_change", "balance", "percent"], "item", "value")


def flow_hierarchy(
    flows: DataFrame, section: str = "Basin", nested: list[tuple[str, str]] = (), adjustment: DataFrame | None = None
) -> DataFrame:
    """Parent / child table of a balance with the share of each child in its parent.

    `nested` adds levels below a label: (role, parent label), for instance transpiration classes
    under evapotranspiration. Storage children count by their absolute change. `adjustment` (one row,
    column `pumping_gap`) becomes a child of the inputs.
    """
    here = flows.filter(F.col("section") == section)
    below = [role for role, _ in nested]
    # The series is summed once; leaves, groups and shares come from this table of a few rows.
    leaf = cut_lineage(here.groupBy("section", "role", "label").agg(F.sum("amount").alias("amount")), "hierarchy")
    parent = F.col("role")
    for role, above in nested:
        parent = F.when(F.col("role") == role, F.lit(above)).otherwise(parent)
    sign = F.when(F.col("role") == "Input", "positive").when(
        F.col("role") == "Storage", F.when(F.col("amount") > 0, "positive").otherwise("negative")
    ).otherwise("negative")
    leaves = leaf.select(
        F.col("label"), parent.alias("parent"),
        F.when(F.col("role") == "Storage", F.abs("amount")).otherwise(F.col("amount")).alias("value"),
        sign.alias("sign"),
    )
    b = section_balance(leaf.filter(~F.col("role").isin(below)) if below else leaf)
    groups = b.select(
        F.explode(
            F.array(
                F.struct(F.lit("Input").alias("label"), F.col("inputs").alias("value"), F.lit("positive").alias("sign")),
                F.struct(F.lit("Output").alias("label"), F.col("outputs").alias("value"), F.lit("negative").alias("sign")),
                F.struct(F.lit("Storage").alias("label"), F.col("magnitude").alias("value"), F.lit("storage").alias("sign")),
                F.struct(F.lit("Balance").alias("label"), F.abs("balance").alias("value"), F.lit("white").alias("sign")),
            )
        ).alias("g")
    ).select("g.label", F.lit("Total").alias("parent"), "g.value", "g.sign")
    if adjustment is not None:
        groups = groups.unionByName(
            adjustment.select(
                F.lit("Adjusted pumping").alias("label"), F.lit("Input").alias("parent"),
                F.col("pumping_gap").alias("value"), F.lit("positive").alias("sign"),
            )
        )
    return share_of_parent(groups.unionByName(leaves))


def share_of_parent(rows: DataFrame, value: str = "value", parent: str = "parent") -> DataFrame:
    """Share of a value in the total of its parent, as number and as text like `12.5%`."""
    total = with_group(rows, [parent], _total=F.sum(value))
    share = safe_divide(F.col(value), F.col("_total"))
    return total.withColumn("share", share).withColumn("share_text", F.format_string("%.1f%%", share * 100)).drop("_total")


def depth_table(totals: DataFrame, cell: DataFrame, value: str = "amount") -> DataFrame:
    """Volumes divided by the total area, three decimals."""
    area = cell.select(F.sum("area")).scalar()
    return totals.withColumn("depth", F.round(F.col(value) / area, 3))


def pumping_gap(
    series: DataFrame, cell: DataFrame, requested: str, actual: str, skip_days: int = 2, raw_leak: bool = True
) -> DataFrame:
    """|sum(requested - actual - leaked)| after the first days.

    The leaked part is the plain sum of depths of the actual pumping, a mixture of units that the
    original report carries; `raw_leak=False` leaves it out.
    """
    pair = daily_sums(series.filter(F.col("variable").isin(requested, actual)), cell)
    by_day = pair.groupBy("date").agg(
        F.coalesce(F.sum(F.when(F.col("variable") == requested, F.col("depth_volume"))), F.lit(0.0)).alias("want"),
        F.coalesce(F.sum(F.when(F.col("variable") == actual, F.col("depth_volume"))), F.lit(0.0)).alias("got"),
        F.coalesce(F.sum(F.when(F.col("variable") == actual, F.col("plain_sum"))), F.lit(0.0)).alias("leak"),
    )
    # One row per day: the skipped days are the first dates, found without ordering the whole table.
    first_days = by_day.select("date").orderBy("date").limit(skip_days)
    kept = by_day.join(first_days, "date", "left_anti")
    leak = F.col("leak") if raw_leak else F.lit(0.0)
    return kept.agg(F.abs(F.sum(F.col("want") - (F.col("got") + leak))).alias("pumping_gap"))


def day_table(daily: DataFrame, variables: list[str]) -> DataFrame:
    """Date x variable table of basin volumes; naming the columns spares a pass to find them."""
    return daily.groupBy("date").pivot("variable", variables).agg(F.sum("volume"))


def land_class_area(cover: DataFrame, cell: DataFrame) -> DataFrame:
    """Area of each class per month end: fraction x cell area."""
    return (
        lookup(cover, cell, ["cell_id"], ["area"])
        .groupBy("cover", "month")
        .agg(F.sum(F.col("fraction") * F.col("area")).alias("class_area"))
    )


def land_output_table(daily: DataFrame) -> DataFrame:
    """Run totals by label in 1e9 m3; variables with `Demand` in the name are left out."""
    return (
        daily.filter(~F.col("variable").contains("Demand"))
        .groupBy("label")
        .agg((F.sum("volume") / 1e9).alias("billion_m3"))
    )


def balance_residual(
    flows: DataFrame, keys: list[str], inputs: list[str], before: list[str], after: list[str], outputs: list[str]
) -> DataFrame:
    """In + previous - end - out per row, missing terms as 0, with the alarm above 1e-7."""

    def total(names: list[str]) -> Column:
        parts = [F.coalesce(F.nanvl(F.col(n), F.lit(0.0)), F.lit(0.0)) for n in names]
        out = F.lit(0.0)
        for p in parts:
            out = out + p
        return out

    residual = total(inputs) + total(before) - total(after) - total(outputs)
    return flows.select(*keys, residual.alias("residual")).withColumn("alarm", F.abs("residual") > 1e-7)


def balance_residual_max(residuals: DataFrame, keys: list[str] = ()) -> DataFrame:
    return residuals.groupBy(*keys).agg(
        F.max(F.abs("residual")).alias("max_residual"), F.count_if("alarm").alias("n_alarm")
    )


def balance_residual_basin(residuals: DataFrame, label: DataFrame, cell: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Residual volume per basin: rows of (cell_id, residual) weighted by area."""
    return (
        lookup(residuals, label.join(cell.select("cell_id", "area"), "cell_id"), ["cell_id"], ["basin", "area"], rows=cell.count())
        .groupBy("basin", *keys)
        .agg(F.sum(F.col("residual") * F.col("area")).alias("residual"))
    )


def total_water_storage(
    groundwater: Column, soil: Column, lake_m3: Column, channel_m3: Column, area: Column,
    in_transit: Column | None = None, unmet_running: Column | None = None,
) -> Column:
    """Depth of all stored water; volumes are spread over the cell area."""
    store = groundwater - (unmet_running if unmet_running is not None else F.lit(0.0))
    total = store + soil + lake_m3 / area + channel_m3 / area
    return total if in_transit is None else total + in_transit
