"""Choice of calibration and validation periods from the valid days of a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroloom.functions.dates import year_end, year_start
from hydroloom.operators.keyed import attach, row_index_by_block

YEAR = 365


def valid_days(obs: DataFrame, start: Column, end: Column) -> DataFrame:
    """Days with a value inside the forcing window; the end day itself is outside."""
    return obs.filter(F.col("q").isNotNull() & (F.col("q") >= 0) & (F.col("date") >= start) & (F.col("date") < end))


def valid_count(obs: DataFrame, start: Column, end: Column) -> DataFrame:
    """Cumulative number of valid days per station, counted year by year."""
    return row_index_by_block(valid_days(obs, start, end), ["station_id"], "date", F.year("date"), "valid")


def split_periods(obs: DataFrame, start: Column, end: Column, min_years: int) -> DataFrame:
    """Validation and calibration period of each station with enough valid days.

    Records of more than 16 valid years give eight years to each period, aligned to 1 January;
    shorter ones are halved, but calibration keeps at least `min_years`.
    """
    counted = valid_count(obs, start, end)
    n = F.col("n")
    totals = counted.groupBy("station_id").agg(
        F.max("valid").alias("n"), F.min("date").alias("first_day"), F.max("date").alias("last_day")
    )
    fraction = F.least(F.lit(0.5), 1 - F.lit(float(min_years * YEAR)) / n)
    is_long = n - 4 > YEAR * 16
    totals = totals.withColumn("is_long", is_long).withColumn(
        "k_split", F.when(is_long, n - YEAR * 8).otherwise(F.bround(n * fraction, 0).cast("long"))
    ).withColumn("k_start", F.when(is_long, n - YEAR * 16))
    picked = attach(counted.select("station_id", "date", "valid"), totals, ["station_id"])
    dates = picked.groupBy("station_id").agg(
        *[F.first(c).alias(c) for c in ("n", "first_day", "last_day", "is_long")],
        F.max(F.when(F.col("valid") == F.col("k_split"), F.col("date"))).alias("split"),
        F.max(F.when(F.col("valid") == F.col("k_start"), F.col("date"))).alias("start16"),
    )
    split = F.when(F.col("is_long"), year_start(F.col("split"))).otherwise(F.col("split"))
    begin = F.when(F.col("is_long"), year_start(F.col("start16"))).otherwise(F.col("first_day"))
    return dates.filter(n > YEAR * min_years).select(
        "station_id", F.col("n").alias("n_valid"), begin.alias("val_start"), F.date_sub(split, 1).alias("val_end"),
        split.alias("cal_start"), year_end(F.col("last_day")).alias("cal_end"),
    )
