"""Outputs that run on over new days: month parts kept as a table, into which each day is folded once.

A full run reads the whole series for every output. Here the parts of all closed months stay as they are: a run reads the days
after the last one it knows, rewrites the months these days fall into, and every kind of output is made from the parts.
The store is `store/parts`, partitioned by month, and `store/frontier`, one row a run with the last day it folded.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroloom.operators.temporal import from_months, month_parts
from hydroloom.sources.manifest import is_missing

PARTS = ("total", "n", "since", "n_since", "last", "last_date")


def frontier(spark: SparkSession, store: str) -> dt.date | None:
    """Last day that is folded, None for a store without days."""
    try:
        return spark.read.schema("upto date").parquet(f"{store}/frontier").agg(F.max("upto")).first()[0]
    except AnalysisException as error:
        if is_missing(error):
            return None
        raise


def read_parts(spark: SparkSession, store: str) -> DataFrame:
    parts = spark.read.parquet(f"{store}/parts")
    return parts.withColumn("month", F.col("month").cast("date"))


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Parts of the same key and month as one: sums add up, of the last values the latest stays."""
    return parts.groupBy(*keys, "month").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n"), F.sum("since").alias("since"), F.sum("n_since").alias("n_since"),
        F.max_by("last", "last_date").alias("last"), F.max("last_date").alias("last_date"),
    )


def _after(series: DataFrame, day: dt.date) -> DataFrame:
    """Rows behind a day; a stack partitioned by year is not read before that year."""
    late = series.filter(F.col("date") > F.lit(day))
    return late.filter(F.col("year") >= day.year) if "year" in series.columns else late


def _write(parts: DataFrame, store: str) -> None:
    """Replace the months of `parts`; small months become one file, large ones are split by adaptive execution."""
    parts.hint("rebalance", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(f"{store}/parts")


def fold_days(series: DataFrame, store: str, keys: list[str], spin: Column) -> dt.date | None:
    """Fold the days of `series(keys, date, value)` behind the frontier into the store; returns the new frontier.

    Only those days are read, and of the store only the month the frontier lies in, if that is not complete. Months are replaced
    whole, and what a month already holds is told by its own last date, so a run that failed between parts and frontier is
    simply run again.
    """
    spark = series.sparkSession
    known = frontier(spark, store)
    new = series.select(*keys, "date", "value") if known is None else _after(series, known).select(*keys, "date", "value")
    old = None
    if known is not None and (known + dt.timedelta(days=1)).day > 1:
        open_month = F.lit(known.replace(day=1))
        old = read_parts(spark, store).filter(F.col("month") == open_month)
        held = old.agg(F.max("last_date")).first()[0]
        if held is not None and held > known:
            new = new.filter((F.trunc("date", "month") > open_month) | (F.col("date") > F.lit(held)))
    parts = month_parts(new, keys, spin)
    if old is not None:
        parts = merged(parts.unionByName(old.select(*parts.columns)), keys)
    _write(parts, store)
    try:
        written = read_parts(spark, store)
    except AnalysisException:
        if known is None:
            return None  # a first run without any day
        raise
    if known is not None:
        written = written.filter(F.col("month") >= F.lit(known.replace(day=1)))
    upto = written.agg(F.max("last_date")).first()[0]
    if upto is not None and upto != known:
        spark.createDataFrame([(upto,)], "upto date").coalesce(1).write.mode("append").parquet(f"{store}/frontier")
    return upto


def refold_months(series: DataFrame, store: str, keys: list[str], spin: Column, months: list[dt.date]) -> None:
    """Rewrite closed months from the series, where values behind the frontier were corrected."""
    if not months:
        return
    known = frontier(series.sparkSession, store)
    inside = series.filter(F.trunc("date", "month").isin(*months) & (F.col("date") <= F.lit(known)))
    if "year" in series.columns:
        inside = inside.filter(F.col("year").isin(*{m.year for m in months}))
    _write(month_parts(inside.select(*keys, "date", "value"), keys, spin), store)


def outputs(spark: SparkSession, store: str, kinds: list[str], keys: list[str], spin: Column) -> DataFrame:
    """`temporal, keys, date, value` of each kind of period (all but daily ones) as of the frontier; no series is read."""
    end = frontier(spark, store)
    parts = read_parts(spark, store)
    made = [from_months(parts, kind, keys, spin, F.lit(end)).withColumn("temporal", F.lit(kind)) for kind in kinds]
    return reduce(DataFrame.unionByName, made).select("temporal", *keys, "date", "value")
