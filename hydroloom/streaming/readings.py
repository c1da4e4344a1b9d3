"""Streams of gauge readings: daily and slot windows, snapshots, enrichment; `months` builds on the closed days.

Input rows are `(gauge_id, ts, variable, value)`. Readings may come late up to a bound; what is
later still is dropped by the watermark, as in any event-time aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LATENESS = "2 days"
MICROS_PER_DAY = 86_400_000_000
STORE_SETTING = "spark.sql.streaming.stateStore.providerClass"


def _day_of(instant: Column) -> Column:
    """UTC day of an instant, whatever the session's time zone; windows are aligned to UTC as well."""
    return F.date_from_unix_date(F.floor(F.unix_micros(instant) / MICROS_PER_DAY).cast("int"))


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    """File stream of readings; the bound on files keeps a restart after a pause from one huge batch."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    )


def stream_daily(readings: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Daily count, sum and mean per gauge and variable, emitted once a day is closed."""
    return (
        readings.withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 day").alias("w"), "gauge_id", "variable")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"))
        .select("gauge_id", "variable", _day_of(F.col("w.start")).alias("date"), "n", "total", "mean")
    )


def slot_start(day: Column, days: int) -> Column:
    """First day of the 10- or 30-day slot of a date; slots start again each 1 January."""
    offset = F.floor((F.dayofyear(day) - 1) / days).cast("int") * days
    return F.date_add(F.trunc(day, "YYYY"), offset)


def stream_slots(readings: DataFrame, days: int = 10, lateness: str = LATENESS) -> DataFrame:
    """Daily sums with the start of their slot: closed days are final, so adding them up per
    slot downstream (`slot_totals`) needs no further state."""
    daily = stream_daily(readings, lateness)
    return daily.withColumn("slot", slot_start(F.col("date"), days))


def slot_totals(daily: DataFrame) -> DataFrame:
    return daily.groupBy("gauge_id", "variable", "slot").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def stream_static_join(readings: DataFrame, station: DataFrame) -> DataFrame:
    """Readings with the attributes of their station, NULL for an unknown one; the static side is planned by its size in each batch."""
    return readings.join(station, "gauge_id", "left")


def run_to_table(
    stream: DataFrame, path: str, checkpoint: str, schema: T.StructType | str | None = None, state_store: str | None = None
) -> DataFrame:
    """Run a stream over what is available into a parquet table and return the table.

    `state_store` is the provider class of its state, where it needs another one than the session's.
    """
    spark = stream.sparkSession
    before = spark.conf.get(STORE_SETTING, None)
    if state_store:
        spark.conf.set(STORE_SETTING, state_store)
    try:
        query = (
            stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start(path)
        )
        query.awaitTermination()
    finally:
        if state_store and before is None:
            spark.conf.unset(STORE_SETTING)
        elif state_store:
            spark.conf.set(STORE_SETTING, before)
    return spark.read.schema(schema or stream.schema).parquet(path)


def snapshot_batches(stream: DataFrame, snapshot_dates: DataFrame, path: str, checkpoint: str) -> None:
    """Store the closed days that a schedule names, one folder per micro-batch.

    Writing a batch again after a failure replaces its own folder, so no row is stored twice.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        chosen = batch.join(snapshot_dates, "date", "left_semi")
        chosen.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    query = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
