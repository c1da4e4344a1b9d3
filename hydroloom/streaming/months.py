"""Month totals and quota alarms over a table of closed days, in batches of bounded size.

`commit_days` runs a daily stream into a table of commits, one per micro-batch. `closed_days` reads that table as a stream
again, any number of files at a time. Two facts make this safe:

* In append mode every day of a commit is later than all days of the commits before it; inside a commit the months follow each
  other in the same way, as parts of their own. So a part's first day (its floor) is the event time of all its rows: a
  part that is split over batches has no late rows, and its rows belong to the month of their event time.
* A part ends with a mark, a row without a gauge whose event time is noon of the part's last day. Files are read in
  the order of their times and the mark is the latest, so the watermark passes a day's morning once the day is complete.

Event times stand on an axis on which every month has 31 days, so that a month is a window of fixed length.
Month totals are an aggregation that closes with the watermark, with RocksDB as state store (`run`). Quota alarms are merged
batch by batch with a table of the open month's totals (`QuotaAlarms`). Both need a file system whose renames are atomic.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hydroloom.session import drop_path
from hydroloom.streaming import readings

DAY_SCHEMA = "gauge_id long, variable string, date date, n long, total double"
ALARM_SCHEMA = "gauge_id long, month date, date date, month_to_date double"
QUOTA_SCHEMA = "gauge_id long, month date, date date, total double, alarmed boolean, mark boolean, found struct<date:date,month_to_date:double>"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SLACK = "1 second"  # the watermark stays behind a commit's floor, else the commit's own rows would be late
NOON = "12 hours"
EPOCH_YEAR, MONTH_DAYS = 1970, 31  # the axis of event times
DAY_MS = 86_400_000


def _files(spark: SparkSession, path: str):
    """Hadoop path and its file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _stamp(spark: SparkSession, folder: str) -> int:
    """Latest modification time of the data files in a folder, in milliseconds."""
    place, system = _files(spark, folder)
    return max((f.getModificationTime() for f in system.listStatus(place) if f.getPath().getName().endswith(".parquet")), default=0)


def commit_batch(batch: DataFrame, path: str, batch_id: int) -> bool:
    """Add a micro-batch of closed days to the table as a whole; False if it is there already or holds no day.

    The commit is written to a hidden folder and renamed when it is complete, so a batch that fails or runs again neither
    doubles nor hides rows.
    """
    spark = batch.sparkSession
    target, system = _files(spark, f"{path}/commit-{batch_id}")
    if system.exists(target):
        return False
    staged = f"{path}/_staged/commit-{batch_id}"
    place, _ = _files(spark, staged)
    system.delete(place, True)
    days = batch.selectExpr("gauge_id", "variable", "date", "n", "total")
    days.withColumn("month", F.trunc("date", "MM")).write.partitionBy("month").parquet(f"{staged}/days")
    found = spark.read.schema(f"{DAY_SCHEMA}, month date").parquet(f"{staged}/days")
    spans = sorted(tuple(r) for r in found.groupBy("month").agg(F.min("date"), F.max("date")).collect())
    for month, first, last in spans:
        # Parts are written one after the other, as files are read in the order of their times.
        part = f"{staged}/days/month={month}"
        if len(spans) == 1:
            system.rename(_files(spark, part)[0], _files(spark, f"{staged}/days-{first}")[0])
        else:
            spark.read.schema(DAY_SCHEMA).parquet(part).write.parquet(f"{staged}/days-{first}")
        mark = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in days.schema]).withColumn("date", F.lit(last))
        while True:
            mark.coalesce(1).write.mode("overwrite").parquet(f"{staged}/mark-{last}")
            if _stamp(spark, f"{staged}/mark-{last}") > _stamp(spark, f"{staged}/days-{first}"):
                break
            time.sleep(1)  # a file system with coarse times
    if not spans:
        drop_path(spark, staged)
        return False
    drop_path(spark, f"{staged}/days")
    if not system.rename(place, target):
        raise RuntimeError(f"commit {batch_id} could not be moved to {path}")
    return True


def commit_days(daily: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream of closed days (`readings.stream_daily`) into the table of commits at `path`."""
    _, system = _files(daily.sparkSession, path)
    system.mkdirs(_files(daily.sparkSession, path)[0])
    query = (
        daily.writeStream.foreachBatch(lambda batch, batch_id: commit_batch(batch, path, batch_id) and None)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def closed_days(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream over the table of commits: days with `mark` and the event time `closed`. A long backlog comes in batches of
    `files_per_batch` files, and no result depends on where they are cut."""
    raw = (
        spark.readStream.schema(DAY_SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
        .option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )
    part = F.regexp_extract(F.col("_metadata.file_path"), r"/(days|mark)-(\d+-\d+-\d+)/[^/]*$", 1)
    named = F.regexp_extract(F.col("_metadata.file_path"), r"/(days|mark)-(\d+-\d+-\d+)/[^/]*$", 2)
    day = named.cast("date")
    months = (F.year(day) - EPOCH_YEAR) * 12 + F.month(day) - 1
    midnight = F.timestamp_micros((months * MONTH_DAYS + F.dayofmonth(day) - 1).cast("long") * DAY_MS * 1000)
    mark = part == "mark"
    closed = F.when(mark, midnight + F.expr(f"interval {NOON}")).otherwise(midnight)
    return raw.select("gauge_id", "variable", "date", "n", "total", mark.alias("mark"), closed.alias("closed")).withWatermark("closed", SLACK)


@dataclass
class QuotaAlarms:
    """First day of each gauge and month on which the total since the month's first day passes the quota, as a merge in
    each batch of `days`.

    The state is a table, one version a batch: totals of the open month, and days whose part has not shown its mark, since
    files of one day may come in different batches. A day is complete once a mark of it or of a later day was read. A batch
    joins its complete days to the state by one shuffle and writes its alarms to a folder of its own, so a batch that runs
    again, from the version before it, replaces what it wrote.
    """

    days: DataFrame
    quota: float

    def run(self, path: str, checkpoint: str) -> DataFrame:
        spark = self.days.sparkSession
        versions = f"{checkpoint}/quota"
        for folder in (path, versions):
            place, system = _files(spark, folder)
            system.mkdirs(place)
        query = (
            self.days.writeStream.foreachBatch(lambda batch, batch_id: self._merge(batch, batch_id, path, versions))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        found = spark.read.schema(ALARM_SCHEMA).option("recursiveFileLookup", "true").parquet(path)
        return found.select("gauge_id", "month", "date", "month_to_date")

    def _merge(self, batch: DataFrame, batch_id: int, path: str, versions: str) -> None:
        spark = batch.sparkSession
        place, system = _files(spark, versions)
        known = sorted(int(f.getPath().getName().split("-")[1]) for f in system.listStatus(place))
        before = [n for n in known if n < batch_id]
        rows = batch.select(
            "gauge_id", F.trunc("date", "MM").alias("month"), "date", F.coalesce("total", F.lit(0.0)).alias("total"),
            F.lit(False).alias("alarmed"), "mark",
        )
        if before:
            rows = rows.unionByName(spark.read.schema(QUOTA_SCHEMA).parquet(f"{versions}/version-{before[-1]}").drop("found"))
        closed = rows.filter("mark").agg(F.max("date")).first()[0]
        given = rows.filter("not mark")
        ready = given.filter(F.lit(False) if closed is None else F.col("date").isNull() | (F.col("date") <= F.lit(closed)))
        waiting = given if closed is None else given.filter(F.col("date") > F.lit(closed))
        # The total so far has no date and comes first; rows of a day share its running sum.
        own = W.partitionBy("gauge_id", "month")
        so_far = F.sum("total").over(own.orderBy("date"))
        passed = F.col("date").isNotNull() & (F.col("so_far") > self.quota) & ~F.isnan("so_far")
        merged = (
            ready.withColumn("so_far", so_far).groupBy("gauge_id", "month")
            .agg(
                F.max(F.struct("date", "so_far"))["so_far"].alias("total"), F.bool_or("alarmed").alias("_before"),
                F.min(F.when(passed, F.struct("date", F.col("so_far").alias("month_to_date")))).alias("_first"),
            )
            .withColumn("found", F.when(~F.col("_before"), F.col("_first")))
            .withColumn("alarmed", F.col("_before") | F.col("found").isNotNull())
        )
        if closed is not None:
            merged = merged.filter((F.col("month") >= F.lit(closed.replace(day=1))) | F.col("found").isNotNull())
        none = F.lit(None)
        columns = ["gauge_id", "month", "date", "total", "alarmed", "mark", "found"]
        version = f"{versions}/version-{batch_id}"
        state = merged.select("gauge_id", "month", none.cast("date").alias("date"), "total", "alarmed", F.lit(False).alias("mark"), "found")
        empty = none.cast("struct<date:date,month_to_date:double>").alias("found")
        state = state.unionByName(waiting.select("*", empty).select(columns))
        last = spark.range(1).select(
            none.cast("long").alias("gauge_id"), none.cast("date").alias("month"), F.lit(closed).cast("date").alias("date"),
            none.cast("double").alias("total"), F.lit(False).alias("alarmed"), F.lit(True).alias("mark"), empty,
        )
        state.unionByName(last).write.mode("overwrite").parquet(version)
        alarms = spark.read.schema(QUOTA_SCHEMA).parquet(version).filter("found is not null")
        alarms.select("gauge_id", "month", "found.date", "found.month_to_date").write.mode("overwrite").parquet(f"{path}/batch-{batch_id}")
        for n in before[:-1]:
            drop_path(spark, f"{versions}/version-{n}")


def stream_month_total(days: DataFrame) -> DataFrame:
    """Month totals per gauge and variable from `closed_days`, each emitted once, when a day of the next month has closed.

    A part of the commits has days of one month only, so a window over the event time holds a month.
    """
    window = F.window("closed", f"{MONTH_DAYS} days").alias("w")
    sums = days.groupBy("gauge_id", "variable", window).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    months = (F.unix_micros("w.start") / (MONTH_DAYS * DAY_MS * 1000)).cast("int")
    month = F.add_months(F.make_date(F.lit(EPOCH_YEAR), F.lit(1), F.lit(1)), months).alias("month")
    # Marks have no count; they leave after the sums, as a filter before them would keep them from the watermark.
    return sums.filter("n is not null").select("gauge_id", "variable", month, "n", "total")


def stream_quota_alarm(days: DataFrame, quota: float) -> QuotaAlarms:
    """First day of each gauge and month on which the withdrawals so far pass the quota, from `closed_days`; all variables add up."""
    return QuotaAlarms(days, quota)


def run(stream: DataFrame | QuotaAlarms, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is available into a table: alarms by their merge, others by `readings.run_to_table` with RocksDB."""
    if isinstance(stream, QuotaAlarms):
        return stream.run(path, checkpoint)
    return readings.run_to_table(stream, path, checkpoint, state_store=STATE_STORE)
