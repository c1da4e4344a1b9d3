"""Manifest of a map stack: for every data file its variable, year, first and last date and number of rows.

It is a small table in a hidden folder of the stack. Catalogues and start checks read it instead of the data, as one would
read file headers. `refresh` compares it with the files that are there, so it is right again after any write or failure,
and reads no more than the partitions in which files came or went.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroloom.session import cut_lineage, drop_path

FOLDER = "_manifest"
SCHEMA = "file string, first_date date, last_date date, rows long, variable string, year int"
MOST_PARTITIONS = 1000  # beyond so many changed partitions the whole stack is read, without a filter


def is_missing(error: AnalysisException) -> bool:
    """Whether a read failed because nothing is there yet."""
    return error.getCondition() == "PATH_NOT_FOUND"


def read(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of a stack (SCHEMA); an error names the way to make it where it lacks."""
    try:
        return spark.read.schema(SCHEMA).parquet(f"{path}/{FOLDER}")
    except AnalysisException as error:
        if is_missing(error):
            raise FileNotFoundError(f"{path} has no manifest; manifest.refresh(spark, path) writes it") from error
        raise


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """`file, variable, year` of the data files by listing alone; no file is opened."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return listed.select(F.col("_metadata.file_path").alias("file"), F.col("variable").cast("string"), F.col("year").cast("int"))


def refresh(spark: SparkSession, path: str) -> None:
    """Bring the manifest up to date with the files of the stack; safe to run again."""
    there = cut_lineage(files_of(spark, path), "stack-files")
    try:
        known = spark.read.schema(SCHEMA).parquet(f"{path}/{FOLDER}")
    except AnalysisException as error:
        if not is_missing(error):
            raise
        known = spark.createDataFrame([], SCHEMA)
    came = there.join(known.select("file"), "file", "left_anti")
    went = known.join(there.select("file"), "file", "left_anti").select("file", "variable", "year")
    changed = came.union(went).select("variable", "year").distinct().limit(MOST_PARTITIONS + 1).collect()
    if changed:
        stack = spark.read.parquet(path).withColumn("variable", F.col("variable").cast("string"))
        if len(changed) <= MOST_PARTITIONS:
            # Literals prune the partitions when the scan is planned.
            own = [(F.col("variable").eqNullSafe(r["variable"])) & (F.col("year").eqNullSafe(r["year"])) for r in changed]
            stack = stack.filter(reduce(lambda a, b: a | b, own))
        spans = stack.groupBy(F.col("_metadata.file_path").alias("file"), "variable", "year").agg(
            F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("rows")
        )
        # Files that lost all their partition's mates leave a partition without files: it gets an empty row, which readers skip.
        gone = went.join(there.select("variable", "year").distinct(), ["variable", "year"], "left_anti").select(
            F.lit(None).cast("string").alias("file"), F.lit(None).cast("date").alias("first_date"), F.lit(None).cast("date").alias("last_date"),
            F.lit(0).cast("long").alias("rows"), "variable", "year",
        ).distinct()
        new = spans.select("file", "first_date", "last_date", "rows", "variable", "year").unionByName(gone)
        new.repartition("variable").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("variable", "year").parquet(f"{path}/{FOLDER}")
    drop_path(spark, there._scratch_path)


def first_dates(spark: SparkSession, path: str) -> DataFrame:
    """`variable, first`: first date of each variable."""
    return read(spark, path).groupBy("variable").agg(F.min("first_date").alias("first")).filter("first is not null")
