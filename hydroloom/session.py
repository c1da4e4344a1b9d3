"""Session settings and the lineage cut used by iterative operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on. AQE measures the real size of every join side before it
# chooses a broadcast and splits skewed partitions, so no operator hints a broadcast of its own
# unless the rows come from a Python literal.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Spark's setting for deleting the shuffle files of a query once it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int | str = 8, memory: str = "8g", app: str = "hydroloom") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
    )
    for key, value in ENGINE_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: `spark.checkpoint.dir`, or a temporary one in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    root = getattr(spark, "_hydroloom_scratch", None)
    if root is None:
        root = tempfile.mkdtemp(prefix="hydroloom-")
        spark._hydroloom_scratch = root
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    return os.path.join(scratch_root(spark), f"{label}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame, label: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    A written table survives the loss of executors, keeps the plan of an iterative job small and
    gives the next round true file sizes to plan its joins with. `instead_of` names the table of the round before: if it
    came from here too, its files are deleted once the new ones are complete. The shuffles behind the table go with the job that
    wrote it: nothing reads them again, and otherwise they stay on disk until the driver's heap happens to be collected.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    kept = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, kept)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    old = getattr(instead_of, "_scratch_path", None)
    if old is not None:
        drop_path(spark, old)
    return table


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
