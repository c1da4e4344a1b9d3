"""Writers of map stacks, gauge files, state snapshots and link tables."""

from __future__ import annotations

import itertools
import os
import re
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroloom.functions import dates
from hydroloom.session import cut_lineage, drop_path
from hydroloom.sources import manifest


def stamp(series: DataFrame, kind: str) -> DataFrame:
    """Month and year outputs carry the first day of their period."""
    if kind.startswith("month"):
        return series.withColumn("date", dates.month_start(F.col("date")))
    if kind.startswith("annual"):
        return series.withColumn("date", dates.year_start(F.col("date")))
    return series


def write_cell_series(
    series: DataFrame, path: str, kind: str = "daily", mode: str = "errorifexists", partitions: str = "static"
) -> None:
    """Map stack, partitioned by variable and year, with cells in ranges and days inside them.

    Range partitioning samples the keys, so a variable that holds most rows is spread over many
    files. A file has all days of its cells: month and year aggregates are complete before their
    shuffle, and boxes of cells skip row groups. A path that exists is an error unless `mode` says more, so that a
    second run cannot double the rows. The stack's manifest is brought up to date afterwards.
    """
    out = stamp(series, kind).withColumn("year", F.year("date"))
    (
        out.repartitionByRange("variable", "year", "cell_id")
        .sortWithinPartitions("variable", "year", "cell_id", "date")
        .write.mode(mode).option("partitionOverwriteMode", partitions).partitionBy("variable", "year").parquet(path)
    )
    manifest.refresh(series.sparkSession, path)


# Characters that Spark escapes in the folder name of a partition.
_ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")


def _folder_name(by: str, key: str | None) -> str:
    """Folder of a partition as Spark names it."""
    if not key:
        return f"{by}=__HIVE_DEFAULT_PARTITION__"
    return f"{by}=" + _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", key)


def _file_writer(by: str, root: str):
    """Writes sorted `(by, line)` rows, a file for each key, and returns the number of files."""

    def write(batches):
        attempt = TaskContext.get().taskAttemptId()
        out = key = place = None
        n = 0

        def close():
            if out is not None:
                out.close()
                # A task that runs again puts the same file in the place of the first one.
                os.replace(out.name, place)

        for batch in batches:
            keys, lines = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k, same in itertools.groupby(range(len(keys)), keys.__getitem__):
                if out is None or k != key:
                    close()
                    folder = os.path.join(root, _folder_name(by, k))
                    os.makedirs(folder, exist_ok=True)
                    # The empty key shares its folder with the missing one.
                    place = os.path.join(folder, "part-00001.txt" if k == "" else "part-00000.txt")
                    # Readers pass over a name like this, should the task end here.
                    out, key, n = open(os.path.join(folder, f"_{attempt}"), "w", encoding="utf-8", newline=""), k, n + 1
                out.write("".join(f"{lines[i] or ''}\n" for i in same))
        close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([n], pa.int64())})

    return write


def write_lines(lines: DataFrame, path: str, by: str = "file") -> None:
    """Lines `(by, position, line)` in order, one folder and file per value of `by`.

    On a mounted file system the tasks write the files themselves, into a folder that takes its name once all are complete: Hadoop's
    local file system starts a process for the access rights of every file and folder. Elsewhere Spark's writer is used.
    """
    spark = lines.sparkSession
    ordered = lines.select(F.col(by).cast("string").alias(by), "position", "line").repartition(by).sortWithinPartitions(by, "position").select(by, "line")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.getUri().getScheme() != "file":
        ordered.write.partitionBy(by).text(path)
        return
    target = place.toUri().getPath()
    if os.path.lexists(target):
        raise FileExistsError(f"path already exists: {path}")
    work = os.path.join(os.path.dirname(os.path.abspath(target)), f"_{uuid.uuid4().hex}")
    os.makedirs(work)
    try:
        ordered.mapInArrow(_file_writer(by, work), "files long").agg(F.sum("files")).collect()
        Path(work, "_SUCCESS").touch()
        os.rename(work, target)
    except BaseException:
        drop_path(spark, work)
        raise


def _format_value(value) -> "F.Column":
    """Number in `%14g` style: six significant digits, 1e31 for a missing one."""
    # Java's %g keeps trailing zeros and has another exponent, so the digits are set by rounding.
    v = F.col(value) if isinstance(value, str) else value
    scale = F.when(v == 0, 0).otherwise(5 - F.floor(F.log10(F.abs(v))))
    factor = F.pow(F.lit(10.0), scale)
    # Dividing by a positive power keeps the decimal digits exact; multiplying by a negative one would not.
    digits = F.when(scale >= 0, F.round(v * factor) / factor).otherwise(F.round(v / F.pow(F.lit(10.0), -scale)) * F.pow(F.lit(10.0), -scale))
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.10f", digits), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    small = (F.abs(v) < 1e-4) & (v != 0)
    text = F.when(small | (F.abs(v) >= 1e6), F.format_string("%.5e", v)).otherwise(plain)
    return F.when(v.isNull(), F.lit("1e31")).otherwise(text)


def write_tss(series: DataFrame, path: str, names: list[str], title: str = "timeseries") -> None:
    """Old gauge text format: one file per `file`, lines of a step and one value per name.

    `series(file, step, name, value)`. The values of a line are gathered by (file, step) — as many
    as there are gauges — and lines are sorted within the file.
    """
    width = len(names) + 1
    index = F.element_at(F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))]), F.col("name"))
    cells = series.withColumn("_i", index).groupBy("file", "step").agg(
        F.map_from_entries(F.collect_list(F.struct("_i", F.lpad(_format_value("value"), 14, " ")))).alias("m")
    )
    values = F.transform(F.array(*[F.lit(i) for i in range(len(names))]), lambda i: F.coalesce(F.element_at("m", i), F.lit("1e31".rjust(14))))
    body = cells.select("file", (F.col("step") + width + 3).cast("long").alias("position"), F.concat(F.lit(" "), F.lpad(F.col("step").cast("string"), 8, " "), F.lit(" "), F.array_join(values, " ")).alias("line"))
    head = [title, str(width), "timestep", *names]
    top = series.select("file").distinct().select(
        "file", F.posexplode(F.array(*[F.lit(h) for h in head])).alias("position", "line")
    ).select("file", (F.col("position") - width - 3).cast("long").alias("position"), "line")
    write_lines(top.unionByName(body), path)


def write_series_csv(series: DataFrame, path: str, points: list[tuple[str, float, float]], kind: str = "daily", title: str = "Timeseries") -> None:
    """Wide CSV at gauges: title, xloc, yloc, `Date,...`, then day-first dates.

    `series(file, name, date, value)`, `points` = (name, x, y) in column order.
    """
    names = [p[0] for p in points]
    wide = stamp(series, kind).groupBy("file", "date").pivot("name", names).agg(F.first("value"))
    cols = [_format_value(F.col(f"`{n}`")) for n in names]
    body = wide.select(
        "file", F.datediff("date", F.lit("0001-01-01").cast("date")).cast("long").alias("position"),
        F.concat_ws(",", F.date_format("date", "dd/MM/yyyy"), *cols).alias("line"),
    )
    head = [
        title, ",".join(["xloc", *[f"{x:.4f}" for _, x, _ in points]]), ",".join(["yloc", *[f"{y:.4f}" for _, _, y in points]]),
        ",".join(["Date", *names]),
    ]
    top = series.select("file").distinct().select("file", F.posexplode(F.array(*[F.lit(h) for h in head])).alias("position", "line")).select(
        "file", (F.col("position") - 10).cast("long").alias("position"), "line"
    )
    write_lines(top.unionByName(body), path)


def write_point_series(series: DataFrame, path: str) -> None:
    """Series of points as CSV with a header."""
    series.write.option("header", "true").csv(path)


def write_clip_catalog(series: DataFrame, target: str, skip: str = "RCP_CO2") -> None:
    """Add variables that the target does not hold yet, except those whose name contains `skip`.

    A variable counts as held once its name is in the target's list, which is written after the data. Files that a failed
    run left behind are replaced: partitions of the variables at hand are overwritten, others stay.
    """
    spark: SparkSession = series.sparkSession
    wanted = series.filter(~F.col("variable").contains(skip))
    listed = f"{target}/_variables"
    try:
        wanted = wanted.join(spark.read.schema("variable string").parquet(listed), "variable", "left_anti")
    except AnalysisException as error:
        if not manifest.is_missing(error):
            raise
    wanted = cut_lineage(wanted, "clip")
    write_cell_series(wanted, target, mode="overwrite", partitions="dynamic")
    wanted.select("variable").distinct().write.mode("append").parquet(listed)
    drop_path(spark, wanted._scratch_path)


def snapshot_state(states: DataFrame, snapshot_dates: DataFrame, path: str) -> None:
    """State variables on chosen dates, one partition per date."""
    states.join(snapshot_dates.select("date").distinct(), "date").withColumnRenamed("date", "snapshot_date").write.partitionBy(
        "snapshot_date"
    ).parquet(path)


def total_map_lines(values: DataFrame) -> DataFrame:
    """(cell_id, line): value x 1000 with three decimals."""
    return values.select("cell_id", F.format_string("%.3f", F.round(F.col("value") * 1000, 3)).alias("line"))


def dump_total_map(values: DataFrame, path: str) -> None:
    """One value per cell and line in cell order."""
    total_map_lines(values).orderBy("cell_id").select("line").write.text(path)


LINK_COLUMNS = 20


def link_lines(links: DataFrame, gauges: DataFrame) -> DataFrame:
    """(gauge_id, line): a gauge and its direct inflows, padded to 20 columns; longer lists stay whole."""
    lists = links.groupBy("gauge_id").agg(F.array_sort(F.collect_list("inflow_id")).alias("ids"))
    ids = F.transform(F.coalesce("ids", F.array().cast("array<bigint>")), lambda x: x.cast("string"))
    pad = F.array_repeat(F.lit(""), F.greatest(F.lit(0), LINK_COLUMNS - F.size(ids)))
    return gauges.select("gauge_id").join(lists, "gauge_id", "left").select(
        "gauge_id", F.array_join(F.concat(F.array(F.col("gauge_id").cast("string")), ids, pad), ",").alias("line")
    )


def write_links_csv(links: DataFrame, gauges: DataFrame, path: str) -> None:
    link_lines(links, gauges).orderBy("gauge_id").select("line").write.text(path)


def write_param_maps(maps: DataFrame, path: str, scores: DataFrame | None = None, score: str = "KGE") -> None:
    """Long parameter maps `(name, cell_id, value)`, one partition per parameter, and beside them the map of the score
    `(cell_id, value)` if given."""
    if scores is not None:
        maps = maps.select("name", "cell_id", "value").unionByName(scores.select(F.lit(score).alias("name"), "cell_id", "value"))
    maps.withColumnRenamed("name", "parameter").write.partitionBy("parameter").parquet(path)
