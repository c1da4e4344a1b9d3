"""Readers of gauge files, observation tables, map stacks and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydroloom import schemas
from hydroloom.functions import dates
from hydroloom.functions.clean import null_sentinels
from hydroloom.session import cut_lineage
from hydroloom.sources import manifest

_FILE = "_metadata.file_path"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with the file they come from and their order in it."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path)
    return raw.select(
        F.col(_FILE).alias("file"), F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("pos"),
        F.trim("value").alias("line"),
    )


def read_tss(spark: SparkSession, path: str, start: Column, fill: float | None = 0.0) -> DataFrame:
    """Rows (file, name, step, date, value) of the old gauge text format.

    A file has a title, the number of columns N, `timestep`, N - 1 names on single lines, then lines
    of a step and N - 1 values. Lines are told apart by their number, so a title may start with a number and a name may hold
    blanks; only the header lines of a file are gathered. Unreadable values and 1e31 become `fill`.
    """
    # The files are read once; headers and data come from a table of their lines.
    lines = cut_lineage(_lines(spark, path), "tss")
    # Row ids count up along a file inside its first block, which holds the header.
    top = lines.filter("pos.b = 0")
    heads = top.join(top.groupBy("file").agg(F.min("pos.i").alias("_first")), "file").withColumn("no", F.col("pos.i") - F.col("_first"))
    width = heads.filter("no = 1").select("file", F.col("line").try_cast("int").alias("width"))
    header = (
        heads.join(width, "file").filter((F.col("no") >= 3) & (F.col("no") <= F.col("width") + 1)).groupBy("file", "_first", "width")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]).alias("names"))
    )
    sized = lines.join(header, "file").withColumn("no", F.when(F.col("pos.b") == 0, F.col("pos.i") - F.col("_first")))
    behind = F.col("no").isNull() | (F.col("no") > F.col("width") + 1)
    data = sized.filter(behind).withColumn("p", F.split("line", r"\s+")).filter((F.size("p") > 1) & F.get("p", F.lit(0)).rlike(r"^\d+$"))
    rows = data.select("file", "names", F.get("p", F.lit(0)).cast("int").alias("step"), F.posexplode(F.slice("p", 2, F.size("p"))).alias("k", "text"))
    value = F.coalesce(null_sentinels(F.col("text").try_cast("double"), "series"), F.lit(fill).cast("double"))
    return rows.select(
        "file", F.get("names", F.col("k")).alias("name"), "step", dates.step_date(start, F.col("step")).alias("date"), value.alias("value")
    )


def read_series_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, name, x, y, date, value) of the series CSV with its three leading lines; 1e31 is NULL."""
    lines = _lines(spark, path).drop("pos").withColumn("p", F.split("line", ","))
    first = F.get("p", F.lit(0))

    def head(word: str, name: str) -> Column:
        return F.max(F.when(first == word, F.slice("p", 2, F.size("p")))).alias(name)

    header = lines.filter(first.isin("xloc", "yloc", "Date")).groupBy("file").agg(head("Date", "names"), head("xloc", "xs"), head("yloc", "ys"))
    data = lines.withColumn("date", dates.parse_date(first)).filter(F.col("date").isNotNull())
    rows = data.select("file", "date", F.posexplode(F.slice("p", 2, F.size("p"))).alias("k", "text"))
    return rows.join(header, "file").select(
        "file", F.get("names", F.col("k")).alias("name"), F.get("xs", F.col("k")).try_cast("double").alias("x"),
        F.get("ys", F.col("k")).try_cast("double").alias("y"), "date", null_sentinels(F.col("text").try_cast("double"), "series").alias("value"),
    )


def read_observations_wide(spark: SparkSession, path: str) -> DataFrame:
    """Long (station_id, date, q) from a table with day-first dates and one column per station.

    Negative values are missing.
    """
    wide = spark.read.option("header", "true").csv(path)
    day, *names = wide.columns
    long = wide.unpivot([day], names, "station_id", "text")
    return long.select(
        "station_id", dates.parse_date(F.col(day)).alias("date"), null_sentinels(F.col("text").try_cast("double"), "observed").alias("q")
    )


def read_stations(spark: SparkSession, path: str, schema: T.StructType = schemas.STATION_CSV) -> DataFrame:
    """Station metadata; a leading index column without a name is skipped."""
    raw = spark.read.option("header", "true").csv(path)
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields if f.name in raw.columns])


def read_observation_folder(spark: SparkSession, folder: str, stations: DataFrame, skip_two: bool = False) -> tuple[DataFrame, DataFrame]:
    """(observations of all stations, stations without a file) of one CSV per station.

    The station is the file name. Stations without a file keep one row with NULL date and value.
    """
    lines = _lines(spark, folder)
    p = F.split("line", ",")
    # A date in the first place marks the data lines, whatever the header says.
    rows = lines.select(
        F.url_decode(F.regexp_extract("file", r"([^/]+)\.csv[^/]*(/[^/]*)?$", 1)).alias("station_id"),
        dates.parse_date(F.get(p, F.lit(0))).alias("date"), F.get(p, F.lit(1)).try_cast("double").alias("q"), "pos",
    )
    if skip_two:
        # The two lines to skip may hold dates too: drop the first two of each file by position.
        firsts = rows.groupBy("station_id").agg(F.min("pos").alias("a"))
        second = rows.join(firsts, "station_id").filter(F.col("pos") > F.col("a")).groupBy("station_id").agg(F.min("pos").alias("b"))
        rows = rows.join(second, "station_id").filter(F.col("pos") > F.col("b"))
    obs = rows.filter(F.col("date").isNotNull()).select("station_id", "date", "q")
    return stations.join(obs, "station_id", "left"), stations.join(obs.select("station_id").distinct(), "station_id", "left_anti")


def scan_cell_series(
    spark: SparkSession, path: str, variables: list[str] | None = None, start: str | None = None, end: str | None = None,
    box: tuple[int, int, int, int] | None = None, zeros: float | None = None, buffer: int = 0, late_start: str = "allow",
) -> DataFrame:
    """Map stack by variable, dates and box. Variables and years prune partitions, the rest reaches
    the parquet scan. `zeros` replaces missing values, `buffer` widens the box by cells for an interpolation at its edge.

    Data that begin after `start` are taken as they are (`late_start="allow"`), stop the call (`"raise"`), or are extended back
    by the same days of their first year (`"extend"`): day n of a year takes the n-th day from the variable's first date on, if the
    stack holds it. Each variable has its own first date, from the stack's manifest.
    """
    if late_start not in ("allow", "raise", "extend"):
        raise ValueError(f"late_start is allow, raise or extend, not {late_start!r}")
    df = spark.read.parquet(path)
    if variables is not None:
        df = df.filter(F.col("variable").isin(*variables))
    if box is not None:
        r0, r1, c0, c1 = box
        df = df.filter(
            (F.col("row") >= r0 - buffer) & (F.col("row") < r1 + buffer) & (F.col("col") >= c0 - buffer) & (F.col("col") < c1 + buffer)
        )
    whole = df
    if start is not None:
        df = df.filter((F.col("date") >= F.lit(start).cast("date")) & (F.col("year") >= int(start[:4])))
    if start is not None and late_start != "allow":
        # First dates of the variables come from the manifest: no data file is opened for them.
        late = manifest.first_dates(spark, path).filter(F.col("first") > F.lit(start).cast("date"))
        if variables is not None:
            late = late.filter(F.col("variable").isin(*variables))
        if late_start == "raise":
            found = late.orderBy("first", "variable").first()
            if found is not None:
                raise ValueError(f"the data begin on {found['first']}, after {start} ({found['variable']})")
        else:
            days = late.select(F.col("variable").alias("_late"), "first", F.explode(F.sequence(F.lit(start).cast("date"), F.date_sub("first", 1))).alias("_day"))
            days = days.withColumn("_model", F.expr("date_add(first, dayofyear(_day) - 1)"))
            model = whole.join(days, (F.col("variable") == F.col("_late")) & (F.col("date") == F.col("_model")))
            df = df.unionByName(model.withColumn("date", F.col("_day")).withColumn("year", F.year("_day")).select(*df.columns))
    if end is not None:
        df = df.filter((F.col("date") <= F.lit(end).cast("date")) & (F.col("year") <= int(end[:4])))
    value = null_sentinels(F.col("value"))
    return df.withColumn("value", value if zeros is None else F.coalesce(value, F.lit(zeros)))


def slot_of(date: Column, kind: str) -> Column:
    """Key of a cyclic or yearly map slice for a date."""
    kinds = {"day": F.dayofyear, "10day": dates.ten_day_slot, "30day": dates.thirty_day_slot, "month": F.month, "year": F.year}
    if kind not in kinds:
        raise ValueError(f"unknown slice kind {kind!r}, expected one of {sorted(kinds)}")
    return kinds[kind](date)


def scan_keyed_maps(days: DataFrame, maps: DataFrame, kind: str, keys: list[str] = ("cell_id",)) -> DataFrame:
    """Attach the slice `(keys, slot, map_value)` of each row's date; NULL where none is stored."""
    return days.withColumn("slot", slot_of(F.col("date"), kind)).join(maps, [*keys, "slot"], "left")


def scan_static(cell: DataFrame, name: str, value: float | str) -> DataFrame:
    """Static map as a column: a constant, or the name of a stored attribute."""
    return cell.withColumn(name, F.col(value) if isinstance(value, str) else F.lit(float(value)))


def catalog_files(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Files of a map stack that overlap the run, in order of their first date: (variable, file, first_date, last_date, rows, rank).

    Only the stack's manifest is read. The window runs over one row per file of a variable.
    """
    from pyspark.sql import Window as W

    spans = manifest.read(spark, path).filter(F.col("file").isNotNull())
    kept = spans.filter(
        F.col("year").between(int(start[:4]), int(end[:4]))
        & (F.col("last_date") >= F.lit(start).cast("date")) & (F.col("first_date") <= F.lit(end).cast("date"))
    )
    ranked = kept.withColumn("rank", F.row_number().over(W.partitionBy("variable").orderBy("first_date", "file")))
    return ranked.select("variable", "file", "first_date", "last_date", "rows", "rank")


def load_state(cell: DataFrame, snapshot: DataFrame, variable: str, default: float = 0.0) -> DataFrame:
    """One stored state variable on the grid, the default where it is absent."""
    stored = snapshot.filter(F.col("variable") == variable).select("cell_id", F.col("value").alias("_v"))
    return cell.select("cell_id").join(stored, "cell_id", "left").select("cell_id", F.coalesce("_v", F.lit(default)).alias(variable))


def read_schedule_366(wide: DataFrame, transfers: dict[str, tuple[int, int]], doy: str = "doy") -> DataFrame:
    """(from_id, to_id, doy, release) of a table with one column of 366 releases per transfer."""
    long = wide.unpivot([doy], list(transfers), "_name", "release")
    ends = F.create_map(*[x for n, (a, b) in transfers.items() for x in (F.lit(n), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")))])
    pair = F.element_at(ends, F.col("_name"))
    return long.select(pair["a"].alias("from_id"), pair["b"].alias("to_id"), F.col(doy).cast("int").alias("doy"), F.col("release").cast("double").alias("release"))


def read_release_schedule(bodies: DataFrame, release: DataFrame, supply: DataFrame | None = None, doy: str = "doy") -> DataFrame:
    """(body, doy, release, supply) from wide tables with one column per body id.

    Ids that are no body are ignored; bodies without a column get -1. Without a supply table the
    releases stand for it.
    """

    def long(wide: DataFrame, name: str) -> DataFrame:
        ids = [c for c in wide.columns if c != doy]
        return wide.unpivot([doy], ids, "body", name).select(F.col("body").cast("long").alias("body"), F.col(doy).cast("int").alias("doy"), F.col(name).cast("double").alias(name))

    days = bodies.select("body").distinct().select("body", F.explode(F.sequence(F.lit(1), F.lit(366))).alias("doy"))
    out = days.join(long(release, "release"), ["body", "doy"], "left")
    if supply is None:
        out = out.withColumn("supply", F.col("release"))
    else:
        out = out.join(long(supply, "supply"), ["body", "doy"], "left")
    return out.na.fill(-1.0, ["release", "supply"])
