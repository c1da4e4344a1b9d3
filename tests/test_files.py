"""File formats, layouts and streams."""

import datetime as dt
from pathlib import Path

import pytest
from helpers import rows
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from hydroloom.session import SHUFFLE_CLEANUP, cut_lineage, scratch_path, scratch_root
from hydroloom.sources import readers, text, writers
from hydroloom.streaming import readings

TSS = """\
timeseries  settingsfile: run.ini date: Wed Jan  8 08:30:48 2025
3
timestep
G1
G2
     1827         1.2095           1e31
     1828         1.2151            2.5
"""


def test_read_old_text_series(spark, tmp_path):
    (tmp_path / "a.tss").write_text(TSS)
    got = rows(readers.read_tss(spark, str(tmp_path), F.lit("1990-01-01").cast("date")).select("name", "step", "date", "value"))
    assert got == [
        ("G1", 1827, dt.date(1995, 1, 1), 1.2095), ("G1", 1828, dt.date(1995, 1, 2), 1.2151),
        ("G2", 1827, dt.date(1995, 1, 1), 0.0), ("G2", 1828, dt.date(1995, 1, 2), 2.5),
    ]
    kept = readers.read_tss(spark, str(tmp_path), F.lit("1990-01-01").cast("date"), fill=None)
    assert kept.filter("value is null").count() == 1


def test_write_old_text_series(spark, tmp_path):
    s = spark.createDataFrame(
        [("r1", 1, "G1", 1.5), ("r1", 2, "G1", 123456.789), ("r1", 10, "G1", 0.001234567), ("r1", 1, "G2", None), ("r1", 2, "G2", -2.0)],
        "file string, step int, name string, value double",
    )
    out = str(tmp_path / "out")
    writers.write_tss(s, out, ["G1", "G2"], title="timeseries run")
    (part,) = Path(out, "file=r1").glob("*.txt")
    lines = part.read_text().splitlines()
    assert lines[:5] == ["timeseries run", "3", "timestep", "G1", "G2"]
    assert [line.split() for line in lines[5:]] == [
        ["1", "1.5", "1e31"], ["2", "123457", "-2"], ["10", "0.00123457", "1e31"],
    ]
    assert lines[5] == " %8g %14g           1e31" % (1, 1.5)


def test_series_csv_round_trip(spark, tmp_path):
    s = spark.createDataFrame(
        [("r1", "G1", dt.date(2001, 1, 31), 1.25), ("r1", "G2", dt.date(2001, 1, 31), None), ("r1", "G1", dt.date(2001, 2, 28), 4.0), ("r1", "G2", dt.date(2001, 2, 28), 5.0)],
        "file string, name string, date date, value double",
    )
    out = str(tmp_path / "csv")
    writers.write_series_csv(s, out, [("G1", 16.5, 48.0), ("G2", 17.0, 48.5)], kind="monthtot")
    (part,) = Path(out, "file=r1").glob("*.txt")
    assert part.read_text().splitlines()[1:] == ["xloc,16.5000,17.0000", "yloc,48.0000,48.5000", "Date,G1,G2", "01/01/2001,1.25,1e31", "01/02/2001,4,5"]
    got = rows(readers.read_series_csv(spark, out).select("name", "x", "date", "value"))
    assert got[0] == ("G1", 16.5, dt.date(2001, 1, 1), 1.25) and got[2] == ("G2", 17.0, dt.date(2001, 1, 1), None)


def test_observation_folder(spark, tmp_path):
    (tmp_path / "S1.csv").write_text("Date,Observation\n2000-01-01,1.5\n2000-01-02,\n")
    (tmp_path / "S 2.csv").write_text("any,thing\n1999-01-01,9\n2000-01-03,2.5\n")
    stations = spark.createDataFrame([("S1",), ("S 2",), ("S3",)], "station_id string")
    obs, missing = readers.read_observation_folder(spark, str(tmp_path), stations)
    assert rows(missing) == [("S3",)] and obs.count() == 5
    skipped, _ = readers.read_observation_folder(spark, str(tmp_path), stations, skip_two=True)
    assert rows(skipped.filter("station_id = 'S 2'")) == [("S 2", dt.date(2000, 1, 3), 2.5)]


def test_scan_prunes_partitions_and_pushes_filters(spark, tmp_path):
    s = spark.range(2000).select(
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("variable"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 800).cast("int")).alias("date"),
        (F.col("id") % 50).alias("cell_id"), (F.col("id") % 10).cast("int").alias("row"), (F.col("id") % 5).cast("int").alias("col"), F.col("id").cast("double").alias("value"),
    )
    path = str(tmp_path / "stack")
    writers.write_cell_series(s, path)
    scan = readers.scan_cell_series(spark, path, ["a"], "2001-02-01", "2001-03-31", (2, 8, 0, 5))
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")  # else the plan's text ends before the last filter
    plan = scan._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PartitionFilters" in plan and "variable" in plan.split("PartitionFilters")[1].split("]")[0]
    pushed = plan.split("PushedFilters")[1]
    assert "IsNotNull(row)" in pushed and "GreaterThanOrEqual(date,2001-02-01)" in pushed
    want = s.filter("variable = 'a' and date between date'2001-02-01' and date'2001-03-31' and row between 2 and 7").count()
    assert scan.count() == want > 0
    files = readers.catalog_files(spark, path, "2001-01-01", "2001-12-31")
    assert {r["variable"] for r in files.collect()} == {"a", "b"}


def test_clip_catalog_skips_what_is_there(spark, tmp_path):
    s = spark.createDataFrame([("a", dt.date(2000, 1, 1), 1, 1.0), ("RCP_CO2", dt.date(2000, 1, 1), 1, 1.0)], "variable string, date date, cell_id long, value double")
    path = str(tmp_path / "clip")
    writers.write_clip_catalog(s, path)
    writers.write_clip_catalog(s.unionByName(s.withColumn("variable", F.lit("b"))), path)
    assert rows(spark.read.parquet(path).groupBy("variable").count()) == [("a", 1), ("b", 2)]


def test_coordinate_lists(spark):
    df = spark.createDataFrame([("g", "16.5 48.0 17.25 48.5")], "k string, coords string")
    assert rows(text.coord_pairs(df, "coords")) == [("g", 0, 16.5, 48.0), ("g", 1, 17.25, 48.5)]
    ids = spark.createDataFrame([("x", "G1 G2"), ("y", "")], "k string, ids string")
    assert rows(text.split_ids(ids, "ids", "id")) == [("x", "G1"), ("x", "G2")]


def test_cut_lineage_leaves_no_shuffle_behind(spark):
    def shuffled() -> set[str]:
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        names = (files.apply(i).getName() for i in range(files.size()))
        return {name for name in names if name.startswith("shuffle_")}

    before = shuffled()
    table = cut_lineage(spark.range(10_000).groupBy((F.col("id") % 5000).alias("k")).count(), "t")
    assert not shuffled() - before
    assert table.count() == 5000 and spark.conf.get(SHUFFLE_CLEANUP) == "false"


def test_cut_lineage_uses_the_configured_folder(spark, tmp_path):
    assert scratch_root(spark)
    table = cut_lineage(spark.range(5), "t")
    assert table.count() == 5 and "Range" not in table._jdf.queryExecution().executedPlan().toString()


def _reading(ts, gauge=1, variable="q", value=1.0):
    return (0, dt.datetime.fromisoformat(ts), gauge, variable, value, "")


def test_late_readings_within_the_bound_count(spark, tmp_path):
    from hydroloom import schemas

    source, state, out = (str(tmp_path / n) for n in ("in", "state", "out"))

    def feed(data):
        spark.createDataFrame(data, schemas.READING).coalesce(1).write.mode("append").parquet(source)
        raw = readings.read_stream(spark, source, schemas.READING)
        stream = readings.stream_daily(raw.select(F.col("user_id").alias("gauge_id"), "ts", F.col("event_type").alias("variable"), "value"))
        return readings.run_to_table(stream, out, state)

    spark.range(0).write.mode("overwrite").parquet(source)
    feed([_reading("2024-01-01T05:00:00"), _reading("2024-01-02T05:00:00")])
    # A reading of the first day comes one day late; the run continues from its checkpoint.
    feed([_reading("2024-01-01T23:00:00", value=2.0), _reading("2024-01-03T05:00:00")])
    # The first day closes; a reading for it is too late now.
    feed([_reading("2024-01-05T05:00:00")])
    table = feed([_reading("2024-01-01T08:00:00", value=100.0), _reading("2024-01-09T05:00:00")])
    got = {r["date"]: (r["n"], r["total"]) for r in table.collect()}
    assert got[dt.date(2024, 1, 1)] == (2, 3.0)
    assert got[dt.date(2024, 1, 2)] == (1, 1.0) and dt.date(2024, 1, 9) not in got


def test_a_stack_that_begins_late_or_is_cut_with_a_buffer(spark, tmp_path):
    path = f"file://{tmp_path}/late"
    data = [("a", dt.date(2001, 1, 1) + dt.timedelta(days=d), r * 10 + c, r, c, float(d)) for d in range(730) for r in range(4) for c in range(4)]
    s = spark.createDataFrame(data, "variable string, date date, cell_id long, row int, col int, value double")
    writers.write_cell_series(s, path)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        writers.write_cell_series(s, path)
    box = (1, 2, 1, 2)
    assert readers.scan_cell_series(spark, path, box=box).select("cell_id").distinct().count() == 1
    assert readers.scan_cell_series(spark, path, box=box, buffer=1).select("cell_id").distinct().count() == 9
    with pytest.raises(ValueError, match="begin on 2001-01-01"):
        readers.scan_cell_series(spark, path, start="2000-12-01", late_start="raise")
    back = readers.scan_cell_series(spark, path, start="2000-12-01", end="2001-01-31", box=box, late_start="extend")
    got = {r["date"]: r["value"] for r in back.collect()}
    assert len(got) == 62 and got[dt.date(2001, 1, 5)] == 4.0
    # 2000 is a leap year: its first of December is day 336, the second of December in 2001.
    assert got[dt.date(2000, 12, 1)] == 335.0


def test_files_of_lines_are_named_like_partitions(spark, tmp_path, monkeypatch):
    keys = ["a b", "x/y=1", "100%", "ä[1]^{", "", None, "q\"'\\:*?#"]
    data = [(k, p, f"{k}-{p}") for k in keys for p in range(30)] + [("a b", 99, None)]
    s = spark.createDataFrame(data, "key string, position long, line string")
    s.select("key", "line").write.partitionBy("key").text(str(tmp_path / "spark"))
    # The tasks write the files: Spark's writer is not asked.
    monkeypatch.setattr(DataFrameWriter, "text", None)
    writers.write_lines(s.orderBy(F.rand(1)), str(tmp_path / "own"), "key")

    def folders(name):
        return {p.name for p in Path(tmp_path, name).iterdir() if p.is_dir()}

    assert folders("own") == folders("spark") and len(folders("own")) == 6
    assert Path(tmp_path, "own", "_SUCCESS").exists() and not list(Path(tmp_path, "own").glob("*/_*"))
    (part,) = Path(tmp_path, "own", "key=a b").iterdir()
    assert part.read_text() == "".join(f"a b-{p}\n" for p in range(30)) + "\n"
    back = spark.read.text(str(tmp_path / "own"))
    assert rows(back.filter("value <> ''").groupBy("key").count(), "count", "key") == rows(
        spark.read.text(str(tmp_path / "spark")).filter("value <> ''").groupBy("key").count(), "count", "key"
    )
    with pytest.raises(FileExistsError):
        writers.write_lines(s, str(tmp_path / "own"), "key")
    assert {p.name for p in tmp_path.iterdir()} == {"own", "spark"}


def test_old_text_series_is_read_once(spark, tmp_path):
    for name in "abc":
        (tmp_path / f"{name}.tss").write_text(TSS)
    out = readers.read_tss(spark, str(tmp_path), F.lit("1990-01-01").cast("date"))
    assert "FileScan text" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 12 and out.select("file").distinct().count() == 3
