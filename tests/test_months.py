"""Month totals and quota alarms over commits of closed days."""

import datetime as dt
from collections import defaultdict

import pytest

from helpers import rows
from hydroloom.streaming import months

DAILY = "gauge_id long, variable string, date date, n long, total double, mean double"


def _span(first, last):
    return [first + dt.timedelta(days=i) for i in range((last - first).days + 1)]


def _stream(spark, source, kind, quota, files=1000):
    days = months.closed_days(spark, source, files)
    return months.stream_month_total(days) if kind == "total" else months.stream_quota_alarm(days, quota)


@pytest.mark.parametrize("kind", ["total", "alarm"])
def test_months_close_once(spark, tmp_path, kind):
    source, state, out = (str(tmp_path / n) for n in ("days", "state", "out"))

    def feed(batch_id, first, last):
        days = spark.createDataFrame([(1, "q", d, 1, 2.0, 2.0) for d in _span(first, last)], DAILY)
        assert months.commit_batch(days, source, batch_id)
        return months.run(_stream(spark, source, kind, 41.0), out, state)

    feed(0, dt.date(2024, 1, 10), dt.date(2024, 1, 25))
    table = feed(1, dt.date(2024, 1, 26), dt.date(2024, 3, 2))
    if kind == "total":
        assert rows(table.select("month", "total")) == [(dt.date(2024, 1, 1), 44.0), (dt.date(2024, 2, 1), 58.0)]
    else:
        # 21 days of 2.0 pass 41: the 30th in January, the 21st in February.
        assert rows(table.select("date")) == [(dt.date(2024, 1, 30),), (dt.date(2024, 2, 21),)]


@pytest.mark.parametrize("kind", ["total", "alarm"])
def test_a_backlog_in_small_batches_gives_the_same(spark, tmp_path, kind):
    """Commits of many files and of one to three weeks, read five files at a time: files of a day come in different batches."""
    source, state, out = (str(tmp_path / n) for n in ("days", "state", "out"))
    data, day = [], dt.date(2024, 1, 1)
    for commit, weeks in enumerate([1, 3, 2, 1, 3]):
        span = _span(day, day + dt.timedelta(days=7 * weeks - 1))
        part = [(g, v, d, 1, float((d.day * 7 + (g or 0)) % 5) if g != 0 else None) for d in span for g in (0, 1, 2, None) for v in ("p", "q")]
        data += part
        frame = spark.createDataFrame([r + (0.0,) for r in part], DAILY).repartition(6, "gauge_id", "variable", "date")
        assert months.commit_batch(frame, source, commit)
        day = span[-1] + dt.timedelta(days=1)
    stream = _stream(spark, source, kind, 100.0, files=5)
    got = rows(months.run(stream, out, state))
    last = day - dt.timedelta(days=1)
    sums = defaultdict(list)
    for g, v, d, n, total in data:
        key = (g, v, d.replace(day=1)) if kind == "total" else (g, d.replace(day=1))
        sums[key].append((d, n, total or 0.0))
    want = []
    for key, own in sums.items():
        if kind == "total":
            if key[2] < last.replace(day=1):
                total = sum(x[2] for x in own) if key[0] != 0 else None
                want.append((*key, sum(x[1] for x in own), None if key[0] == 0 else total))
            continue
        so_far = 0.0
        for d in sorted({x[0] for x in own}):
            so_far += sum(x[2] for x in own if x[0] == d)
            if so_far > 100.0:
                want.append((*key, d, so_far))
                break
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=order) == sorted(want, key=order)
    batches = len(list((tmp_path / "state" / "commits").glob("[0-9]*")))
    assert batches >= 5


def test_a_commit_is_added_once(spark, tmp_path):
    source = str(tmp_path / "days")
    days = spark.createDataFrame([(1, "q", dt.date(2024, 1, 1), 1, 2.0, 2.0)], DAILY)
    assert months.commit_batch(days, source, 7)
    # The batch runs again after a failure, and a failed attempt left files behind.
    assert not months.commit_batch(days, source, 7)
    days.write.parquet(f"{source}/_staged/commit-8/days")
    assert months.commit_batch(days.selectExpr("gauge_id", "variable", "date_add(date, 1) as date", "n", "total", "mean"), source, 8)
    assert not months.commit_batch(days.limit(0), source, 9)
    seen = spark.read.schema(months.DAY_SCHEMA).option("recursiveFileLookup", "true").parquet(source)
    assert rows(seen.filter("gauge_id is not null").select("gauge_id", "date")) == [(1, dt.date(2024, 1, 1)), (1, dt.date(2024, 1, 2))]


def test_a_commit_has_a_part_for_each_month(spark, tmp_path):
    """Files are read in the order of their times: months of a commit must follow each other, each with its mark."""
    source = str(tmp_path / "days")
    days = spark.createDataFrame([(1, "q", d, 1, 2.0, 2.0) for d in _span(dt.date(2023, 12, 30), dt.date(2024, 2, 2))], DAILY).repartition(5)
    assert months.commit_batch(days, source, 0)
    files = sorted((f.stat().st_mtime_ns, f.parent.name) for f in (tmp_path / "days").rglob("*.parquet"))
    order = list(dict.fromkeys(name for _, name in files))
    assert order == ["days-2023-12-30", "mark-2023-12-31", "days-2024-01-01", "mark-2024-01-31", "days-2024-02-01", "mark-2024-02-02"]
    assert spark.read.schema(months.DAY_SCHEMA).option("recursiveFileLookup", "true").parquet(source).filter("n is not null").count() == 35


def test_month_totals_need_no_python(spark, tmp_path):
    source = str(tmp_path / "days")
    assert months.commit_batch(spark.createDataFrame([(1, "q", dt.date(2024, 1, 1), 1, 2.0, 2.0)], DAILY), source, 0)
    plan = months.stream_month_total(months.closed_days(spark, source))._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" not in plan and "Aggregate" in plan


def test_quota_alarms_need_no_python_and_can_run_again(spark, tmp_path):
    """The state is merged by Spark; a batch that runs again replaces its rows, and a day waits for its mark."""
    path, versions = str(tmp_path / "out"), str(tmp_path / "versions")
    for folder in (path, versions):
        (tmp_path / folder).mkdir()
    schema = "gauge_id long, date date, total double, mark boolean"
    day = lambda d: dt.date(2024, 1, d)
    batches = [
        [(1, day(1), 3.0, False), (None, day(1), None, False), (None, day(2), None, True)],
        [(1, day(3), 1.0, False), (1, day(4), 5.0, False), (None, day(3), 9.0, False)],
        [(1, day(3), 2.0, False), (None, day(4), None, True)],
        [(1, dt.date(2024, 2, 1), 6.0, False), (1, day(5), 1.0, False), (None, dt.date(2024, 2, 1), None, True)],
    ]
    for batch_id, batch in enumerate(batches):
        frame = spark.createDataFrame(batch, schema)
        alarms = months.stream_quota_alarm(frame, 5.0)
        assert not isinstance(alarms, type(frame))  # no stateful operator of Python rows
        for _ in range(2):
            alarms._merge(frame, batch_id, path, versions)
        got = spark.read.schema(months.ALARM_SCHEMA).option("recursiveFileLookup", "true").parquet(path)
        want = [(None, day(1), day(3), 9.0), (1, day(1), day(3), 6.0)] if batch_id >= 2 else []
        want += [(1, dt.date(2024, 2, 1), dt.date(2024, 2, 1), 6.0)] if batch_id == 3 else []
        assert sorted(rows(got), key=str) == sorted(want, key=str)
    kept = spark.read.schema(months.QUOTA_SCHEMA).parquet(f"{versions}/version-3")
    assert rows(kept.filter("not mark and found is null").select("month")) == []
