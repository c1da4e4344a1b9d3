"""Calendar features, schedules and calendar conversion as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings of a date, most specific first.
DATE_FORMATS = ("d/M/yyyy", "d/M/yy", "d.M.yyyy", "d.M.yy", "d-M-yyyy", "yyyy-M-d", "d-M-yy")


def month_start(date: Column) -> Column:
    return F.trunc(date, "MM")


def year_start(date: Column) -> Column:
    return F.trunc(date, "YYYY")


def year_end(date: Column) -> Column:
    return F.make_date(F.year(date), F.lit(12), F.lit(31))


def days_in_month(date: Column) -> Column:
    return F.dayofmonth(F.last_day(date))


def days_in_year(date: Column) -> Column:
    return F.dayofyear(year_end(date))


def ten_day_slot(date: Column) -> Column:
    return F.floor((F.dayofyear(date) - 1) / 10).cast("int")


def thirty_day_slot(date: Column) -> Column:
    return F.floor((F.dayofyear(date) - 1) / 30).cast("int")


def period_end_flag(date: Column) -> Column:
    """2 at a year's end, 1 at a month's end, else 0."""
    return F.when(date == year_end(date), 2).when(date == F.last_day(date), 1).otherwise(0)


def date_features(date: Column) -> dict[str, Column]:
    return {
        "doy": F.dayofyear(date),
        "slot10": ten_day_slot(date),
        "slot30": thirty_day_slot(date),
        "new_month": F.dayofmonth(date) == 1,
        "new_year": F.dayofyear(date) == 1,
        "days_in_month": days_in_month(date),
        "days_in_year": days_in_year(date),
        "period_end": period_end_flag(date),
    }


def parse_date(text: Column, start: Column | None = None) -> Column:
    """Day-first date with `/`, `.` or `-`; a bare number is a step counted from `start`.

    Each spelling is tried only where its pattern fits, so a two-digit year is never read as year 24.
    """
    shapes = {
        "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yy": r"^\d{1,2}/\d{1,2}/\d{2}$",
        "d.M.yyyy": r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yy": r"^\d{1,2}\.\d{1,2}\.\d{2}$",
        "d-M-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yy": r"^\d{1,2}-\d{1,2}-\d{2}$",
        "yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$",
    }
    text = F.trim(text)
    out = F.lit(None).cast("date")
    for fmt in DATE_FORMATS:
        out = F.when(text.rlike(shapes[fmt]), F.try_to_timestamp(text, F.lit(fmt)).cast("date")).otherwise(out)
    if start is not None:
        out = F.when(text.rlike(r"^\d+$"), step_date(start, text.try_cast("int"))).otherwise(out)
    return out


def step_index(date: Column, start: Column) -> Column:
    """1-based step number of a date."""
    return F.datediff(date, start) + 1


def step_date(start: Column, step: Column) -> Column:
    return F.date_add(start, step - 1)


def date_schedule(start: Column, end: Column, every: int, unit: str) -> Column:
    """Array of dates every n days (`d`), months (`m`) or years (`y`) from the first on.

    Month steps clamp to the last day of a month with true leap years.
    """
    name = {"d": "day", "m": "month", "y": "year"}[unit]
    return F.sequence(start, end, F.expr(f"interval {int(every)} {name}"))


def date_list(words: list[str], start: Column, end: Column) -> Column:
    """Array of the dates that words name: dates, step numbers from `start`, and as the last word a repetition such as
    `2m`, which goes on from the first date up to `end`. Each date comes once, in order."""
    repeat = re.fullmatch(r"(\d+)([dmy])", words[-1]) if len(words) > 1 else None
    named = words[:-1] if repeat else words
    dates = F.array(*[parse_date(F.lit(word), start) for word in named])
    if repeat:
        first = F.get(dates, F.lit(0))
        more = F.when(first <= end, date_schedule(first, end, int(repeat[1]), repeat[2]))
        dates = F.concat(dates, F.coalesce(more, F.array().cast("array<date>")))
    return F.array_sort(F.array_distinct(dates))


# Days before each month in a year of 365 days.
DAYS_BEFORE_MONTH = (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334)


def calendar_ymd(day_number: Column, calendar: str, base_year: int) -> tuple[Column, Column, Column]:
    """(year, month, day) of a 0-based day number since 1 January of `base_year`.

    360_day keeps 30 February as integers, so the result is not a DateType.
    """
    if calendar in ("standard", "gregorian", "proleptic_gregorian"):
        d = F.date_add(F.make_date(F.lit(base_year), F.lit(1), F.lit(1)), day_number.cast("int"))
        return F.year(d), F.month(d), F.dayofmonth(d)
    if calendar in ("noleap", "365_day"):
        year = F.floor(day_number / 365)
        doy = day_number - year * 365
        month, before = F.lit(1), F.lit(0)
        for m, b in enumerate(DAYS_BEFORE_MONTH, start=1):
            month = F.when(doy >= b, m).otherwise(month)
            before = F.when(doy >= b, b).otherwise(before)
        return (year + base_year).cast("int"), month.cast("int"), (doy - before + 1).cast("int")
    if calendar == "360_day":
        year = F.floor(day_number / 360)
        doy = day_number - year * 360
        month = F.floor(doy / 30)
        return (year + base_year).cast("int"), (month + 1).cast("int"), (doy - month * 30 + 1).cast("int")
    raise ValueError(f"unknown calendar {calendar!r}")


def calendar_number(year: Column, month: Column, day: Column, calendar: str, base_year: int) -> Column:
    """Inverse of `calendar_ymd`."""
    if calendar in ("standard", "gregorian", "proleptic_gregorian"):
        return F.datediff(F.make_date(year, month, day), F.make_date(F.lit(base_year), F.lit(1), F.lit(1)))
    if calendar in ("noleap", "365_day"):
        before = F.element_at(F.array(*[F.lit(b) for b in DAYS_BEFORE_MONTH]), month)
        return (year - base_year) * 365 + before + day - 1
    if calendar == "360_day":
        return (year - base_year) * 360 + (month - 1) * 30 + day - 1
    raise ValueError(f"unknown calendar {calendar!r}")
