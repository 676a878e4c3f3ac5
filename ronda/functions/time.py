"""Time labels, trailing windows and survey periods."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTH = "ano_mes"  # column that a history stored by month is partitioned by


def clock(moment: Column) -> Column:
    return F.date_format(moment, "HH:mm")


def slot_label(start: Column, end: Column) -> Column:
    return F.concat(clock(start), F.lit(" - "), clock(end))


def day_range_label(first: Column, last: Column) -> Column:
    return F.concat(F.date_format(first, "dd/MM"), F.lit(" - "), F.date_format(last, "dd/MM"))


def within_days(day: Column, as_of: dt.date, days: int) -> Column:
    """Trailing closed range that includes ``as_of`` itself."""
    return day.between(F.lit(as_of - dt.timedelta(days=days)), F.lit(as_of))


def month_key(day: Column) -> Column:
    return (F.year(day) * 100 + F.month(day)).cast("int")


def month_keys(as_of: dt.date, days: int) -> tuple[int, int]:
    """First and last month key a trailing window touches."""
    first = as_of - dt.timedelta(days=days)
    return first.year * 100 + first.month, as_of.year * 100 + as_of.month


def months_between(first: int, last: int) -> list[int]:
    """Month keys from the first to the last."""
    count = (last // 100 - first // 100) * 12 + last % 100 - first % 100
    months = [first // 100 * 12 + first % 100 - 1 + k for k in range(count + 1)]
    return [m // 12 * 100 + m % 12 + 1 for m in months]


def survey_period(day: Column) -> Column:
    """Bimonthly period of a date: its month, moved back to an even one."""
    month = F.add_months(F.trunc(day, "MM"), -(F.month(day) % 2))
    return F.date_format(month, "yyyyMM")


def open_periods(as_of: dt.date) -> tuple[str, str]:
    """The period running on ``as_of`` and the one before; as plain values
    they reach the scan."""
    months = as_of.year * 12 + as_of.month - 1
    running = months - as_of.month % 2
    return tuple(f"{m // 12:04d}{m % 12 + 1:02d}" for m in (running, running - 2))
