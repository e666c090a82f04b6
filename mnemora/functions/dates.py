"""Dates. Timestamps of the graph are ISO strings, compared as strings; elapsed time needs their instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000


def instant(c: Column) -> Column:
    """The instant of an ISO string, date or timestamp; null where it is none."""
    return F.try_to_timestamp(F.regexp_replace(c.cast("string"), "Z\\z", "")).cast("timestamp_ntz")


def _micros(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", b.cast("timestamp_ntz"), a.cast("timestamp_ntz"))


def days_between(a: Column, b: Column) -> Column:
    """Whole days of elapsed time, either way; not calendar days."""
    return F.floor(F.abs(_micros(a, b)) / F.lit(DAY)).cast("long")


def days_floored(a: Column, b: Column) -> Column:
    """|floor(a - b)| in days: one more than days_between where a comes before b by a part of a day."""
    return F.abs(F.floor(_micros(a, b) / F.lit(DAY))).cast("long")


def duration_minutes(c: Column) -> Column:
    """Minutes of ``30d``, ``24h`` or ``15m``."""
    n = F.regexp_extract(c, r"^(\d+)([dhm])\z", 1).try_cast("long")
    unit = F.regexp_extract(c, r"^(\d+)([dhm])\z", 2)
    return n * F.when(unit == "d", 1440).when(unit == "h", 60).when(unit == "m", 1)


def file_date(name: Column) -> Column:
    found = F.regexp_extract(name, r"(?:^|/)(\d{4}-\d{2}-\d{2})[^/]*\z", 1)
    return F.when(found != "", found)


def slider_value(at: Column, first: Column, last: Column) -> Column:
    """Percent of the way from first to last, rounded; 100 where they are one."""
    span = _micros(last, first)
    return F.when(span <= 0, F.lit(100)).otherwise(F.floor(_micros(at, first) / span * 100 + 0.5)).cast("long")


def slider_date(value: Column, first: Column, last: Column) -> Column:
    """The instant at some percent of the way, in whole milliseconds."""
    return F.timestamp_add("MILLISECOND", F.floor(value / 100 * _micros(last, first) / 1000).cast("long"), first.cast("timestamp_ntz"))


def days_ago(days: Column) -> Column:
    return F.when(days == 0, "today").when(days == 1, "yesterday").otherwise(F.concat(days.cast("string"), F.lit("d ago")))
