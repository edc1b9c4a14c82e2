"""Dates and instants kept as ISO text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
INSTANT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.,][0-9]{1,6})?)?(Z|[+-][0-9]{2}:?[0-9]{2}(:[0-9]{2})?)$"


def valid_date(c: Column) -> Column:
    return F.coalesce(c.rlike(DATE) & F.try_to_date(c, "yyyy-MM-dd").isNotNull(), F.lit(False))


def instant(c: Column) -> Column:
    """The instant of a text with an offset; null without one."""
    return F.when(c.rlike(INSTANT), F.try_to_timestamp(c))


def valid_instant(c: Column) -> Column:
    return F.coalesce(instant(c).isNotNull(), F.lit(False))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6


def lookback_ok(start: Column, checked: Column) -> Column:
    """At least seven days."""
    return seconds_between(start, checked) >= 7 * 86_400


def reusable(age_seconds: Column, ttl: int) -> Column:
    return (age_seconds >= 0) & (age_seconds <= ttl)


def default_window(cutoff: Column) -> Column:
    """A day back, thirty days ahead, and for platforms the earlier of the start and seven days back."""
    start = cutoff - F.expr("INTERVAL 24 HOURS")
    return F.struct(start.alias("start"), (cutoff + F.expr("INTERVAL 30 DAYS")).alias("end"), F.least(start, cutoff - F.expr("INTERVAL 7 DAYS")).alias("platform_start"))
