"""Time helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIODS = ("hour", "day")


def unix_time(seconds: Column) -> Column:
    """Unix seconds as TIMESTAMP; NULL stays NULL."""
    return F.timestamp_seconds(seconds)


def period_start(period: str | None, time: Column) -> Column:
    """Start of the hour or day in UTC sessions; anything but ``day`` means ``hour``."""
    return F.date_trunc("day" if period == "day" else "hour", time)


def rfc3339(time: Column) -> Column:
    """``2024-01-30T00:00:00+00:00``."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ssxxx")


def time_bound(text: str) -> Column:
    """A time given as text. Bad text is an error, not an empty result."""
    return F.to_timestamp(F.lit(text))


def narrow_long(value: Column) -> Column:
    """Unsigned 64-bit value as BIGINT, NULL when it does not fit."""
    return value.try_cast("bigint")
