"""Clock times and bar times, without time zones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_hhmm(text: Column) -> Column:
    """Minutes of the day from text such as ``09:30``; NULL when malformed.

    Characters 1-2 are the hour and 4-5 the minute. The separator is not
    looked at, and text shorter than five characters is malformed.
    """
    hour = F.substring(text, 1, 2).try_cast("int")
    minute = F.substring(text, 4, 2).try_cast("int")
    valid = (F.length(text) >= 5) & hour.between(0, 23) & minute.between(0, 59)
    return F.when(valid, hour * 60 + minute)


def at_minute(day: Column, minute: Column | int) -> Column:
    """Timestamp at a minute of a day; NULL if either is NULL."""
    minute = F.lit(minute) if isinstance(minute, int) else minute
    return day.cast("timestamp_ntz") + F.make_dt_interval(mins=minute)


def is_minute(ts: Column, minute: int) -> Column:
    """Whether a timestamp falls exactly on a minute of its own day."""
    return ts == at_minute(F.to_date(ts), minute)


# Date forms read besides ISO dates and timestamps.
DATE_FORMATS = ("yyyy/M/d", "yyyyMMdd")


def parse_date(text: Column) -> Column:
    """Date from text; NULL when it cannot be read."""
    readings = [F.try_to_timestamp(text), *[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS]]
    return F.coalesce(*readings).cast("date")
