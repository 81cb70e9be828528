"""Date parts as the operators need them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_simple(ts: Column) -> Column:
    """Weeks of seven days from 1 January."""
    return (F.floor((F.dayofyear(ts) - 1) / 7) + 1).cast("int")


def week_iso(ts: Column) -> Column:
    return F.weekofyear(ts)


def weekday_monday(ts: Column) -> Column:
    """1 for Monday to 7 for Sunday."""
    return F.weekday(ts) + 1


def time_of_day(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")
