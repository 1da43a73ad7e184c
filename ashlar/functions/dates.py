"""Date parts in UTC, as doubles; datetimes may be timestamps, dates or epoch milliseconds (numbers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _t(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def from_millis(x) -> Column:
    return F.timestamp_millis(_t(x).cast("long"))


def year(x) -> Column:
    return F.year(_t(x)).cast("double")


def month(x) -> Column:
    return F.month(_t(x)).cast("double")


def day(x) -> Column:
    return F.dayofmonth(_t(x)).cast("double")


def hour(x) -> Column:
    return F.hour(_t(x)).cast("double")


def minute(x) -> Column:
    return F.minute(_t(x)).cast("double")


def second(x) -> Column:
    return F.second(_t(x)).cast("double")


def weekday(x) -> Column:
    """0 is Sunday."""
    return (F.dayofweek(_t(x)) - 1).cast("double")


def epoch_millis(x) -> Column:
    return F.unix_millis(_t(x).cast("timestamp")).cast("double")
