"""Date and time expressions with the boundary-counting semantics of SQL's date_diff."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def boundary_days(start: Column | str, end: Column | str) -> Column:
    return F.datediff(F.to_date(_column(end)), F.to_date(_column(start))).cast("long")


def boundary_seconds(start: Column | str, end: Column | str) -> Column:
    """Second boundaries between two timestamps; fractions of seconds are cut, not rounded."""
    return F.unix_timestamp(_column(end).cast("timestamp")) - F.unix_timestamp(_column(start).cast("timestamp"))


def boundary_minutes(start: Column | str, end: Column | str) -> Column:
    minute = lambda x: F.floor(F.unix_timestamp(_column(x).cast("timestamp")) / 60)
    return minute(end) - minute(start)


def iso_weekday(ts: Column | str) -> Column:
    """1 for Monday to 7 for Sunday."""
    return F.weekday(_column(ts)) + 1


def month_label(ts: Column | str) -> Column:
    return F.date_format(_column(ts), "yyyy-MM")


def chat_timestamp(header: Column) -> Column:
    """The header of an exported record ('dd/mm/yy, h:mm:ss a.m.', a narrow space before the half-day) as local time; null if it is none.

    Two-digit years are 20yy.
    """
    plain = F.replace(F.replace(F.replace(header, F.lit("\u202f"), F.lit(" ")), F.lit("a.m."), F.lit("AM")), F.lit("p.m."), F.lit("PM"))
    return F.try_to_timestamp(plain, F.lit("d/M/yy, h:mm:ss a")).cast("timestamp_ntz")
