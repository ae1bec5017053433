"""Calendar arithmetic on wall-clock timestamps (TIMESTAMP_NTZ) and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(t: Column) -> Column:
    """First day of the month of ``t``, as DATE."""
    return F.trunc(t.cast("date"), "month")


def window_end(start: Column, months: int = 12) -> Column:
    """First day after a window of whole months; windows start on day 1."""
    return F.add_months(start, months)


def in_window(t: Column, start: Column, months: int = 12) -> Column:
    """Half-open test ``start <= t < start + months``."""
    return (t >= start) & (t < window_end(start, months))


def expected_slots(start: Column, per_day: float = 240, months: int = 12) -> Column:
    """Readings a complete window holds: its number of days times ``per_day``.

    Counting days makes leap years come out right wherever the window starts.
    """
    return F.date_diff(window_end(start, months), start) * F.lit(per_day)


def _seconds_between(earlier: Column, later: Column) -> Column:
    # plain subtraction of wall-clock times knows no zone, so no hour goes missing
    return (later - earlier).cast("interval second").cast("decimal(18, 6)").cast("double")


def minutes_between(earlier: Column, later: Column) -> Column:
    """Elapsed minutes, always in minutes whatever the cadence."""
    return _seconds_between(earlier, later) / F.lit(60.0)


def days_between(earlier: Column, later: Column) -> Column:
    """Elapsed days with their fraction."""
    return _seconds_between(earlier, later) / F.lit(86_400.0)


def clock_hour(t: Column) -> Column:
    """Number of the wall-clock hour; never decreases along ``t``."""
    return F.unix_date(t.cast("date")) * 24 + F.hour(t)


def wall_micros(t: Column) -> Column:
    """Microseconds of the wall clock since 1970, as a long; knows no zone."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    # an interval by an interval is a long; parts of the date and decimals cost many times as much
    return F.call_function("div", t.cast("timestamp_ntz") - epoch, F.expr("interval '0.000001' second"))
