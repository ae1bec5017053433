"""Names, keys and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def object_name(name: Column, state: Column) -> Column:
    """Station key: the name without blanks and commas, a dot, the state."""
    return F.concat_ws(".", F.translate(name, " ,", ""), state)


def station_from_file(file_name: Column) -> Column:
    """Station key of a series file: its name without the ending."""
    return F.regexp_replace(file_name, r"\.csv(\.gz)?$", "")


def window_label(start: Column) -> Column:
    """Readable name of a window: full month name and year of its start."""
    return F.date_format(start, "MMMMyyyy")


def yyyymmdd(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd")

