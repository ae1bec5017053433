"""Column-level functions: rounding, calendar, text, quantiles, error propagation."""

from sondera.functions.calendar import (
    clock_hour,
    days_between,
    expected_slots,
    in_window,
    minutes_between,
    month_start,
    window_end,
)
from sondera.functions.errors import propagate, with_error
from sondera.functions.numeric import (
    crossing_time,
    half_even,
    interval_bin,
    mixed,
    no_nan,
    percent,
    signif,
)
from sondera.functions.quantiles import t_quantile
from sondera.functions.text import (
    object_name,
    station_from_file,
    window_label,
    yyyymmdd,
)

__all__ = [
    "clock_hour",
    "crossing_time",
    "days_between",
    "expected_slots",
    "half_even",
    "in_window",
    "interval_bin",
    "minutes_between",
    "mixed",
    "month_start",
    "no_nan",
    "object_name",
    "percent",
    "propagate",
    "signif",
    "station_from_file",
    "t_quantile",
    "window_end",
    "window_label",
    "with_error",
    "yyyymmdd",
]
