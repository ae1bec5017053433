"""Numeric column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column, digits: int = 0) -> Column:
    """Round ties to the even neighbour: 26.5 gives 26, 27.5 gives 28."""
    return F.bround(x, digits)


def no_nan(x: Column) -> Column:
    """NaN becomes NULL; tables inside the library hold no NaN."""
    return F.when(~F.isnan(x), x)


def signif(x: Column, digits: int) -> Column:
    """Round to ``digits`` significant digits; zero stays zero."""
    place = F.lit(digits - 1) - F.floor(F.log10(F.abs(x)))
    # Multiply or divide by a whole power of ten: 10^-2 itself is not exact.
    power = F.pow(F.lit(10.0), F.abs(place))
    rounded = F.when(place >= 0, F.bround(x * power, 0) / power).otherwise(
        F.bround(x / power, 0) * power
    )
    return F.when(x == 0, F.lit(0.0)).otherwise(rounded)


def interval_bin(y: Column, step: float) -> Column:
    """Smallest whole ``k`` with ``y <= k * step``.

    The quotient may be one off next to a grid point, so the comparison itself
    decides; a bin and ``y <= k * step`` never disagree.
    """
    k = F.ceil(y / F.lit(step))
    return (
        F.when(y > k * F.lit(step), k + 1).when(y <= (k - 1) * F.lit(step), k - 1).otherwise(k)
    )


def crossing_time(
    level: Column, x0: Column, y0: Column, x1: Column, y1: Column
) -> Column:
    """Where the line through (x0, y0) and (x1, y1) reaches ``level``.

    NULL when a point is missing or both have the same ``x`` or ``y``.
    """
    span = F.when(x1 != x0, x1 - x0)
    return x0 + F.try_divide((level - y0) * span, y1 - y0)


def percent(x: Column) -> Column:
    return x * F.lit(100.0)


def mixed(shallow: Column, deep: Column, shallow_share: float = 1 / 3) -> Column:
    """Depth-weighted mean of a shallow and a deep value."""
    return shallow * F.lit(shallow_share) + deep * F.lit(1 - shallow_share)
