"""Student-t quantiles as a column expression."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

TABLE_SIZE = 200


def _central_mass(theta: float, df: int) -> float:
    """P(|T| < t) for whole ``df`` with theta = atan(t / sqrt(df)) (finite series)."""
    cos, sin = math.cos(theta), math.sin(theta)
    odd = df % 2 == 1
    term = cos if odd else 1.0
    total = 0.0
    for k in range((df - 1) // 2 if odd else df // 2):
        total += term
        step = (2 * k + 2) / (2 * k + 3) if odd else (2 * k + 1) / (2 * k + 2)
        term *= step * cos * cos
    if odd:
        return 2 / math.pi * (theta + sin * total)
    return sin * total


@lru_cache(maxsize=None)
def t_table(p: float, size: int = TABLE_SIZE) -> tuple[float, ...]:
    """Upper quantiles for 1..size degrees of freedom (``p`` at least one half)."""
    if not 0.5 <= p < 1:
        raise ValueError("p must be in [0.5, 1)")
    quantiles = []
    for df in range(1, size + 1):
        low, high = 0.0, math.pi / 2
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if _central_mass(mid, df) < 2 * p - 1 else (low, mid)
        quantiles.append(math.sqrt(df) * math.tan((low + high) / 2))
    return tuple(quantiles)


def expansion_terms(p: float) -> tuple[float, ...]:
    """Coefficients c0..c4 of the quantile as a series in 1/df, for large df."""
    z = NormalDist().inv_cdf(p)
    return (
        z,
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )


def t_quantile(p: float, df: Column) -> Column:
    """Student-t quantile: a 200-entry constant array, the series beyond it.

    NULL for fewer than one degree of freedom.
    """
    table = F.lit(list(t_table(p)))
    inverse = F.lit(1.0) / F.greatest(df, F.lit(1))
    c0, *rest = expansion_terms(p)
    series = F.lit(c0)
    for power, c in enumerate(rest, start=1):
        series = series + F.lit(c) * F.pow(inverse, F.lit(power))
    return F.when(
        df.between(1, TABLE_SIZE), F.try_element_at(table, df.cast("int"))
    ).when(df > TABLE_SIZE, series)
