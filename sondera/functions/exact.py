"""Sums of doubles that do not depend on the order or the partitioning of the rows.

A double is a whole number of small powers of two.  It is cut into digits of
``WIDTH`` bits at fixed places, the digits of each place are added up as longs, which is exact in any
order, and the sums are put together at the end, always in the same way.  Everything is a
built-in aggregate, so partial sums are made before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a digit; a group may have 2^(63 - WIDTH) rows, 34 thousand millions.
WIDTH = 28
#: Places of the digits: values are multiples of 2^-224 (4e-68) and below 2^196 (1e59).
LOWEST, HIGHEST = -8, 6


def _digits(x: Column) -> Column:
    """Signed digits of a double from the highest place down; NULL for NULL, infinities and NaN.

    Each step takes off the part of the rest at its place, and is exact.
    """
    places = F.array(*[F.lit(2.0 ** (-WIDTH * k)) for k in range(HIGHEST, LOWEST - 1, -1)])
    digit = lambda a, scale: F.floor(a["rest"] * scale)
    start = F.struct(F.abs(x).alias("rest"), F.array().cast("array<bigint>").alias("digits"))
    step = lambda a, scale: F.struct(
        (a["rest"] - digit(a, scale) / scale).alias("rest"),
        F.concat(a["digits"], F.array(digit(a, scale))).alias("digits"),
    )
    lost = F.raise_error(F.concat(F.lit("out of range for an exact sum: "), x.cast("string")))
    signed = lambda a: F.transform(a["digits"], lambda d: F.when(x < 0, -d).otherwise(d))
    # in range if nothing is left over, also above the highest place
    whole = lambda a: F.when(a["rest"] == 0, signed(a)).otherwise(lost.cast("array<bigint>"))
    return F.when(F.abs(x) < F.lit(_LIMIT), F.aggregate(places, start, step, whole)).when(
        F.abs(x) < float("inf"), lost.cast("array<bigint>")
    )


_LIMIT = 2.0 ** (WIDTH * (HIGHEST + 1))


def _special(x: Column) -> Column:
    return F.isnan(x) | (F.abs(x) == float("inf"))


def _total(digits: Column, special: Column, n: Column) -> Column:
    """Sums of digits put together, unless there were special values or none at all."""
    sums = [F.sum(F.get(digits, F.lit(HIGHEST - k))) for k in range(LOWEST, HIGHEST + 1)]
    # carry upwards, so that all digits but the last are nonnegative and below 2^WIDTH
    step = lambda a, s: F.struct(
        F.shiftright(s + a["carry"], WIDTH).alias("carry"),
        F.concat(F.array((s + a["carry"]).bitwiseAND((1 << WIDTH) - 1)), a["down"]).alias("down"),
    )
    start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.array().cast("array<bigint>").alias("down"))
    whole = F.aggregate(F.array(*sums), start, step, lambda a: F.concat(F.array(a["carry"]), a["down"]))
    total = F.aggregate(whole, F.lit(0.0), lambda t, d: t * F.lit(2.0**WIDTH) + d.cast("double"))
    return F.when(F.count(special) > 0, F.sum(special)).when(F.count(n) > 0, total * F.lit(2.0 ** (WIDTH * LOWEST)))


def exact_sum(x: Column) -> Column:
    """Aggregate: the sum of ``x`` as a double, the same for every order of the rows.

    It is within one unit in the last place of the true sum.  NULLs are left out and a sum
    over nothing is NULL, as with ``sum``; infinities and NaN give what they give
    there.  A finite value out of range stops the query instead of being rounded.
    For several sums in one aggregation, ``with_digits`` keeps the plan small.
    """
    x = x.cast("double")
    return _total(_digits(x), F.when(_special(x), x), x)


def with_digits(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``df`` with the digits of each value, computed once a row, for ``digit_sum`` of the same name."""
    columns = {}
    for name, x in values.items():
        x = x.cast("double")
        columns |= {f"_value_{name}": x}
    df = df.withColumns(columns)
    more = {}
    for name in values:
        x = F.col(f"_value_{name}")
        more |= {f"_digits_{name}": _digits(x), f"_special_{name}": F.when(_special(x), x)}
    return df.withColumns(more)


def digit_sum(name: str) -> Column:
    """Aggregate: ``exact_sum`` of a value of ``with_digits``."""
    return _total(F.col(f"_digits_{name}"), F.col(f"_special_{name}"), F.col(f"_value_{name}"))


def digit_avg(name: str) -> Column:
    return F.try_divide(digit_sum(name), F.count(f"_value_{name}"))


def exact_avg(x: Column) -> Column:
    """Aggregate: the mean of ``x`` from its exact sum."""
    return F.try_divide(exact_sum(x), F.count(x))
