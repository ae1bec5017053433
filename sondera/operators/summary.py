"""Grouped means with their spread."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondera.functions.exact import digit_avg, digit_sum, with_digits
from sondera.functions.quantiles import t_quantile


def summarize_se(
    df: DataFrame, by: Sequence[str], column: str, mean: str = "mean", n: str = "n"
) -> DataFrame:
    """n, mean, sd and standard error; n counts rows with a NULL value too."""
    return (
        df.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias(n),
            F.avg(column).alias(mean),
            F.stddev_samp(column).alias("sd"),
        )
        .withColumn("se", F.col("sd") / F.sqrt(n))
    )


def summarize_ci(
    df: DataFrame, by: Sequence[str], column: str, level: float = 0.95, mean: str = "mean"
) -> DataFrame:
    """The same with the half width of the Student-t interval."""
    width = F.col("se") * t_quantile(level / 2 + 0.5, F.col("n") - 1)
    return summarize_se(df, by, column, mean).withColumn("ci", width)


def quadrature(error: Column) -> Column:
    """Aggregate: error of a sum of independent terms."""
    return F.sqrt(F.sum(error * error))


def sum_with_error(
    df: DataFrame, by: Sequence[str], columns: Sequence[str], exact: bool = False
) -> DataFrame:
    """Totals of each ``x`` with the error of ``dx`` added in quadrature.

    ``exact`` makes every bit independent of the order of the rows, see ``exact_sum``.
    """
    if exact:
        squares = {f"d{c}": F.col(f"d{c}") * F.col(f"d{c}") for c in columns}
        df = with_digits(df, {c: F.col(c) for c in columns} | squares)
    measures = []
    for c in columns:
        if exact:
            measures += [digit_sum(c).alias(c), F.sqrt(digit_sum(f"d{c}")).alias(f"d{c}")]
        else:
            measures += [F.sum(c).alias(c), quadrature(F.col(f"d{c}")).alias(f"d{c}")]
    return df.groupBy(*by).agg(*measures)


def mean_with_error(
    df: DataFrame, by: Sequence[str], columns: Sequence[str], keep: Column, exact: bool = False
) -> DataFrame:
    """Means over the rows that pass ``keep``; groups with none stay, n = 0.

    The error is the quadrature sum over n, where n also counts passing rows
    whose value is NULL.  ``exact`` makes every bit independent of the order of the rows.
    """
    if exact:
        values = {c: F.when(keep, F.col(c)) for c in columns}
        values |= {f"d{c}": F.when(keep, F.col(f"d{c}") * F.col(f"d{c}")) for c in columns}
        df = with_digits(df.withColumn("_keep", keep), values)
        keep = F.col("_keep")
    n = F.count_if(keep)
    measures = [n.alias("n")]
    for c in columns:
        if exact:
            mean, error = digit_avg(c), F.sqrt(digit_sum(f"d{c}"))
        else:
            mean, error = F.avg(F.when(keep, F.col(c))), quadrature(F.when(keep, F.col(f"d{c}")))
        measures += [mean.alias(c), F.try_divide(F.coalesce(error, F.lit(0.0)), n).alias(f"d{c}")]
    return df.groupBy(*by).agg(*measures)
