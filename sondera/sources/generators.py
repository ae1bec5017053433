"""Grids and calendars that Spark derives from the rows it is given."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondera.operators.sweep import Every


def calendar(df: DataFrame, begin: Column, end: Column, keep: Sequence[str] = ()) -> DataFrame:
    """One row per day of each input row's range."""
    days = F.sequence(begin, end, F.expr("interval 1 day"))
    return df.select(*keep, F.explode(days).alias("day"))


def window_starts(
    df: DataFrame, begin: Column, end: Column, keep: Sequence[str] = (), step: Every = Every(1, "month")
) -> DataFrame:
    """One row per window start, every ``step``, of each input row's range.

    Steps count from ``begin``, so a start on the 31st comes back to the 31st.
    """
    return df.select(*keep, F.explode(F.sequence(begin, end, step.interval())).alias("start"))


def expected_per_year(days: DataFrame, per_day: float = 240) -> DataFrame:
    """Days, hours, minutes and expected readings per calendar year."""
    return (
        days.groupBy(F.year("day").alias("year"))
        .agg(F.count(F.lit(1)).alias("days"))
        .select(
            "year",
            "days",
            (F.col("days") * 24).alias("hours"),
            (F.col("days") * 24 * 60).alias("minutes"),
            (F.col("days") * F.lit(per_day)).alias("slots"),
        )
    )


def threshold_grid(df: DataFrame, last_k: Column, step: float, keep: Sequence[str] = ()) -> DataFrame:
    """Thresholds 0, step, ... as whole ``k`` with their ``portion``."""
    return df.select(*keep, F.explode(F.sequence(F.lit(0), last_k)).alias("k")).withColumn(
        "portion", F.col("k") * F.lit(step)
    )
