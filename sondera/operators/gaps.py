"""Time between successive readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondera.functions.calendar import clock_hour, minutes_between
from sondera.operators.ordered import neighbour_pairs


def gap_histogram(
    readings: DataFrame,
    key: str = "station",
    t: str = "t",
    digits: int | None = None,
    bucket: Column | None = None,
    rows: int | None = None,
) -> DataFrame:
    """How often each gap, in minutes, occurs per key.

    ``bucket`` splits the times of a key, by default into hours of the clock, and ``rows``
    cuts what is denser than that.
    Equal timestamps are counted before they travel: d copies are d - 1 gaps of
    zero, and the distinct times alone are put in order.
    """
    times = readings.groupBy(key, t).agg(F.count(F.lit(1)).alias("copies"))
    bucket = clock_hour(F.col(t)) if bucket is None else bucket
    pairs = neighbour_pairs(times, [key], [t], ["copies"], bucket, rows)
    gap = minutes_between(F.col(t), F.col(f"next_{t}"))
    gap = gap if digits is None else F.bround(gap, digits)
    step = F.struct(gap.alias("gap"), F.lit(1).cast("bigint").alias("n"))
    repeats = F.struct(F.lit(0.0).alias("gap"), (F.col("copies") - 1).alias("n"))
    return (
        pairs.select(key, F.inline(F.array(step, repeats)))
        .filter("gap IS NOT NULL AND n > 0")
        .groupBy(key, "gap")
        .agg(F.sum("n").alias("n"))
    )


def gap_summary(gaps: DataFrame, key: str = "station", nominal: float = 6) -> DataFrame:
    """Largest gap and its count, count and share of the nominal gap.

    A key without any nominal gap stays, with count zero.
    """
    regular = F.coalesce(F.sum(F.when(F.col("gap") == nominal, F.col("n"))), F.lit(0))
    return gaps.groupBy(key).agg(
        F.max("gap").alias("largest_gap"),
        F.max_by("n", "gap").alias("largest_gap_count"),
        regular.alias("nominal_gaps"),
        F.try_divide(regular, F.sum("n")).alias("nominal_share"),
    )
