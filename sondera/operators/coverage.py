"""Coverage of rolling 12-month windows and the choice of the fullest one.

The readings are read once, by :func:`monthly_bins`, into a row per station,
month and whole-degree bin.  Windows start on the first of a month and are
whole months long, so coverage and histograms are exact sums of those rows and
the raw readings are never ranged over again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondera.functions.calendar import expected_slots, month_start, window_end
from sondera.functions.numeric import half_even

GRID = (-5, 50)


def monthly_bins(
    readings: DataFrame,
    key: str = "station",
    t: str = "t",
    v: str = "v",
    grid: tuple[int, int] = GRID,
) -> DataFrame:
    """Readings per (key, month, half-even bin); bin NULL off the grid.

    A reading without a time is in no month and is left out.
    Map-side aggregation leaves at most grid size + 1 rows per key and month in
    each task, so a station with a third of all readings costs no more to
    shuffle than any other.  Later steps read the result more than once: stage
    it first.
    """
    rounded = half_even(F.col(v), 0)
    bin_ = F.when(rounded.between(*grid), rounded).cast("int")
    return readings.filter(F.col(t).isNotNull()).groupBy(
        F.col(key), month_start(F.col(t)).alias("month"), bin_.alias("bin")
    ).agg(F.count(F.lit(1)).alias("n"))


def monthly_counts(bins: DataFrame, key: str = "station") -> DataFrame:
    """Readings per (key, month), whatever their value.

    Shuffled by key alone, a few thousand rows for each, so that the windows
    along a key's months find its rows in place.
    """
    return bins.repartition(key).groupBy(key, "month").agg(F.sum("n").alias("n"))


def span(counts: DataFrame) -> tuple[Column, Column]:
    """First and last month of the data, from one scalar subquery."""
    both = counts.agg(
        F.struct(F.min("month").alias("first"), F.max("month").alias("last"))
    ).scalar()
    return both["first"], both["last"]


def fill_months(
    counts: DataFrame, begin: Column, end: Column, key: str = "station"
) -> DataFrame:
    """One row per key and month of [begin, end], zero where nothing was read.

    Every row writes out the empty months up to its successor, in the same
    partitioning by key that the later windows use.  Months outside the range
    are clipped here and not filtered before, so that the table of counts stays
    the same subplan, and the same shuffle, as in the histogram.
    """
    along = W.partitionBy(key).orderBy("month")
    # greatest and least skip NULL: the first row starts at begin, the last stops at end
    later = F.when(F.row_number().over(along) > 1, F.col("month"))
    start = F.greatest(later, begin)
    stop = F.least(F.add_months(F.lead("month").over(along), -1), end)
    step = F.expr("interval 1 month")
    return (
        counts.filter("month IS NOT NULL")
        .withColumns({"_start": start, "_stop": stop})
        .filter("_start <= _stop")
        .select(key, "month", "n", F.explode(F.sequence("_start", "_stop", step)).alias("_m"))
        .select(
            key,
            F.col("_m").alias("month"),
            F.when(F.col("_m") == F.col("month"), F.col("n")).otherwise(F.lit(0)).alias("n"),
        )
    )


def coverage(
    counts: DataFrame,
    key: str = "station",
    begin: Column | None = None,
    end: Column | None = None,
    per_day: float = 240,
    months: int = 12,
) -> DataFrame:
    """Count, expected count and share for every window start of every key.

    Starts run monthly from ``begin`` to ``end`` (by default the span of the
    data, which takes one more pass over the times); windows may reach past
    ``end``.
    """
    if begin is None or end is None:
        first, last = span(counts)
        begin = first if begin is None else begin
        end = last if end is None else end
    ahead = W.partitionBy(key).orderBy("month").rowsBetween(0, months - 1)
    filled = fill_months(counts, begin, F.add_months(end, months - 1), key)
    expected = expected_slots(F.col("month"), per_day, months)
    return (
        filled.withColumn("n", F.sum("n").over(ahead))
        .filter(F.col("month") <= end)
        .select(
            key,
            F.col("month").alias("start"),
            F.year("month").alias("year"),
            F.month("month").alias("mon"),
            "n",
            expected.alias("expected"),
            (F.col("n") / expected).alias("pct"),
        )
    )


def best_window(windows: DataFrame, key: str = "station") -> DataFrame:
    """Fullest window per key; of equally full ones the latest."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("pct"), F.desc("start")))
    return windows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def pooled_windows(bins: DataFrame, months: int = 12) -> DataFrame:
    """Window counts of all readings taken as one series.

    The series meets in one task as one row per month of its span.
    """
    pooled = bins.groupBy("month").agg(F.sum("n").alias("n"))
    whole = pooled.withColumn("series", F.lit("all"))
    return coverage(whole, "series", months=months, per_day=1).drop("expected", "pct")


def top_windows(windows: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` windows with most readings, earlier first among equals."""
    return windows.orderBy(F.desc("n"), "start").limit(k)


def top_windows_per(windows: DataFrame, key: str = "station", k: int = 10) -> DataFrame:
    """The same for every key."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), "start"))
    return windows.withColumn("rank", rank).filter(F.col("rank") <= k)


def restrict_to_window(
    readings: DataFrame,
    windows: DataFrame,
    key: str = "station",
    t: str = "t",
    keep: Sequence[str] = (),
    months: int = 12,
) -> DataFrame:
    """Raw readings inside their key's window.

    Each window is written out as its months, which turns the range test into
    an equality on (key, month) and spreads one station over twelve keys.  If
    the readings have a ``year`` (see ``read_series``) it is joined as well, so
    that files of years without a window are not read.  If they have their ``month`` (see
    ``write_bucketed``) that is joined, and buckets by station and month are not shuffled.
    """
    step = F.expr("interval 1 month")
    stop = F.add_months(window_end(F.col("start"), months), -1)
    chosen = windows.select(
        key, *keep, F.explode(F.sequence(F.col("start"), stop, step)).alias("_month")
    )
    if "month" in readings.columns:
        return readings.join(chosen.withColumnRenamed("_month", "month"), [key, "month"])
    dated = readings.withColumn("_month", month_start(F.col(t)))
    on = [key, "_month"]
    if "year" in readings.columns:
        chosen, on = chosen.withColumn("year", F.year("_month")), [*on, "year"]
    return dated.join(chosen, on).drop("_month")
