"""Temperature sensitivity: ratio of rates, and ratio of times to a given loss."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondera.functions.errors import with_error
from sondera.functions.numeric import crossing_time, half_even, interval_bin
from sondera.operators.ordered import neighbour_pairs
from sondera.operators.summary import summarize_se
from sondera.session import stage, stages

COLD, WARM = "IB 20", "IB 30"


def _by_treatment(names: Sequence[str], treatment: str) -> list[Column]:
    """Each named column once per treatment, with suffix _20 and _30."""
    return [
        F.max(F.when(F.col(treatment) == level, F.col(c))).alias(f"{c}_{suffix}")
        for level, suffix in ((COLD, "20"), (WARM, "30"))
        for c in names
    ]


def q10(
    summary: DataFrame,
    by: Sequence[str] = ("day", "depth"),
    value: str = "rate",
    error: str = "sd",
    replicates: int = 6,
    treatment: str = "treatment",
) -> DataFrame:
    """Warm over cold rate with its error.

    ``value`` names the column to compare: the mean rate, or ``se`` for the
    ratio older tables hold.  ``replicates`` is the number of bottles in both
    treatments together.
    """
    wide = (
        summary.select(*by, treatment, F.col(value).alias("rate"), F.col(error).alias("drate"))
        .groupBy(*by)
        .agg(*_by_treatment(["rate", "drate"], treatment))
    )
    ratio = with_error(wide, "q10 ~ rate_30 / rate_20")
    se = F.col("dq10") / F.sqrt(F.lit(float(replicates)))
    return ratio.select(*by, "q10", "dq10", se.alias("seq10"))


def threshold_bins(
    df: DataFrame,
    keys: Sequence[str],
    x: str = "day",
    y: str = "fraction",
    step: float = 0.01,
) -> DataFrame:
    """Extremes of the points per key and threshold bin.

    Each point falls in the one bin ``k`` whose threshold ``k * step`` is the
    first to include it.  The bins are aggregated before they are shuffled.
    """
    bin_ = F.greatest(interval_bin(F.col(y), step), F.lit(0)).cast("int")
    return (
        df.filter(F.col(y).isNotNull())
        .groupBy(*keys, bin_.alias("k"))
        .agg(
            F.max(x).alias("x_max"),
            F.max(y).alias("y_max"),
            F.min(x).alias("x_min"),
            F.min(y).alias("y_min"),
        )
    )


def last_threshold(df: DataFrame, y: str = "fraction", step: float = 0.01) -> Column:
    """Number of the last threshold: the largest y to two places, over step."""
    top = F.round(half_even(F.max(y), 2) / F.lit(step), 0).cast("int")
    return df.agg(top).scalar()


def threshold_pairs(
    bins: DataFrame, keys: Sequence[str], step: float = 0.01, last_k: Column | None = None
) -> DataFrame:
    """Last point at or below and first point above each threshold ``k * step``.

    "Below" is the largest x and y over all points with y <= k * step, "above"
    the smallest over the others, so points need no order and no neighbour:
    running extremes over :func:`threshold_bins` along k are enough.

    Thresholds run to ``last_k``, by default that of the largest y.  Finding it
    reads ``bins`` twice; stage them first where they are dear.
    """
    last_k = last_threshold(bins, "y_max", step) if last_k is None else last_k
    along = W.partitionBy(*keys).orderBy("k")
    so_far = along.rowsBetween(W.unboundedPreceding, 0)
    # the bins above, read backwards: a frame that only grows is linear in the bins
    later = W.partitionBy(*keys).orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, -1)
    # a bin answers for its own k and the empty ones up to the next bin
    upto = F.least(F.lead("k").over(along) - 1, last_k)
    return (
        bins.select(
            *keys,
            F.col("k").alias("_k"),
            upto.alias("_upto"),
            F.max("x_max").over(so_far).alias("x0"),
            F.max("y_max").over(so_far).alias("y0"),
            F.min("x_min").over(later).alias("x1"),
            F.min("y_min").over(later).alias("y1"),
        )
        .filter("_k <= _upto")
        .select(*keys, F.explode(F.sequence("_k", "_upto")).alias("k"), "x0", "y0", "x1", "y1")
    )


def threshold_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    x: str = "day",
    y: str = "fraction",
    step: float = 0.01,
    last_k: Column | None = None,
    rows: int | None = None,
) -> DataFrame:
    """The same from true neighbours: each pair answers the thresholds between.

    Equals :func:`threshold_pairs` where y never falls.  Where it does, a
    threshold crossed again is listed again, one row per upward crossing.

    Where tables are staged the points are ordered once.  That scan leaves the pairs that
    pass a threshold and the last row of each bucket with the bucket's largest y, and the
    last threshold of all comes from these.  Elsewhere it takes another pass over the points.
    """
    known = df.filter(F.col(y).isNotNull())
    once = last_k is None and stages(df.sparkSession)
    if last_k is None and not once:
        last_k = last_threshold(known, y, step)
    low = F.greatest(interval_bin(F.col(y), step), F.lit(0)).cast("int")
    high = interval_bin(F.col(f"next_{y}"), step).cast("int") - 1
    passing = neighbour_pairs(known, keys, order, [x, y], bucket, rows, top=y if once else None).withColumns(
        {"_low": low, "_high": high}
    )
    if once:
        passing = stage(
            passing.filter("_high IS NULL OR _low <= _high OR _top IS NOT NULL").select(
                *keys, x, y, f"next_{x}", f"next_{y}", "_low", "_high", "_top"
            )
        )
        last_k = last_threshold(passing, "_top", step)
    return (
        passing.withColumn("_high", F.least("_high", last_k))
        .filter("_low <= _high")
        .select(
            *keys,
            F.explode(F.sequence("_low", "_high")).alias("k"),
            F.col(x).alias("x0"),
            F.col(y).alias("y0"),
            F.col(f"next_{x}").alias("x1"),
            F.col(f"next_{y}").alias("y1"),
        )
    )


def crossing_times(pairs: DataFrame, step: float = 0.01) -> DataFrame:
    """Interpolated time at which each threshold is passed; NULL if never."""
    level = F.col("k") * F.lit(step)
    return pairs.withColumn(
        "crossing",
        crossing_time(level, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")),
    )


def first_crossings(crossings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per threshold: the first time it is crossed, NULL if never."""
    return crossings.groupBy(*keys, "k").agg(F.min("crossing").alias("crossing"))


def elapsed_by_portion(crossings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Time spent on each further step: difference of successive crossings."""
    along = W.partitionBy(*keys).orderBy("k")
    return crossings.withColumn(
        "elapsed", F.col("crossing") - F.lag("crossing", 1, 0.0).over(along)
    )


def q10q(
    elapsed: DataFrame, by: Sequence[str] = ("k", "depth"), treatment: str = "treatment"
) -> DataFrame:
    """Cold over warm time for the same step of loss, with its error.

    Portions reached under the cold treatment only stay, with NULL ratio; the
    zero portion is left out.
    """
    summary = summarize_se(elapsed.filter(F.col("k") != 0), [*by, treatment], "elapsed", "elapsed")
    wide = (
        summary.withColumnRenamed("sd", "delapsed")
        .groupBy(*by)
        .agg(*_by_treatment(["elapsed", "delapsed", "n"], treatment))
        .filter(F.col("n_20").isNotNull())
    )
    ratio = with_error(wide, "q10q ~ elapsed_20 / elapsed_30")
    n = F.col("n_20") + F.col("n_30")
    return ratio.select(
        *by, "q10q", F.col("dq10q").alias("sd"), n.alias("n"), (F.col("dq10q") / F.sqrt(n)).alias("se")
    )
