"""Whole-degree histograms of the chosen windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondera.operators.coverage import GRID


def temperature_grid(df: DataFrame, keep: Sequence[str], grid: tuple[int, int] = GRID) -> DataFrame:
    """Every row of ``df`` at every whole temperature of the grid."""
    return df.select(*keep, F.explode(F.sequence(F.lit(grid[0]), F.lit(grid[1]))).alias("temp_c"))


def fill_grid(counted: DataFrame, keys: Sequence[str], grid: tuple[int, int] = GRID) -> DataFrame:
    """Every grid temperature per key, zero where ``counted`` has no bin.

    ``counted`` holds ``bin`` and ``n``; a NULL bin stands for what is off the
    grid or missing and only makes sure that its key appears.
    """
    low, high = grid
    below = counted.withColumn("bin", F.coalesce("bin", F.lit(low - 1)))
    along = W.partitionBy(*keys).orderBy("bin")
    start = F.when(F.lag("bin").over(along).isNull(), F.lit(low)).otherwise(F.col("bin"))
    stop = F.coalesce(F.lead("bin").over(along) - 1, F.lit(high))
    return (
        below.withColumns({"_start": start, "_stop": stop})
        .filter("_start <= _stop")
        .select(*keys, "bin", "n", F.explode(F.sequence("_start", "_stop")).alias("temp_c"))
        .select(
            *keys,
            "temp_c",
            F.when(F.col("temp_c") == F.col("bin"), F.col("n")).otherwise(F.lit(0)).alias("n"),
        )
    )


def window_histogram(
    bins: DataFrame,
    windows: DataFrame,
    key: str = "station",
    grid: tuple[int, int] = GRID,
    months: int = 12,
    by: Sequence[str] = (),
) -> DataFrame:
    """Readings per key and temperature in the key's window, zero bins included.

    ``by`` adds window columns to the key.  Readings off the grid do not count,
    and a window without any reading on it still gets its zeros.
    """
    keys = [key, *by]
    chosen = windows.select(*keys, F.col("start").alias("_from")).alias("w")
    table = bins.select(F.col(key).alias("_key"), "month", "bin", F.col("n").alias("_n"))
    inside = (
        (F.col(f"w.{key}") == F.col("_key"))
        & (F.col("month") >= F.col("_from"))
        & (F.col("month") < F.add_months("_from", months))
    )
    counted = chosen.join(table, inside, "left").groupBy(*keys, "bin").agg(F.sum("_n").alias("n"))
    return fill_grid(counted, keys, grid)


def series_histogram(
    bins: DataFrame, windows: DataFrame, grid: tuple[int, int] = GRID, months: int = 12
) -> DataFrame:
    """The same for several, overlapping windows of all readings as one series.

    Each window is written out as its months and joined by month.
    """
    pooled = bins.groupBy("month", "bin").agg(F.sum("n").alias("n"))
    stop = F.add_months("start", months - 1)
    spread = windows.select(
        "start",
        F.explode(F.sequence(F.col("start"), stop, F.expr("interval 1 month"))).alias("month"),
    )
    counted = spread.join(pooled, "month", "left").groupBy("start", "bin").agg(F.sum("n").alias("n"))
    return fill_grid(counted, ["start"], grid)


#: Most columns that a wide table takes from its data.
WIDEST = 10_000


def histogram_map(hist: DataFrame, column: str) -> DataFrame:
    """One row per temperature with ``cells``, a map from each group's name to its number.

    Any number of groups fits, and none has to be known before.  A NULL group is named ``NA``.
    """
    name = F.coalesce(F.col(column).cast("string"), F.lit("NA")).alias("_name")
    cell = F.struct(F.col("_name").alias("key"), F.col("n").alias("value"))
    return (
        hist.groupBy("temp_c", name)
        .agg(F.sum("n").alias("n"))
        .groupBy("temp_c")
        .agg(F.map_from_entries(F.sort_array(F.collect_list(cell))).alias("cells"))
    )


def group_totals(hist: DataFrame, column: str, names: Sequence = ()) -> DataFrame:
    """``name, n, listed``: the readings of each group in the data, and whether ``names`` lists it.

    What a wide table with these columns leaves out are the rows that are not listed.
    """
    name = F.coalesce(F.col(column).cast("string"), F.lit("NA")).alias("name")
    listed = F.col("name").isin([str(x) for x in names]) if names else F.lit(False)
    return hist.groupBy(name).agg(F.sum("n").alias("n")).withColumn("listed", listed)


def histogram_wide(hist: DataFrame, column: str, names: Sequence | None = None) -> DataFrame:
    """Temperatures down, groups across; groups with no row give zero.

    Without ``names`` the columns are the groups that the data hold, in order of name,
    found by one small aggregation; more than ``WIDEST`` of them are refused, and
    ``histogram_map`` is for these.
    """
    if names is None:
        found = group_totals(hist, column).select("name").orderBy("name").limit(WIDEST + 1).collect()
        if len(found) > WIDEST:
            raise ValueError(f"more than {WIDEST} groups in {column}: use histogram_map")
        names = [r["name"] for r in found]
    cells = [F.coalesce(F.try_element_at(F.col("cells"), F.lit(str(v))), F.lit(0)).alias(str(v)) for v in names]
    return histogram_map(hist, column).select("temp_c", *cells)
