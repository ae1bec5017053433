"""Table verbs: column picks, casts, overrides, reshaping, appends."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def columns_like(df: DataFrame, contains: str = "", startswith: str = "") -> list[str]:
    """Column names holding ``contains`` and starting with ``startswith``, any case."""
    return [
        c
        for c in df.columns
        if contains.lower() in c.lower() and c.lower().startswith(startswith.lower())
    ]


def select_like(
    df: DataFrame, keep: Sequence[str] = (), contains: str = "", startswith: str = ""
) -> DataFrame:
    """``keep`` first, then the columns whose names match."""
    matched = [c for c in columns_like(df, contains, startswith) if c not in keep]
    return df.select(*keep, *matched)


def everything_after(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """Move some columns to the front."""
    return df.select(*first, *[c for c in df.columns if c not in first])


def across(df: DataFrame, columns: Iterable[str], fn: Callable[[Column], Column]) -> DataFrame:
    """Apply one function to many columns in one projection."""
    return df.withColumns({c: fn(F.col(c)) for c in columns})


def to_numeric(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Text to DOUBLE; text that is no number becomes NULL."""
    return across(
        df, df.columns if columns is None else columns, lambda c: c.try_cast("double")
    )


def override(df: DataFrame, key: str, column: str, values: dict) -> DataFrame:
    """Replace ``column`` where ``key`` has one of a few listed values."""
    replaced = F.col(column)
    for name, value in values.items():
        replaced = F.when(F.col(key) == F.lit(name), F.lit(value)).otherwise(replaced)
    return df.withColumn(column, replaced)


def at_max(df: DataFrame, column: str) -> DataFrame:
    """Rows at the largest value of a column, found by a scalar subquery."""
    return df.filter(F.col(column) == df.agg(F.max(column)).scalar())


def cast_wide(
    df: DataFrame, rows: Sequence[str], column: str, value: str, names: dict
) -> DataFrame:
    """Long to wide: ``names`` maps each value of ``column`` to a new column.

    The cells are conditional aggregates, so it is one shuffle.  A cell with
    several rows takes the largest.
    """
    return df.groupBy(*rows).agg(
        *[F.max(F.when(F.col(column) == v, F.col(value))).alias(n) for v, n in names.items()]
    )


def melt(
    df: DataFrame,
    ids: Sequence[str],
    measures: Sequence[str],
    variable: str = "variable",
    value: str = "value",
    drop_null: bool = False,
) -> DataFrame:
    """Wide to long; NULL cells stay unless dropped."""
    long = df.unpivot(list(ids), list(measures), variable, value)
    return long.dropna(subset=[value]) if drop_null else long


def append(*frames: DataFrame) -> DataFrame:
    """Stack tables by column name; a column a table lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def label(df: DataFrame, headers: dict[str, str]) -> DataFrame:
    """Keep and rename the listed columns, in the listed order."""
    return df.select(*[F.col(f"`{c}`").alias(h) for c, h in headers.items()])


def extent(df: DataFrame, columns: Iterable[str], by: Sequence[str] = ()) -> DataFrame:
    """Smallest, largest and spread of each column."""
    measures = []
    for c in columns:
        low, high = F.min(c), F.max(c)
        measures += [
            low.alias(f"{c}_min"),
            high.alias(f"{c}_max"),
            F.abs(high - low).alias(f"{c}_range"),
        ]
    return df.groupBy(*by).agg(*measures)
