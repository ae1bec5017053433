"""Station tables: which have data, and what is known about each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_series(stations: DataFrame, readings: DataFrame, key: str = "station") -> DataFrame:
    """Stations without any reading.  Keys are made distinct before they travel."""
    return stations.join(readings.select(key).distinct(), key, "left_anti")


def with_series(stations: DataFrame, readings: DataFrame, key: str = "station") -> DataFrame:
    """Stations with at least one reading."""
    return stations.join(readings.select(key).distinct(), key, "left_semi")


def station_metadata(responses: DataFrame, listed: DataFrame) -> DataFrame:
    """Response metadata as numbers, completed from the station list."""
    numeric = responses.select(
        F.col("id").try_cast("bigint").alias("id"),
        "name",
        F.col("lat").try_cast("double").alias("lat"),
        F.col("lon").try_cast("double").alias("lon"),
    )
    right = listed.withColumnsRenamed({"StationID": "id", "Name": "name"})
    return numeric.join(right, ["id", "name"], "left")


def attach(
    stations: DataFrame, tables: Sequence[tuple[DataFrame, str]], key: str = "station"
) -> DataFrame:
    """Left-join one-row-per-station results onto the station table.

    ``tables`` pairs each result with the name of its own key column.
    """
    for table, own_key in tables:
        stations = stations.join(table.withColumnRenamed(own_key, key), key, "left")
    return stations
