"""Page-wise ingest: plan the requests, read landed pages, report failed ones.

Fetching a page is the business of a downloader outside Spark.  It leaves one
CSV per page; the jobs here cover all stations at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondera.functions.text import yyyymmdd
from sondera.sources import schemas


def plan_requests(
    stations: DataFrame,
    begin: Column,
    end: Column,
    step_days: int = 30,
    keep: Sequence[str] = ("station",),
) -> DataFrame:
    """One row per station and page of ``step_days`` from begin to end.

    The last page reaches one day past the end, unless a page ends exactly on
    it.  ``begin`` and ``end`` may differ by station.
    """
    starts = F.when(begin < end, F.sequence(begin, end, F.expr(f"interval {step_days} days")))
    next_start = F.date_add("_from", step_days)
    stop = F.when(next_start <= F.col("_end"), next_start).otherwise(F.date_add("_end", 1))
    return (
        stations.select(*keep, end.alias("_end"), F.explode(starts).alias("_from"))
        .filter(F.col("_from") < F.col("_end"))
        .select(
            *keep,
            F.col("_from").alias("page_from"),
            stop.alias("page_to"),
            yyyymmdd(F.col("_from")).alias("chunk_begin"),
            yyyymmdd(stop).alias("chunk_end"),
        )
    )


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """All landed pages of all stations."""
    return spark.read.csv(folder, schema=schemas.ddl(schemas.PAGE), header=True, nullValue="NA")


def failed_pages(plan: DataFrame, landed: DataFrame) -> DataFrame:
    """Planned pages of which nothing landed."""
    on = ["station", "chunk_begin"]
    return plan.join(landed.select(*on).distinct(), on, "left_anti")


def page_of(t: Column, begin: Column, step_days: int = 30) -> Column:
    """First day, ``yyyymmdd``, of the page that asks for ``t``."""
    pages = F.floor(F.date_diff(t.cast("date"), begin) / F.lit(step_days)).cast("int")
    return yyyymmdd(F.date_add(begin, pages * step_days))


def trim_range(df: DataFrame, begin: Column, end: Column, t: str = "t", v: str = "v") -> DataFrame:
    """Readings with a value from ``begin`` up to the midnight that starts ``end``."""
    at = F.col(t)
    return df.filter(
        (at >= begin.cast("timestamp_ntz"))
        & (at <= end.cast("timestamp_ntz"))
        & F.col(v).isNotNull()
    )


def distinct_readings(df: DataFrame) -> DataFrame:
    """Each reading once: neighbouring pages share their boundary day.

    Copies collapse inside each task before they are shuffled.
    """
    return df.dropDuplicates()


def ingest_pages(
    spark: SparkSession, folder: str, plan: DataFrame, begin: Column, end: Column
) -> tuple[DataFrame, DataFrame]:
    """Trimmed distinct readings of the planned stations, and the failed pages."""
    pages = read_pages(spark, folder)
    wanted = pages.join(plan.select("station").distinct(), "station", "left_semi")
    readings = distinct_readings(
        trim_range(wanted.select("station", "t", "v", "f"), begin, end)
    )
    return readings, failed_pages(plan, pages)
