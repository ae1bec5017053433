"""Writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondera.functions.calendar import month_start
from sondera.operators.budget import budget_long, budget_wide, state_budget_wide
from sondera.operators.frame import label
from sondera.operators.histogram import histogram_wide
from sondera.session import stage

#: Times in CSV keep their microseconds; by default Spark writes milliseconds.
CSV_TIMES = {
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]",
}
#: For very many small files: Hadoop starts a process or two for each local file and its checksum file;
#: without the checksum files it starts one.  Other file systems pass over these options.
PLAIN_FILES = {
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",
}
#: Folder of the stations' table inside a working copy; scans pass over it.
STATIONS = "_stations"

# Published headers, with the misspelling of two of them.
SEDIMENT_HEADERS = {
    "erodedSedVolume_LargeTall": "Eroded Marsh Sediment Volume Deep Bank & Large Erosion (m^3/yr)",
    "erodedSedVolume_SmallTall": "Eroded Marsh Sediment Volume Deep Bank & Small Erosion (m^3/yr)",
    "erodedSedVolume_LargeShort": "Eroded Marsh Sediment Volume Shallow Bank & Large Erosion (m^3/yr)",
    "erodedSedVolume_SmallShort": "Eroded Marsh Sediment Volume Shllow Bank & Small Erosion (m^3/yr)",
    "erodedSedC_LargeTall": "Eroded Marsh Sediment Carbon Deep Bank & Large Erosion (kg/yr)",
    "erodedSedC_SmallTall": "Eroded Marsh Sediment Carbon Deep Bank & Small Erosion (kg/yr)",
    "erodedSedC_LargeShort": "Eroded Marsh Sediment Carbon Shallow Bank & Large Erosion (kg/yr)",
    "erodedSedC_SmallShort": "Eroded Marsh Sediment Carbon Shllow Bank & Small Erosion (kg/yr)",
    "Decomp_LargeShort": "Eroded Carbon Decomposed Shallow Bank & Large Erosion (kg/yr)",
    "dDecomp_LargeShort": "Eroded Carbon Decomposed Shallow Bank & Large Erosion SD (kg/yr)",
    "Decomp_LargeTall": "Eroded Carbon Decomposed Deep Bank & Large Erosion (kg/yr)",
    "dDecomp_LargeTall": "Eroded Carbon Decomposed Deep Bank & Large Erosion SD (kg/yr)",
    "Decomp_SmallShort": "Eroded Carbon Decomposed Shallow Bank & Small Erosion (kg/yr)",
    "dDecomp_SmallShort": "Eroded Carbon Decomposed Shallow Bank & Small Erosion SD (kg/yr)",
    "Decomp_SmallTall": "Eroded Carbon Decomposed Deep Bank & Small Erosion (kg/yr)",
    "dDecomp_SmallTall": "Eroded Carbon Decomposed Deep Bank & Small Erosion SD (kg/yr)",
}
PLACE_HEADERS = {"n": "n stations", "marsh_shore": "Marsh Shoreline (km)"}
NATION_HEADERS = {**PLACE_HEADERS, **SEDIMENT_HEADERS}
REGION_HEADERS = {"region": "Region", **NATION_HEADERS}
STATE_BUDGET_HEADERS = {
    "region": "Region",
    "state": "State",
    **PLACE_HEADERS,
    "deep": "Deep Sed Annual Decomp (mol C/mol C)",
    "ddeep": "Deep Sed Annual Decomp SD (mol C/mol C)",
    "shallow": "Shallow Sed Annual Decomp (mol C/mol C)",
    "dshallow": "Shallow Sed Annual Decomp SD (mol C/mol C)",
    **SEDIMENT_HEADERS,
}
STATE_MEAN_HEADERS = {
    "region": "Region",
    "state": "State",
    "n": "n stations",
    "deep": "Mean Deep Sed Annual Decomp (mol C/mol C)",
    "ddeep": "SD Deep Sed Annual Decomp (mol C/mol C)",
    "shallow": "Mean Shallow Sed Annual Decomp (mol C/mol C)",
    "dshallow": "SD Shallow Sed Annual Decomp SD (mol C/mol C)",
}
STATION_HEADERS = {
    "loss_deep": "Deep Sed C Annual Decomp (mol C/mol C)",
    "dloss_deep": "Deep Sed C Annual Decomp SD (mol C/mol C)",
    "loss_shallow": "Shallow Sed C Annual Decomp (mol C/mol C)",
    "dloss_shallow": "Shallow Sed C Annual Decomp SD (mol C/mol C)",
}
LONG_HEADERS = {
    "region": "Region",
    "state": "State",
    "marsh_shore": "MarshShore",
    "n": "n",
    "BankHt": "BankHt",
    "ErosionRate": "ErosionRate",
    "erodedSedVolume": "erodedSedVolume",
    "erodedSedCarbon": "erodedSedCarbon",
    "Decomp": "Decomp",
    "SD": "SD",
}


def station_headers(df: DataFrame) -> dict[str, str]:
    """All columns, the results among them under readable names."""
    return {c: STATION_HEADERS.get(c, c) for c in df.columns}


def write_csv(df: DataFrame, path: str, headers: dict[str, str] | None = None) -> None:
    """CSV with a header; NULL is an empty cell.  ``headers`` picks and renames."""
    table = label(df, headers) if headers else df
    table.write.mode("overwrite").options(nullValue="", emptyValue="", **CSV_TIMES).csv(path, header=True)


def write_histogram_wide(hist: DataFrame, path: str, stations: list[str] | None = None) -> None:
    """Temperatures down and stations across, as CSV: those listed, or all that the data hold."""
    wide = histogram_wide(hist, "station", stations)
    write_csv(wide.withColumnRenamed("temp_c", "temp"), path)


def write_station_files(readings: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """A folder ``station=<key>`` of CSV per station, as ``read_station_series`` reads it.

    A station is one file of up to ``rows_per_file`` rows.  A longer one is cut into as many
    pieces as it needs, each a file of its own task; months stay whole where they fit.
    Stations are dealt over the session's shuffle partitions: what a task costs is its files, and
    coalesced by bytes they left cores idle in a second wave.
    """
    tasks = int(readings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    month = F.date_trunc("month", F.col("t").cast("timestamp_ntz"))
    sizes = readings.groupBy("station", month.alias("_month")).agg(F.count(F.lit(1)).alias("_n"))
    along = W.partitionBy("station").orderBy("_month")
    # pieces are filled month by month; a month of more rows than a file has pieces of its own
    before = F.coalesce(F.sum("_n").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    long = (
        sizes.withColumns({"_before": before, "_all": F.sum("_n").over(W.partitionBy("station"))})
        .filter(F.col("_all") > rows_per_file)
        .select(
            F.col("station").alias("_station"),
            "_month",
            F.floor(F.col("_before") / rows_per_file).alias("_first"),
            F.ceil(F.col("_n") / rows_per_file).alias("_parts"),
        )
    )
    # staged, its size is known when the join is planned, so a small one does not cost a shuffle of the readings
    long = stage(long)
    dealt = readings.withColumn("_at", month).join(
        long, F.col("station").eqNullSafe(F.col("_station")) & F.col("_at").eqNullSafe(F.col("_month")), "left"
    )
    piece = F.coalesce(F.col("_first") + F.pmod(F.xxhash64(F.col("t").cast("string")), F.col("_parts")), F.lit(0))
    (
        dealt.withColumn("_piece", piece)
        .repartition(tasks, "station", "_piece")
        .sortWithinPartitions("station", "_piece", "t")
        .select(*readings.columns)
        .write.mode("overwrite")
        .options(maxRecordsPerFile=rows_per_file, **CSV_TIMES, **PLAIN_FILES)
        .partitionBy("station")
        .csv(path, header=True)
    )


def write_series(readings: DataFrame, path: str, rows_per_file: int = 50_000_000) -> None:
    """The working copy: Parquet by year, clustered by station and time.

    Range partitioning puts neighbouring stations into the same file and cuts a
    station with very many readings over several, so statistics prune both.  Beside it lies a small
    table of the stations, for ``readers.series_stations``.
    """
    spark = readings.sparkSession
    (
        readings.withColumn("year", F.year("t"))
        .repartitionByRange("year", "station", "t")
        .sortWithinPartitions("year", "station", "t")
        .write.mode("overwrite")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy("year")
        .parquet(path)
    )
    (
        spark.read.parquet(path)
        .groupBy("station", "year")
        .agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))
        .write.mode("overwrite")
        .parquet(f"{path.rstrip('/')}/{STATIONS}")
    )


def write_bucketed(readings: DataFrame, table: str, buckets: int) -> None:
    """The readings as a table in buckets of (station, month), sorted by time inside.

    Joins and aggregations by these columns then read the buckets where they lie;
    windows reach their readings without a shuffle of these (see ``restrict_to_window``).  As many
    ``buckets`` as the session has shuffle partitions, or more, keep Spark from dealing again.
    """
    (
        readings.withColumn("month", month_start(F.col("t")))
        .repartition(buckets, "station", "month")
        .write.mode("overwrite")
        .bucketBy(buckets, "station", "month")
        .sortBy("station", "month", "t")
        .saveAsTable(table)
    )


def result_tables(stations: DataFrame, means: DataFrame, rolled: DataFrame) -> dict[str, tuple[DataFrame, dict[str, str]]]:
    """The result tables with their headers, by name; nothing is computed yet.

    ``stations`` is the metadata with the losses, ``means`` the state means and ``rolled``
    the budget rolled up from them.
    """
    wide = budget_wide(rolled)
    return {
        "stations": (stations, station_headers(stations)),
        "state_means": (means, STATE_MEAN_HEADERS),
        "state_budget": (state_budget_wide(rolled, means), STATE_BUDGET_HEADERS),
        "region_budget": (wide.filter("level = 'region'"), REGION_HEADERS),
        "nation_budget": (wide.filter("level = 'nation'"), NATION_HEADERS),
        "long_budget": (budget_long(rolled), LONG_HEADERS),
    }


def publish(
    path: str,
    stations: DataFrame,
    hist: DataFrame,
    means: DataFrame,
    rolled: DataFrame,
    columns: list[str] | None = None,
    only: Sequence[str] | None = None,
) -> dict[str, str]:
    """The seven result tables as CSV folders under ``path``; returns where each lies.

    ``hist`` is the histogram of the fullest windows, with the stations of ``columns`` across (by default
    all that it holds); see ``result_tables`` for the others.  ``only`` names the tables to write.
    ``readers.read_published`` reads them back.
    """
    tables = result_tables(stations, means, rolled)
    wanted = [*tables, "temperatures"] if only is None else only
    places = {name: f"{path.rstrip('/')}/{name}" for name in wanted}
    for name, place in places.items():
        if name == "temperatures":
            write_histogram_wide(hist, place, columns)
        else:
            table, headers = tables[name]
            write_csv(table, place, headers)
    return places
