"""File readers.  Every path is an argument; every result has a fixed schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondera.functions.numeric import half_even, no_nan
from sondera.functions.text import object_name, station_from_file
from sondera.sources import schemas

REGIONS = ("Atlantic", "Gulf", "Pacific")


def read_named(spark: SparkSession, path: str, schema: dict[str, str]) -> DataFrame:
    """CSV columns picked by header name and converted.

    Columns not in the schema are never parsed.  The text ``NA`` and text that
    does not convert become NULL, and so does NaN.
    """
    raw = spark.read.csv(path, header=True, nullValue="NA")
    cells = []
    for name, kind in schema.items():
        cell = F.col(f"`{name}`").try_cast(kind)
        cells.append((no_nan(cell) if kind == "double" else cell).alias(name))
    return raw.select(*cells)


def read_incubation(spark: SparkSession, path: str) -> DataFrame:
    """Gas readings; the prior-reading columns stay text, see ``drop_aired``."""
    return read_named(spark, path, schemas.INCUBATION)


def incubation_names(df: DataFrame) -> DataFrame:
    """File headers to the column names the operators use.

    ``time_order`` is the number in the time point's name, so that the tenth
    reading of a day follows the second.
    """
    gas = {
        f"{g}.{kind}": f"{g}_{kind.replace('.', '_')}"
        for g in ("CO2", "CH4")
        for kind in ("sys.ppm.p", "air.ppm", "sys.ppm")
    }
    plain = {
        "Time.Point": "time_point",
        "Bottle": "bottle",
        "Treatment": "treatment",
        "Depth": "depth",
        "Rep": "rep",
    }
    number = F.regexp_extract("time_point", r"(\d+(\.\d+)?)", 1).try_cast("double")
    return df.withColumnsRenamed({**gas, **plain}).withColumn("time_order", number)


def read_carbon(spark: SparkSession, path: str) -> DataFrame:
    """Initial carbon per bottle."""
    return read_named(spark, path, schemas.CARBON).withColumnsRenamed(
        {"Bottle": "bottle", "C.g": "c_g", "C.mol": "c_mol"}
    )


def read_sensor(
    spark: SparkSession, path: str, ts_format: str = "M/d/yyyy H:mm"
) -> DataFrame:
    """One long sensor series ``t, v``, rounded to whole degrees, NULLs dropped.

    The text is wall-clock time of a zone without daylight saving, so it is
    kept without a zone.
    """
    raw = read_named(spark, path, schemas.SENSOR)
    when = F.try_to_timestamp("start_datetime", F.lit(ts_format)).cast("timestamp_ntz")
    value = half_even(no_nan(F.col("result_value").try_cast("double")), 0)
    return raw.select(when.alias("t"), value.alias("v")).dropna(subset=["v"])


def read_station_list(
    spark: SparkSession, path: str, regions: Sequence[str] = REGIONS
) -> DataFrame:
    """Listed stations of some regions, with their key ``station``."""
    listed = read_named(spark, path, schemas.STATION_LIST)
    return listed.withColumn("station", object_name(F.col("Name"), F.col("State"))).filter(
        F.col("Region").isin(*regions)
    )


def read_station_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Station metadata; stations without a state are left out."""
    table = read_named(spark, path, schemas.STATION_METADATA)
    return table.filter(F.col("State").isNotNull()).withColumnsRenamed(
        {"State": "state", "Region": "region", "ObjName": "station"}
    )


def read_shoreline(spark: SparkSession, path: str) -> DataFrame:
    """Marsh shoreline length per region and state."""
    return read_named(spark, path, schemas.SHORELINE).withColumnsRenamed(
        {"Region": "region", "Abb": "state", "Marsh shore (km)": "length"}
    )


def _typed_series(raw: DataFrame) -> DataFrame:
    return raw.select(
        "station",
        F.col("t").try_cast("timestamp_ntz").alias("t"),
        no_nan(F.col("v").try_cast("double")).alias("v"),
        "f",
    )


def _station_of(path: str) -> Column:
    """Station key of a series file, from the encoded path of its row.

    Either the name of a file ``<key>.csv`` or the folder ``station=<key>``,
    in which a writer has escaped some characters once more.  It is computed for every
    row, so only the last names of the path are cut out and decoded.
    """
    decoded = lambda x: F.when(x.contains("%"), F.url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))).otherwise(x)
    name, parent = F.substring_index(path, "/", -1), F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    own = F.when(parent.startswith("station=") & (parent != "station="), F.substr(parent, F.lit(len("station=") + 1)))
    return F.when(own.isNotNull(), decoded(decoded(own))).otherwise(station_from_file(decoded(name)))


def station_files(spark: SparkSession, folder: str) -> DataFrame:
    """``station, path`` of the series files of a folder; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv{,.gz}")
        .load(folder)
    )
    return files.select(F.col("_metadata.file_path").alias("encoded"), "path").select(
        _station_of("encoded").alias("station"), "path"
    )


#: Stations whose files are picked by name; of a longer list, all files are read and their rows picked.
NAMED = 10_000


def _all_files(spark: SparkSession, folder: str) -> DataFrame:
    """Readings of every series file of a folder, with ``station`` from the file's path."""
    raw = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv{,.gz}")
        .csv(folder, schema=schemas.ddl(schemas.SERIES), header=True, nullValue="NA", mode="PERMISSIVE")
    )
    return raw.withColumn("station", _station_of("_metadata.file_path"))


def read_series_csv(spark: SparkSession, folder: str) -> DataFrame:
    """All station files of a folder as one table.

    Rows whose time or value does not parse stay, with NULL; ``undated`` counts
    those without a time.
    """
    return _typed_series(_all_files(spark, folder))


def read_station_series(
    spark: SparkSession, folder: str, stations: DataFrame, key: str = "station", named: int = NAMED
) -> tuple[DataFrame, DataFrame]:
    """Readings of the listed stations, and the stations without a file.

    The folder is listed, not asked for one name after the other, so a missing
    file is a row of the second table and never an error; a file without rows
    is there.  Of up to ``named`` stations only the own files are read: the test on a
    file's path is made before it is opened.  Files are those of
    ``write_station_files`` or one ``<key>.csv`` (or ``.csv.gz``) per station.
    """
    return listed_series(spark, folder, stations, key, named), missing_files(spark, folder, stations, key)


def listed_series(
    spark: SparkSession, folder: str, stations: DataFrame, key: str = "station", named: int = NAMED
) -> DataFrame:
    """The first table of ``read_station_series`` alone; the folder is listed once."""
    listed = stations.select(F.col(key).alias("station")).distinct()
    every = _all_files(spark, folder)
    names = [r.station for r in listed.limit(named + 1).collect()]
    if len(names) <= named:
        # an expression on the path alone, which Spark evaluates file by file
        readings = every.filter(_station_of("_metadata.file_path").isin([n for n in names if n is not None]))
    else:
        readings = every.join(listed, "station", "left_semi")
    return _typed_series(readings)


def missing_files(spark: SparkSession, folder: str, stations: DataFrame, key: str = "station") -> DataFrame:
    """The second table alone: stations without a file, from one listing and no file's contents."""
    listed = stations.select(F.col(key).alias("station")).distinct()
    files = station_files(spark, folder).select("station").distinct()
    return listed.join(files, "station", "left_anti").withColumnRenamed("station", key)


def undated(readings: DataFrame) -> DataFrame:
    """``station, n``: readings without a time, which are in no window."""
    lost = readings.filter("t IS NULL")
    return lost.groupBy("station").agg(F.count("*").alias("n"))


def read_series(spark: SparkSession, folder: str) -> DataFrame:
    """Readings as written by ``write_series``: Parquet with ``year``, the partition.

    A filter on ``year``, or a join on it, skips the other years' files.
    """
    return spark.read.parquet(folder)


def series_stations(spark: SparkSession, folder: str) -> DataFrame:
    """``station, year, n, first, last`` of a working copy, from the table that ``write_series`` leaves beside it.

    No file with readings is opened, so which stations have data costs a row per station and year.
    """
    return spark.read.parquet(f"{folder.rstrip('/')}/_stations")


def read_published(spark: SparkSession, path: str, headers: dict[str, str], kinds: dict[str, str]) -> DataFrame:
    """A published table under the names it had before it was written.

    ``headers`` are those of the writer; columns are doubles but for those in ``kinds``.
    """
    table = read_named(spark, path, {header: kinds.get(name, "double") for name, header in headers.items()})
    return table.select(*[F.col(f"`{header}`").alias(name) for name, header in headers.items()])
