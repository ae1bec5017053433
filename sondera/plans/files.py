"""Readers, writers and the stream as queries: the test tables written as files and read back.

Every query lands its files in a fresh folder of the cluster's shared one, see
``session.shared_folder``, and returns what the library's reader makes of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondera.functions.text import object_name
from sondera.operators import budget, histogram, stations
from sondera.operators.incubation import AIRED, drop_aired
from sondera.plans import network
from sondera.plans.queries import GATE, OVERRIDES, PER_DAY, _best, _bins, _final, rounded
from sondera.plans.views import Views
from sondera.session import shared_folder
from sondera.sources import ingest, readers, schemas, sinks
from sondera.streaming.ingest import compact, ingest_stream, stored_readings

FILES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def file_query(fn: Callable[[Views, str], DataFrame]) -> Callable[[Views, str], DataFrame]:
    """Register ``fn``, which gets a fresh folder besides the tables."""
    FILES[fn.__name__] = lambda spark, folder: fn(Views(spark, folder), shared_folder(spark, fn.__name__))
    return fn


def _landed(df: DataFrame, path: str) -> str:
    """``df`` as the CSV files of someone else: a header, and ``NA`` where nothing is known."""
    df.write.options(nullValue="NA", **sinks.CSV_TIMES).csv(path, header=True)
    return path


# -- single tables -----------------------------------------------------------


@file_query
def incubation_file(v: Views, folder: str) -> DataFrame:
    """Gas readings under the file's headers, among columns that are not asked for; aired bottles left out."""
    raw = v.gas_readings()
    headers = {
        "event_type": "Remarks",
        "bottle": "Bottle",
        "treatment": "Treatment",
        "depth": "Depth",
        "rep": "Rep",
        "day": "day",
        **{f"{g}_{c}": f"{g}.{c.replace('_', '.')}" for g in ("CO2", "CH4") for c in ("sys_ppm_p", "air_ppm", "sys_ppm")},
    }
    table = raw.select(
        *[F.col(c).alias(name) for c, name in headers.items()],
        F.concat(F.lit("T"), "event_id").alias("Time.Point"),
        F.lit("1/2/24").alias("Date"),
        F.lit("10:00").alias("Time"),
        F.when(F.col("event_type") != "view", F.col("day")).alias("ElapsedDays"),
    )
    read = readers.incubation_names(readers.read_incubation(v.spark, _landed(table, folder)))
    kept = drop_aired(read, "CO2_sys_ppm_p")
    columns = ["bottle", "treatment", "depth", "rep", "CO2_air_ppm", "CH4_air_ppm", "CO2_sys_ppm", "CH4_sys_ppm"]
    return rounded(
        kept.select(
            F.col("time_order").cast("bigint").alias("event_id"),
            *columns,
            *[F.col(f"{g}_sys_ppm_p").cast("double").alias(f"{g}_prior") for g in ("CO2", "CH4")],
            F.col("ElapsedDays").isNotNull().alias("timed"),
        )
    )


@file_query
def carbon_file(v: Views, folder: str) -> DataFrame:
    """Carbon per bottle: NaN in accounts below zero, ``NA`` where the segment is machinery."""
    mol = F.when(F.col("c_acctbal") < 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal") / 1000)
    table = v.table("customer").select(
        F.concat(F.lit("B "), "c_custkey").alias("Bottle"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_acctbal")).alias("C.g"),
        mol.alias("C.mol"),
    )
    return rounded(readers.read_carbon(v.spark, _landed(table, folder)))


@file_query
def sensor_file(v: Views, folder: str) -> DataFrame:
    """One long sensor series whose times are text to the minute; errors hold no number."""
    value = F.when(F.col("event_type") == "error", "bad").otherwise(F.col("value").cast("string"))
    table = v.table("events").select(
        "event_id",
        F.date_format("ts", "M/d/yyyy H:mm").alias("start_datetime"),
        value.alias("result_value"),
    )
    return readers.read_sensor(v.spark, _landed(table, folder))


@file_query
def station_list_file(v: Views, folder: str) -> DataFrame:
    """Listed stations of two regions; their names hold blanks and commas."""
    table = v.stations().select(
        F.col("station").alias("StationID"),
        F.concat_ws(", ", "name", "state").alias("Name"),
        F.col("state").alias("State"),
        F.col("region").alias("Region"),
        "lat",
    )
    return readers.read_station_list(v.spark, _landed(table, folder), ("ASIA", "MIDDLE EAST"))


@file_query
def station_metadata_file(v: Views, folder: str) -> DataFrame:
    """Station metadata as the library writes it; those of Europe lack a state and are left out."""
    table = v.stations().select(
        F.col("station").alias("id"),
        "name",
        "lat",
        "lon",
        F.when(F.col("region") != "EUROPE", F.col("state")).alias("State"),
        F.col("region").alias("Region"),
        object_name(F.col("name"), F.col("state")).alias("ObjName"),
    )
    sinks.write_csv(table, folder)
    return rounded(readers.read_station_metadata(v.spark, folder))


@file_query
def shoreline_file(v: Views, folder: str) -> DataFrame:
    table = v.shore().select(
        F.col("region").alias("Region"),
        F.col("state").alias("Abb"),
        (F.col("length") * 2).alias("Hard (km)"),
        F.col("length").alias("Marsh shore (km)"),
    )
    return readers.read_shoreline(v.spark, _landed(table, folder))


# -- series ------------------------------------------------------------------


def _series(v: Views) -> DataFrame:
    """The daily series with flags that hold commas, and times to the microsecond."""
    micros = F.make_dt_interval(secs=(F.col("l_orderkey") % 1_000_000) / 1_000_000)
    half = F.lit(0.5) * (F.col("l_linenumber") % 2)
    return v.table("lineitem").select(
        F.col("l_suppkey").alias("station"),
        (F.col("l_shipdate") + micros).alias("t"),
        (F.col("l_quantity") - half).alias("v"),
        F.concat("l_linestatus", F.lit(",0,"), "l_returnflag").alias("f"),
    )


def _listed(v: Views) -> DataFrame:
    """Every third customer, taken as a station; most have no file."""
    return v.table("customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("station"))


@file_query
def station_files(v: Views, folder: str) -> DataFrame:
    """A file for each station; the readings of the listed ones."""
    sinks.write_station_files(_series(v), folder, rows_per_file=100_000)
    return readers.listed_series(v.spark, folder, _listed(v)).select("station", "t", "v", "f")


@file_query
def station_files_missing(v: Views, folder: str) -> DataFrame:
    """The listed stations that have no file."""
    sinks.write_station_files(_series(v), folder, rows_per_file=100_000)
    return readers.missing_files(v.spark, folder, _listed(v))


@file_query
def working_copy(v: Views, folder: str) -> DataFrame:
    """The Parquet copy by year: the readings of two years, the other years' files left closed."""
    sinks.write_series(_series(v), folder)
    kept = readers.read_series(v.spark, folder).filter(F.col("year").isin(1996, 2000))
    return kept.select("station", "t", "v", "f", F.col("year").cast("bigint").alias("year"))


@file_query
def working_copy_stations(v: Views, folder: str) -> DataFrame:
    """Stations and years of the copy from the small table beside it."""
    sinks.write_series(_series(v), folder)
    table = readers.series_stations(v.spark, folder)
    return table.select("station", F.col("year").cast("bigint").alias("year"), "n", "first", "last")


# -- pages -------------------------------------------------------------------

BEGIN, END, PAGE_DAYS = "2024-01-01", "2024-01-29", 7


def _pages(v: Views) -> DataFrame:
    """Ticks as landed pages of a week; errors carry no value, some pages never land."""
    begin = F.lit(BEGIN).cast("date")
    week = F.floor(F.date_diff(F.col("ts").cast("date"), begin) / PAGE_DAYS)
    return (
        v.table("events")
        .filter((F.col("user_id") + week) % 6 != 0)
        .select(
            F.col("user_id").cast("string").alias("station"),
            ingest.page_of(F.col("ts"), begin, PAGE_DAYS).alias("chunk_begin"),
            F.col("ts").alias("t"),
            F.when(F.col("event_type") != "error", F.col("value")).alias("v"),
            F.col("event_type").alias("f"),
            "event_id",
        )
    )


PAGE = list(schemas.PAGE)


def _plan(v: Views) -> tuple[DataFrame, Column, Column]:
    begin, end = F.lit(BEGIN).cast("date"), F.lit(END).cast("date")
    users = v.table("events").filter("user_id % 4 <> 0").select(F.col("user_id").cast("string").alias("station")).distinct()
    return ingest.plan_requests(users, begin, end, PAGE_DAYS), begin, end


@file_query
def page_files(v: Views, folder: str) -> DataFrame:
    """Readings of the planned stations from their landed pages, all of which landed twice."""
    pages = _pages(v).select(*PAGE)
    landing = _landed(pages.unionByName(pages), folder)
    return ingest.ingest_pages(v.spark, landing, *_plan(v))[0]


@file_query
def page_files_failed(v: Views, folder: str) -> DataFrame:
    """The planned pages of which nothing landed."""
    failed = ingest.ingest_pages(v.spark, _landed(_pages(v).select(*PAGE), folder), *_plan(v))[1]
    return failed.select("station", "chunk_begin", "chunk_end")


@file_query
def page_stream(v: Views, folder: str) -> DataFrame:
    """The pages as a stream in three waves that overlap, compacted after the second; each reading once."""
    landing, out = f"{folder}/landing", f"{folder}/readings"
    waves = ("event_id % 2 = 0", "event_id % 3 = 0", "event_id % 2 = 1 OR event_id % 5 = 0")
    for i, wave in enumerate(waves):
        wanted = _pages(v).filter(wave).select(*PAGE)
        wanted.write.mode("append").options(nullValue="NA", **sinks.CSV_TIMES).csv(landing, header=True)
        ingest_stream(v.spark, landing, out).awaitTermination()
        if i == 1:
            compact(v.spark, out)
    return stored_readings(v.spark, out).select("station", "t", "v", "f")


# -- result tables -----------------------------------------------------------

TEXT = {"region": "string", "state": "string", "level": "string", "BankHt": "string", "ErosionRate": "string", "n": "bigint"}


def _published(v: Views, folder: str, name: str, headers: dict[str, str], kinds: dict[str, str] = TEXT) -> DataFrame:
    """One published result table, written with its headers and read back."""
    bins = _bins(v)
    losses = network.station_losses(bins, _final(v), per_day=PER_DAY)
    means = network.state_means(v.stations(), losses, GATE)
    rolled = network.national_budget(v.shore(), means, overrides=OVERRIDES)
    results = losses.select("station", "start", "pct", *sinks.STATION_HEADERS)
    known = stations.attach(v.stations(), [(results, "station")]).drop("name")
    hist = histogram.window_histogram(bins, _best(bins))
    placed = hist.join(v.stations().select("station", "region"), "station").select(F.col("region").alias("station"), "temp_c", "n")
    places = sinks.publish(folder, known, placed, means, rolled, only=[name])
    return readers.read_published(v.spark, places[name], headers, kinds)


@file_query
def published_stations(v: Views, folder: str) -> DataFrame:
    plain = ["station", "lat", "lon", "state", "region", "start", "pct"]
    headers = {**{c: c for c in plain}, **sinks.STATION_HEADERS}
    return rounded(_published(v, folder, "stations", headers, {**TEXT, "station": "bigint", "start": "date"}))


@file_query
def published_temperatures(v: Views, folder: str) -> DataFrame:
    """The histogram with the regions across, found in the data."""
    regions = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
    headers = {"temp_c": "temp", **{x: x for x in regions}}
    return _published(v, folder, "temperatures", headers, {"temp_c": "int", **dict.fromkeys(regions, "bigint")})


@file_query
def published_state_means(v: Views, folder: str) -> DataFrame:
    return rounded(_published(v, folder, "state_means", sinks.STATE_MEAN_HEADERS))


def _measures(df: DataFrame) -> DataFrame:
    """Rates to six places, amounts to two."""
    rates = [c for c in budget.STATE_MEANS if c != "n" and c in df.columns]
    amounts = [c for c, kind in df.dtypes if kind == "double" and c not in rates]
    return df.withColumns({**{c: F.round(F.col(c), 6) for c in rates}, **{c: F.round(F.col(c), 2) for c in amounts}})


@file_query
def published_state_budget(v: Views, folder: str) -> DataFrame:
    return _measures(_published(v, folder, "state_budget", sinks.STATE_BUDGET_HEADERS))


@file_query
def published_region_budget(v: Views, folder: str) -> DataFrame:
    return _measures(_published(v, folder, "region_budget", sinks.REGION_HEADERS))


@file_query
def published_nation_budget(v: Views, folder: str) -> DataFrame:
    return _measures(_published(v, folder, "nation_budget", sinks.NATION_HEADERS))


@file_query
def published_long_budget(v: Views, folder: str) -> DataFrame:
    """The union of all levels; places above the state have an empty cell for it."""
    return rounded(_published(v, folder, "long_budget", sinks.LONG_HEADERS), 2)
