from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from sondera.operators.stations import missing_series, station_metadata, with_series
from sondera.sources import generators, readers, sinks
from sondera.sources.ingest import (
    distinct_readings,
    failed_pages,
    ingest_pages,
    page_of,
    plan_requests,
    read_pages,
    trim_range,
)
from sondera.streaming import ingest
from sondera.streaming.ingest import append_new, ingest_stream, stored_readings


def save(path, text):
    path.write_text(text)
    return str(path)


def date(text):
    return F.lit(text).cast("date")


@pytest.mark.parametrize(
    "end, pages",
    [
        ("2010-03-02", [("20100101", "20100131"), ("20100131", "20100302")]),
        (
            "2010-03-10",
            [("20100101", "20100131"), ("20100131", "20100302"), ("20100302", "20100311")],
        ),
        ("2010-01-02", [("20100101", "20100103")]),
        ("2010-01-01", []),
    ],
)
def test_request_plan(spark, end, pages):
    stations = spark.createDataFrame([("a",)], "station string")
    plan = plan_requests(stations, date("2010-01-01"), date(end))
    assert [(r.chunk_begin, r.chunk_end) for r in plan.orderBy("page_from").collect()] == pages


def test_long_plan_has_one_row_per_page(spark):
    stations = spark.createDataFrame([("a",), ("b",)], "station string")
    plan = plan_requests(stations, date("2010-01-01"), date("2020-09-01"))
    assert plan.count() == 2 * 130


def test_page_of_meets_the_plan(spark):
    stations = spark.createDataFrame([("a",)], "station string")
    begin, end = date("2010-01-01"), date("2010-12-24")
    days = generators.calendar(stations, begin, end, ["station"])
    pages = days.select("station", page_of(F.col("day"), begin).alias("chunk_begin"))
    assert failed_pages(plan_requests(stations, begin, end), pages).count() == 0


def page(rows):
    return "station,chunk_begin,t,v,f\n" + "".join(",".join(r) + "\n" for r in rows)


@pytest.fixture()
def landing(tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    shared = ("2010-01-31 00:00:00", "5.5", "0")
    save(folder / "a1.csv", page([("a", "20100101", "2010-01-01 00:00:00", "4.0", "0"), ("a", "20100101", *shared)]))
    save(folder / "a2.csv", page([("a", "20100131", *shared), ("a", "20100131", "2010-02-28 10:00:00", "NA", "0")]))
    save(
        folder / "b1.csv",
        page([("b", "20100101", "2010-03-02 00:00:00", "7.0", "0"), ("b", "20100101", "2010-03-02 00:06:00", "8.0", "0")]),
    )
    save(folder / "z1.csv", page([("z", "20100101", "2010-01-05 00:00:00", "1.0", "0")]))
    return folder


def test_page_ingest(spark, landing):
    stations = spark.createDataFrame([("a",), ("b",), ("c",)], "station string")
    begin, end = date("2010-01-01"), date("2010-03-02")
    plan = plan_requests(stations, begin, end)
    readings, failed = ingest_pages(spark, str(landing), plan, begin, end)
    got = sorted((r.station, r.t, r.v) for r in readings.collect())
    assert got == [
        ("a", dt.datetime(2010, 1, 1), 4.0),
        ("a", dt.datetime(2010, 1, 31), 5.5),
        ("b", dt.datetime(2010, 3, 2), 7.0),  # the end counts up to its first midnight
    ]
    assert sorted((r.station, r.chunk_begin) for r in failed.collect()) == [
        ("b", "20100131"), ("c", "20100101"), ("c", "20100131")
    ]


def stored(spark, out):
    return sorted(map(tuple, stored_readings(spark, out).select("station", "t", "v", "f").collect()))


def in_batch(spark, folder):
    pages = read_pages(spark, str(folder)).filter("t IS NOT NULL AND v IS NOT NULL")
    return sorted(map(tuple, distinct_readings(pages.select("station", "t", "v", "f")).collect()))


def test_stream_equals_batch(spark, landing, tmp_path):
    out = str(tmp_path / "out")
    ingest_stream(spark, str(landing), out).awaitTermination()
    first = in_batch(spark, landing)
    assert stored(spark, out) == first
    # later pages: a copy of an old reading, and a reading far older than all others
    save(
        landing / "b2.csv",
        page([("b", "20100131", "2010-03-02 00:00:00", "7.0", "0"), ("b", "20100131", "1999-01-01 00:00:00", "3.0", "0")]),
    )
    ingest_stream(spark, str(landing), out).awaitTermination()
    assert stored(spark, out) == sorted([*first, ("b", dt.datetime(1999, 1, 1), 3.0, "0")]) == in_batch(spark, landing)
    ingest_stream(spark, str(landing), out).awaitTermination()  # nothing new
    assert stored(spark, out) == in_batch(spark, landing)


def test_stream_takes_old_files_and_null_flags(spark, landing, tmp_path):
    out = str(tmp_path / "out")
    ingest_stream(spark, str(landing), out).awaitTermination()
    for age, name in ((10, "old"), (90, "older"), (0, "new")):
        rows = [("s", "20100101", f"2011-01-0{1 + age // 45} 00:00:00", "1.0", ""), ("a", "20100101", "2010-01-01 00:00:00", "4.0", "0")]
        path = save(landing / f"{name}.csv", page(rows))
        then = os.path.getmtime(path) - age * 86400
        os.utime(path, (then, then))
    ingest_stream(spark, str(landing), out).awaitTermination()
    assert stored(spark, out) == in_batch(spark, landing)
    assert sum(r[0] == "s" for r in stored(spark, out)) == 2


def test_a_replayed_batch_and_two_feeds(spark, landing, tmp_path):
    out, pages = str(tmp_path / "out"), read_pages(spark, str(landing))
    for feed, batch in (("x", 0), ("x", 0), ("x", 1), ("y", 0), ("y", 0)):
        append_new(pages, out, feed, batch)
        assert stored(spark, out) == in_batch(spark, landing)
    other, second = tmp_path / "other", str(tmp_path / "second")
    other.mkdir()
    save(other / "q.csv", page([("q", "20100101", "2010-01-01 00:00:00", "4.0", "0")]))
    ingest_stream(spark, str(landing), str(tmp_path / "first")).awaitTermination()
    ingest_stream(spark, str(other), second).awaitTermination()
    assert stored(spark, second) == in_batch(spark, other)
    assert stored(spark, str(tmp_path / "first")) == in_batch(spark, landing)


def files_read(df):
    return df.select(F.col("_metadata.file_path")).distinct().count()


def month_pages(spark, month, n=40, shift=0.0):
    rows = [(f"s{i % 20}", "x", dt.datetime(2010 + month // 12, month % 12 + 1, 1 + i % 28, i % 24), i + shift, "0") for i in range(n)]
    return spark.createDataFrame(rows, "station string, chunk_begin string, t timestamp_ntz, v double, f string")


def test_a_batch_reads_the_cells_it_touches(spark, tmp_path):
    """The tenth batch reads no more than the first, and one that comes again no more than its month."""
    out, read = str(tmp_path / "out"), []
    for batch in range(10):
        pages = month_pages(spark, batch)
        before = stored_readings(spark, out)
        fresh = pages.withColumns(ingest._cell_columns())
        read.append(0 if before is None else files_read(ingest.touched(before, fresh)))
        append_new(pages, out, "x", batch)
    assert read == [0] * 10
    stored = stored_readings(spark, out)
    again = month_pages(spark, 3).withColumns(ingest._cell_columns())
    assert 0 < files_read(ingest.touched(stored, again)) <= 20 < files_read(stored)
    # the same readings in another feed, and late ones among old
    late = month_pages(spark, 3).unionByName(month_pages(spark, 3, 60))
    append_new(late, out, "y", 0)
    assert stored_readings(spark, out).count() == 10 * 40 + 20
    assert stored_readings(spark, out).filter("feed = 'y'").count() == 20


def test_compaction(spark, tmp_path):
    out, months = str(tmp_path / "out"), [month_pages(spark, m, 30 + m, s) for m, s in ((0, 0.0), (1, 0.0), (0, 0.5), (2, 0.0), (1, 0.5))]
    assert ingest.compact(spark, out) == 0
    for batch, pages in enumerate(months):
        append_new(pages, out, "x", batch)
    rows, files = stored(spark, out), files_read(stored_readings(spark, out))
    assert ingest.compact(spark, out) == 1
    assert stored(spark, out) == rows and files_read(stored_readings(spark, out)) < files
    assert {r.feed for r in stored_readings(spark, out).select("feed").distinct().collect()} == {"compacted"}
    # replays of what is compacted, new batches, other feeds, and another compaction
    append_new(months[1], out, "x", 1)
    append_new(months[0], out, "y", 0)
    assert stored(spark, out) == rows
    append_new(month_pages(spark, 7), out, "x", 5)
    assert len(stored(spark, out)) == len(rows) + 40
    rows = stored(spark, out)
    assert ingest.compact(spark, out) == 2 and stored(spark, out) == rows
    # one that broke off before its log entry changes nothing
    stored_readings(spark, out).select("station", "t", "v", "f", "month", "slot").limit(5).write.partitionBy("month", "slot").parquet(
        f"{out}/feed=compacted/batch=3"
    )
    assert stored(spark, out) == rows
    append_new(month_pages(spark, 8), out, "x", 6)
    assert ingest.compact(spark, out) == 3 and len(stored(spark, out)) == len(rows) + 40


def test_trim_bounds(spark):
    rows = [("2010-01-01 00:00:00", 1.0), ("2009-12-31 23:59:59", 1.0), ("2010-02-01 00:00:00", 1.0),
            ("2010-02-01 00:00:01", 1.0), ("2010-01-15 00:00:00", None)]
    df = spark.createDataFrame(rows, "t string, v double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    assert trim_range(df, date("2010-01-01"), date("2010-02-01")).count() == 2


def test_incubation_scan_by_name(spark, tmp_path):
    path = save(
        tmp_path / "gas.csv",
        "Extra,Date,Time,Time.Point,day,ElapsedDays,Bottle,Treatment,Depth,Rep,CO2.sys.ppm.p,CH4.sys.ppm.p,"
        "CO2.air.ppm,CH4.air.ppm,CO2.sys.ppm,CH4.sys.ppm,More\n"
        "x,1/2/20,10:00,T12,0,0.1,IB 20-S1,IB 20,S,1,opened bottles to atmosphere,2,400,2,NA,2.5,y\n",
    )
    row = readers.incubation_names(readers.read_incubation(spark, path)).first()
    assert (row.bottle, row.day, row.CO2_sys_ppm_p) == ("IB 20-S1", 0.0, "opened bottles to atmosphere")
    assert row.CO2_sys_ppm is None and row.CH4_sys_ppm == 2.5 and len(row) == 16
    assert row.time_order == 12.0


def test_sensor_scan(spark, tmp_path):
    path = save(
        tmp_path / "s.csv",
        "id,start_datetime,result_value\n1,1/5/2008 9:30,26.5\n2,12/31/2008 23:00,27.5\n3,1/6/2008 0:00,bad\n",
    )
    rows = readers.read_sensor(spark, path).orderBy("t").collect()
    assert [tuple(r) for r in rows] == [
        (dt.datetime(2008, 1, 5, 9, 30), 26.0), (dt.datetime(2008, 12, 31, 23), 28.0)
    ]


def test_station_tables(spark, tmp_path):
    listed = save(
        tmp_path / "list.csv",
        'StationID,Name,State,Region\n1,"Port A, North",AA,Gulf\n2,Lake B,BB,Great Lakes\n3,C,CC,Pacific\n',
    )
    stations = readers.read_station_list(spark, listed)
    assert sorted(r.station for r in stations.collect()) == ["C.CC", "PortANorth.AA"]
    meta = save(
        tmp_path / "meta.csv",
        "id,name,lat,lon,State,Region,ObjName\n1,\"Port A, North\",28.1,-97.0,AA,Gulf,PortANorth.AA\n9,Q,1,2,NA,NA,NA\n",
    )
    rows = readers.read_station_metadata(spark, meta).collect()
    assert [(r.station, r.lat) for r in rows] == [("PortANorth.AA", 28.1)]
    responses = spark.createDataFrame(
        [("1", "Port A, North", "28.1", "-97"), ("x", "C", "bad", "1")], "id string, name string, lat string, lon string"
    )
    joined = {r.name: r for r in station_metadata(responses, stations).collect()}
    assert (joined["Port A, North"].State, joined["Port A, North"].lon) == ("AA", -97.0)
    assert (joined["C"].id, joined["C"].lat, joined["C"].State) == (None, None, None)


def test_shoreline_with_a_repeated_header(spark, tmp_path):
    path = save(
        tmp_path / "shore.csv",
        "Region,Abb,State,Hard (km),Hard (km),Marsh shore (km)\nGulf,AA,Aland,1,2,33\nGulf,BB,Bland,,,\n",
    )
    rows = readers.read_shoreline(spark, path).orderBy("state").collect()
    assert [tuple(r) for r in rows] == [("Gulf", "AA", 33.0), ("Gulf", "BB", None)]


def test_carbon(spark, tmp_path):
    path = save(tmp_path / "c.csv", "Bottle,C.g,C.mol\nIB 20-S1,0.09,0.008\nIB 20-S2,NaN,NaN\n")
    assert [r.c_mol for r in readers.read_carbon(spark, path).orderBy("bottle").collect()] == [0.008, None]


def readings(spark):
    rows = [(s, dt.datetime(y, 3, 1 + d, d), d + 0.5, "0,0,0") for s in ("A.AA", "B.BB") for y in (2019, 2020) for d in range(5)]
    return spark.createDataFrame(rows, "station string, t timestamp_ntz, v double, f string")


def test_series_files_and_missing_ones(spark, tmp_path):
    folder = tmp_path / "series"
    folder.mkdir()
    save(folder / "A.AA.csv", '"t","v","f"\n2010-06-25 16:00:00,26.1,"0,0,0"\n2010-06-26,NA,"0,0,0"\nrubbish,2,"1"\n')
    save(folder / "Z.ZZ.csv", '"t","v","f"\n2010-06-25 16:00:00,1,"0"\n')
    stations = spark.createDataFrame([("A.AA",), ("B.BB",)], "station string")
    found, missing = readers.read_station_series(spark, str(folder), stations)
    rows = sorted(map(tuple, found.collect()), key=str)
    assert len(rows) == 3 and {r[0] for r in rows} == {"A.AA"}
    assert ("A.AA", dt.datetime(2010, 6, 25, 16), 26.1, "0,0,0") in rows
    assert ("A.AA", dt.datetime(2010, 6, 26), None, "0,0,0") in rows
    assert [r.station for r in missing.collect()] == ["B.BB"]
    assert [r.station for r in missing_series(stations, found).collect()] == ["B.BB"]
    assert [r.station for r in with_series(stations, found).collect()] == ["A.AA"]


def test_series_round_trips(spark, tmp_path):
    df = readings(spark)
    expected = sorted(map(tuple, df.collect()))
    parquet = str(tmp_path / "parquet")
    sinks.write_series(df, parquet)
    assert sorted(os.listdir(parquet))[-2:] == ["year=2019", "year=2020"]
    back = readers.read_series(spark, parquet).select("station", "t", "v", "f")
    assert sorted(map(tuple, back.collect())) == expected


def test_stations_of_a_working_copy(spark, tmp_path):
    path = str(tmp_path / "parquet")
    df = readings(spark)
    sinks.write_series(df, path)
    table = readers.series_stations(spark, path)
    assert sorted(table.columns) == ["first", "last", "n", "station", "year"]
    assert table.agg(F.sum("n")).first()[0] == df.count() == readers.read_series(spark, path).count()
    names = sorted({r.station for r in df.collect()})
    listed = spark.createDataFrame([(n,) for n in [*names, "none"]], "station string")
    missing = missing_series(listed, table)
    assert [r.station for r in missing.collect()] == ["none"]
    # nothing but the small table is opened
    assert all("/_stations/" in f for f in missing.inputFiles() if f.startswith("file"))
    assert sorted(r.station for r in with_series(listed, table).collect()) == names


def test_buckets_are_joined_where_they_lie(spark, tmp_path):
    from sondera.operators.coverage import best_window, coverage, monthly_bins, monthly_counts, restrict_to_window

    rows = [(f"s{i % 9}", dt.datetime(2019, 1, 1) + dt.timedelta(hours=37 * i), float(i % 50), "0") for i in range(900)]
    df = spark.createDataFrame(rows, "station string, t timestamp_ntz, v double, f string")
    best = best_window(coverage(monthly_counts(monthly_bins(df)), per_day=1)).select("station", "start")
    best = spark.createDataFrame(best.collect(), best.schema)
    expected = sorted(map(tuple, restrict_to_window(df, best).select("station", "t", "v").collect()))
    name = "bucketed_readings"
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        sinks.write_bucketed(df, name, 8)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        inside = restrict_to_window(spark.table(name), best)
        assert sorted(map(tuple, inside.select("station", "t", "v").collect())) == expected
        plan = inside._jdf.queryExecution().executedPlan().toString()
        indent = lambda line: len(line) - len(line.lstrip(" :+-"))
        lines = plan.split("== Initial Plan ==")[0].splitlines()
        at = next(i for i, line in enumerate(lines) if "FileScan" in line)
        parents, level = [], indent(lines[at])
        for line in reversed(lines[:at]):
            if indent(line) < level:
                parents.append(line)
                level = indent(line)
        assert parents and not any("Exchange" in line for line in parents)
        assert "Bucketed: true" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_station_files_round_trip(spark, tmp_path):
    names = ["A B.TX", "A#1.TX", "A%1.TX", "O'Connor.TX", "A+B.TX", "plain.TX", "[x]{y}.TX"]
    rows = [(s, dt.datetime(2020, 3, d), d + 0.5, "0,0,0") for s in names for d in (1, 2)]
    df = spark.createDataFrame(rows, "station string, t timestamp_ntz, v double, f string")
    path = str(tmp_path / "csv")
    sinks.write_station_files(df, path)
    stations = spark.createDataFrame([(s,) for s in [*names[:-1], "none.TX"]], "station string")
    found, missing = readers.read_station_series(spark, path, stations)
    assert sorted(map(tuple, found.select("station", "t", "v", "f").collect())) == sorted(r for r in rows if r[0] != names[-1])
    assert [r.station for r in missing.collect()] == ["none.TX"]
    assert sorted({r.station for r in readers.read_series_csv(spark, path).collect()}) == sorted(names)


def test_times_keep_their_microseconds(spark, tmp_path):
    rows = [("a", dt.datetime(2020, 3, 1, 4, 5, 6, us), 1.5, "0") for us in (0, 1, 123456, 999999)]
    df = spark.createDataFrame(rows, "station string, t timestamp_ntz, v double, f string")
    path = str(tmp_path / "csv")
    sinks.write_station_files(df, path)
    assert sorted(map(tuple, readers.read_series_csv(spark, path).select("station", "t", "v", "f").collect())) == rows
    table = str(tmp_path / "table")
    sinks.write_csv(df, table)
    kinds = {"station": "string", "t": "timestamp_ntz", "f": "string"}
    assert sorted(map(tuple, readers.read_published(spark, table, {c: c for c in df.columns}, kinds).collect())) == rows


def test_shared_folder():
    from types import SimpleNamespace

    from sondera.session import shared_folder

    def session(master, **conf):
        return SimpleNamespace(conf=SimpleNamespace(get=conf.get), sparkContext=SimpleNamespace(master=master))

    assert shared_folder(session("local[4]"), "x") != shared_folder(session("local[4]"), "x")
    named = session("spark://host:7077", **{"spark.checkpoint.dir": "s3a://bucket/tmp/"})
    assert shared_folder(named, "x").startswith("s3a://bucket/tmp/sondera-files/x-")
    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(session("spark://host:7077"), "x")


def test_one_file_for_each_station(spark, tmp_path):
    start = dt.datetime(2020, 1, 1)
    rows = [("long", start + dt.timedelta(hours=i), float(i), "0") for i in range(3000)]
    rows += [("burst", start + dt.timedelta(seconds=i), float(i), "0") for i in range(1000)]
    rows += [(f"s{i % 40}", start + dt.timedelta(days=i), 1.0, "0") for i in range(400)] + [("lost", None, 2.0, "0")]
    df = spark.createDataFrame(rows, "station string, t timestamp_ntz, v double, f string").repartition(7)
    path = str(tmp_path / "csv")
    sinks.write_station_files(df, path, rows_per_file=800)
    files = {d: [f for f in os.listdir(f"{path}/{d}") if f.endswith(".csv")] for d in os.listdir(path) if d.startswith("station=")}
    assert len(files) == 43 and {d for d, f in files.items() if len(f) > 1} == {"station=long", "station=burst"}
    lines = [sum(1 for _ in open(f"{path}/{d}/{f}")) - 1 for d in ("station=long", "station=burst") for f in files[d]]
    assert max(lines) <= 800 and sum(lines) == 4000 and len(files["station=long"]) <= 8
    back = readers.read_series_csv(spark, path).select("station", "t", "v", "f")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)


@pytest.mark.parametrize("named", [10_000, 0])
def test_only_files_of_listed_stations_are_opened(spark, tmp_path, named):
    folder = tmp_path / "series"
    folder.mkdir()
    for name in ("A.TX", "B.TX", "C.TX"):
        save(folder / f"{name}.csv", '"t","v","f"\n2010-06-25 16:00:00,26.1,"0"\n')
    if named:
        (folder / "broken.TX.csv.gz").write_bytes(b"this is no gzip file")  # reading it would fail
    stations = spark.createDataFrame([("A.TX",), ("C.TX",), ("A.TX",), ("D.TX",), (None,)], "station string")
    found, missing = readers.read_station_series(spark, str(folder), stations, named=named)
    assert sorted(r.station for r in found.collect()) == ["A.TX", "C.TX"]
    assert sorted((r.station for r in missing.collect()), key=str) == ["D.TX", None]


def test_files_by_name(spark, tmp_path):
    import gzip

    folder = tmp_path / "series"
    folder.mkdir()
    stations = spark.createDataFrame([(s,) for s in ("A B.TX", "A#1.TX", "A%1.TX", "empty.TX", "zipped.TX")], "station string")
    found, missing = readers.read_station_series(spark, str(folder), stations)
    assert found.count() == 0 and missing.count() == 5  # an empty folder
    head = '"t","v","f"\n'
    for name in ("A B.TX", "A#1.TX", "A%1.TX"):
        save(folder / f"{name}.csv", head + '2010-06-25 16:00:00,26.1,"0,0,0"\n')
    save(folder / "empty.TX.csv", head)
    with gzip.open(folder / "zipped.TX.csv.gz", "wt") as f:
        f.write(head + "2010-06-25 16:00:00,1,0\nrubbish,2,0\n")
    found, missing = readers.read_station_series(spark, str(folder), stations)
    assert sorted(r.station for r in found.collect()) == ["A B.TX", "A#1.TX", "A%1.TX", "zipped.TX", "zipped.TX"]
    assert missing.count() == 0  # a file with a header only is there
    assert [tuple(r) for r in readers.undated(found).collect()] == [("zipped.TX", 1)]


def test_csv_with_headers(spark, tmp_path):
    df = spark.createDataFrame([("s", 1.5, None)], "station string, loss_deep double, loss_shallow double")
    path = str(tmp_path / "out")
    sinks.write_csv(df, path, sinks.station_headers(df))
    lines = sorted(line for f in os.listdir(path) if f.endswith(".csv") for line in open(f"{path}/{f}"))
    assert lines[0].startswith("s,1.5,\n") or lines[1].startswith("s,1.5,")
    assert any(line.startswith("station,Deep Sed C Annual Decomp (mol C/mol C)") for line in lines)


def test_wide_histogram_file(spark, tmp_path):
    hist = spark.createDataFrame([("a", 1, 5), ("b", 1, 7), ("a", 2, 0)], "station string, temp_c int, n bigint")
    sinks.write_histogram_wide(hist, str(tmp_path / "wide"), ["a", "b"])
    got = spark.read.csv(str(tmp_path / "wide"), header=True, inferSchema=True).orderBy("temp").collect()
    assert [tuple(r) for r in got] == [(1, 5, 7), (2, 0, 0)]


def test_generators(spark):
    one = spark.range(1)
    days = generators.calendar(one, date("2010-01-01"), date("2020-12-31"))
    years = {r.year: r for r in generators.expected_per_year(days).collect()}
    assert (years[2019].slots, years[2020].slots, years[2020].hours) == (87600, 87840, 8784)
    assert generators.window_starts(one, date("2010-01-01"), date("2020-12-01")).count() == 132
    grid = generators.threshold_grid(one, F.lit(3), 0.01).collect()
    assert [r.k for r in grid] == [0, 1, 2, 3] and grid[3].portion == pytest.approx(0.03)


def test_small_files_without_a_second_shuffle(spark, tmp_path, monkeypatch):
    """Long stations are a table of its own before the readings move; no checksum file lies beside a CSV."""
    kept = []

    def staged(df):
        df.write.parquet(str(tmp_path / "staged"))
        kept.append(spark.read.parquet(str(tmp_path / "staged")))
        return kept[-1]

    monkeypatch.setattr(sinks, "stage", staged, raising=False)
    rows = [("long", dt.datetime(2020, 1, 1) + dt.timedelta(days=i), float(i), "0") for i in range(300)] + [("a=b station=c", dt.datetime(2020, 1, 1), 1.0, "0"), ("lost", None, 2.0, "0")]
    df = spark.createDataFrame(rows, "station string, t timestamp_ntz, v double, f string")
    path = tmp_path / "csv"
    sinks.write_station_files(df, str(path), rows_per_file=100)
    assert len(kept) == 1 and {r._station for r in kept[0].collect()} == {"long"}
    assert list(path.rglob("*.csv")) and not list(path.rglob(".*.crc"))
    back = readers.read_series_csv(spark, str(path)).select("station", "t", "v", "f")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)


def test_a_folder_is_listed_once(spark, tmp_path, monkeypatch):
    """Each of the two tables lists the folder once, without the other's scan."""
    for name in ("A.TX", "B%.TX"):
        save(tmp_path / f"{name}.csv", '"t","v","f"\n2010-06-25 16:00:00,26.1,"0"\n')
    stations = spark.createDataFrame([("B%.TX",), ("D.TX",), ("D.TX",), (None,)], "station string")
    listed = []
    for name in ("_all_files", "station_files"):
        monkeypatch.setattr(readers, name, lambda *a, f=getattr(readers, name), n=name: listed.append(n) or f(*a))
    assert [r.station for r in readers.listed_series(spark, str(tmp_path), stations).collect()] == ["B%.TX"]
    assert sorted((r.station for r in readers.missing_files(spark, str(tmp_path), stations).collect()), key=str) == ["D.TX", None]
    assert listed == ["_all_files", "station_files"]


def test_stations_are_dealt_over_all_shuffle_partitions(spark, tmp_path):
    """Many small files are as many tasks' work as the session has partitions, however few their bytes."""
    rows = [(f"s{i}", dt.datetime(2020, 1, 1), float(i), "0") for i in range(100)]
    sinks.write_station_files(spark.createDataFrame(rows, "station string, t timestamp_ntz, v double, f string"), str(tmp_path / "csv"))
    tasks = {f.name.split("-")[1] for f in (tmp_path / "csv").rglob("part-*.csv")}
    assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
