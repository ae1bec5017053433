"""Windows of any start, step and length against plain loops."""

from __future__ import annotations

import calendar
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sondera.functions.calendar import wall_micros
from sondera.operators.coverage import best_window, coverage, monthly_bins, monthly_counts
from sondera.operators.sweep import Every, first_open, in_span, last_started, span_histogram, sweep, sweep_coverage, within

SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800}


def after(t, every, times=1):
    if every.unit in SECONDS:
        return t + dt.timedelta(seconds=SECONDS[every.unit] * every.n * times)
    m = t.month - 1 + every.months * times
    year, month = t.year + m // 12, m % 12 + 1
    return t.replace(year=year, month=month, day=min(t.day, calendar.monthrange(year, month)[1]))


def readings(seed=1, n=400):
    rng = random.Random(seed)
    base = dt.datetime(2019, 12, 31, 13, 30)
    rows = [("dense", base + dt.timedelta(seconds=rng.randrange(500 * 86_400)), rng.randrange(-30, 130) / 2) for _ in range(n)]
    rows += [("copy", base + dt.timedelta(days=300), 5.0)] * 50
    rows += [("sparse", base + dt.timedelta(days=rng.randrange(500), microseconds=rng.randrange(10**6)), 1.5) for _ in range(9)]
    # borders: a start, a microsecond before it, an end, leap days
    rows += [("edge", base, 1.0), ("edge", base + dt.timedelta(days=7, microseconds=-1), 2.0), ("edge", dt.datetime(2020, 2, 29), None)]
    rows += [("edge", dt.datetime(2021, 2, 28, 23, 59, 59, 999_999), 3.0), ("lost", None, 1.0), ("dense", None, 2.0), (None, base + dt.timedelta(days=40), 2.0)]
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "station string, t timestamp_ntz, v double").repartition(parts)


def plain(rows, step, length, begin=None, end=None):
    times = [t for _, t, _ in rows if t is not None]
    begin, end = begin or min(times), end or max(times)
    starts, i = [], 0
    while after(begin, step, i) <= end:
        starts.append(after(begin, step, i))
        i += 1
    out = {}
    for s in {r[0] for r in rows}:
        own = [t for k, t, _ in rows if k == s and t is not None]
        counts = [(a, sum(a <= t < after(a, length) for t in own)) for a in starts]
        if any(n for _, n in counts):
            out |= {(s, a): n for a, n in counts}
    return out


CASES = [
    (Every(7, "day"), Every(90, "day")),
    (Every(1, "week"), Every(3, "day")),
    (Every(1, "month"), Every(12, "month")),
    (Every(2, "month"), Every(1, "month")),
    (Every(1, "month"), Every(45, "day")),
    (Every(5, "day"), Every(1, "month")),
    (Every(30, "hour"), Every(1, "year")),
    (Every(13, "hour"), Every(36, "hour")),
]


@pytest.mark.parametrize("step, length", CASES, ids=lambda e: f"{e.n}{e.unit}")
def test_counts(spark, step, length):
    rows = readings()
    got = {(r.station, r.start): r.n for r in sweep(frame(spark, rows), step, length).collect()}
    assert got == plain(rows, step, length)


@pytest.mark.parametrize("begin", [dt.datetime(2020, 1, 31), dt.datetime(2019, 6, 1, 6), dt.datetime(2020, 8, 31, 23, 59, 59)])
@pytest.mark.parametrize("step, length", [CASES[0], CASES[2], CASES[5]], ids=lambda e: f"{e.n}{e.unit}")
def test_given_bounds(spark, begin, step, length):
    rows, end = readings(2, 150), dt.datetime(2021, 3, 30)
    bounds = {"begin": F.lit(begin).cast("timestamp_ntz"), "end": F.lit(end).cast("timestamp_ntz")}
    got = {(r.station, r.start): r.n for r in sweep(frame(spark, rows), step, length, **bounds).collect()}
    assert got == plain(rows, step, length, begin, end)


def test_agrees_with_whole_months(spark):
    rows = [(s, t and t.replace(hour=0, minute=0, second=0, microsecond=0), v) for s, t, v in readings()]
    df = frame(spark, rows)
    begin = F.lit(dt.date(2019, 12, 1))
    monthly = coverage(monthly_counts(monthly_bins(df)), begin=begin, end=F.lit(dt.date(2021, 5, 1)), per_day=1)
    swept = sweep_coverage(df, Every(1), Every(12), begin=begin, end=F.lit(dt.date(2021, 5, 1)), per_day=1)
    columns = ["station", F.col("start").cast("date").alias("start"), "n", F.col("expected").cast("bigint").alias("expected"), "pct"]
    have = {tuple(r) for r in swept.select(*columns).collect()}
    assert have == {tuple(r) for r in monthly.select(*columns).filter("station <> 'lost' OR station IS NULL").collect()}


def test_work_before_the_shuffle_is_bounded_by_the_windows(spark):
    """A key with very many readings sends two rows for each window start at most."""
    start = dt.datetime(2020, 1, 1)
    df = spark.range(200_000, numPartitions=2).select(
        F.lit("hot").alias("station"), (F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("id") * 60).cast("decimal(18,6)"))).alias("t")
    )
    out = sweep(df, Every(7, "day"), Every(28, "day"))
    total = out.agg(F.sum("n"), F.count("*")).first()
    assert total[1] == 20 and total[0] > 3 * 200_000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "Join" not in plan


def test_readings_within_windows(spark):
    rows = readings()
    df = frame(spark, rows)
    for length in (Every(90, "day"), Every(9, "day"), Every(1, "month"), Every(5, "hour")):
        windows = best_window(sweep_coverage(df, Every(7, "day"), length))
        chosen = {r.station: r.start for r in windows.collect()}
        got = sorted(((r.station, r.t, r.start) for r in within(df, windows, length, keep=["start"]).collect()), key=str)
        expected = [(s, t, chosen[s]) for s, t, _ in rows if t and s is not None and s in chosen and chosen[s] <= t < after(chosen[s], length)]
        assert got == sorted(expected, key=str)
        assert windows.count() == len(chosen)


def test_histogram_of_a_span(spark):
    rows = readings()
    df = frame(spark, rows)
    windows = best_window(sweep_coverage(df, Every(7, "day"), Every(90, "day"))).filter("station IS NOT NULL")
    chosen = {r.station: r.start for r in windows.collect()}
    got = {(r.station, r.temp_c): r.n for r in span_histogram(df, windows, Every(90, "day")).collect()}
    assert len(got) == len(chosen) * 56
    for (s, c), n in got.items():
        end = chosen[s] + dt.timedelta(days=90)
        assert n == sum(k == s and t is not None and chosen[s] <= t < end and v is not None and round(v) == c for k, t, v in rows)


def test_in_span(spark):
    df = frame(spark, readings())
    start, length = dt.datetime(2020, 1, 31, 12), Every(1, "month")
    got = df.filter(in_span(F.col("t"), F.lit(start).cast("timestamp_ntz"), length)).count()
    assert got == sum(t is not None and start <= t < dt.datetime(2020, 2, 29, 12) for _, t, _ in readings())


def test_nothing_to_count(spark):
    none = frame(spark, readings()).limit(0)
    assert sweep(none, *CASES[0]).count() == 0
    assert sweep(frame(spark, [("a", None, 1.0)]), *CASES[0]).count() == 0
    with pytest.raises(ValueError):
        Every(0, "day")
    with pytest.raises(ValueError):
        Every(1, "fortnight")


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_numbers_of_windows_are_whole_long_arithmetic(spark, zone):
    """No clock parts and no decimals for every reading; times before 1970 and before the begin count down."""
    times = [dt.datetime(1901, 5, 6, 7, 8, 9, 999_999), dt.datetime(1969, 12, 31, 23, 59, 59, 1), dt.datetime(2020, 3, 8, 2, 30), dt.datetime(2040, 1, 1)]
    begin, step, length = dt.datetime(2020, 1, 1, 0, 0, 0, 5), Every(13, "hour"), Every(36, "hour")
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(t,) for t in [*times, None]], "t timestamp_ntz")
        start = F.lit(begin.isoformat()).cast("timestamp_ntz")
        out = df.select("t", wall_micros(F.col("t")).alias("m"), last_started(F.col("t"), start, step).alias("last"), first_open(F.col("t"), start, step, length).alias("first"))
        micros = lambda d: (d.days * 86_400 + d.seconds) * 10**6 + d.microseconds
        for r in out.collect():
            if r.t is None:
                assert (r.m, r["last"], r["first"]) == (None, None, None)
                continue
            passed = micros(r.t - begin)
            assert r.m == micros(r.t - dt.datetime(1970, 1, 1))
            assert r["last"] == passed // step.micros and r["first"] == (passed - length.micros) // step.micros + 1
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert not any(part in plan for part in ("secondwithfraction", "extract", "hour(", "unix_date", "decimal", "make_dt_interval"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
