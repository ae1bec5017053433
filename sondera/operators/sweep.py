"""Windows of any start, step and length over the readings, without a range join.

Window ``i`` begins at ``begin`` plus ``i`` steps and ends a length later.  Starts and ends
both never decrease, so the windows that hold a time are those from one number to
another, and both numbers follow from the time alone.  A reading adds 1 from
its first window on and takes it off after its last one; sums of these
differences along the windows count the readings of every window.  Equal pairs of
numbers are counted before anything is shuffled, so a key costs two rows per window
start at most, however many readings it has.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondera.functions.numeric import half_even
from sondera.functions.calendar import wall_micros
from sondera.operators.coverage import GRID
from sondera.operators.histogram import fill_grid

MICROS = {"second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86_400 * 10**6, "week": 7 * 86_400 * 10**6}
#: Adding whole months moves a day by no more than this, where a month is too short for it.
SHIFT = 4


@dataclass(frozen=True)
class Every:
    """A step or a length: ``n`` seconds, minutes, hours, days, weeks, months or years."""

    n: int
    unit: str = "month"

    def __post_init__(self) -> None:
        if self.n < 1 or self.unit not in (*MICROS, "month", "year"):
            raise ValueError(f"no step: {self.n} {self.unit}")

    @property
    def months(self) -> int:
        """Its months; 0 for a length that is the same everywhere."""
        return {"month": self.n, "year": 12 * self.n}.get(self.unit, 0)

    @property
    def micros(self) -> int:
        return MICROS.get(self.unit, 0) * self.n

    def interval(self) -> Column:
        return F.expr(f"interval {self.n} {self.unit}")

    def after(self, t: Column, times: Column | int = 1) -> Column:
        """``t`` and ``times`` of it; months that are too short end on their last day."""
        times = F.lit(times) if isinstance(times, int) else times
        t = t.cast("timestamp_ntz")
        if self.months:
            return t + F.make_ym_interval(F.lit(0), (times * self.months).cast("int"))
        return t + F.expr(f"interval '{self.micros // 10**6}' second") * times


def last_started(t: Column, begin: Column, step: Every, ago: int = 0) -> Column:
    """Number of the last window that begins at ``t`` or before; negative before ``begin``.

    Of steps that are the same everywhere, ``ago`` is taken off ``t`` first, in microseconds.
    """
    if not step.months:
        passed = wall_micros(t) - wall_micros(begin) - F.lit(ago).cast("bigint")
        return F.call_function("div", passed - F.pmod(passed, F.lit(step.micros)), F.lit(step.micros))
    whole = (F.year(t) - F.year(begin)) * 12 + F.month(t) - F.month(begin)
    near = F.floor(whole / step.months).cast("bigint")
    return F.when(step.after(begin, near) <= t, near).otherwise(near - 1)


def first_open(t: Column, begin: Column, step: Every, length: Every) -> Column:
    """Number of the first window that ends after ``t``."""
    if not (length.months or step.months):
        return last_started(t, begin, step, ago=length.micros) + 1
    if not length.months:
        return last_started(length.after(t, -1), begin, step) + 1
    # the starts a length before t, give or take the days that months can shift
    sure = last_started(length.after(t, -1) - F.expr(f"interval {SHIFT} day"), begin, step)
    more = 3 if step.months else math.ceil(2 * SHIFT * MICROS["day"] / step.micros) + 1
    closed = F.filter(
        F.sequence(F.lit(1).cast("bigint"), F.lit(more).cast("bigint")),
        lambda j: length.after(step.after(begin, sure + j)) <= t,
    )
    return sure + 1 + F.size(closed)


def in_span(t: Column, start: Column, length: Every) -> Column:
    """Half-open test ``start <= t < start + length``."""
    t = t.cast("timestamp_ntz")
    return (t >= start.cast("timestamp_ntz")) & (t < length.after(start))


def expected_in(start: Column, length: Every, per_day: float) -> Column:
    """Readings that a complete window holds: its days, with their fraction, times ``per_day``."""
    micros = wall_micros(length.after(start)) - wall_micros(start.cast("timestamp_ntz"))
    return micros / F.lit(float(MICROS["day"])) * F.lit(per_day)


def time_span(readings: DataFrame, t: str = "t") -> tuple[Column, Column]:
    """First and last time of the data, from one scalar subquery."""
    both = readings.agg(F.struct(F.min(t).alias("first"), F.max(t).alias("last"))).scalar()
    return both["first"].cast("timestamp_ntz"), both["last"].cast("timestamp_ntz")


def sweep(
    readings: DataFrame,
    step: Every,
    length: Every,
    keys: Sequence[str] = ("station",),
    t: str = "t",
    begin: Column | None = None,
    end: Column | None = None,
) -> DataFrame:
    """``keys``, ``window``, ``start`` and ``n``, the readings in each window of each key, zeros included.

    Windows begin every ``step`` from ``begin`` (by default the first time of the
    data) to ``end`` (the last) and may reach past it.  Readings without a time
    are in no window; keys that have no reading in any window do not appear.
    """
    if begin is None or end is None:
        first, last = time_span(readings, t)
        begin = first if begin is None else begin
        end = last if end is None else end
    # columns first: a scalar subquery can't stand inside a higher-order function
    first_start, time, last_window = F.col("_begin"), F.col("_t"), F.col("_last")
    ends = {"_begin": begin.cast("timestamp_ntz"), "_end": end.cast("timestamp_ntz")}
    final = {"_last": last_started(F.col("_end"), first_start, step)}
    ranges = (
        readings.filter(F.col(t).isNotNull())
        .select(*keys, F.col(t).cast("timestamp_ntz").alias("_t"))
        .withColumns(ends)
        .select(
            *keys,
            F.greatest(first_open(time, first_start, step, length), F.lit(0).cast("bigint")).alias("_from"),
            F.least(last_started(time, first_start, step), last_started(F.col("_end"), first_start, step)).alias("_to"),
        )
        .filter("_from <= _to")
        .groupBy(*keys, "_from", "_to")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    change = F.explode(
        F.array(
            F.struct(F.col("_from").alias("window"), F.col("_n").alias("change")),
            F.struct((F.col("_to") + 1).alias("window"), (-F.col("_n")).alias("change")),
        )
    )
    along = W.partitionBy(*keys).orderBy("window")
    upto = along.rowsBetween(W.unboundedPreceding, 0)
    sums = (
        ranges.select(*keys, change.alias("_c"))
        .select(*keys, "_c.*")
        .groupBy(*keys, "window")
        .agg(F.sum("change").alias("change"))
        .withColumns(ends)
        .withColumns(final)
        .withColumns(
            {
                "n": F.sum("change").over(upto),
                "_stop": F.least(F.lead("window").over(along) - 1, last_window),
                "_first": F.row_number().over(along) == 1,
            }
        )
    )
    # a count holds until the next change; the windows before the first change are empty
    pieces = F.filter(
        F.array(
            F.struct(F.lit(0).cast("bigint").alias("a"), F.when(F.col("_first"), F.col("window") - 1).alias("b"), F.lit(0).cast("bigint").alias("n")),
            F.struct(F.col("window").alias("a"), F.coalesce("_stop", last_window).alias("b"), F.col("n").alias("n")),
        ),
        lambda p: p["a"] <= p["b"],
    )
    return (
        sums.select(*keys, "_begin", F.explode(pieces).alias("_p"))
        .select(*keys, "_begin", F.explode(F.sequence("_p.a", "_p.b")).alias("window"), F.col("_p.n").alias("n"))
        .select(*keys, "window", step.after(first_start, F.col("window")).alias("start"), "n")
    )


def sweep_coverage(
    readings: DataFrame,
    step: Every,
    length: Every,
    key: str = "station",
    t: str = "t",
    begin: Column | None = None,
    end: Column | None = None,
    per_day: float = 240,
) -> DataFrame:
    """``sweep`` with the expected count and the share, for ``coverage.best_window`` and its like."""
    expected = expected_in(F.col("start"), length, per_day)
    return sweep(readings, step, length, [key], t, begin, end).select(
        key, "start", "n", expected.alias("expected"), (F.col("n") / expected).alias("pct")
    )


def within(
    readings: DataFrame,
    windows: DataFrame,
    length: Every,
    key: str = "station",
    t: str = "t",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Raw readings inside their key's windows (``key``, ``start``), which may begin anywhere.

    Each window is written out as the days or months that it touches, whichever are fewer than
    about thirty, so the test is an equality on (key, day or month) and only then on the time.
    """
    unit = "day" if 0 < length.micros <= 31 * MICROS["day"] else "month"
    cell = lambda x: F.date_trunc(unit, x).cast("timestamp_ntz")
    start = F.col("start").cast("timestamp_ntz")
    cells = F.sequence(cell(start), cell(length.after(start) - F.expr("interval 1 microsecond")), F.expr(f"interval 1 {unit}"))
    chosen = windows.select(F.col(key), *[c for c in keep if c != "start"], start.alias("start"), F.explode(cells).alias("_cell"))
    placed = readings.withColumn("_cell", cell(F.col(t).cast("timestamp_ntz")))
    own = [c for c in readings.columns if c != key]
    joined = placed.join(chosen.withColumnRenamed("start", "_start"), [key, "_cell"]).filter(in_span(F.col(t), F.col("_start"), length))
    return joined.select(key, *own, *[F.col("_start").alias("start") if c == "start" else F.col(c) for c in keep])


def span_histogram(
    readings: DataFrame,
    windows: DataFrame,
    length: Every,
    key: str = "station",
    t: str = "t",
    v: str = "v",
    grid: tuple[int, int] = GRID,
) -> DataFrame:
    """Readings per key, start and whole temperature in the key's windows, zero bins included."""
    shown = half_even(F.col(v), 0)
    bin_ = F.when(shown.between(*grid), shown).cast("int").alias("bin")
    counted = (
        within(readings, windows, length, key, t, keep=["start"])
        .groupBy(key, "start", bin_)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    empty = windows.select(key, F.col("start").cast("timestamp_ntz").alias("start"), F.lit(None).cast("int").alias("bin"), F.lit(0).cast("bigint").alias("n"))
    both = counted.unionByName(empty).groupBy(key, "start", "bin").agg(F.sum("n").alias("n"))
    return fill_grid(both, [key, "start"], grid)
