"""Every operator as a query over the test tables.

Doubles are rounded on the way out, because sums differ in their last digits
with the order of the rows; ``digits`` is chosen by the size of the numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondera.functions.calendar import month_start
from sondera.functions.exact import exact_avg, exact_sum
from sondera.functions.numeric import half_even, percent, signif
from sondera.functions.text import object_name, window_label
from sondera.operators import (
    budget,
    coverage,
    frame,
    gaps,
    histogram,
    incubation,
    layers,
    response,
    sensitivity,
    stations,
    summary,
)
from sondera.operators.sweep import Every, span_histogram, sweep, sweep_coverage, within
from sondera.plans import network
from sondera.plans.views import BOTTLE_KEYS, BOTTLE_ORDER, Views
from sondera.session import stage
from sondera.sources import generators, ingest

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# One reading a day is complete; synthetic stations reach about a third of it.
PER_DAY = 1
GATE = 0.30
OVERRIDES = {"IRAN": 66459.0}


def query(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    REGISTRY[fn.__name__] = lambda spark, folder: fn(Views(spark, folder))
    return fn


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    doubles = [c for c, kind in df.dtypes if kind == "double"]
    return df.withColumns({c: F.round(F.col(c), digits) for c in doubles})


def elapsed_hour(t: str = "day"):
    return F.floor(F.col(t) * 24)


# -- coverage and histograms ------------------------------------------------


def _bins(v: Views) -> DataFrame:
    return stage(coverage.monthly_bins(v.readings()))


def _coverage(bins: DataFrame) -> DataFrame:
    return coverage.coverage(coverage.monthly_counts(bins), per_day=PER_DAY)


def _best(bins: DataFrame) -> DataFrame:
    return coverage.best_window(_coverage(bins))


def _window_columns(df: DataFrame) -> DataFrame:
    expected = F.col("expected").cast("bigint")
    return rounded(df.withColumn("expected", expected))


@query
def reading_counts(v: Views) -> DataFrame:
    """Readings per calendar month of the pooled series, empty months included."""
    pooled = _bins(v).groupBy("month").agg(F.sum("n").alias("n"))
    first, last = coverage.span(pooled)
    filled = coverage.fill_months(pooled.withColumn("series", F.lit("all")), first, last, "series")
    return filled.select(F.year("month").alias("year"), F.month("month").alias("mon"), "n")


@query
def coverage_windows(v: Views) -> DataFrame:
    return _window_columns(_coverage(_bins(v)))


@query
def coverage_dirty(v: Views) -> DataFrame:
    """Windows where every fifth order's readings have lost their time."""
    lost = F.when(F.col("l_orderkey") % 5 != 0, F.col("l_shipdate"))
    dated = v.table("lineitem").select(F.col("l_suppkey").alias("station"), lost.alias("t"), F.col("l_quantity").alias("v"))
    return _window_columns(_coverage(stage(coverage.monthly_bins(dated))))


QUARTER, WEEK = Every(90, "day"), Every(7, "day")


def _swept(v: Views) -> DataFrame:
    return sweep_coverage(v.readings(), WEEK, QUARTER, per_day=PER_DAY)


def _whole(df: DataFrame) -> DataFrame:
    return rounded(df.withColumn("expected", F.col("expected").cast("bigint")))


@query
def sweep_windows(v: Views) -> DataFrame:
    """Windows of 90 days, one beginning every seventh day of the data."""
    return _whole(_swept(v))


@query
def sweep_dirty(v: Views) -> DataFrame:
    """Half years from the fifteenth of every other month, with lost times."""
    lost = F.when(F.col("l_orderkey") % 5 != 0, F.col("l_shipdate"))
    dated = v.table("lineitem").select(F.col("l_suppkey").alias("station"), lost.alias("t"))
    begin, end = F.lit("1993-01-15").cast("date"), F.lit("1997-12-31").cast("date")
    return sweep(dated, Every(2), Every(6), begin=begin, end=end).select("station", "start", "n")


@query
def sweep_hours(v: Views) -> DataFrame:
    """Windows of 36 hours every 13 hours over the irregular series."""
    return sweep(v.ticks(), Every(13, "hour"), Every(36, "hour")).select("station", "start", "n")


@query
def sweep_best(v: Views) -> DataFrame:
    return _whole(coverage.best_window(_swept(v)))


@query
def sweep_histogram(v: Views) -> DataFrame:
    """Whole-degree histogram of each station's fullest 90 days."""
    best = stage(coverage.best_window(_swept(v)).select("station", "start"))
    return span_histogram(v.readings(), best, QUARTER)


@query
def sweep_readings(v: Views) -> DataFrame:
    """Raw readings inside the fullest 90 days, reduced to their value range."""
    best = coverage.best_window(_swept(v)).select("station", "start")
    inside = within(v.readings(), best, QUARTER, keep=["start"])
    return inside.groupBy("station", "start").agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("v_min"), F.max("v").alias("v_max")
    )


@query
def best_window(v: Views) -> DataFrame:
    return _window_columns(_best(_bins(v)))


@query
def top_windows(v: Views) -> DataFrame:
    top = coverage.top_windows(coverage.pooled_windows(_bins(v))).drop("series")
    return top.withColumn("label", window_label(F.col("start")))


@query
def temp_histogram(v: Views) -> DataFrame:
    bins = _bins(v)
    return histogram.window_histogram(bins, _best(bins))


@query
def hist_wide(v: Views) -> DataFrame:
    """Histogram of the fullest windows with the regions across."""
    bins = _bins(v)
    hist = histogram.window_histogram(bins, _best(bins))
    placed = hist.join(v.stations().select("station", "region"), "station")
    return histogram.histogram_wide(placed, "region")


@query
def hist_cells(v: Views) -> DataFrame:
    """The same by nation as maps, laid out again; and which of three listed nations it would have shown."""
    bins = _bins(v)
    hist = histogram.window_histogram(bins, _best(bins))
    placed = stage(hist.join(v.stations().select("station", "state"), "station"))
    cells = histogram.histogram_map(placed, "state").select("temp_c", F.explode("cells").alias("state", "n"))
    listed = histogram.group_totals(placed, "state", ["CHINA", "FRANCE", "NOWHERE"])
    return cells.join(listed.select(F.col("name").alias("state"), "listed"), "state")


@query
def window_readings(v: Views) -> DataFrame:
    """Raw readings inside the fullest window, reduced to their value range."""
    inside = coverage.restrict_to_window(v.readings(), _best(_bins(v)), keep=["start"])
    return inside.groupBy("station", "start").agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("v_min"), F.max("v").alias("v_max")
    )


@query
def expected_slots(v: Views) -> DataFrame:
    """Expected readings per calendar year of the data."""
    days = v.readings().select(F.col("t").cast("date").alias("d"))
    years = days.agg(
        F.trunc(F.min("d"), "year").alias("a"), F.last_day(F.add_months(F.trunc(F.max("d"), "year"), 11)).alias("b")
    )
    table = generators.expected_per_year(generators.calendar(years, F.col("a"), F.col("b")))
    return table.withColumn("slots", F.col("slots").cast("bigint"))


@query
def window_starts(v: Views) -> DataFrame:
    """Month starts between the first and the last reading of each station."""
    month = month_start(F.col("t"))
    own = v.readings().groupBy("station").agg(F.min(month).alias("a"), F.max(month).alias("b"))
    return generators.window_starts(own, F.col("a"), F.col("b"), ["station"])


@query
def window_starts_fortnight(v: Views) -> DataFrame:
    """Starts every 14 days between the first and the last reading of each station."""
    day = F.col("t").cast("date")
    own = v.readings().groupBy("station").agg(F.min(day).alias("a"), F.max(day).alias("b"))
    return generators.window_starts(own, F.col("a"), F.col("b"), ["station"], Every(14, "day"))


@query
def threshold_grid(v: Views) -> DataFrame:
    """Thresholds up to the largest fraction of each treatment and depth."""
    last = F.round(half_even(F.max("fraction"), 2) / F.lit(0.01), 0).cast("int")
    top = v.fractions().groupBy("treatment", "depth").agg(last.alias("last_k"))
    return rounded(generators.threshold_grid(top, F.col("last_k"), 0.01, ["treatment", "depth"]))


@query
def top_and_first(v: Views) -> DataFrame:
    """Per station: windows with readings, the best one, and the first of its list."""
    windows = _coverage(_bins(v))
    full = windows.groupBy("station").agg(
        F.count_if(F.col("n") > 0).alias("windows"),
        F.count_if(F.col("pct") >= GATE).alias("qualified"),
    )
    first = coverage.top_windows_per(windows, k=1).select("station", "start", "n")
    return full.join(first, "station")


# -- incubation -------------------------------------------------------------


def _by_day(df: DataFrame) -> DataFrame:
    return df.withColumn("whole_day", F.floor("day"))


RATE_GROUP = ["whole_day", "depth", "treatment"]


def _rates(v: Views) -> DataFrame:
    return incubation.rate_summary(_by_day(incubation.rate_to_date(v.fractions())), RATE_GROUP)


def _final(v: Views) -> DataFrame:
    last = v.bottles().agg(F.floor(F.max("day"))).scalar()
    return response.final_rates(_rates(v), day="whole_day", last_day=last)


@query
def gas_production(v: Views) -> DataFrame:
    kept = incubation.drop_aired(v.gas_readings(), "CO2_sys_ppm_p")
    produced = incubation.gas_production(kept)
    totals = incubation.cumulative(produced, BOTTLE_KEYS, BOTTLE_ORDER, elapsed_hour())
    return rounded(
        totals.select(
            "event_id",
            *[
                f"{g}_{c}"
                for g in ("CO2", "CH4")
                for c in ("bottle_umol", "production_umol", "cumulative_umol")
            ],
        )
    )


@query
def respired_fraction(v: Views) -> DataFrame:
    cols = ["respired_umol", "respired_per_c", "remaining_mol", "fraction"]
    table = v.fractions().select("event_id", "bottle", *cols)
    # respired_per_c is about a million times the fraction; the remaining carbon
    # is a decimal of ten places, which six would cut at ties
    digits = {"respired_umol": 6, "respired_per_c": 2, "remaining_mol": 12, "fraction": 6}
    return table.withColumns({c: F.round(F.col(c), d) for c, d in digits.items()})


@query
def fraction_summary_ci(v: Views) -> DataFrame:
    return rounded(
        summary.summarize_ci(_by_day(v.fractions()), RATE_GROUP, "fraction", mean="fraction")
    )


@query
def rate_summary(v: Views) -> DataFrame:
    return rounded(_rates(v))


@query
def final_rates(v: Views) -> DataFrame:
    return rounded(_final(v), 8)


@query
def q10(v: Views) -> DataFrame:
    return rounded(sensitivity.q10(_rates(v), by=["whole_day", "depth"]))


def _pairs(v: Views) -> DataFrame:
    bins = stage(sensitivity.threshold_bins(v.fractions(), BOTTLE_KEYS))
    return sensitivity.threshold_pairs(bins, BOTTLE_KEYS)


@query
def crossing_times(v: Views) -> DataFrame:
    return rounded(sensitivity.crossing_times(_pairs(v)))


@query
def crossing_neighbours(v: Views) -> DataFrame:
    """Crossing times from true neighbours instead of running extremes."""
    pairs = sensitivity.threshold_neighbours(v.fractions(), BOTTLE_KEYS, BOTTLE_ORDER, elapsed_hour())
    return rounded(sensitivity.crossing_times(pairs))


@query
def elapsed_by_portion(v: Views) -> DataFrame:
    crossings = sensitivity.crossing_times(_pairs(v))
    return rounded(
        sensitivity.elapsed_by_portion(crossings, BOTTLE_KEYS).select(
            *BOTTLE_KEYS, "k", "crossing", "elapsed"
        )
    )


@query
def q10q(v: Views) -> DataFrame:
    crossings = sensitivity.crossing_times(_pairs(v))
    return rounded(sensitivity.q10q(sensitivity.elapsed_by_portion(crossings, BOTTLE_KEYS)))


@query
def plot_series(v: Views) -> DataFrame:
    table = summary.summarize_se(_by_day(v.fractions()), RATE_GROUP, "fraction", "fraction")
    shown = layers.plot_series(table)
    axis = layers.axis_label(F.floor(percent(F.col("fraction"))))
    return rounded(shown.withColumn("axis", axis))


# -- response curve and loss -------------------------------------------------


@query
def activation_energy(v: Views) -> DataFrame:
    return rounded(response.activation_energy(_final(v)).select("depth", "ea", "dea"), 8)


@query
def arrhenius_curve(v: Views) -> DataFrame:
    return rounded(response.arrhenius(_final(v)), 8)


@query
def arrhenius_curve_sequential(v: Views) -> DataFrame:
    """The curve with the published order of evaluation."""
    return rounded(response.arrhenius(_final(v), compat=True), 8)


@query
def curve_wide(v: Views) -> DataFrame:
    return rounded(response.curve_wide(response.arrhenius(_final(v))), 8)


def _losses(v: Views) -> DataFrame:
    return network.station_losses(_bins(v), _final(v), per_day=PER_DAY)


def _means(v: Views) -> DataFrame:
    return network.state_means(v.stations(), _losses(v), GATE)


@query
def annual_loss(v: Views) -> DataFrame:
    loss = [c for c in ("loss_deep", "dloss_deep", "loss_shallow", "dloss_shallow")]
    return rounded(_losses(v).select("station", "start", "pct", *loss))


@query
def annual_loss_constant(v: Views) -> DataFrame:
    bins = _bins(v)
    hist = histogram.window_histogram(bins, _best(bins))
    return rounded(response.total_constant_rate(hist, _final(v), cadence_days=1.0))


@query
def series_loss(v: Views) -> DataFrame:
    """Yearly loss of the pooled series in each of its ten fullest windows."""
    return rounded(network.series_loss(_bins(v), _final(v), cadence_days=1.0), 2)


@query
def state_mean_loss(v: Views) -> DataFrame:
    return rounded(_means(v))


# -- budget -------------------------------------------------------------------


def _state_budget(v: Views) -> DataFrame:
    return budget.state_budget(budget.shoreline_lengths(v.shore(), OVERRIDES), _means(v))


def _rolled(v: Views) -> DataFrame:
    return network.national_budget(v.shore(), _means(v), overrides=OVERRIDES)


@query
def erosion_scenarios(v: Views) -> DataFrame:
    table = _state_budget(v).select(
        "region", "state", "length", "n", "erosion", "bank", "area", "volume", "carbon", "decomp", "sd"
    )
    return rounded(table, 2)


@query
def budget_rollup(v: Views) -> DataFrame:
    return rounded(_rolled(v), 2)


@query
def budget_exact(v: Views) -> DataFrame:
    """The same by sums that do not depend on the order of the rows."""
    losses = network.station_losses(_bins(v), _final(v), per_day=PER_DAY, exact=True)
    means = network.state_means(v.stations(), losses, GATE, exact=True)
    return rounded(network.national_budget(v.shore(), means, overrides=OVERRIDES, exact=True), 2)


@query
def price_totals(v: Views) -> DataFrame:
    """Exact sums and means of amounts that no double holds: lines by return flag."""
    amount = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    table = v.table("lineitem").groupBy("l_returnflag").agg(
        exact_sum(amount).alias("total"), exact_avg(F.col("l_discount")).alias("mean"), F.count(F.lit(1)).alias("n")
    )
    return rounded(table, 3)


@query
def budget_long(v: Views) -> DataFrame:
    return rounded(budget.budget_long(_rolled(v)), 2)


@query
def budget_wide(v: Views) -> DataFrame:
    return rounded(budget.budget_wide(_rolled(v)), 2)


# -- gaps, ingest, metadata ----------------------------------------------------


def _gaps(v: Views) -> DataFrame:
    return gaps.gap_histogram(v.ticks(), digits=0)


@query
def gap_histogram(v: Views) -> DataFrame:
    return _gaps(v)


@query
def gap_dense(v: Views) -> DataFrame:
    """The same from one bucket for each station, cut where it holds more than a hundred times."""
    return gaps.gap_histogram(v.ticks(), digits=0, bucket=F.lit(0), rows=100)


@query
def gap_summary(v: Views) -> DataFrame:
    return rounded(gaps.gap_summary(_gaps(v), nominal=6))


@query
def gap_melt(v: Views) -> DataFrame:
    """Gap summary as rows of (station, measure, value), NULLs dropped."""
    table = frame.across(
        gaps.gap_summary(_gaps(v)),
        ["largest_gap_count", "nominal_gaps"],
        lambda c: c.cast("double"),
    )
    measures = ["largest_gap", "largest_gap_count", "nominal_gaps", "nominal_share"]
    return rounded(frame.melt(table, ["station"], measures, drop_null=True))


@query
def gaps_in_best_window(v: Views) -> DataFrame:
    """Gap summary inside each station's fullest window; daily is nominal."""
    return rounded(network.gaps_in_best_window(v.readings(), _best(_bins(v)), nominal=1440))


def _days(v: Views) -> DataFrame:
    """Days on which each station was read."""
    return v.readings().select("station", F.col("t").cast("date").alias("day")).distinct()


def _station_range(days: DataFrame) -> DataFrame:
    return days.groupBy("station").agg(F.min("day").alias("a"), F.max("day").alias("b"))


@query
def request_plan(v: Views) -> DataFrame:
    """Pages of 30 days over each station's own range of dates."""
    plan = ingest.plan_requests(_station_range(_days(v)), F.col("a"), F.col("b"))
    return plan.select("station", "chunk_begin", "chunk_end")


@query
def failed_pages(v: Views) -> DataFrame:
    """Pages of 7 days in which a station left no reading."""
    days = stage(_days(v))
    ranges = _station_range(days)
    plan = ingest.plan_requests(ranges, F.col("a"), F.col("b"), 7, ["station", "a"])
    landed = (
        days.join(ranges, "station")
        .select("station", ingest.page_of(F.col("day"), F.col("a"), 7).alias("chunk_begin"))
    )
    return ingest.failed_pages(plan, landed).select("station", "chunk_begin", "chunk_end")


@query
def dedupe_trim(v: Views) -> DataFrame:
    """Every tick landed twice; kept once, from day 3 to the midnight of day 25."""
    twice = frame.append(v.ticks(), v.ticks())
    begin, end = (F.lit(d).cast("date") for d in ("2024-01-03", "2024-01-25"))
    return ingest.distinct_readings(ingest.trim_range(twice, begin, end))


@query
def missing_series(v: Views) -> DataFrame:
    """Customers taken as stations that have no ticks."""
    listed = v.table("customer").select(F.col("c_custkey").alias("station"), "c_name")
    return stations.missing_series(listed, v.ticks())


@query
def with_series(v: Views) -> DataFrame:
    listed = v.table("customer").select(F.col("c_custkey").alias("station"), "c_name")
    return stations.with_series(listed, v.ticks())


@query
def station_key(v: Views) -> DataFrame:
    raw = v.stations().withColumn("listed", F.concat_ws(", ", "name", "state"))
    return raw.select("station", "listed", object_name(F.col("listed"), F.col("state")).alias("key"))


@query
def metadata_join(v: Views) -> DataFrame:
    """Stations with window, gaps and loss of each, numbers and keys checked."""
    columns = ["station", "start", F.col("readings").alias("n"), "pct", "loss_deep", "loss_shallow"]
    losses = _losses(v).select(*columns)
    summary_ = gaps.gap_summary(gaps.gap_histogram(v.readings()), nominal=1440)
    renamed = summary_.select(F.col("station").alias("name_key"), "largest_gap", "nominal_gaps")
    known = stations.attach(v.stations(), [(losses, "station"), (renamed, "name_key")])
    doubled = frame.across(known, frame.columns_like(known, contains="loss"), percent)
    return rounded(frame.everything_after(doubled.drop("name"), ["station", "state", "region"]))


@query
def response_metadata(v: Views) -> DataFrame:
    """Response metadata arriving as text, joined to the list on two keys."""
    text = v.table("supplier").select(
        F.col("s_suppkey").cast("string").alias("id"),
        F.col("s_name").alias("name"),
        F.col("s_acctbal").cast("string").alias("lat"),
        F.col("s_name").alias("lon"),
    )
    listed = v.stations().select(
        F.col("station").alias("StationID"), F.col("name").alias("Name"), "state", "region"
    )
    return stations.station_metadata(text, listed)


@query
def incubation_scan(v: Views) -> DataFrame:
    """Picks, renames, casts and filters of the reading scans, on events."""
    raw = v.table("events").withColumn("number", F.translate("props", '{"k: }', ""))
    named = raw.withColumnsRenamed({"ts": "t", "value": "result_value"})
    typed = frame.to_numeric(named, ["number", "event_type"])
    kept = typed.filter(F.col("number").isNotNull() & ~F.col("number").isin(0.0, 50.0)).filter(
        F.col("user_id").isNotNull()
    )
    return frame.select_like(
        kept.withColumns(
            {
                "result_value": half_even(F.col("result_value"), 0),
                "result_class": F.when(F.col("number") > 50, "high").otherwise("low"),
                "result_month": month_start(F.col("t")),
                "was_text": F.col("event_type").isNull(),
            }
        ).drop("props"),
        ["event_id", "number", "was_text"],
        startswith="result",
    )


# -- layers -------------------------------------------------------------------


def _station_layer(v: Views) -> DataFrame:
    known = stations.attach(v.stations(), [(_losses(v), "station")])
    return layers.station_layer(known, GATE)


@query
def mixed_layer(v: Views) -> DataFrame:
    cols = ["pct_shallow", "pct_deep", "pct_mixed"]
    table = _station_layer(v).select("station", "region", *cols, *[
        signif(F.col(c), 3).alias(f"{c}_3") for c in cols
    ])
    return rounded(table)


@query
def extent(v: Views) -> DataFrame:
    """Bounding box and value limits of the shown stations by region."""
    return rounded(
        frame.extent(_station_layer(v), ["lon", "lat", "pct_mixed"], by=["region"])
    )


@query
def label_fanout(v: Views) -> DataFrame:
    """State means joined to shorelines: states with two rows appear twice."""
    names = v.places().select("state", "region")
    twice = frame.append(names, names.withColumn("region", F.lit("GULF")))
    return rounded(
        twice.join(_means(v).drop("region"), "state", "left").select(
            "state", "region", "n", "deep", "shallow"
        )
    )


@query
def outline_centroids(v: Views) -> DataFrame:
    """Centroid of the outline through the customers of each nation."""
    vertices = v.table("customer").select(
        F.col("c_nationkey").alias("nationkey"),
        F.col("c_custkey").alias("x"),
        (F.col("c_acctbal") + 20000).alias("y"),
    )
    bucket = F.floor(F.col("x") / 100_000)
    return rounded(layers.centroids(vertices, "nationkey", "x", bucket), 3)


@query
def outline_parts(v: Views) -> DataFrame:
    """Nations of several rings, one for each market segment; buildings are holes."""
    segment = F.col("c_mktsegment")
    vertices = v.table("customer").select(
        F.col("c_nationkey").alias("nationkey"),
        segment.alias("part"),
        (segment == "BUILDING").alias("hole"),
        F.col("c_custkey").alias("x"),
        (F.col("c_acctbal") + 20000 * (1 + F.ascii(segment) % 5)).alias("y"),
    )
    table = layers.rings(vertices, ["nationkey", "part", "hole"], "x", F.floor(F.col("x") / 100_000))
    return rounded(layers.outlines(table, "nationkey", "hole"), 2)


@query
def state_labels(v: Views) -> DataFrame:
    vertices = v.table("customer").select(
        F.col("c_nationkey").alias("nationkey"),
        F.col("c_custkey").alias("x"),
        (F.col("c_acctbal") + 20000).alias("y"),
    )
    bucket = F.floor(F.col("x") / 100_000)
    outlines = layers.centroids(vertices, "nationkey", "x", bucket)
    named = outlines.join(v.places().select("nationkey", "state"), "nationkey")
    table = layers.state_labels(
        named,
        _means(v),
        renames=[("IRAN", "MIDDLE EAST", "IRAN (East)")],
        positions=[("IRAN", "MIDDLE EAST", 25.0, 61.5)],
    )
    return rounded(table, 3)
