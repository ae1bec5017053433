"""The analyses end to end, as functions from input tables to result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondera.operators import budget, coverage, histogram, response, sensitivity, stations
from sondera.operators.gaps import gap_histogram, gap_summary
from sondera.operators.incubation import (
    InstrumentSpec,
    cumulative,
    drop_aired,
    gas_production,
    rate_summary,
    rate_to_date,
    respired_fraction,
)
from sondera.operators.summary import mean_with_error, summarize_ci
from sondera.session import stage

GROUP = ("day", "depth", "treatment")


def incubation_results(
    readings: DataFrame,
    carbon: DataFrame,
    order: Sequence[str] = ("day", "time_order", "time_point"),
    days_per_bucket: float = 1.0,
    spec: InstrumentSpec = InstrumentSpec(),
    compat: bool = False,
) -> dict[str, DataFrame]:
    """Analysis A: gas readings to respired fractions, rates, Q10 and Q10q.

    Thresholds are crossed between neighbouring readings, for the first time
    where a fraction falls again; ``compat`` takes independent extremes instead,
    which is the same where fractions never fall.
    """
    keys = ["treatment", "depth", "rep", "bottle"]
    bucket = F.floor(F.col("day") / F.lit(days_per_bucket))
    produced = gas_production(drop_aired(readings, "CO2_sys_ppm_p"), spec)
    totals = cumulative(produced, keys, order, bucket, carbon=carbon)
    respired = stage(respired_fraction(totals, compat=compat))
    rates = rate_summary(rate_to_date(respired), GROUP)
    bins = stage(sensitivity.threshold_bins(respired, keys))
    if compat:
        crossings = sensitivity.crossing_times(sensitivity.threshold_pairs(bins, keys))
    else:
        last = sensitivity.last_threshold(bins, "y_max")
        pairs = sensitivity.threshold_neighbours(respired, keys, order, bucket, last_k=last)
        crossings = sensitivity.first_crossings(sensitivity.crossing_times(pairs), keys)
    return {
        "respired": respired,
        "summary": summarize_ci(respired, GROUP, "fraction", mean="fraction"),
        "rates": rates,
        "q10": sensitivity.q10(rates, value="se" if compat else "rate"),
        "q10q": sensitivity.q10q(sensitivity.elapsed_by_portion(crossings, keys)),
    }


def series_loss(
    bins: DataFrame,
    rates: DataFrame,
    k: int = 10,
    cadence_days: float = 6 / 60 / 24,
    compat: bool = False,
) -> DataFrame:
    """Analysis B: yearly loss, in mmol per mol, in the ``k`` fullest windows of one series."""
    top = coverage.top_windows(coverage.pooled_windows(bins), k).select("start")
    hist = histogram.series_histogram(bins, top)
    curve = response.arrhenius(rates, compat=compat)
    return response.annual_loss(hist, curve, ["start"], cadence_days, scale=1000.0)


def station_losses(
    bins: DataFrame,
    rates: DataFrame,
    per_day: float = 240,
    compat: bool = False,
    begin: Column | None = None,
    end: Column | None = None,
    exact: bool = False,
) -> DataFrame:
    """Analysis C, first part: fullest window of each station and its loss per year.

    ``exact``, here and below, makes the sums independent of the order of the rows.
    """
    counts = coverage.monthly_counts(bins)
    best = coverage.best_window(
        coverage.coverage(counts, begin=begin, end=end, per_day=per_day)
    )
    # the window travels with its histogram, which saves joining it again
    window = ["start", "readings", "expected", "pct"]
    hist = histogram.window_histogram(bins, best.withColumnRenamed("n", "readings"), by=window)
    curve = response.arrhenius(rates, compat=compat)
    losses = response.annual_loss(hist, curve, ["station", *window], cadence_days=1 / per_day, exact=exact)
    return response.normalise_year(losses, per_day=per_day)


def gaps_in_best_window(
    readings: DataFrame, best: DataFrame, nominal: float = 6
) -> DataFrame:
    """Gap summary of each station inside its fullest window."""
    inside = coverage.restrict_to_window(readings, best)
    return gap_summary(gap_histogram(inside), nominal=nominal)


def state_means(
    metadata: DataFrame, losses: DataFrame, min_coverage: float = 0.95, exact: bool = False
) -> DataFrame:
    """Mean loss per state over the stations with enough coverage."""
    known = stations.attach(metadata, [(losses, "station")])
    named = known.withColumnsRenamed(
        {f"{d}loss_{x}": f"{d}{x}" for d in ("", "d") for x in ("deep", "shallow")}
    )
    # a station without a window has a NULL share and does not qualify
    enough = F.coalesce(F.col("pct") >= min_coverage, F.lit(False))
    return mean_with_error(named, ["region", "state"], ["deep", "shallow"], enough, exact)


def national_budget(
    shore: DataFrame,
    means: DataFrame,
    compat: bool = False,
    overrides: dict | None = None,
    exact: bool = False,
) -> DataFrame:
    """Analysis C, second part: state, region and nation by scenario."""
    lengths = budget.shoreline_lengths(shore, overrides)
    return budget.roll_up(budget.state_budget(lengths, means, compat), exact)
