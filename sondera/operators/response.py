"""Rates at any temperature from rates at two, and yearly loss from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondera.functions.errors import with_error
from sondera.operators.coverage import GRID
from sondera.operators.frame import across, at_max
from sondera.operators.histogram import temperature_grid
from sondera.operators.sensitivity import COLD, WARM
from sondera.operators.summary import sum_with_error

# Gas constant in kJ per mol and kelvin, reference temperatures.
GAS_CONSTANT = 0.00831446
ZERO_C = 273.15
T_COLD = 20 + ZERO_C
T_WARM = 30 + ZERO_C
DEPTHS = {"deep": "M", "shallow": "S"}


def final_rates(
    summary: DataFrame,
    day: str = "day",
    depth: str = "depth",
    treatment: str = "treatment",
    last_day: Column | None = None,
) -> DataFrame:
    """Rates of the last day, one row per depth: k1, dk1 cold and k2, dk2 warm.

    ``last_day`` names it where the readings tell more cheaply than the summary.
    """
    last = at_max(summary, day) if last_day is None else summary.filter(F.col(day) == last_day)
    last = last.filter(F.col(depth).isin(*DEPTHS.values()))
    name = F.when(F.col(depth) == DEPTHS["deep"], "deep").otherwise("shallow")
    return last.groupBy(name.alias("depth")).agg(
        *[
            F.max(F.when(F.col(treatment) == level, F.col(source))).alias(target)
            for level, rate in ((COLD, "k1"), (WARM, "k2"))
            for source, target in (("rate", rate), ("sd", f"d{rate}"))
        ]
    )


def activation_energy(rates: DataFrame) -> DataFrame:
    """Ea in kJ/mol from two rates: ``ea`` with error ``dea``."""
    span = 1 / T_WARM - 1 / T_COLD
    return with_error(rates, f"ea ~ -(log(k2) - log(k1)) * {GAS_CONSTANT} / ({span!r})")


def arrhenius(
    rates: DataFrame,
    keep: Sequence[str] = ("depth",),
    grid: tuple[int, int] = GRID,
    compat: bool = False,
) -> DataFrame:
    """Rate ``k`` and error ``dk`` at every whole temperature of the grid.

    The exponent is found first, then its exponential.  ``compat`` computes the
    second error after ``k`` has been overwritten, as published tables do.
    """
    with_ea = activation_energy(rates)
    cols = ["k1", "dk1", "ea", "dea"]
    at = temperature_grid(with_ea, [*keep, *cols], grid).withColumn(
        "temp_k", F.col("temp_c") + F.lit(ZERO_C)
    )
    exponent = with_error(
        at, f"k ~ -(ea / {GAS_CONSTANT}) * (1 / temp_k - 1 / {T_COLD!r})", exact=["temp_k"]
    )
    curve = with_error(exponent, "k ~ exp(k + log(k1))", sequential=compat)
    return curve.select(*keep, "temp_c", "temp_k", "k", "dk")


def curve_wide(curve: DataFrame) -> DataFrame:
    """One row per temperature with the deep and shallow rate side by side."""
    return curve.groupBy("temp_c").agg(
        *[
            F.max(F.when(F.col("depth") == d, F.col(c))).alias(f"{c}_{d}")
            for d in DEPTHS
            for c in ("k", "dk")
        ]
    )


def annual_loss(
    hist: DataFrame,
    curve: DataFrame,
    keys: Sequence[str] = ("station",),
    cadence_days: float = 6 / 60 / 24,
    scale: float = 1.0,
    exact: bool = False,
) -> DataFrame:
    """Loss over the window: time at each temperature times the rate there.

    The wide curve has one row per temperature of the grid, so it is broadcast
    whatever the number of readings.  Without a rate the loss is NULL, and the
    station stays.  ``scale`` 1000 gives mmol per mol.  ``exact`` makes every bit
    independent of the order of the rows.
    """
    rate = F.broadcast(curve_wide(curve))
    joined = hist.join(rate, "temp_c", "left").withColumn(
        "days", F.col("n") * F.lit(cadence_days * scale)
    )
    for d in DEPTHS:
        joined = with_error(joined, f"loss_{d} ~ days * k_{d}", exact=["days"])
    return sum_with_error(joined, keys, [f"loss_{d}" for d in DEPTHS], exact)


def total_constant_rate(
    hist: DataFrame,
    rates: DataFrame,
    keys: Sequence[str] = ("station",),
    cadence_days: float = 6 / 60 / 24,
    scale: float = 1000.0,
) -> DataFrame:
    """Loss if every reading were at the warm rate."""
    days = F.sum("n") * F.lit(cadence_days * scale)
    warm = {d: rates.filter(F.col("depth") == d).select("k2").scalar() for d in DEPTHS}
    return (
        hist.groupBy(*keys)
        .agg(days.alias("days"))
        .select(*keys, *[(F.col("days") * k).alias(f"loss_{d}") for d, k in warm.items()])
    )


def normalise_year(
    df: DataFrame, columns: Sequence[str] | None = None, per_day: float = 240
) -> DataFrame:
    """Scale to full coverage and to 365 days: x / pct, times 365/366 if leap."""
    if columns is None:
        columns = [c for c in df.columns if "loss" in c]
    leap = F.col("expected") == F.lit(366 * per_day)

    def scaled(x):
        full = F.try_divide(x, F.col("pct"))
        return F.when(leap, full * F.lit(365) / F.lit(366)).otherwise(full)

    return across(df, columns, scaled)
