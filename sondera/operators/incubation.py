"""Gas readings of incubation bottles to respired carbon and rates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondera.functions.numeric import half_even
from sondera.operators.ordered import running_total
from sondera.operators.summary import summarize_se

# Fixed value: the text that marks a bottle being aired, not a reading.
AIRED = "opened bottles to atmosphere"
GAS_DIGITS = {"CO2": 2, "CH4": 4}


@dataclass(frozen=True)
class InstrumentSpec:
    """Volumes in litres, temperature in kelvin (fixed values)."""

    vol_hs: float = 0.615
    vol_gga: float = 0.35258189116719
    vol_total: float = 0.967581891167191
    temp_k: float = 300.85
    gas_constant: float = 0.08206

    @property
    def headspace_mol(self) -> float:
        """Moles of gas in the headspace at one atmosphere."""
        return self.vol_hs / (self.temp_k * self.gas_constant)


def drop_aired(df: DataFrame, column: str = "CO2.sys.ppm.p") -> DataFrame:
    """Remove the aired-bottle rows; like any test, it also removes NULLs."""
    return df.filter(F.col(f"`{column}`") != AIRED)


def undilute(system: Column, air: Column, spec: InstrumentSpec) -> Column:
    """Concentration in the bottle from that of bottle plus analyser."""
    in_analyser = F.lit(spec.vol_gga / spec.vol_total) * air
    return (system - in_analyser) * F.lit(spec.vol_total / spec.vol_hs)


def gas_production(
    df: DataFrame, spec: InstrumentSpec = InstrumentSpec(), day: str = "day"
) -> DataFrame:
    """Bottle ppm, amount and production since the prior reading, per gas.

    Reads ``<gas>_sys_ppm``, ``<gas>_air_ppm`` and the text ``<gas>_sys_ppm_p``;
    text that is no number gives NULL.  Production on day 0 is 0.
    """
    mol = F.lit(spec.headspace_mol)
    for gas, digits in GAS_DIGITS.items():
        prior = F.col(f"{gas}_sys_ppm_p").try_cast("double")
        ppm = undilute(F.col(f"{gas}_sys_ppm"), F.col(f"{gas}_air_ppm"), spec)
        amount = half_even(F.col(f"{gas}_bottle_ppm") * mol, digits)
        made = F.when(F.col(day) == 0, F.lit(0.0)).otherwise(
            F.col(f"{gas}_bottle_umol") - prior * mol
        )
        df = (
            df.withColumn(f"{gas}_bottle_ppm", ppm)
            .withColumn(f"{gas}_bottle_umol", amount)
            .withColumn(f"{gas}_production_umol", half_even(made, digits))
        )
    return df


def cumulative(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    gases: Sequence[str] = tuple(GAS_DIGITS),
    carbon: DataFrame | None = None,
    on: str = "bottle",
    rows: int | None = None,
) -> DataFrame:
    """Running total of each gas per bottle, in the order given.

    ``carbon`` adds each bottle's initial ``c_mol`` on the way; its key must be
    among ``keys``.
    """
    return running_total(
        df,
        keys,
        order,
        {f"{g}_production_umol": f"{g}_cumulative_umol" for g in gases},
        bucket,
        attach=None if carbon is None else carbon.select(on, "c_mol"),
        on=[on],
        rows=rows,
    )


def respired_fraction(
    df: DataFrame, carbon: DataFrame | None = None, on: str = "bottle", compat: bool = False
) -> DataFrame:
    """Respired and remaining carbon relative to the initial ``c_mol``.

    Joins ``carbon`` by bottle unless ``cumulative`` has brought it already.
    ``compat`` keeps the divisor 1e7 that published tables use for the
    remaining carbon; the default is 1e6 micromoles per mole.
    """
    total = F.col("CO2_cumulative_umol") + F.col("CH4_cumulative_umol")
    c_mol = F.col("c_mol")
    if carbon is not None:
        df = df.join(carbon.select(on, "c_mol"), on, "left")
    return df.withColumns(
        {
            "CO2_per_c": F.try_divide(F.col("CO2_cumulative_umol"), c_mol),
            "CH4_per_c": F.try_divide(F.col("CH4_cumulative_umol"), c_mol),
            "respired_umol": total,
            "respired_per_c": F.try_divide(total, c_mol),
            "remaining_mol": c_mol - total / F.lit(1e7 if compat else 1e6),
            "fraction": F.try_divide(total, c_mol * F.lit(1e6)),
        }
    )


def rate_to_date(df: DataFrame, y: str = "fraction", day: str = "day") -> DataFrame:
    """Mean rate since the start; NULL on day 0."""
    return df.withColumn("rate", F.try_divide(F.col(y), F.col(day)))


def rate_summary(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """n, mean rate, sd and standard error per group."""
    return summarize_se(df, by, "rate", mean="rate")
