"""Eroded volume, carbon and loss by scenario, rolled up to region and nation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondera.functions.errors import with_error
from sondera.functions.exact import digit_sum, with_digits
from sondera.operators.frame import override
from sondera.operators.summary import quadrature

# Erosion in m per year, layer thickness in m, kg carbon per m3,
# and the shoreline length in km that replaces the listed one.
EROSION_RATES = {"Large": 0.3, "Small": 0.1}
SHALLOW_M = 0.1
DEEP_M = {"Tall": 0.2, "Short": 0.0}
CARBON_DENSITY = 27.0
LENGTH_OVERRIDES = {"LA": 66459.0}

# Prefixes of the wide measures, and published names of banks and measures.
MEASURES = {"volume": "erodedSedVolume", "carbon": "erodedSedC", "decomp": "Decomp", "sd": "dDecomp"}
BANK_NAMES = {"Tall": "Deep", "Short": "Shallow"}
LONG_NAMES = {"volume": "erodedSedVolume", "carbon": "erodedSedCarbon", "decomp": "Decomp", "sd": "SD"}
STATE_MEANS = ("deep", "ddeep", "shallow", "dshallow")


def shoreline_lengths(shore: DataFrame, overrides: dict | None = None) -> DataFrame:
    """Region, state and length, with listed states replaced, once each."""
    values = LENGTH_OVERRIDES if overrides is None else overrides
    return (
        override(shore.select("region", "state", "length"), "state", "length", values)
        .dropDuplicates()
    )


def erosion_scenarios(df: DataFrame, density: float = CARBON_DENSITY) -> DataFrame:
    """Four rows per input row: two erosion rates by two bank heights.

    Adds eroded area, and volume and carbon of the shallow and the deep layer.
    """
    scenarios = F.array(
        *[
            F.struct(
                F.lit(rate).alias("erosion"),
                F.lit(metres).alias("erosion_m"),
                F.lit(bank).alias("bank"),
                F.lit(deep).alias("deep_m"),
            )
            for rate, metres in EROSION_RATES.items()
            for bank, deep in DEEP_M.items()
        ]
    )
    area = F.col("erosion_m") * (F.col("length") * F.lit(1000.0))
    return (
        df.select("*", F.inline(scenarios))
        .withColumn("area", area)
        .withColumn("volume_shallow", F.col("area") * F.lit(SHALLOW_M))
        .withColumn("volume_deep", F.col("area") * F.col("deep_m"))
        .withColumn("volume", F.col("volume_shallow") + F.col("volume_deep"))
        .withColumn("carbon_shallow", F.col("volume_shallow") * F.lit(density))
        .withColumn("carbon_deep", F.col("volume_deep") * F.lit(density))
        .withColumn("carbon", F.col("carbon_shallow") + F.col("carbon_deep"))
    )


def eroded_loss(scenarios: DataFrame, compat: bool = False) -> DataFrame:
    """Eroded carbon lost per year, ``decomp``, with its error ``sd``.

    Reads the state means ``shallow``, ``deep`` and their errors.  A short bank
    has no deep layer.  ``compat`` gives tall banks under small erosion the
    error of large erosion, as published tables do.
    """
    layered = with_error(
        scenarios, "lost_shallow ~ carbon_shallow * shallow", exact=["carbon_shallow"]
    )
    layered = with_error(layered, "lost_deep ~ carbon_deep * deep", exact=["carbon_deep"])
    tall = F.col("bank") == "Tall"
    both = F.sqrt(F.pow(F.col("dlost_shallow"), 2) + F.pow(F.col("dlost_deep"), 2))
    if compat:
        both = both * (F.lit(EROSION_RATES["Large"]) / F.col("erosion_m"))
    return layered.withColumns(
        {
            "decomp": F.when(tall, F.col("lost_shallow") + F.col("lost_deep")).otherwise(
                F.col("lost_shallow")
            ),
            "sd": F.when(tall, both).otherwise(F.col("dlost_shallow")),
        }
    ).drop("lost_shallow", "dlost_shallow", "lost_deep", "dlost_deep")


def state_budget(
    shore: DataFrame, state_means: DataFrame, compat: bool = False
) -> DataFrame:
    """Shoreline lengths with state means, as scenario rows.

    States without a station stay, with NULL loss.
    """
    joined = shore.join(state_means, ["region", "state"], "left")
    return eroded_loss(erosion_scenarios(joined), compat)


def roll_up(budget: DataFrame, exact: bool = False) -> DataFrame:
    """State rows with their region and national totals, in one aggregation.

    Values add up and errors add in quadrature; a total over nothing is 0, a
    missing state value stays NULL.  ``exact`` makes every bit independent of the
    order of the rows.
    """
    measures = ["volume", "carbon", "decomp"]
    leaf = ["region", "state", "shore_km", "stations"]
    source = budget.select(
        "erosion",
        "bank",
        "region",
        "state",
        F.col("length").alias("shore_km"),
        F.col("n").alias("stations"),
        F.col("length"),
        "n",
        *measures,
        "sd",
    )
    if exact:
        values = {c: F.col(c) for c in ("length", *measures)} | {"sd": F.col("sd") * F.col("sd")}
        source = with_digits(source, values)
    add = digit_sum if exact else F.sum
    error = F.sqrt(digit_sum("sd")) if exact else quadrature(F.col("sd"))
    scenario = ["erosion", "bank"]
    level = F.grouping("state") + F.grouping("region")

    def total(x):
        return F.when(F.grouping("state") == 0, x).otherwise(F.coalesce(x, F.lit(0)))

    grouped = source.groupingSets(
        [[*scenario, *leaf], [*scenario, "region"], scenario], *scenario, *leaf
    ).agg(
        level.alias("_level"),
        add("length").alias("marsh_shore"),
        total(F.sum("n")).alias("n"),
        *[total(add(m)).alias(m) for m in measures],
        total(error).alias("sd"),
    )
    names = F.when(F.col("_level") == 0, "state").when(F.col("_level") == 1, "region")
    return grouped.select(
        names.otherwise("nation").alias("level"),
        F.when(F.col("_level") == 2, "National").otherwise(F.col("region")).alias("region"),
        "state",
        "marsh_shore",
        "n",
        "erosion",
        "bank",
        *measures,
        "sd",
    )


def budget_wide(
    rolled: DataFrame, keys: Sequence[str] = ("level", "region", "state", "marsh_shore", "n")
) -> DataFrame:
    """One row per place with its 16 measures side by side, ``<measure>_<erosion><bank>``."""
    cells = [
        F.max(F.when((F.col("erosion") == rate) & (F.col("bank") == bank), F.col(column))).alias(
            f"{prefix}_{rate}{bank}"
        )
        for column, prefix in MEASURES.items()
        for rate in EROSION_RATES
        for bank in DEEP_M
    ]
    return rolled.groupBy(*keys).agg(*cells)


def state_budget_wide(rolled: DataFrame, means: DataFrame) -> DataFrame:
    """The wide rows of the states beside the state means they were made from."""
    wide = budget_wide(rolled.filter("level = 'state'")).drop("level")
    return wide.join(means.select("region", "state", *STATE_MEANS), ["region", "state"], "left")


def budget_long(rolled: DataFrame) -> DataFrame:
    """One row per place, bank and erosion rate under the published names."""
    bank = F.lit(None).cast("string")
    for name, published in BANK_NAMES.items():
        bank = F.when(F.col("bank") == name, published).otherwise(bank)
    return rolled.select(
        "level",
        "region",
        "state",
        "marsh_shore",
        "n",
        bank.alias("BankHt"),
        F.col("erosion").alias("ErosionRate"),
        *[F.col(c).alias(name) for c, name in LONG_NAMES.items()],
    )
