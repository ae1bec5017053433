"""The test tables seen as readings, stations, shorelines and bottles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondera.functions.calendar import days_between
from sondera.operators.incubation import AIRED, cumulative, respired_fraction

EXPERIMENT_START = "2024-01-01 00:00:00"
BOTTLE_KEYS = ["treatment", "depth", "rep"]
BOTTLE_ORDER = ["day", "event_id"]


class Views:
    """Neutral views over one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """One DataFrame per table: its footers are looked up once."""
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    def readings(self) -> DataFrame:
        """Daily series: half of the values end in .5."""
        half = F.lit(0.5) * (F.col("l_linenumber") % 2)
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("station"),
            F.col("l_shipdate").alias("t"),
            (F.col("l_quantity") - half).alias("v"),
        )

    def ticks(self) -> DataFrame:
        """Irregular series with microsecond times."""
        return self.table("events").select(
            F.col("user_id").alias("station"), F.col("ts").alias("t"), (F.col("value") / 10).alias("v")
        )

    def places(self) -> DataFrame:
        """Nations with their region: ``nationkey, state, region``."""
        regions = self.table("region").withColumnRenamed("r_regionkey", "n_regionkey")
        return (
            self.table("nation")
            .join(regions, "n_regionkey")
            .select(
                F.col("n_nationkey").alias("nationkey"),
                F.col("n_name").alias("state"),
                F.col("r_name").alias("region"),
            )
        )

    def stations(self) -> DataFrame:
        suppliers = self.table("supplier").withColumnRenamed("s_nationkey", "nationkey")
        return suppliers.join(self.places(), "nationkey").select(
            F.col("s_suppkey").alias("station"),
            F.col("s_name").alias("name"),
            (F.col("s_acctbal") / 100).alias("lat"),
            (F.lit(0.0) - F.col("s_acctbal") / 50).alias("lon"),
            "state",
            "region",
        )

    def shore(self) -> DataFrame:
        """Shoreline length: 100 km per customer, counted before the join."""
        counts = (
            self.table("customer")
            .groupBy(F.col("c_nationkey").alias("nationkey"))
            .agg((F.count(F.lit(1)) * F.lit(100.0)).alias("length"))
        )
        return self.places().join(counts, "nationkey").select("region", "state", "length")

    def bottles(self) -> DataFrame:
        """Incubation readings: one bottle per user, two gases."""
        user = F.col("user_id")
        return self.table("events").select(
            user.alias("bottle"),
            F.when(user % 2 == 0, "IB 20").otherwise("IB 30").alias("treatment"),
            F.when(F.floor(user / 2) % 2 == 0, "S").otherwise("M").alias("depth"),
            F.floor(user / 4).alias("rep"),
            days_between(F.lit(EXPERIMENT_START).cast("timestamp_ntz"), F.col("ts")).alias("day"),
            "event_id",
            "event_type",
            "value",
        )

    def gas_readings(self) -> DataFrame:
        """The bottles with concentrations; error events stand for aired bottles."""
        aired = F.col("event_type") == "error"
        prior = F.when(aired, AIRED).otherwise((F.col("value") / 4).cast("string"))
        return self.bottles().withColumns(
            {
                "CO2_sys_ppm_p": prior,
                "CH4_sys_ppm_p": F.when(aired, AIRED).otherwise(
                    (F.col("value") / 400).cast("string")
                ),
                "CO2_air_ppm": F.col("value") / 2,
                "CH4_air_ppm": F.col("value") / 200,
                "CO2_sys_ppm": F.col("value"),
                "CH4_sys_ppm": F.col("value") / 100,
            }
        )

    def carbon(self) -> DataFrame:
        """Initial carbon of each bottle, in mol."""
        return self.table("customer").select(
            F.col("c_custkey").alias("bottle"),
            ((F.lit(20000.0) + F.col("c_acctbal")) / F.lit(1e6)).alias("c_mol"),
        )

    def fractions(self) -> DataFrame:
        """Respired fraction after every reading, production being the event value."""
        produced = self.bottles().withColumns(
            {
                "CO2_production_umol": F.col("value"),
                "CH4_production_umol": F.bround(F.col("value") / 100, 4),
            }
        )
        bucket = F.floor(F.col("day") * 24)
        keys = [*BOTTLE_KEYS, "bottle"]
        return respired_fraction(
            cumulative(produced, keys, BOTTLE_ORDER, bucket, carbon=self.carbon())
        )
