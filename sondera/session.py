"""Session settings the library is written for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Wall-clock times never change zone, so UTC keeps every day 24 hours long.
# The adaptive settings split hot join keys and size reducers at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Formulas build thousands of small expressions; do not record a call site for each.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | str = "*", app: str = "sondera", **conf: str) -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    defaults = {
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": "8",
    }
    for name, value in {**defaults, **SETTINGS, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared folder as Parquet and read it back.

    The folder is the one the session names in ``spark.checkpoint.dir``; without
    it this fails instead of falling back to a disk that dies with its executor.
    Unlike an RDD checkpoint the table is computed once, and later reads prune
    its columns.  Tables collect under ``sondera-stage``; delete them with the
    other checkpoints.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{folder.rstrip('/')}/sondera-stage/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for files that executors write and read again.

    It lies in the folder of spark.checkpoint.dir.  Without that setting a session of one
    machine gets a temporary folder; on a cluster, whose executors share none, this fails.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="sondera-")
    return f"{base.rstrip('/')}/sondera-files/{name}-{uuid.uuid4().hex}"


def stages(spark: SparkSession) -> bool:
    """Whether ``stage`` saves tables in this session."""
    return bool(spark.conf.get("spark.checkpoint.dir", None))


def stage(df: DataFrame) -> DataFrame:
    """For a small table that one plan reads several times.

    Saved once where the cluster names a shared folder; otherwise left lazy, and
    each use computes it again.
    """
    return cut_lineage(df) if stages(df.sparkSession) else df
