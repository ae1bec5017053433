"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondera.session import cut_lineage

#: A word is a longest run of characters other than blank, tab and line ends.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column | str) -> Column:
    """The words of a text in order; none for a NULL text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(
        F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.array().cast("array<string>")
    )


def word_count(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


_OWN_FOLDER: list[str] = []


def saved(df: DataFrame) -> DataFrame:
    """``df`` written once to the folder of spark.checkpoint.dir and read back.

    Lost executors then cost a read and not a recomputation.  Without that setting a session
    of one machine (tests, a notebook) uses a temporary folder; on a cluster, whose
    executors don't share one, this fails.  The session's settings stay as they are.
    """
    spark = df.sparkSession
    master = spark.sparkContext.master
    alone = master == "local" or master.startswith("local[")
    if spark.conf.get("spark.checkpoint.dir", None) or not alone:
        return cut_lineage(df)
    if not _OWN_FOLDER:
        _OWN_FOLDER.append(tempfile.mkdtemp(prefix="sondera-"))
    path = f"{_OWN_FOLDER[0]}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_order() -> list[Column]:
    """Where a row stands in the Parquet files of a table that Spark wrote: part, file, row.

    For a table that was range-sorted before it was written this is its order.
    """
    file = F.col("_metadata.file_name")
    part = F.regexp_extract(file, r"part-(\d+)", 1).cast("int")
    return [part.alias("_part"), file.alias("_file"), F.col("_metadata.row_index").alias("_at")]


_SHIPPED: set[str] = set()


def python_tasks(spark: SparkSession, megabytes: int = 8) -> None:
    """Make ready for Python in tasks.

    Arrow batches are bounded by bytes, so that very long texts do not pile up,
    and the executors get this package, whether or not it is installed there.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        packed = Path(tempfile.mkdtemp(prefix="sondera-")) / "sondera.zip"
        with zipfile.ZipFile(packed, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        context.addPyFile(str(packed))
        _SHIPPED.add(context.applicationId)
