"""Incremental form of the page ingest: new landed pages, each reading once.

Nothing is dropped by age.  A reading is compared with all that is stored, so
the result does not depend on when its page landed, nor on how pages are dealt
to batches.

What is stored lies in cells, a month and a slot of stations.  A batch reads the
cells that it touches and no others, so its cost follows its own readings.  Each batch
adds small files; ``compact`` gathers them into few.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sondera.sources import schemas

READING = ["station", "t", "v", "f"]


def page_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Landed pages as a stream, a bounded number of files per batch.

    By default the source passes over files a week older than the newest one;
    here no backlog is too old.
    """
    return (
        spark.readStream.schema(schemas.ddl(schemas.PAGE))
        .option("header", True)
        .option("nullValue", "NA")
        .option("maxFilesPerTrigger", max_files)
        .option("maxFileAge", "36500d")
        .csv(folder)
    )


#: Slots into which the stations of a month are dealt.
SLOTS = 64
#: The feed that compactions write, and the folder of their log (hidden from scans).
COMPACTED, LOG = "compacted", "_compactions"


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table in a folder; None if there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _covered(spark: SparkSession, out: str) -> list[Row]:
    """``feed, batch, generation`` of the batches that finished compactions hold; a row per batch compacted."""
    log = _table(spark, f"{out.rstrip('/')}/{LOG}")
    return [] if log is None else log.collect()


def stored_readings(spark: SparkSession, out: str) -> DataFrame | None:
    """What the stream has written, with ``month``, ``slot``, ``feed`` and ``batch``; None before the first batch.

    Batches that a compaction has taken over, and compactions that did not finish,
    are left out by their folders' names, so their files are not read.
    """
    rows = _table(spark, out)
    if rows is None:
        return None
    covered = _covered(spark, out)
    by_feed: dict[str, list[int]] = {}
    for r in covered:
        by_feed.setdefault(r.feed, []).append(r.batch)
    finished = sorted({r.generation for r in covered})
    feed, batch = F.col("feed").cast("string"), F.col("batch").cast("bigint")
    visible = (feed != COMPACTED) | batch.isin(finished)
    for name, batches in by_feed.items():
        visible = visible & ~((feed == name) & batch.isin(batches))
    return rows.filter(visible)


def _cell_columns() -> dict[str, Column]:
    return {
        "month": F.year("t") * 100 + F.month("t"),
        "slot": F.pmod(F.xxhash64("station"), F.lit(SLOTS)).cast("int"),
    }


def touched(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The stored readings in the cells of ``fresh``, by a filter on folders alone."""
    cells = [r.cell for r in fresh.select((F.col("month") * SLOTS + F.col("slot")).alias("cell")).distinct().collect()]
    return stored.filter((F.col("month") * SLOTS + F.col("slot")).isin(cells))


def append_new(pages: DataFrame, out: str, feed: str, batch: int) -> None:
    """Write the readings of a batch that no other batch has stored.

    Only the cells that the batch touches are read back; their list has a row for each
    month and slot of the batch.  A batch owns one folder and overwrites it, so a replayed
    batch leaves the same rows once.  One replayed after a compaction that holds it adds nothing.
    """
    spark = pages.sparkSession
    if any((r.feed, r.batch) == (feed, batch) for r in _covered(spark, out)):
        return
    fresh = (
        pages.filter("t IS NOT NULL AND v IS NOT NULL")
        .select(*READING)
        .withColumns(_cell_columns())
        .dropDuplicates(READING)
    )
    stored = stored_readings(spark, out)
    if stored is not None:
        others = touched(stored, fresh).filter(
            ~((F.col("feed").cast("string") == feed) & (F.col("batch") == batch))
        ).select(*READING)
        same = [fresh[c].eqNullSafe(others[c]) for c in READING]
        fresh = fresh.join(others, same, "left_anti")
    folder = f"{out.rstrip('/')}/feed={feed}/batch={batch}"
    # a cell's rows meet in one task, so a batch adds one file to each cell
    fresh.repartition("month", "slot").write.mode("overwrite").partitionBy("month", "slot").parquet(folder)


def compact(spark: SparkSession, out: str) -> int:
    """Gather all that is visible into one folder of one file per cell; returns its generation.

    Run it while no batch is running.  The new folder counts only when the log
    names it, and the log is written last: a compaction that breaks off changes nothing, and
    no reader sees a reading twice or not at all.  The batches' own folders stay until
    someone deletes them.
    """
    stored = stored_readings(spark, out)
    if stored is None:
        return 0
    held = [(str(r.feed), int(r.batch)) for r in stored.select("feed", "batch").distinct().collect()]
    covered = _covered(spark, out)
    generation = 1 + max([r.generation for r in covered], default=0)
    base = out.rstrip("/")
    gathered = stored.select(*READING, "month", "slot").repartition("month", "slot").sortWithinPartitions("station", "t")
    gathered.write.mode("overwrite").partitionBy("month", "slot").parquet(f"{base}/feed={COMPACTED}/batch={generation}")
    entries = [(f, b, generation) for f, b in held]
    log = spark.createDataFrame(entries, "feed string, batch bigint, generation bigint")
    log.coalesce(1).write.mode("append").parquet(f"{base}/{LOG}")
    return generation


def ingest_stream(
    spark: SparkSession, landing: str, out: str, checkpoint: str | None = None
) -> StreamingQuery:
    """Start one pass over everything new in ``landing``, adding Parquet to ``out``.

    Progress is kept under ``checkpoint``, by default beside the output, so that
    two feeds never share one.  Several feeds may write to one output, one after
    the other.
    """

    def write(pages: DataFrame, batch: int) -> None:
        feed = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        append_new(pages, out, feed, batch)

    return (
        page_stream(spark, landing)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint or f"{out.rstrip('/')}.progress")
        .trigger(availableNow=True)
        .start()
    )
