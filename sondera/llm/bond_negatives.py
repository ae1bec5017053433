"""Hard negatives by a vertical scan of the vectors.

Rows are laid out in blocks, one column for each dimension, with the least and
the greatest value of each column.  An anchor reads the columns in descending
order of the magnitude of its own components.  After some columns a row's score
lies between its sum so far plus the least, and plus the greatest, that the unread
columns can still add.  These two limits clear bits of the candidate bitmap: a
row goes when it can't be among the best any more, or can't fall into a window any
more.  Who is left after the last column has its exact score.

Two scans do the work: one over the rows of the anchor's label for the positives,
one over the others for the windows that the positives' scores open.  Each block
meets each chunk of anchors once; the best of all blocks are then ranked.

All joins are merged, as Spark can't tell which of their sides are small: it leaves
the number of copies of the anchors out of its estimate, and takes the size of a
saved table's files for that of its rows.  A broadcast would pass the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondera.llm.common import python_tasks, saved
from sondera.llm.vectors import Extent, extent, from_bytes, matrix, to_bytes, usable

#: Rows in a block, anchors in a chunk, columns read between two looks at the limits.
BLOCK, CHUNK, STEP = 8192, 256, 8
#: Multiples of it, without their whole parts, lie evenly between 0 and 1.
GOLDEN = (5**0.5 - 1) / 2
#: Partitions for each slot: few slots meet in one, and partitions without any cost little.
SPREAD = 4

NEGATIVES = (
    "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
)

Shrink = Callable[[np.ndarray, np.ndarray], np.ndarray]


def vertical_scan(
    columns: np.ndarray, low: np.ndarray, high: np.ndarray, anchor: np.ndarray, shrink: Shrink, step: int = STEP
) -> tuple[np.ndarray, np.ndarray]:
    """Places that ``shrink`` never cleared, and their exact scores with the anchor.

    ``columns`` has a row for each dimension; ``shrink`` gets lower and upper
    limits of the scores and returns what to keep.
    """
    order = np.argsort(-np.abs(anchor), kind="stable")
    ends = np.stack([anchor * low, anchor * high])[:, order]
    rest_low = np.append(np.cumsum(ends.min(axis=0)[::-1])[::-1], 0)
    rest_high = np.append(np.cumsum(ends.max(axis=0)[::-1])[::-1], 0)
    alive, total = np.arange(columns.shape[1]), np.zeros(columns.shape[1], dtype=columns.dtype)
    every = True
    for i in range(0, len(order), step):
        dims = order[i : i + step]
        total = total + anchor[dims] @ (columns[dims] if every else columns[np.ix_(dims, alive)])
        end = min(i + step, len(order))
        keep = shrink(total + rest_low[end], total + rest_high[end])
        if not keep.all():
            alive, total, every = alive[keep], total[keep], False
        if not len(alive):
            break
    return alive, total


def kth(values: np.ndarray, k: int):
    """The k-th greatest value, or none."""
    return np.partition(values, -k)[-k] if len(values) >= k else None


def among_best(k: int) -> Shrink:
    """Keeps what may be one of the ``k`` highest scores, ties included."""

    def shrink(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        sure = kth(low, k)
        return np.ones(len(low), dtype=bool) if sure is None else high >= sure

    return shrink


def in_window(score: np.ndarray, positive: int, percent: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Whether scores reach the lower end of a positive's window, and whether they stay within the upper."""
    return 100 * score >= percent[0] * positive, 100 * score <= percent[1] * positive


def in_windows(positives: list[int], k: int, percent: tuple[int, int]) -> Shrink:
    """Keeps what may be one of the ``k`` highest scores in the window of one of the positives."""

    def shrink(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(low), dtype=bool)
        for p in positives:
            may = in_window(high, p, percent)[0] & in_window(low, p, percent)[1]
            certain = in_window(low, p, percent)[0] & in_window(high, p, percent)[1]
            sure = kth(low[certain], k)
            keep |= may if sure is None else may & (high >= sure)
        return keep

    return shrink


def _ranked(score: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((keys, -score))[:k]


def vertical_blocks(vectors: DataFrame, size: Extent, slots: int, rows: int = BLOCK) -> DataFrame:
    """Blocks of columns: ``slot``, ``keys``, ``labels``, ``columns``, ``low``, ``high``; sorted by label inside.

    Tasks begin at slots spread by the golden ratio, so blocks are dealt evenly whatever their rows.
    """
    names = ["slot", "keys", "labels", "columns", "low", "high"]
    kinds = [pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.binary(), pa.binary()]

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, made = [], 0, 0
        start = int(TaskContext.get().partitionId() * GOLDEN % 1 * slots)

        def block() -> pa.RecordBatch:
            keys, labels, x = (np.concatenate(p) for p in zip(*held))
            order = np.lexsort((keys, labels))
            keys, labels, x = keys[order], labels[order], x[order]
            row = [
                (start + made) % slots,
                to_bytes(keys),
                labels.tolist(),
                [to_bytes(c) for c in x.T],
                to_bytes(x.min(axis=0)),
                to_bytes(x.max(axis=0)),
            ]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=names)

        for batch in batches:
            parts = batch.column("key").to_numpy(), batch.column("label").to_numpy(), matrix(batch.column("vector"), size)
            for i in range(0, batch.num_rows, rows):
                held.append(tuple(p[i : i + rows] for p in parts))
                count += len(held[-1][0])
                if count >= rows:
                    yield block()
                    held, count, made = [], 0, made + 1
        if held:
            yield block()

    kind = "slot int, keys binary, labels array<long>, columns array<binary>, low binary, high binary"
    return vectors.mapInArrow(lay, kind)


def _scan(size: Extent, same: bool, k: int, percent: tuple[int, int]):
    """Blocks with chunks of anchors to candidates: of the anchors' label, or of the others and by window."""
    schema = pa.schema([(n, pa.int64()) for n in ("anchor_id", "label", "positive_score", "key", "score")])

    def one(keys: np.ndarray, columns: np.ndarray, low: np.ndarray, high: np.ndarray, anchor: dict) -> Iterator[tuple]:
        a = from_bytes(anchor["data"], size.kind)
        if same:
            own = int((keys == anchor["key"]).sum())
            at, score = vertical_scan(columns, low, high, a, among_best(k + own))
            at, score = at[keys[at] != anchor["key"]], score[keys[at] != anchor["key"]]
            for i in _ranked(score, keys[at], k):
                yield anchor["key"], anchor["label"], None, int(keys[at[i]]), int(score[i])
        else:
            at, score = vertical_scan(columns, low, high, a, in_windows(anchor["positives"], k, percent))
            for p in anchor["positives"]:
                inside = np.flatnonzero(np.logical_and(*in_window(score, p, percent)))
                for i in inside[_ranked(score[inside], keys[at[inside]], k)]:
                    yield anchor["key"], anchor["label"], p, int(keys[at[i]]), int(score[i])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, labels = from_bytes(row["keys"], "<i8"), np.array(row["labels"])
                columns = np.stack([from_bytes(c, size.kind) for c in row["columns"]]) if size.width else np.zeros((0, len(keys)), dtype=size.kind)
                low, high = from_bytes(row["low"], size.kind), from_bytes(row["high"], size.kind)
                out: list[tuple] = []
                others: dict[int, tuple] = {}
                for anchor in row["members"]:
                    begin, end = np.searchsorted(labels, [anchor["label"], anchor["label"] + 1])
                    if same:
                        part = keys[begin:end], columns[:, begin:end]
                    else:
                        if anchor["label"] not in others:
                            others.clear()
                            apart = np.r_[0:begin, end : len(keys)]
                            others[anchor["label"]] = keys[apart], np.ascontiguousarray(columns[:, apart])
                        part = others[anchor["label"]]
                    if len(part[0]):
                        out += one(*part, low, high, anchor)
                values = list(zip(*out)) if out else [[]] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in values], schema=schema)

    return scan


def _chunks(anchors: DataFrame, chunks: int, slots: int) -> DataFrame:
    """Anchors in chunks, in order of label, a copy for each slot."""
    return (
        anchors.withColumn("chunk", F.pmod(F.xxhash64("key"), F.lit(chunks)))
        .groupBy("chunk")
        .agg(F.sort_array(F.collect_list(F.struct("label", "key", "data", "positives"))).alias("members"))
        .select("members", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    )


def hard_negatives(
    rows: DataFrame,
    anchors: DataFrame,
    positives: int = 5,
    negatives: int = 3,
    percent: tuple[int, int] = (50, 95),
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    block: int = BLOCK,
    chunk: int = CHUNK,
) -> DataFrame:
    """Rows of another label that score almost as high with an anchor as its positives.

    ``rows`` and ``anchors`` have ``key``, ``vector`` and ``label`` (an integer);
    other columns are not read.  An anchor's positives are the ``positives``
    other rows of its label with the highest scores, and the negatives of a
    positive with score p the first ``negatives`` rows of other labels whose
    score is from ``percent[0]`` to ``percent[1]`` % of p; ties go to the smaller key.
    Returns ``anchor_id``, ``positive_id``, ``rank`` from 1, ``negative_id`` and
    both scores.  A window is empty where p is negative.

    Rows with a NULL key, label or vector, or a component that is NULL or not
    finite, take no part; shorter vectors end in zeros.  Repeated rows count
    each; of anchors with the same key the one with the least label, then vector, counts, and
    rows of the anchor's key are no positives.  Empty tables give none.
    """
    spark = rows.sparkSession
    python_tasks(spark)

    def prepared(df: DataFrame) -> DataFrame:
        return usable(df.filter(F.col(label).isNotNull()), key, vector, label=label).withColumn("label", F.col("label").cast("long"))

    vectors, asked = prepared(rows), prepared(anchors)
    size = extent(vectors.unionByName(asked))
    slots = size.rows // block + 1

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = pa.array([to_bytes(x) for x in matrix(batch.column("vector"), size)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), data], names=["key", "label", "data"])

    once = asked.groupBy("key").agg(F.min(F.struct("label", "vector")).alias("first")).select("key", "first.*")
    starts = saved(once.mapInArrow(plain, "key long, label long, data binary"))
    chunks = starts.count() // chunk + 1
    blocks = saved(vertical_blocks(vectors, size, slots, block))
    found = "anchor_id long, label long, positive_score long, key long, score long"

    def scanned(with_positives: DataFrame, same: bool, k: int) -> DataFrame:
        copies = _chunks(with_positives, chunks, slots)
        laid, sent = (df.repartition(SPREAD * slots, "slot") for df in (blocks, copies))
        met = laid.join(sent.hint("merge"), "slot").drop("slot")
        return met.mapInArrow(_scan(size, same, k, percent), found)

    def ranked(df: DataFrame, k: int, *by: str) -> DataFrame:
        n = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "key"))
        return df.withColumn("rank", n).filter(F.col("rank") <= k)

    none = F.array().cast("array<long>").alias("positives")
    first = saved(
        ranked(scanned(starts.select("*", none), True, positives), positives, "anchor_id").select(
            F.col("anchor_id"), F.col("key").alias("positive_id"), F.col("score").alias("positive_score")
        )
    )
    opened = first.groupBy(F.col("anchor_id").alias("key")).agg(F.sort_array(F.collect_set("positive_score")).alias("positives"))
    second = ranked(scanned(starts.join(opened.hint("merge"), "key"), False, negatives), negatives, "anchor_id", "positive_score")
    return (
        first.join(second.hint("merge"), ["anchor_id", "positive_score"])
        .select("anchor_id", "positive_id", "rank", F.col("key").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )
