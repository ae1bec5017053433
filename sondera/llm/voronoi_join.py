"""Exact top-k by inner product: a Voronoi join of queries and data.

A bounded sample of the rows serves as pivots; each row belongs to the cell of
its nearest pivot.  A summary of the data holds, for each cell, the few rows
nearest to its pivot and their distances.  For a row x at distance b of pivot p

    q.x >= q.p - |q| b ,

so the summary gives each query a score that its k-th answer reaches.  Cells of
queries are joined into groups.  For a cell with pivot p and radius u

    q.x <= p.x + u |x|    for each of its queries q ,

and a row goes to a group only if this bound reaches, for one of its cells, the
least score that a query of the cell is sure of.  Groups get their rows in
blocks; each block meets the group's queries by itself, and the best of all
blocks are the answers.  Bounds only save work: answers are exact for any pivots.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondera.llm.common import python_tasks, saved
from sondera.llm.vectors import Extent, extent, from_bytes, matrix, to_bytes, usable

#: Most pivots; what is broadcast and collected grows with them alone.
PIVOTS = 1000
#: Queries in a group, and rows in a block.
GROUP, BLOCK = 512, 4096
#: Bytes that a task holds back to fill blocks.
HELD = 64 << 20

ANSWERS = "query_id long, rank int, vec_id long, score long"


@dataclass(frozen=True)
class Cells:
    """Pivots; for those with queries (``at``, in order of group): radius, sure score, start of each group."""

    pivots: np.ndarray
    at: np.ndarray
    radius: np.ndarray
    sure: np.ndarray
    starts: np.ndarray


def nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each row, and the distance."""
    x, p = x.astype(float), pivots.astype(float)
    cell = ((p * p).sum(axis=1) - 2 * (x @ p.T)).argmin(axis=1)
    return cell, np.sqrt(((x - p[cell]) ** 2).sum(axis=1))


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(float) ** 2).sum(axis=1))


def slack(size: Extent, *parts: np.ndarray) -> float:
    """More than rounding can move a bound."""
    return 1 + 1e-9 * size.width * sum(float(np.abs(p).max(initial=0)) for p in parts)


def choose_pivots(vectors: DataFrame, size: Extent, most: int) -> np.ndarray:
    """The distinct vectors among the rows with the least hash of the key; about the root of their number."""
    n = min(most, int(np.ceil(size.rows**0.5)))
    rows = vectors.orderBy(F.xxhash64("key"), "key").limit(n).select("vector").collect()
    column = pa.array([r[0] for r in rows], pa.list_(pa.float64()))
    return np.unique(matrix(column, size), axis=0)


def summarise(vectors: DataFrame, size: Extent, pivots: np.ndarray, k: int) -> list[tuple[int, float, int]]:
    """For each cell the ``k`` rows nearest to its pivot: (cell, distance, key)."""
    sent = vectors.sparkSession.sparkContext.broadcast(pivots)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        for batch in batches:
            cell, distance = nearest(matrix(batch.column("vector"), size), sent.value)
            new = cell, distance, batch.column("key").to_numpy()
            held = [np.concatenate(x) for x in zip(held, new)]
            order = np.lexsort((held[2], held[1], held[0]))
            held = [x[order] for x in held]
            first = np.searchsorted(held[0], held[0])
            few = np.arange(len(first)) - first < k
            held = [x[few] for x in held]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["cell", "distance", "key"])

    own = Window.partitionBy("cell").orderBy("distance", "key")
    found = vectors.mapInArrow(least, "cell long, distance double, key long")
    near = found.withColumn("_n", F.row_number().over(own)).filter(F.col("_n") <= k).drop("_n")
    return [tuple(r) for r in near.collect()]


def sure_scores(
    queries: np.ndarray, keys: np.ndarray, pivots: np.ndarray, summary: list[tuple[int, float, int]], k: int
) -> np.ndarray:
    """For each query a score that ``k`` rows of other keys reach; minus infinity, if the summary has fewer."""
    cell, distance, own = (np.array(x) for x in zip(*summary))
    out = np.empty(len(queries))
    for i in range(0, len(queries), 256):
        q = queries[i : i + 256].astype(float)
        low = (q @ pivots.astype(float).T)[:, cell.astype(int)] - _norms(q)[:, None] * distance
        low[keys[i : i + 256, None] == own] = -np.inf
        out[i : i + 256] = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] >= k else -np.inf
    return out


def group_cells(pivots: np.ndarray, counts: dict[int, int], most: int) -> list[list[int]]:
    """Cells in groups of neighbours with about ``most`` queries; a larger cell is a group by itself."""
    left, groups = dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))), []
    while left:
        seed = next(iter(left))
        order = np.argsort(((pivots - pivots[seed]).astype(float) ** 2).sum(axis=1), kind="stable")
        group, n = [seed], left.pop(seed)
        for c in order.tolist():
            if c in left and n + left[c] <= most:
                n += left.pop(c)
                group.append(c)
        groups.append(sorted(group))
    return groups


def needed(x: np.ndarray, cells: Cells, size: Extent) -> np.ndarray:
    """Rows by groups: whether a query of the group may have the row among its answers."""
    most = x.astype(float) @ cells.pivots[cells.at].astype(float).T
    reach = _norms(x)[:, None] * cells.radius
    enough = most + reach >= cells.sure - slack(size, most, reach)
    return np.logical_or.reduceat(enough, cells.starts, axis=1)


def _blocks(vectors: DataFrame, size: Extent, cells: Cells, salts: int, block: int) -> DataFrame:
    """The rows that each group needs, in blocks: ``group``, ``salt``, ``keys``, ``data``."""
    sent = vectors.sparkSession.sparkContext.broadcast(cells)
    names = ["group", "salt", "keys", "data"]

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        count: dict[int, int] = {}
        made = 0

        def flush(group: int) -> pa.RecordBatch:
            nonlocal made
            keys, x = (np.concatenate(p) for p in zip(*held.pop(group)))
            del count[group]
            made += 1
            salt = (int(keys[0]) + made) % salts
            values = [[group], [salt], [to_bytes(keys)], [to_bytes(x)]]
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], names=names)

        for batch in batches:
            all_keys = batch.column("key").to_numpy()
            all_x = matrix(batch.column("vector"), size)
            for i in range(0, len(all_keys), block):
                keys, x = all_keys[i : i + block], all_x[i : i + block]
                wanted = needed(x, sent.value, size)
                for g in np.flatnonzero(wanted.any(axis=0)).tolist():
                    own = wanted[:, g]
                    held.setdefault(g, []).append((keys[own], x[own]))
                    count[g] = count.get(g, 0) + int(own.sum())
                    if count[g] >= block:
                        yield flush(g)
                while sum(count.values()) * size.width * 8 > HELD:
                    yield flush(max(count, key=count.get))
        for g in list(held):
            yield flush(g)

    return vectors.mapInArrow(replicate, "group int, salt int, keys binary, data binary")


def best(scores: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` highest scores of each row, ties by key; minus infinity is none."""
    k_here = min(k, scores.shape[1])
    limit = np.partition(scores, -k_here, axis=1)[:, -k_here]
    row, col = np.nonzero((scores >= limit[:, None]) & (scores > -np.inf))
    order = np.lexsort((keys[col], -scores[row, col], row))
    row, col = row[order], col[order]
    few = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[few], col[few]


def _solve(k: int, size: Extent):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, x, own, q = (batch.column(c)[i].as_py() for c in ("keys", "data", "query_keys", "queries"))
                keys, own = from_bytes(keys, "<i8"), from_bytes(own, "<i8")
                x = from_bytes(x, size.kind).reshape(len(keys), size.width)
                q = from_bytes(q, size.kind).reshape(len(own), size.width)
                scores = q @ x.T
                allowed = own[:, None] != keys
                # doubles hold these scores exactly, or else order them well enough to cut
                ranked = np.where(allowed, scores, -np.inf) if size.kind == "<f8" else scores
                if size.kind == "<f8":
                    row, col = best(ranked, keys, k)
                else:
                    row, col = np.nonzero(allowed)
                    order = np.lexsort((keys[col], -scores[row, col], row))
                    row, col = row[order], col[order]
                    few = np.arange(len(row)) - np.searchsorted(row, row) < k
                    row, col = row[few], col[few]
                out = [own[row], keys[col], scores[row, col].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=schema)

    return solve


def top_k(
    queries: DataFrame,
    data: DataFrame,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    pivots: int = PIVOTS,
    group: int = GROUP,
    block: int = BLOCK,
) -> DataFrame:
    """The ``k`` rows of ``data`` with the highest inner product for each query, exactly.

    Both tables have ``key`` and ``vector``; other columns are not read.  Returns
    ``query_id``, ``rank`` from 1, ``vec_id`` and ``score``, the product of the
    vectors as whole numbers; ties go to the smaller key.  Rows with the query's
    own key are no answers.  Rows with a NULL key or vector, or a component that
    is NULL or not finite, take no part; shorter vectors end in zeros.  Repeated
    rows of ``data`` are answers each; of queries with the same key the one with the
    least vector counts.  A query without rows to compare has no answer; empty
    tables give none.
    """
    spark = data.sparkSession
    python_tasks(spark)
    vectors, asked = usable(data, key, vector), usable(queries, key, vector)
    size = extent(vectors.unionByName(asked))
    own_size = extent(vectors)
    if not own_size.rows:
        return spark.createDataFrame([], ANSWERS)
    points = choose_pivots(vectors, Extent(own_size.rows, size.width, size.kind), pivots)
    summary = summarise(vectors, size, points, k + 1)
    sent = spark.sparkContext.broadcast((points, summary))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, summary = sent.value
        for batch in batches:
            q, keys = matrix(batch.column("vector"), size), batch.column("key").to_numpy()
            cell, distance = nearest(q, pivots)
            sure = sure_scores(q, keys, pivots, summary, k)
            arrays = [batch.column("key"), pa.array(cell), pa.array(distance), pa.array(sure), pa.array([to_bytes(x) for x in q], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "cell", "distance", "sure", "data"])

    once = asked.groupBy("key").agg(F.min("vector").alias("vector"))
    placed = saved(once.mapInArrow(place, "key long, cell long, distance double, sure double, data binary"))
    found = {
        r["cell"]: r
        for r in placed.groupBy("cell")
        .agg(F.count("*").alias("n"), F.max("distance").alias("radius"), F.min("sure").alias("sure"))
        .collect()
    }
    if not found:
        return spark.createDataFrame([], ANSWERS)
    groups = group_cells(points, {c: r["n"] for c, r in found.items()}, group)
    at = [c for g in groups for c in g]
    cells = Cells(
        points,
        np.array(at),
        np.array([found[c]["radius"] for c in at]),
        np.array([found[c]["sure"] for c in at]),
        np.cumsum([0] + [len(g) for g in groups[:-1]]),
    )
    salts = size.rows // (4 * block) + 1
    packs = [-(-sum(found[c]["n"] for c in g) // group) for g in groups]
    of_cell = spark.createDataFrame(
        [(c, i, packs[i]) for i, g in enumerate(groups) for c in g], "cell long, group int, packs int"
    )
    packed = (
        placed.join(F.broadcast(of_cell), "cell")
        .withColumn("pack", F.pmod(F.xxhash64("key"), F.col("packs")))
        .groupBy("group", "pack")
        .agg(F.collect_list(F.struct("key", "data")).alias("members"))
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, members in zip(batch.column("group").to_pylist(), batch.column("members").to_pylist()):
                keys = np.array([m["key"] for m in members], dtype=np.int64)
                x = np.stack([from_bytes(m["data"], size.kind) for m in members])
                values = [pa.array([g], pa.int32()), pa.array([to_bytes(keys)], pa.binary()), pa.array([to_bytes(x)], pa.binary())]
                yield pa.RecordBatch.from_arrays(values, names=["group", "query_keys", "queries"])

    asked_packs = packed.mapInArrow(pack, "group int, query_keys binary, queries binary").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    blocks = _blocks(vectors, size, cells, salts, block)
    solved = (
        blocks.join(asked_packs, ["group", "salt"])
        .select("keys", "data", "query_keys", "queries")
        .mapInArrow(_solve(k, size), "query_id long, vec_id long, score long")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return solved.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
