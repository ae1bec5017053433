"""Token ids packed into rows of one length, best fit decreasing.

Documents are dealt to shards of bounded size, so a shard fits in a task and every
row of the matrix belongs to one shard.  Without an order they are dealt by a hash; with
one, shards are cut from the documents in that order, and follow each other in it.
Within a shard the pieces go from long to short, each to the row with the least room
that holds it.  A segment tree over the amounts of room finds that row in log(length)
steps.  A document longer than a row is cut into full rows and a rest; nothing
is lost or moved, and ``offsets`` tell where each piece begins.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondera.llm.common import python_tasks, saved

PACKED = (
    "shard long, pack int, n_tokens int, ids binary, position_ids binary, "
    "cu_seqlens array<int>, doc_ids array<long>, offsets array<long>"
)
_SCHEMA = pa.schema(
    [
        ("shard", pa.int64()),
        ("pack", pa.int32()),
        ("n_tokens", pa.int32()),
        ("ids", pa.binary()),
        ("position_ids", pa.binary()),
        ("cu_seqlens", pa.list_(pa.int32())),
        ("doc_ids", pa.list_(pa.int64())),
        ("offsets", pa.list_(pa.int64())),
    ]
)
_LOADED: dict[str, tiktoken.Encoding] = {}


def encoding(ranks: str, pattern: str) -> tiktoken.Encoding:
    """The encoder of this Python worker, kept for later tasks."""
    if ranks not in _LOADED:
        pairs = (line.split() for line in ranks.splitlines())
        table = {base64.b64decode(piece): int(rank) for piece, rank in pairs}
        _LOADED.clear()
        _LOADED[ranks] = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}
        )
    return _LOADED[ranks]


class Rooms:
    """Rows by the room they have left; a segment tree finds the least room that is enough."""

    def __init__(self, length: int) -> None:
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """A row with the least room of at least ``need``, and that room."""
        node, count = need + self.leaves, self.count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1  # up, until there is something to the right
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._change(room, -1)
        return self.rows[room].pop(), room

    def _change(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1


def best_fit(lengths: list[int], length: int) -> list[list[int]]:
    """Rows of indexes into ``lengths``, each of at most ``length`` in sum; ties keep their order."""
    rows: list[list[int]] = []
    rooms = Rooms(length)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = rooms.take(lengths[i])
        if found is None:
            rows.append([])
            found = len(rows) - 1, length
        row, room = found
        rows[row].append(i)
        if room > lengths[i]:
            rooms.put(row, room - lengths[i])
    return rows


def _pack(shard: int, first: int, docs: list[tuple[int | None, np.ndarray]], length: int, pad: int, kind):
    pieces = [
        (doc, at, ids[at : at + length]) for doc, ids in docs for at in range(0, len(ids), length)
    ]
    for pack, members in enumerate(best_fit([len(p[2]) for p in pieces], length), first):
        row, place = np.full(length, pad, dtype=kind), np.zeros(length, dtype=kind)
        ends = [0]
        for i in members:
            n = len(pieces[i][2])
            row[ends[-1] : ends[-1] + n] = pieces[i][2]
            place[ends[-1] : ends[-1] + n] = np.arange(n)
            ends.append(ends[-1] + n)
        yield {
            "shard": shard,
            "pack": pack,
            "n_tokens": ends[-1],
            "ids": row.tobytes(),
            "position_ids": place.tobytes(),
            "cu_seqlens": ends,
            "doc_ids": [pieces[i][0] for i in members],
            "offsets": [pieces[i][1] for i in members],
        }


#: Copies of a row that are dealt together; bytes of text in a task; a shard is written early above this many times its size.
COPIES, TASK_BYTES, EARLY = 64, 32 << 20, 4


def text_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0


def _dealt(docs: DataFrame, shards: int, parts: int) -> DataFrame:
    """``docs`` (doc_id, text) by ``_shard``, a hash; of a row that occurs very often at most COPIES lie together.

    Such rows are found by a count of hashes, aggregated, and cut into pieces with
    a number of ``copies``.
    """
    key = F.xxhash64("doc_id", "text")
    often = (
        docs.select(key.alias("_key")).groupBy("_key").agg(F.count("*").alias("n")).filter(F.col("n") > COPIES).select("_key")
    )
    keyed = docs.withColumn("_key", key)
    if often.take(1):
        often = saved(often)
        pieces = F.ceil(F.col("n") / COPIES).cast("long")
        own = F.least(F.lit(COPIES), F.col("n") - F.col("piece") * COPIES).cast("int")
        hot = (
            keyed.join(often, "_key", "left_semi")
            .groupBy("doc_id", "text")
            .agg(F.count("*").alias("n"))
            .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
            .select("doc_id", "text", "piece", own.alias("copies"))
        )
        keyed = (
            keyed.join(often, "_key", "left_anti")
            .select("doc_id", "text", F.lit(0).cast("long").alias("piece"), F.lit(1).alias("copies"))
            .unionByName(hot)
        )
    else:
        keyed = keyed.select("doc_id", "text", F.lit(0).cast("long").alias("piece"), F.lit(1).alias("copies"))
    hashed = F.when(F.col("piece") == 0, key).otherwise(F.xxhash64(key, "piece"))
    return (
        keyed.withColumn("_shard", F.pmod(hashed, F.lit(shards)))
        .repartition(parts, "_shard")
        .sortWithinPartitions("_shard", "doc_id", "text", "piece")
        .select("_shard", "doc_id", "text", "copies")
    )


def pack_tokens(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    length: int = 2048,
    text: str = "text",
    shard_bytes: int = 4 << 20,
    order: Sequence[str] = (),
) -> DataFrame:
    """Rows of ``length`` token ids from ``docs`` (doc_id, text); other columns are not read.

    ``ids`` and ``position_ids`` are one row of a matrix each, little-endian
    unsigned 16-bit integers (32-bit, if the vocabulary needs them), filled up
    with the first free id and with 0.  ``cu_seqlens`` has the ends of the
    segments, from 0; positions start at 0 again in each.  ``doc_ids`` and
    ``offsets`` name the document of each segment and its place in that.

    With the columns ``order`` the documents are range-sorted by them, shards of about
    ``shard_bytes`` of text are cut off in turn, and rows come in order of ``shard``: no
    document of a shard comes after one of the next.  Otherwise a hash deals them.

    NULL, empty texts have no tokens and so no segment; a NULL id stays NULL in
    ``doc_ids``; repeated rows are packed as often as they occur; an empty
    table gives none.  ``vocabulary`` is a file of ranks on the driver, whose
    text is broadcast (its size is that of the vocabulary).  Strings that look
    like special tokens are ordinary text.
    """
    spark: SparkSession = docs.sparkSession
    python_tasks(spark)
    with open(vocabulary, encoding="ascii") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    pad = max(int(line.split()[1]) for line in ranks.value.splitlines()) + 1
    kind = "<u2" if pad < 1 << 16 and length <= 1 << 16 else "<u4"
    cut = bool(order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(ranks.value, pattern)
        # in order, shards are numbered by task and then in turn
        shard, held, size, first = TaskContext.get().partitionId() << 32 if cut else None, [], 0, 0

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, first
            rows = list(_pack(shard, first, held, length, pad, kind))
            held, size, first = [], 0, first + len(rows)
            for i in range(0, len(rows), 256):
                yield pa.RecordBatch.from_pylist(rows[i : i + 256], schema=_SCHEMA)

        for batch in batches:
            cols = (batch.column(c).to_pylist() for c in ("_shard", "doc_id", "text", "copies"))
            for own, doc, body, copies in zip(*cols):
                if not cut and own != shard:
                    yield from done()
                    shard, first = own, 0
                ids = np.array(encoder.encode_ordinary(body), dtype=kind)
                for _ in range(copies):
                    held.append((doc, ids))
                    size += len(body)
                    if size >= shard_bytes * (1 if cut else EARLY):
                        yield from done()
                        shard, first = (shard + 1, 0) if cut else (shard, first)
        yield from done()

    texts = docs.select("doc_id", F.col(text).alias("text"), *order).filter("text IS NOT NULL AND text <> ''")
    size = text_bytes(texts, "text")
    parts = size // TASK_BYTES + 1
    if cut:
        columns = [F.lit(None).cast("long").alias("_shard"), "doc_id", "text", F.lit(1).alias("copies")]
        dealt = texts.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*columns)
    else:
        dealt = _dealt(texts, size // shard_bytes + 1, parts)
    return dealt.mapInArrow(pack, PACKED)
