"""Quality scores from random-indexing word vectors and a small network.

Every word of a text gives two tokens: its letters (hashed) and its shape
(punctuation left over, capitals, same word again).  Each token has a fixed
random index vector with one signed entry; a token's word vector is the sum of
the index vectors of its neighbours over the whole corpus.  The mean of the
word vectors of a document goes through two layers of numpy weights, and the
logit is divided by a temperature fitted on labelled rows that were kept back.

The word vectors come from all documents: each task adds up integers for its
texts and sends them as slabs of the table, a few dozen rows a task; slabs are added up in
two rounds.  The table has a fixed size, ``TOKENS x DIMS``, so it may be collected and
broadcast.  The network is
fitted on at most ``sample`` labelled rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondera.llm.common import python_tasks, saved
from sondera.llm.vectors import from_bytes, to_bytes

CORES, SHAPES, DIMS = 1 << 14, 1 << 10, 32
SAME = CORES + SHAPES  # the shape of a word equal to the one before
TOKENS = SAME + 1
NEIGHBOURS = (1, 2, 3)
#: Cells of the table in a row, and parts in which the first round adds up each slab.
SLAB, PARTS = 1 << 13, 16
SUMS = "slab int, part int, sums binary"
_CACHED_WORDS = 600_000
_RUN = 1 << 19  # words handled at once
_LETTERS = re.compile(r"[^\W_]+")


class Shapes(dict):
    """Word to its two tokens in one number; emptied when full."""

    def __missing__(self, word: str) -> int:
        rest = _LETTERS.sub("", word)
        core = "".join(_LETTERS.findall(word)) if rest else word
        mark = rest + "^" if len(core) > 1 and core.isupper() else rest
        shape = 1 + zlib.crc32(mark.encode()) % (SHAPES - 1) if mark else 0
        code = zlib.crc32(core.lower().encode()) % CORES * SHAPES + shape
        if len(self) >= _CACHED_WORDS:
            self.clear()
        if len(word) <= 48:
            self[word] = code
        return code


_SHAPES = Shapes()  # of this Python worker, kept for later tasks


def tokens(text: str | None) -> np.ndarray:
    """Tokens of a text, two a word, in order."""
    if not text:
        return np.zeros(0, dtype=np.int64)
    code = np.fromiter(map(_SHAPES.__getitem__, text.split()), dtype=np.int64)
    out = np.empty((len(code), 2), dtype=np.int64)
    out[:, 0] = code // SHAPES
    out[:, 1] = CORES + code % SHAPES
    out[1:, 1][code[1:] == code[:-1]] = SAME
    return out.ravel()


def _index_vectors(dims: int) -> np.ndarray:
    """For each neighbour distance and token: 2 * dimension + (1 if the sign is minus)."""
    rng = np.random.default_rng(11)
    return rng.integers(0, 2 * dims, size=(2 * len(NEIGHBOURS), TOKENS))


def _runs(texts: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens of consecutive texts and where each text starts, in runs of bounded size."""
    run, size = [], 0
    for t in texts:
        own = tokens(t)
        if run and size + len(own) > _RUN:
            yield np.concatenate(run), np.cumsum([0, *map(len, run)])
            run, size = [], 0
        run.append(own)
        size += len(own)
    if run:
        yield np.concatenate(run), np.cumsum([0, *map(len, run)])


def word_vectors(docs: DataFrame, text: str = "text", dims: int = DIMS) -> np.ndarray:
    """Unit word vectors (TOKENS, dims) from the neighbours in all texts."""
    python_tasks(docs.sparkSession)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = _index_vectors(dims)
        total = np.zeros(TOKENS * dims)
        for batch in batches:
            for seq, starts in _runs(batch["text"]):
                row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
                for k, gap in enumerate(NEIGHBOURS):
                    near = row[gap:] == row[:-gap]
                    left, right = seq[:-gap][near], seq[gap:][near]
                    for at, other, code in ((left, right, 2 * k), (right, left, 2 * k + 1)):
                        entry = index[code][other]
                        sign = 1.0 - 2.0 * (entry & 1)
                        total += np.bincount(
                            at * dims + (entry >> 1), weights=sign, minlength=len(total)
                        )
        part = TaskContext.get().partitionId() % PARTS
        for i in range(0, len(total), SLAB):
            slab = total[i : i + SLAB]
            if slab.any():
                yield pd.DataFrame({"slab": [i], "part": [part], "sums": [to_bytes(slab.astype(np.int64))]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, None

        def row() -> pa.RecordBatch:
            values = [pa.array([own[0]], pa.int32()), pa.array([own[1]], pa.int32()), pa.array([to_bytes(held)], pa.binary())]
            return pa.RecordBatch.from_arrays(values, names=["slab", "part", "sums"])

        for batch in batches:
            for slab, part, sums in zip(*(batch.column(c).to_pylist() for c in ("slab", "part", "sums"))):
                if (slab, part) != own:
                    if own is not None:
                        yield row()
                    own, held = (slab, part), np.zeros(0, dtype=np.int64)
                more = from_bytes(sums, "<i8")
                held = held + more if len(held) else more
        if own is not None:
            yield row()

    def merged(sums: DataFrame) -> DataFrame:
        by = sums.repartition("slab", "part").sortWithinPartitions("slab", "part")
        return by.mapInArrow(merge, SUMS)

    sums = docs.select(F.col(text).alias("text")).filter("text IS NOT NULL").mapInPandas(add, SUMS)
    table = np.zeros(TOKENS * dims)
    for r in merged(merged(sums).withColumn("part", F.lit(0))).collect():
        slab = from_bytes(bytes(r["sums"]), "<i8")
        table[r["slab"] : r["slab"] + len(slab)] = slab
    table = table.reshape(TOKENS, dims)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1)).astype(np.float32)


def pooled(docs: DataFrame, vectors: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``pooled``: the mean word vector; zeros if no word."""
    python_tasks(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    @F.pandas_udf("array<float>")
    def mean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for seq, starts in _runs(texts):
                for a in range(0, len(starts) - 1, 64):  # the gathered rows stay small
                    cut = starts[a : a + 65]
                    rows = shared.value[seq[cut[0] : cut[-1]]]
                    filled = np.diff(cut) > 0
                    part = np.zeros((len(cut) - 1, rows.shape[1]), dtype=np.float32)
                    if filled.any():
                        sums = np.add.reduceat(rows, (cut[:-1] - cut[0])[filled], axis=0, dtype=float)
                        part[filled] = sums / np.diff(cut)[filled, None]
                    out.extend(part)
            yield pd.Series(out)

    return docs.select(
        *[c for c in docs.columns if c not in (text, "pooled")], mean(F.col(text)).alias("pooled")
    )


class Network:
    """Two layers, fitted with Adam, and a temperature for the logits."""

    def __init__(self, hidden: int = 32, epochs: int = 30, seed: int = 3) -> None:
        self.hidden, self.epochs, self.seed = hidden, epochs, seed
        self.layers: list[np.ndarray] | None = None
        self.base, self.temperature = 0.5, 1.0

    def _logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum((x - self.centre) / self.spread @ w1 + b1, 0) @ w2 + b2[0]

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        """One row in five is kept back for the temperature."""
        if len(y) < 10 or y.min() == y.max():  # nothing to tell apart: the share of ones
            self.base = (y.sum() + 1) / (len(y) + 2)
            return self
        rng = np.random.default_rng(self.seed)
        back = np.arange(len(y)) % 5 == 4
        own = np.flatnonzero(~back)
        self.centre, self.spread = x[own].mean(axis=0), x[own].std(axis=0) + 1e-6
        d, h = x.shape[1], self.hidden
        layers = [rng.normal(0, d**-0.5, (d, h)), np.zeros(h), rng.normal(0, h**-0.5, h), np.zeros(1)]
        self.layers = layers
        first, second = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
        step = 0
        for _ in range(self.epochs):
            rng.shuffle(own)
            for i in range(0, len(own), 128):
                rows = own[i : i + 128]
                z = (x[rows] - self.centre) / self.spread
                inner = np.maximum(z @ layers[0] + layers[1], 0)
                error = (_sigmoid(inner @ layers[2] + layers[3][0]) - y[rows]) / len(rows)
                back_in = np.outer(error, layers[2]) * (inner > 0)
                slopes = [
                    z.T @ back_in + 1e-4 * layers[0],
                    back_in.sum(axis=0),
                    inner.T @ error + 1e-4 * layers[2],
                    np.array([error.sum()]),
                ]
                step += 1
                for p, m, s, g in zip(layers, first, second, slopes):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    p -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        grid = np.geomspace(0.5, 8, 49)
        z, t = self._logit(x[back]), y[back]
        self.temperature = min(grid, key=lambda a: np.mean(np.logaddexp(0, z / a) - t * z / a))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.base)
        return _sigmoid(self._logit(x) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit_network(rows: DataFrame, key: str, label: str = "quality", sample: int = 20_000) -> Network:
    """Fit on ``pooled`` of at most ``sample`` labelled rows, those with the least md5 of the key."""
    train = (
        rows.filter(F.col(label).isin(0, 1))
        .select(F.md5(F.col(key).cast("string")).alias("_order"), "pooled", label)
        .orderBy("_order", label)
        .limit(sample)
        .collect()
    )
    x = np.array([r["pooled"] for r in train], dtype=float) if train else np.zeros((0, 1))
    return Network().fit(x, np.array([r[label] for r in train], dtype=float))


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    train: str,
    key: str = "doc_id",
    text: str = "text",
    threshold: float = 0.3,
    sample: int = 20_000,
) -> DataFrame:
    """``docs`` without the text, with ``score`` (0 to 1) and ``predicted`` (score >= threshold).

    ``train`` is a condition on columns of ``docs``: only labels of such rows are
    learnt from.  Several labels of a key all count; labels other than 0 and 1
    and labels without a document are not used.  A NULL or empty text has the
    zero vector and gets the score of that.  With fewer than ten labels, or one
    kind only, every row gets the smoothed share of ones.  Extra columns stay.
    """
    docs = docs.drop("score", "predicted", "pooled")
    vectors = word_vectors(docs, text)
    rows = saved(pooled(docs, vectors, text))
    marks = labels.select(F.col(key).alias("_key"), F.col("quality").alias("_quality"))
    joined = rows.filter(train).join(marks, rows[key] == F.col("_key"))
    shared = docs.sparkSession.sparkContext.broadcast(fit_network(joined, "_key", "_quality", sample))

    @F.pandas_udf("double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            x = np.array(vectors.tolist(), dtype=float).reshape(len(vectors), -1)
            yield pd.Series(shared.value.score(x))

    return (
        rows.withColumn("score", judge("pooled"))
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
        .drop("pooled")
    )
