"""Vectors as whole numbers: which rows take part, and blocks of them as bytes.

A component x counts as floor(256 x).  Scores are inner products of these whole
numbers.  They are computed in doubles while no partial sum can pass 2^53, in 64-bit
integers beyond, and refused where a score could leave 64 bits; so they are exact,
and so are up to 128 times a score, as comparisons by percent need them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 256.0


def usable(df: DataFrame, key: str, vector: str, **others: str) -> DataFrame:
    """``key`` (long), ``others`` and ``vector`` (doubles) of the rows that take part.

    Rows with a NULL key or vector, or with a NULL, NaN or infinite component, do not.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    x = F.col(vector).cast("array<double>")
    return df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(x, finite)).select(
        F.col(key).cast("long").alias("key"), *[F.col(c).alias(n) for n, c in others.items()], x.alias("vector")
    )


@dataclass(frozen=True)
class Extent:
    """Number of rows, length of the longest vector (shorter ones end in zeros), kind of exact numbers."""

    rows: int
    width: int
    kind: str


def extent(vectors: DataFrame) -> Extent:
    sizes = vectors.agg(
        F.count("*"),
        F.max(F.size("vector")),
        F.max(F.array_max(F.transform("vector", lambda x: F.abs(x)))),
    ).first()
    rows, width, peak = sizes[0], sizes[1] or 0, SCALE * (sizes[2] or 0.0) + 1
    most = 128.0 * width * peak * peak
    if most >= 2.0**63:
        raise ValueError("components are so large that scores do not fit a long")
    return Extent(rows, width, "<f8" if most < 2.0**53 else "<i8")


def matrix(column: pa.Array, size: Extent) -> np.ndarray:
    """A row of whole numbers for each vector."""
    out = np.zeros((len(column), size.width), dtype=size.kind)
    ends = column.offsets.to_numpy()
    values = np.floor(column.values.to_numpy(zero_copy_only=False) * SCALE)
    lengths = np.diff(ends)
    rows = np.repeat(np.arange(len(column)), lengths)
    out[rows, np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], lengths)] = values[ends[0] : ends[-1]]
    return out


def to_bytes(numbers: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as they need; the first byte tells how many."""
    peak = int(np.abs(numbers).max(initial=0))
    width = 2 if peak < 1 << 15 else 4 if peak < 1 << 31 else 8
    return bytes([width]) + np.ascontiguousarray(numbers).astype(f"<i{width}").tobytes()


def from_bytes(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<i{data[0]}", offset=1).astype(kind)
