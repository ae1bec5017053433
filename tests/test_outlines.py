"""Outlines of several rings against sums over triangles."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sondera.operators import layers

SCHEMA = "key string, part int, hole boolean, i int, x double, y double"


def square(x, y, size, clockwise=False):
    corners = [(x, y), (x + size, y), (x + size, y + size), (x, y + size)]
    return corners[::-1] if clockwise else corners


def table(spark, outlines):
    rows = [
        (key, part, hole, i, float(x), float(y))
        for key, parts in outlines.items()
        for part, (hole, ring) in enumerate(parts)
        for i, (x, y) in enumerate(ring)
    ]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


OUTLINES = {
    # a square of 10 with a hole of 2 in it, and an island of 4 to the east
    "land": [(False, square(0, 0, 10)), (True, square(6, 6, 2, True)), (False, square(20, 3, 4))],
    "turned": [(False, square(0, 0, 10, True)), (True, square(6, 6, 2)), (False, square(20, 3, 4, True))],
    "one": [(False, square(1, 1, 2))],
    "line": [(False, [(0, 0), (5, 5)])],
    None: [(False, square(-4, -4, 2))],
}


def expected(parts):
    area = x = y = 0.0
    for hole, ring in parts:
        xs, ys = [p[0] for p in ring], [p[1] for p in ring]
        a = (max(xs) - min(xs)) * (max(ys) - min(ys)) * (-1 if hole else 1)
        area, x, y = area + a, x + a * (max(xs) + min(xs)) / 2, y + a * (max(ys) + min(ys)) / 2
    return x / area, y / area


@pytest.mark.parametrize("hole", ["hole", None])
def test_parts_weigh_by_area_and_holes_subtract(spark, hole):
    found = layers.centroids(table(spark, OUTLINES), "key", "i", F.floor(F.col("i") / 2), part="part", hole=hole)
    got = {r.key: (r.x, r.y) for r in found.collect()}
    assert set(got) == set(OUTLINES)
    for key in ("land", "turned", "one", None):
        assert got[key] == pytest.approx(expected(OUTLINES[key]))
    assert got["line"] == (None, None)


def test_no_edge_joins_two_parts(spark):
    """As one ring the same vertices give another centroid."""
    df = table(spark, {"land": OUTLINES["land"]}).withColumn("n", F.col("part") * 10 + F.col("i"))
    apart = layers.centroids(df, "key", "n", F.lit(0), part="part").first()
    as_one = layers.centroids(df, "key", "n", F.lit(0)).first()
    assert (apart.x, apart.y) == pytest.approx(expected(OUTLINES["land"]))
    assert abs(as_one.x - apart.x) > 0.05


def test_measures_of_outlines(spark):
    df = table(spark, OUTLINES)
    ring_table = layers.rings(df, ["key", "part", "hole"], "i", F.lit(0))
    got = {r.key: (r.area, r.rings) for r in layers.outlines(ring_table, "key", "hole").collect()}
    assert got["land"] == got["turned"] == (100 - 4 + 16, 3) and got["line"] == (0.0, 1)
    assert layers.centroids(df.limit(0), "key", "i", F.lit(0), part="part").count() == 0
