"""Tables behind maps and plots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondera.functions.numeric import mixed, percent, signif
from sondera.operators.ordered import neighbour_pairs


def station_layer(
    stations: DataFrame, min_coverage: float = 0.95, region: str | None = None
) -> DataFrame:
    """Stations that pass the coverage gate with their loss in percent."""
    shown = stations.filter(F.col("pct") >= min_coverage)
    if region is not None:
        shown = shown.filter(F.col("region") == region)
    return shown.withColumns(
        {
            "pct_shallow": percent(F.col("loss_shallow")),
            "pct_deep": percent(F.col("loss_deep")),
            "pct_mixed": percent(mixed(F.col("loss_shallow"), F.col("loss_deep"))),
        }
    )


def loss_label(state: Column, share: Column, digits: int = 3) -> Column:
    """Two-line map label such as ``NC:`` over ``18.2%``."""
    shown = signif(percent(share), digits).cast("string")
    return F.concat(state, F.lit(":\n"), F.regexp_replace(shown, r"\.0$", ""), F.lit("%"))


def state_labels(
    outlines: DataFrame,
    means: DataFrame,
    renames: Sequence[tuple[str, str, str]] = (),
    positions: Sequence[tuple[str, str, float, float]] = (),
) -> DataFrame:
    """Label rows: outline centroids joined to the state means.

    A state in two regions gives two rows.  ``renames`` holds (state, region,
    label) and ``positions`` (state, region, x, y) for such states.
    """
    joined = outlines.join(means, "state", "left")
    name, x, y = F.col("state"), F.col("x"), F.col("y")
    for state, region, shown in renames:
        here = (F.col("state") == state) & (F.col("region") == region)
        name = F.when(here, F.lit(shown)).otherwise(name)
    for state, region, at_x, at_y in positions:
        here = (F.col("state") == state) & (F.col("region") == region)
        x = F.when(here, F.lit(at_x)).otherwise(x)
        y = F.when(here, F.lit(at_y)).otherwise(y)
    share = mixed(F.col("shallow"), F.col("deep"))
    return joined.select(
        "state",
        "region",
        name.alias("postal"),
        x.alias("x"),
        y.alias("y"),
        loss_label(name, share).alias("label_mixed"),
        loss_label(name, F.col("shallow")).alias("label_shallow"),
        loss_label(name, F.col("deep")).alias("label_deep"),
    )


def rings(
    vertices: DataFrame, keys: Sequence[str], order: str, bucket: Column, x: str = "x", y: str = "y"
) -> DataFrame:
    """Signed measures of each ring given as vertices in drawing order.

    ``area2`` is twice its area, negative if it turns clockwise, and ``moment_x`` and ``moment_y`` six
    times its first moments.  Edges join each vertex to its successor and the last one
    to the first.
    """
    edges = neighbour_pairs(vertices, keys, [order], [x, y], bucket)
    inner = edges.filter(F.col(f"next_{order}").isNotNull())
    ends = vertices.groupBy(*keys).agg(
        F.max_by(x, order).alias(x),
        F.max_by(y, order).alias(y),
        F.min_by(x, order).alias(f"next_{x}"),
        F.min_by(y, order).alias(f"next_{y}"),
    )
    names = [*keys, x, y, f"next_{x}", f"next_{y}"]
    x0, y0, x1, y1 = (F.col(c) for c in names[-4:])
    cross = x0 * y1 - x1 * y0
    return (
        inner.select(*names)
        .unionByName(ends.select(*names))
        .groupBy(*keys)
        .agg(
            F.sum(cross).alias("area2"),
            F.sum((x0 + x1) * cross).alias("moment_x"),
            F.sum((y0 + y1) * cross).alias("moment_y"),
        )
    )


def outlines(
    ring_table: DataFrame, key: str, hole: str | None = None
) -> DataFrame:
    """Area and centroid of each outline from its rings; parts weigh by area and holes subtract.

    ``hole`` names a column of ``ring_table`` that is true for holes, whichever way they turn.  Without it
    the rings that turn like the outline's largest one are parts and the others holes.
    An outline without area has no centroid.
    """
    if hole is None:
        largest = F.max_by(F.signum("area2"), F.abs("area2"))
        turns = ring_table.groupBy(key).agg(largest.alias("_turn"))
        ring_table = ring_table.join(turns, ring_table[key].eqNullSafe(turns[key])).drop(turns[key])
        sign = F.col("_turn")
    else:
        sign = F.signum("area2") * F.when(F.col(hole), -1.0).otherwise(1.0)
    area2 = F.sum(F.col("area2") * sign)
    return ring_table.groupBy(key).agg(
        F.try_divide(F.sum(F.col("moment_x") * sign), area2 * 3).alias("x"),
        F.try_divide(F.sum(F.col("moment_y") * sign), area2 * 3).alias("y"),
        (area2 / 2).alias("area"),
        F.count(F.lit(1)).alias("rings"),
    )


def centroids(
    vertices: DataFrame,
    key: str,
    order: str,
    bucket: Column,
    x: str = "x",
    y: str = "y",
    part: str | None = None,
    hole: str | None = None,
) -> DataFrame:
    """Area centroid of each outline given as vertices in drawing order.

    Each value of ``part`` is a ring of its own; without it an outline is one ring.
    ``hole`` is a boolean column of the vertices, the same along a ring (see ``outlines``).
    """
    keys = [key, *([part] if part else []), *([hole] if hole else [])]
    found = outlines(rings(vertices, keys, order, bucket, x, y), key, hole)
    return found.select(key, "x", "y")


def plot_series(summary: DataFrame, mean: str = "fraction", se: str = "se") -> DataFrame:
    """Readable depth and treatment with the bounds of one standard error."""
    return summary.withColumns(
        {
            "depth": F.when(F.col("depth") == "M", "Deep").otherwise("Shallow"),
            "treatment": F.when(F.col("treatment") == "IB 20", "20° C").otherwise("30° C"),
            "low": F.col(mean) - F.col(se),
            "high": F.col(mean) + F.col(se),
        }
    )


def axis_label(x: Column) -> Column:
    """Percent label at whole tens, blank elsewhere."""
    shown = F.concat(x.cast("bigint").cast("string"), F.lit("%"))
    return F.when(x % 10 == 0, shown).otherwise(F.lit(""))
