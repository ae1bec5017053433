"""Ordered computations on keys of any size.

A window over a whole key puts that key into one task.  Here the order is cut
into buckets (an hour of the clock, a stretch of the numeric axis): the row
work runs per (key, bucket), and only one or two rows per bucket meet in a
second window over the key: at most two per hour of the whole span, however
many rows the key has.  Results equal those of one window over the key.

``bucket`` must never decrease along the order.  Where a bucket may itself hold very
many rows, ``rows`` cuts it at quantiles of the first order column until none holds
much more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Parts that one quantile sketch cuts a bucket into, and how often parts are cut again.
PARTS, LEVELS = 64, 3
#: Cut tables of more rows than this are left to Spark's own choice of join.
BROADCAST_CELLS = 10_000


def _cut_points(df: DataFrame, keys: Sequence[str], x: str, rows: int) -> DataFrame | None:
    """``_k0`` ..., ``_c`` and ``_cuts`` of the cells with more than ``rows`` rows; none if there is none.

    The sketch is taken once and kept as a table, since another run of it could put the
    cuts elsewhere.  It has a row for every ``rows`` rows of ``df`` at most.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    cells = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("_cell").alias("_c"), F.col(x).alias("_x"))
    counts = cells.groupBy(*names, "_c").agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_low"))
    dense = counts.filter(F.col("_n") > rows).filter("_low IS NOT NULL")
    found = dense.collect()
    if not found:
        return None
    dense = df.sparkSession.createDataFrame(found, dense.schema)
    dense = F.broadcast(dense) if len(found) <= BROADCAST_CELLS else dense
    own = dense.select(*[F.col(n).alias(f"{n}d") for n in [*names, "_c"]], "_n", "_low")
    same = [F.col(n).eqNullSafe(F.col(f"{n}d")) for n in [*names, "_c"]]
    quantiles = F.percentile_approx("_x", [i / PARTS for i in range(1, PARTS)], 100 * PARTS)
    parts = F.least(F.lit(PARTS), F.ceil(F.col("_n") / rows)).cast("int")
    wanted = F.transform(
        F.sequence(F.lit(1), parts - 1), lambda j: F.get("_q", F.floor(j * PARTS / parts).cast("int") - 1)
    )
    cuts = (
        cells.join(own, same)
        .groupBy(*names, "_c", "_n", "_low")
        .agg(quantiles.alias("_q"))
        .select(*names, "_c", F.filter(F.array_distinct(wanted), lambda c: c > F.col("_low")).alias("_cuts"))
        .filter(F.size("_cuts") > 0)
    )
    table = cuts.collect()
    if not table:
        return None
    table = df.sparkSession.createDataFrame(table, cuts.schema)
    return F.broadcast(table) if len(found) <= BROADCAST_CELLS else table


def by_depth(df: DataFrame, keys: Sequence[str], bucket: Column, x: str, rows: int) -> DataFrame:
    """``df`` with ``_cell``, the bucket cut further until it holds about ``rows`` rows at most.

    Cells never decrease along ``x``, the first column of the order.  Rows equal in ``x`` stay
    together.  Where no bucket is that dense this costs one count and cuts nothing.
    """
    df = df.withColumn("_cell", F.array(bucket.cast("bigint")))
    for _ in range(LEVELS):
        cuts = _cut_points(df, keys, x, rows)
        if cuts is None:
            break
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        passed = F.size(F.filter(F.coalesce("_cuts", F.array().cast(cuts.schema["_cuts"].dataType)), lambda c: c <= F.col(x)))
        df = (
            df.join(cuts, [*same, F.col("_cell") == F.col("_c")], "left")
            .withColumn("_cell", F.concat("_cell", F.array(passed.cast("bigint"))))
            .drop("_c", "_cuts", *[f"_k{i}" for i in range(len(keys))])
        )
    return df


def neighbour_pairs(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    carry: Sequence[str],
    bucket: Column,
    rows: int | None = None,
    top: str | None = None,
) -> DataFrame:
    """Each row beside its successor: ``c`` and ``next_c`` for order and carry.

    The last row of a key has NULL successors.  ``rows`` cuts dense buckets, see ``by_depth``.
    ``top`` names a column whose largest value in a bucket comes along as ``_top`` on the
    bucket's last row (NULL on the others), found by the scan that is made anyway.
    """
    if rows is not None:
        df = by_depth(df, keys, bucket, order[0], rows)
        bucket = F.col("_cell")
    cols = list(dict.fromkeys([*order, *carry]))
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order)
    across = W.partitionBy(*keys).orderBy(*order)
    placed = df.select(*keys, *cols, bucket.alias("_bucket")).select(
        *keys,
        *cols,
        *[F.lead(c).over(inside).alias(f"next_{c}") for c in cols],
        F.lead(F.lit(False), 1, True).over(inside).alias("_last"),
        F.lag(F.lit(False), 1, True).over(inside).alias("_first"),
        *([] if top is None else [F.max(top).over(inside.rowsBetween(W.unboundedPreceding, 0)).alias("_top")]),
    )
    if top is not None:
        placed = placed.withColumn("_top", F.when(F.col("_last"), F.col("_top")))
    within = placed.filter(~F.col("_last"))
    edges = (
        placed.filter(F.col("_last") | F.col("_first"))
        .withColumns({f"next_{c}": F.lead(c).over(across) for c in cols})
        .filter("_last")
    )
    return within.unionByName(edges).drop("_first", "_last")


PLACES = 18


def exact_amount(x: Column) -> Column:
    """``x`` as a decimal of ``PLACES`` places; an error if that would change it."""
    amount = x.cast(f"decimal(38,{PLACES})")
    lost = F.raise_error(F.concat(F.lit(f"more than {PLACES} decimal places: "), x.cast("string")))
    return F.when(amount.cast("double") == x.cast("double"), amount).when(x.isNotNull(), lost)


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, str],
    bucket: Column,
    attach: DataFrame | None = None,
    on: Sequence[str] = (),
    rows: int | None = None,
) -> DataFrame:
    """Running totals of amounts along an order.

    ``values`` maps amount columns to output columns.  Amounts are added as
    decimals of ``PLACES`` places: exact, and the same for every partitioning.
    An amount that needs more places stops the query instead of being rounded;
    the total alone becomes a double.

    ``attach`` is a table by key columns ``on`` to be left-joined as well.  It
    meets the bucket totals, a few rows per key, and reaches the rows with
    them, so the rows are not shuffled by a hot key for its sake.  ``rows`` cuts
    dense buckets, see ``by_depth``.
    """
    columns = df.columns
    if rows is not None:
        df = by_depth(df, keys, bucket, order[0], rows)
        bucket = F.col("_cell")
    keyed = df.withColumn("_group", F.struct(*keys, bucket.alias("_bucket")))
    exact = {v: exact_amount(F.col(v)) for v in values}
    earlier = (
        W.partitionBy(*[f"_group.{k}" for k in keys])
        .orderBy("_group._bucket")
        .rowsBetween(W.unboundedPreceding, -1)
    )
    offsets = (
        keyed.groupBy("_group")
        .agg(*[F.sum(x).alias(v) for v, x in exact.items()])
        .select(
            "_group",
            *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_before_{v}") for v in values],
        )
    )
    if attach is not None:
        named = offsets.withColumns({f"_on_{c}": F.col(f"_group.{c}") for c in on})
        table = attach.withColumnsRenamed({c: f"_on_{c}" for c in on})
        offsets = named.join(table, [f"_on_{c}" for c in on], "left").drop(
            *[f"_on_{c}" for c in on]
        )
    inside = W.partitionBy("_group").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = keyed.withColumns({f"_run_{v}": F.sum(x).over(inside) for v, x in exact.items()})
    total = {
        out: (F.coalesce(F.col(f"_run_{v}"), F.lit(0)) + F.col(f"_before_{v}")).cast("double")
        for v, out in values.items()
    }
    helpers = ["_group", *set(df.columns) - set(columns), *[f"_run_{v}" for v in values], *[f"_before_{v}" for v in values]]
    return local.join(offsets, "_group").withColumns(total).drop(*helpers)
