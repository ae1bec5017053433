"""Mixing sources to target weights along a curriculum.

Sizes are words.  Each source's target follows from its weight, but stops at
``most`` times its size; what it leaves is shared by the others by weight.  A
document is taken a whole number of times.  Every source has a schedule, its
weight over the course of training; the integral of the schedule is the
cumulative demand for its words.  The words taken of a source are numbered, pass
after pass, and the training position of a copy is where the demand reaches the
number of its middle word.  Range-sorting by position gives the training order.

Prefix sums run in two steps: totals by (source, bucket) and inside a bucket, so a
source with a third of all rows is spread over the buckets.  Sources are numbered
by a range sort, and the level of the targets is found by aggregations over them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondera.llm.common import saved, word_count, written_order

#: Knots (time, weight) of the schedules that sources take in turn; each integrates to 1.
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)
WEIGHTS = (1, 2, 3)
KEY = ("doc_id", "source", "size")


def inverse_demand(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Time at which a piecewise linear schedule has asked for ``share`` of its words."""
    area, steps = 0.0, []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        steps.append((area, t0, t1, w0, (w1 - w0) / (t1 - t0)))
        area += (w0 + w1) / 2 * (t1 - t0)
    when = None
    for begin, t0, t1, w0, slope in reversed(steps):
        rest = F.greatest(share * area - begin, F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0)))
        t = F.least(F.lit(t0) + 2 * rest / F.greatest(F.lit(w0) + root, F.lit(1e-12)), F.lit(t1))
        when = t if when is None else F.when(share * area >= after, when).otherwise(t)
        after = begin
    return when


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with ``turn``, their number from 0 by code point, NULL last."""
    by_name = F.col("source").asc_nulls_last()
    ordered = saved(sources.repartitionByRange(by_name).sortWithinPartitions(by_name))
    placed = ordered.select("*", *written_order())
    # a row for each file that the range sort wrote
    before = W.orderBy("_part", "_file").rowsBetween(W.unboundedPreceding, -1)
    files = (
        placed.groupBy("_part", "_file")
        .agg(F.count("*").alias("_rows"))
        .select("_file", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    return placed.join(F.broadcast(files), "_file").select(
        *sources.columns, (F.col("_before") + F.col("_at")).alias("turn")
    )


def water_level(sources: DataFrame, most: int) -> float:
    """The level at which targets of level x weight, stopped at ``most`` x size, sum up to all sizes.

    Each step shares by weight among the sources below their limit what the others
    leave, and ends when none is above; a step is one aggregation.
    """
    level, full = 0.0, -1
    while True:
        stopped = level * F.col("weight") > most * F.col("source_size")
        r = sources.agg(
            F.sum("source_size"),
            F.sum(F.when(stopped, most * F.col("source_size"))),
            F.sum(F.when(~stopped, F.col("weight"))),
            F.count(F.when(stopped, True)),
        ).first()
        if not r[0] or not r[2] or r[3] == full:
            return level
        level, full = (r[0] - (r[1] or 0)) / r[2], r[3]


def source_targets(
    sized: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = 3
) -> DataFrame:
    """One row per source: ``source_size``, ``n_docs``, ``turn``, ``target``.

    Sources go by code point, NULL last, and take the weights in turn.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("turn") % len(weights) + 1).cast("int"))
    totals = sized.groupBy("source").agg(
        F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("n_docs")
    )
    sources = saved(numbered(totals).withColumn("weight", weight))
    level = water_level(sources, most)
    target = F.least((most * F.col("source_size")).cast("double"), F.lit(level) * F.col("weight"))
    return sources.select("source", "source_size", "n_docs", "turn", target.alias("target"))


def _running(df: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """``df`` with the sums of the rows before each (``name``) and of its whole source (``all_name``), in order of ``_order``."""
    by_bucket = W.partitionBy("turn").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy("turn", "_bucket").orderBy("_order", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("turn")
    buckets = df.groupBy("turn", "_bucket").agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()])
    for n in sums:
        buckets = buckets.withColumns(
            {f"_ahead_{n}": F.coalesce(F.sum(f"_sum_{n}").over(by_bucket), F.lit(0)), f"all_{n}": F.sum(f"_sum_{n}").over(whole)}
        ).drop(f"_sum_{n}")
    own = df.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    joined = own.join(buckets, ["turn", "_bucket"])
    return joined.withColumns({n: F.col(n) + F.col(f"_ahead_{n}") for n in sums}).drop(*[f"_ahead_{n}" for n in sums])


def mix(docs: DataFrame, text: str = "text", weights: Sequence[int] = WEIGHTS, most: int = 3) -> DataFrame:
    """What the mix takes of each document (``doc_id``, ``source``, ``text``).

    One row per (doc_id, source, size) with ``rows`` (equal ones among the
    documents; they share the decision and the positions), ``source_size``, ``target``,
    ``copies``, ``taken`` and the ``positions`` of the copies, 0 to 1.

    Every document is taken floor(target / source size) times.  The words still
    missing come once more from the documents above the mean size, in order of
    the md5 of the id up to their part, and then from the others, so a source
    misses its target by no more than half a document of mean size, if its
    small documents hold enough.  The copies of a source follow each other pass by pass
    in that order, and the last, partial pass holds its own documents alone: a
    copy whose middle is word k of all n words taken stands where the integral of the schedule
    reaches k / n.  NULL texts have size 0 and no words to take; NULL ids
    and sources are values like others; an empty table gives none.  Reruns agree.
    """
    sized = saved(
        docs.select("doc_id", "source", word_count(text).alias("size"))
        .groupBy(*KEY)
        .agg(F.count("*").alias("rows"))
    )
    sources = saved(source_targets(sized, weights, most))
    few = sources.limit(100_001).count() <= 100_000
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    large, words = F.col("_large"), F.col("_words")
    placed = (
        sized.join(F.broadcast(sources) if few else sources, sized["source"].eqNullSafe(sources["source"]))
        .drop(sources["source"])
        .withColumn("_large", F.col("size") * F.col("n_docs") > F.col("source_size"))
        .withColumn("_words", F.col("size") * F.col("rows"))
        .withColumn("_order", order)
        .withColumn("_bucket", F.substring("_order", 1, 3))
    )
    zero = F.lit(0).cast("long")
    summed = saved(
        _running(placed, {"large": F.when(large, words).otherwise(zero), "small": F.when(~large, words).otherwise(zero)})
        .withColumn("_passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("_more", F.col("target") - F.col("_passes") * F.col("source_size"))
    )
    # the partial pass: large documents up to their part, then small ones up to the rest
    first = large & (F.col("large") + words / 2 <= F.col("_more") * F.col("all_large") / F.col("source_size"))
    from_large = summed.filter(first).groupBy("turn").agg(F.sum("_words").alias("_from_large"))
    rest = F.col("_more") - F.coalesce("_from_large", F.lit(0))
    extra = F.when(words == 0, False).when(large, first).otherwise(F.col("small") + words / 2 <= rest)
    decided = summed.join(F.broadcast(from_large) if few else from_large, "turn", "left").withColumn("_extra", extra)
    counted = _running(decided, {"extra": F.when(F.col("_extra"), words).otherwise(zero)})
    size = F.col("source_size")
    begin = lambda j: F.when(j < F.col("_passes"), j * size + F.col("large") + F.col("small")).otherwise(
        F.col("_passes") * size + F.col("extra")
    )

    def position(j: Column) -> Column:
        q = (begin(j) + words / 2) / (F.col("_passes") * size + F.col("all_extra"))
        kinds = [inverse_demand(q, k) for k in SCHEDULES]
        out = kinds[0]
        for i, t in enumerate(kinds[1:], 1):
            out = F.when(F.col("turn") % len(kinds) == i, t).otherwise(out)
        return out

    return (
        counted.withColumn("copies", F.when(words == 0, 0).otherwise(F.col("_passes") + F.col("_extra").cast("int")).cast("int"))
        .withColumn("taken", F.col("size") * F.col("copies"))
        .withColumn(
            "positions",
            F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), position))
            .otherwise(F.array().cast("array<double>")),
        )
        .select(*KEY, "rows", "source_size", "target", "copies", "taken", "positions")
    )


def training_order(docs: DataFrame, mixed: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` as often as the mix takes them, in order of position; the columns of ``docs``.

    Documents that the mix doesn't take are left out, so NULL and wordless texts are; NULL
    ids and sources are found as values like others, and repeated rows are taken each.  Rows
    are range-sorted by position over the partitions, ties by doc_id; an empty table gives none.
    """
    names = [f"_{k}" for k in KEY]
    plan = mixed.filter("copies > 0").select(
        *[F.col(k).alias(n) for k, n in zip(KEY, names)], F.col("positions").alias("_positions")
    )
    sized = docs.withColumn("_words", word_count(text))
    same = (
        sized["doc_id"].eqNullSafe(plan["_doc_id"])
        & sized["source"].eqNullSafe(plan["_source"])
        & (sized["_words"] == plan["_size"])
    )
    return (
        sized.join(plan, same)
        .withColumn("_position", F.explode("_positions"))
        .repartitionByRange("_position", "doc_id")
        .sortWithinPartitions("_position", "doc_id")
        .select(*docs.columns)
    )
