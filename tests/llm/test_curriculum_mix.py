from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest

from corpus import FOLDER, words
from sondera.llm import curriculum_mix as cm

SCHEMA = "doc_id long, source string, text string, size string"


def frame(spark, rows):
    return spark.createDataFrame([(i, s, t, "x") for i, s, t in rows], SCHEMA)


def water_level(sizes):
    """Targets by sharing again and again, sources by code point with NULL last."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, open_, target = float(sum(sizes.values())), set(names), dict.fromkeys(names, 0.0)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        for s in full or open_:
            target[s] = 3.0 * sizes[s] if full else level * weight[s]
        if not full:
            break
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    sources = ["a"] * 60 + ["b"] * 4 + ["c"] * 2 + [None] * 3 + ["Z"] * 25
    return [(i, s, " ".join("w" * r.randint(1, 3) for _ in range(r.randint(0, 60)))) for i, s in enumerate(sources)]


def test_targets_and_words_taken(spark, rows):
    got = cm.mix(frame(spark, rows)).collect()
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, s, t in rows:
        sizes[s] += len(words(t))
        largest[s] = max(largest[s], len(words(t)))
    want = water_level(dict(sizes))
    for r in got:
        assert r.target == pytest.approx(want[r.source])
        assert r.source_size == sizes[r.source] and r.taken <= 3 * r.size
        assert len(r.positions) == r.copies and all(0 <= p <= 1 for p in r.positions)
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1e-6
    again = cm.mix(frame(spark, rows).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_training_order(spark, rows):
    df = frame(spark, rows)
    mixed = cm.mix(df)
    copies = {r.doc_id: r.copies for r in mixed.collect()}
    out = cm.training_order(df, mixed)
    assert out.columns == df.columns
    order = [r.doc_id for r in out.collect()]
    assert {i: order.count(i) for i in copies} == copies
    place = sorted((p, r.doc_id) for r in mixed.collect() for p in r.positions)
    assert order == [i for _, i in place]


def demand(knots, t):
    """Integral of a schedule up to ``t``, by its trapezes."""
    total = 0.0
    for (a, u), (b, v) in zip(knots, knots[1:]):
        end = min(max(t, a), b)
        total += (end - a) * (u + u + (v - u) * (end - a) / (b - a)) / 2
    return total


def held_to_schedule(mixed):
    """Asserts the words taken up to each tenth of training, source by source."""
    by = defaultdict(list)
    for r in mixed:
        for p in r.positions:
            by[r.source].append((p, r.size * r.rows))
    names = sorted({r.source for r in mixed}, key=lambda s: (s is None, s or ""))
    for turn, source in enumerate(names):
        own, knots = by[source], cm.SCHEDULES[turn % 3]
        words_taken, largest = sum(w for _, w in own), max((w for _, w in own), default=0)
        for t in range(1, 11):
            here = sum(w for p, w in own if p <= t / 10)
            # the copy across the border counts whole where its middle lies
            assert abs(here - words_taken * demand(knots, t / 10)) <= largest / 2 + 1e-6, (source, t)


def test_words_follow_the_schedules(spark, rows):
    held_to_schedule(cm.mix(frame(spark, rows)).collect())
    # one hot source with less than one pass, a small one with almost three
    some = [(i, "hot" if i % 10 else "small", "w " * (1 + i * 7 % 90)) for i in range(600)]
    mixed = cm.mix(frame(spark, some)).collect()
    held_to_schedule(mixed)
    partial = [p for r in mixed for p in r.positions if r.source == "hot"]
    assert min(partial) < 0.02 and max(partial) > 0.98
    held_to_schedule(cm.mix(spark.read.parquet(f"{FOLDER}/documents.parquet")).collect())


def test_sources_are_numbered_in_order(spark):
    names = [None, "", *[f"s{i:03}" for i in range(150)], "Z", "é"]
    df = spark.createDataFrame([(n, 1) for n in names], "source string, x int").repartition(5)
    got = {r.source: r.turn for r in cm.numbered(df).collect()}
    assert got == {n: i for i, n in enumerate(sorted(names, key=lambda s: (s is None, (s or "").encode())))}


def test_schedules_are_inverted(spark):
    for knots in cm.SCHEDULES:
        steps = 1000
        for q in (0.0, 0.1, 0.5, 0.9, 1.0):
            from pyspark.sql import functions as F

            t = spark.range(1).select(cm.inverse_demand(F.lit(q), knots).alias("t")).first().t

            def weight(x):
                for (a, u), (b, v) in zip(knots, knots[1:]):
                    if x <= b:
                        return u + (v - u) * (x - a) / (b - a)
                return knots[-1][1]

            area = sum(weight(t * (i + 0.5) / steps) for i in range(steps)) * t / steps
            assert area == pytest.approx(q, abs=1e-5)


def test_nulls_repeats_and_no_rows(spark):
    rows = [(None, None, None), (None, None, "a b"), (7, "s", "x y z"), (7, "s", "x y z"), (7, "s", "")]
    got = cm.mix(frame(spark, rows)).collect()
    assert sum(r.rows for r in got) == 5
    assert all(r.taken == 0 for r in got if r.size == 0)
    assert not any(math.isnan(r.target) for r in got)
    assert cm.mix(frame(spark, rows).limit(0)).count() == 0
    empty = frame(spark, [(1, "a", None), (2, "b", " ")])
    assert {(r.copies, r.target) for r in cm.mix(empty).collect()} == {(0, 0.0)}
