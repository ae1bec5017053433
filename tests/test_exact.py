"""Sums that are the same to the bit under any partitioning."""

from __future__ import annotations

import math
import random
import struct
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from sondera.functions.exact import exact_avg, exact_sum
from sondera.operators import budget
from sondera.operators.summary import mean_with_error, sum_with_error


def bits(x):
    return None if x is None else struct.pack("<d", x)


def values(seed, n):
    r = random.Random(seed)
    kinds = [
        lambda: r.uniform(-1, 1),
        lambda: r.uniform(-1, 1) * 10.0 ** r.randint(-35, 40),
        lambda: float(r.randint(-(2**53), 2**53)),
        lambda: math.ldexp(r.randint(1, 2**53), r.randint(-200, 100)),
        lambda: r.choice([0.0, -0.0, 0.1, -0.1, 1e16, -1e16, 2.0**27, 2.0**28, -(2.0**28), 2.0**-28]),
    ]
    return [kinds[i % len(kinds)]() for i in range(n)]


def total(spark, xs, parts=1):
    df = spark.createDataFrame([(x,) for x in xs], "x double").repartition(parts)
    return df.agg(exact_sum(F.col("x")).alias("s")).first().s


@pytest.mark.parametrize("seed", range(4))
def test_against_fractions(spark, seed):
    xs = values(seed, 300)
    true = sum(map(Fraction, xs))
    got = total(spark, xs, 3)
    assert abs(Fraction(got) - true) <= Fraction(math.ulp(got))


def test_cancellation(spark):
    xs = [1e40, 1.0, -1e40, 2.0**-60, 1e-30]
    assert total(spark, xs) == 1.0 + 2.0**-60 + 1e-30
    assert total(spark, [0.1] * 10) == 1.0
    assert total(spark, [-0.3, 0.1, 0.2]) == float(Fraction(-0.3) + Fraction(0.1) + Fraction(0.2))
    assert total(spark, [-5.5]) == -5.5 and total(spark, [-(2.0**-224), 2.0**195]) == 2.0**195


def test_equal_bits_under_1_and_200_partitions(spark):
    r = random.Random(9)
    rows = [(r.choice("abc"), x) for x in values(9, 3000)]
    df = spark.createDataFrame(rows, "key string, x double")
    seen, plain = set(), set()
    for parts in (1, 7, 200):
        got = df.repartition(parts).groupBy("key").agg(
            exact_sum(F.col("x")).alias("s"), exact_avg(F.col("x")).alias("m"), F.sum("x").alias("p")
        ).collect()
        seen.add(tuple(sorted((g.key, bits(g.s), bits(g.m)) for g in got)))
        plain.add(tuple(sorted((g.key, bits(g.p)) for g in got)))
    assert len(seen) == 1 and len(plain) > 1


def test_nulls_and_special_values(spark):
    inf, nan = float("inf"), float("nan")
    assert total(spark, [None, 1.5, None]) == 1.5 and total(spark, [None]) is None and total(spark, []) is None
    assert total(spark, [inf, 1.0]) == inf and total(spark, [-inf, 1.0, None]) == -inf
    assert math.isnan(total(spark, [inf, -inf])) and math.isnan(total(spark, [nan, 1.0]))
    for x in (1e60, 1e-70, -1e300):
        with pytest.raises(Exception, match="out of range"):
            total(spark, [1.0, x])


def test_budget_to_the_bit(spark):
    r = random.Random(2)
    columns = ["region", "state", "length", "n", "erosion", "bank", "volume", "carbon", "decomp", "sd"]
    rows = [
        (f"r{i % 3}", f"s{i}", r.uniform(1, 1e4), i, e, b, *(r.uniform(0, 1e9) for _ in range(3)), None if i == 7 else r.uniform(0, 1e6))
        for i in range(90) for e in ("Large", "Small") for b in ("Tall", "Short")
    ]
    df = spark.createDataFrame(rows, columns)
    results = []
    for parts in (1, 200):
        got = budget.roll_up(df.repartition(parts), exact=True).collect()
        results.append(sorted(str(tuple(bits(x) if isinstance(x, float) else x for x in g)) for g in got))
    assert results[0] == results[1]
    near = {(g.level, g.region, g.state, g.erosion, g.bank): g for g in budget.roll_up(df).collect()}
    for g in budget.roll_up(df, exact=True).collect():
        other = near[g.level, g.region, g.state, g.erosion, g.bank]
        assert g.decomp == pytest.approx(other.decomp) and g.sd == (other.sd and pytest.approx(other.sd))


def test_means_and_totals_to_the_bit(spark):
    r = random.Random(3)
    rows = [(i % 4, r.uniform(0, 1), r.uniform(0, 1e-3) if i % 9 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, x double, dx double")
    for fold in (
        lambda d: sum_with_error(d, ["k"], ["x"], exact=True),
        lambda d: mean_with_error(d, ["k"], ["x"], F.col("x") > 0.2, exact=True),
    ):
        a, b = (sorted((g.k, bits(g.x), bits(g.dx)) for g in fold(df.repartition(n)).collect()) for n in (1, 200))
        assert a == b
