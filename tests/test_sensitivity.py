from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from sondera.operators import sensitivity
from sondera.operators.response import (
    activation_energy,
    annual_loss,
    arrhenius,
    curve_wide,
    final_rates,
    normalise_year,
    total_constant_rate,
)
from sondera.operators.sensitivity import (
    crossing_times,
    elapsed_by_portion,
    last_threshold,
    q10q,
    threshold_bins,
    threshold_neighbours,
    threshold_pairs,
)

STEP = 0.01


def monotone(seed=3):
    """Bottle ``hot`` holds most points; ``flat`` never moves."""
    rng = random.Random(seed)
    rows, sizes = [], {"hot": 300, "a": 20, "b": 5, "flat": 4}
    for bottle, n in sizes.items():
        y = 0.0
        for i in range(n):
            y += 0.0 if bottle == "flat" else rng.choice([0, 0.2, 1, 3]) * rng.random() / n * 5 * STEP
            rows.append((bottle, float(i), i, y))
    rows.append(("a", 99.0, 99, None))
    return rows


def brute(rows):
    top = max(r[3] for r in rows if r[3] is not None)
    last = round(round(top, 2) / STEP)
    out = {}
    for bottle in {r[0] for r in rows}:
        points = [(x, y) for b, x, _, y in rows if b == bottle and y is not None]
        for k in range(last + 1):
            below = [p for p in points if p[1] <= k * STEP]
            above = [p for p in points if p[1] > k * STEP]
            if below:
                out[bottle, k] = (
                    max(p[0] for p in below), max(p[1] for p in below),
                    min((p[0] for p in above), default=None), min((p[1] for p in above), default=None),
                )
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "bottle string, day double, id int, fraction double")


def as_dict(df):
    return {(r.bottle, r.k): (r.x0, r.y0, r.x1, r.y1) for r in df.collect()}


@pytest.mark.parametrize("parts", [1, 6])
def test_both_forms_equal_brute_force_on_monotone_series(spark, parts):
    df = frame(spark, monotone()).repartition(parts)
    expected = brute(monotone())
    pairs = threshold_pairs(threshold_bins(df, ["bottle"]), ["bottle"])
    assert as_dict(pairs) == expected
    near = threshold_neighbours(df, ["bottle"], ["day", "id"], F.floor(F.col("day") / 10))
    # of points with equal y the extremes take the last before and the first after
    assert as_dict(near) == expected


def test_forms_differ_where_the_series_falls(spark):
    rows = [("u", 0.0, 0, 0.02), ("u", 1.0, 1, 0.01), ("u", 2.0, 2, 0.03)]
    df = frame(spark, rows)
    assert as_dict(threshold_pairs(threshold_bins(df, ["bottle"]), ["bottle"])) == brute(rows)
    near = as_dict(threshold_neighbours(df, ["bottle"], ["day", "id"], F.floor("day")))
    assert near["u", 1] == (1.0, 0.01, 2.0, 0.03)
    assert near["u", 3] == (2.0, 0.03, None, None)


@pytest.mark.parametrize("once", [False, True])
def test_thresholds_reach_the_largest_value_wherever_it_lies(spark, monkeypatch, once):
    if once:  # a table of its own, as a staged one is
        monkeypatch.setattr(sensitivity, "stages", lambda _: True)
        monkeypatch.setattr(sensitivity, "stage", lambda df: spark.createDataFrame(df.collect(), df.schema))
    # the top is in the middle of a bucket of a key that has fallen since
    rows = [("u", 0.0, 0, 0.01), ("u", 1.0, 1, 0.05), ("u", 2.0, 2, 0.02), ("u", 3.0, 3, None), ("w", 0.5, 4, 0.03)]
    near = as_dict(threshold_neighbours(frame(spark, rows), ["bottle"], ["day", "id"], F.floor(F.col("day") / 10)))
    assert sorted(k for b, k in near if b == "w") == [3, 4, 5]
    assert near["w", 5] == (0.5, 0.03, None, None)
    assert near["u", 5] == (2.0, 0.02, None, None)
    empty = frame(spark, [])
    assert as_dict(threshold_neighbours(empty, ["bottle"], ["day", "id"], F.floor("day"))) == {}


def test_neighbours_read_the_points_once(spark, tmp_path, monkeypatch):
    def written(df):
        df.write.parquet(str(tmp_path / "staged"))
        return spark.read.parquet(str(tmp_path / "staged"))

    monkeypatch.setattr(sensitivity, "stages", lambda _: True)
    monkeypatch.setattr(sensitivity, "stage", written)
    frame(spark, monotone()).write.parquet(str(tmp_path / "points"))
    points = spark.read.parquet(str(tmp_path / "points"))
    near = threshold_neighbours(points, ["bottle"], ["day", "id"], F.floor(F.col("day") / 10))
    # what is left to run, the subquery of the last threshold included, reads the staged pairs
    left = near._jdf.queryExecution().toString()
    assert str(tmp_path / "staged") in left and str(tmp_path / "points") not in left
    assert as_dict(near) == brute(monotone())


def test_last_threshold(spark):
    df = frame(spark, [("u", 0.0, 0, 0.126)])
    assert df.select(last_threshold(df)).first()[0] == 13


def test_elapsed_and_q10q(spark):
    rows = []
    for treatment, speed in (("IB 20", 0.005), ("IB 30", 0.01)):
        for rep in range(3):
            rows += [(treatment, "S", rep, float(d), d * speed) for d in range(11)]
    df = spark.createDataFrame(rows, "treatment string, depth string, rep int, day double, fraction double")
    keys = ["treatment", "depth", "rep"]
    pairs = crossing_times(threshold_pairs(threshold_bins(df, keys), keys))
    elapsed = elapsed_by_portion(pairs, keys)
    one = {r.k: r for r in elapsed.filter("treatment = 'IB 30' and rep = 0").collect()}
    assert one[3].crossing == pytest.approx(3.0) and one[3].elapsed == pytest.approx(1.0)
    ratio = {r.k: r for r in q10q(elapsed).collect()}
    assert 0 not in ratio
    assert ratio[3].q10q == pytest.approx(2.0) and ratio[3].n == 6
    assert ratio[3].se == pytest.approx(ratio[3].sd / math.sqrt(6))
    # the cold bottles never pass 0.05: listed without a time
    assert ratio[5].q10q is None and 6 not in {k for k, r in ratio.items() if r.q10q is not None}


def rates(spark):
    rows = [("deep", 6e-4, 3e-5, 1.2e-3, 5e-5), ("shallow", 8e-4, 4e-5, 1.5e-3, 6e-5)]
    return spark.createDataFrame(rows, "depth string, k1 double, dk1 double, k2 double, dk2 double")


def test_curve_passes_through_both_rates(spark):
    got = {(r.depth, r.temp_c): r for r in arrhenius(rates(spark)).collect()}
    assert len(got) == 112
    assert got["deep", 20].k == pytest.approx(6e-4) and got["deep", 30].k == pytest.approx(1.2e-3)
    assert got["shallow", 20].dk == pytest.approx(4e-5)


def test_order_of_evaluation_changes_the_error_only(spark):
    plain = {(r.depth, r.temp_c): r for r in arrhenius(rates(spark)).collect()}
    late = {(r.depth, r.temp_c): r for r in arrhenius(rates(spark), compat=True).collect()}
    assert all(plain[k].k == late[k].k for k in plain)
    # at the cold reference temperature the exponent is 0 and both nearly agree
    assert late["deep", 20].dk == pytest.approx(plain["deep", 20].dk, rel=1e-3)
    assert late["deep", 5].dk > 2 * plain["deep", 5].dk


def test_activation_energy_from_known_q10(spark):
    rows = [("deep", 1.0, 0.1, 2.22, 0.1), ("shallow", 1.0, 0.1, 1.96, 0.1)]
    df = spark.createDataFrame(rows, "depth string, k1 double, dk1 double, k2 double, dk2 double")
    got = {r.depth: r.ea for r in activation_energy(df).collect()}
    assert got["deep"] == pytest.approx(58.8, abs=0.2)
    assert got["shallow"] == pytest.approx(49.7, abs=0.2)


def test_final_rates(spark):
    rows = [
        (10.0, "M", "IB 20", 9.0, 9.0),
        (20.0, "M", "IB 20", 1.0, 0.1),
        (20.0, "M", "IB 30", 2.0, 0.2),
        (20.0, "S", "IB 30", 3.0, 0.3),
    ]
    df = spark.createDataFrame(rows, "day double, depth string, treatment string, rate double, sd double")
    for last_day in (None, F.lit(20.0)):
        got = {r.depth: tuple(r)[1:] for r in final_rates(df, last_day=last_day).collect()}
        assert got == {"deep": (1.0, 0.1, 2.0, 0.2), "shallow": (None, None, 3.0, 0.3)}


def test_annual_loss_by_hand(spark):
    hist = spark.createDataFrame(
        [("s", 20, 240), ("s", 30, 480), ("s", 0, 0), ("empty", 10, 0)], "station string, temp_c int, n bigint"
    )
    curve = arrhenius(rates(spark))
    at = {(r.depth, r.temp_c): r for r in curve.collect()}
    got = {r.station: r for r in annual_loss(hist, curve).collect()}
    deep = 1 * at["deep", 20].k + 2 * at["deep", 30].k
    assert got["s"].loss_deep == pytest.approx(deep)
    assert got["s"].dloss_deep == pytest.approx(math.hypot(at["deep", 20].dk, 2 * at["deep", 30].dk))
    assert got["empty"].loss_deep == 0.0
    constant = {r.station: r for r in total_constant_rate(hist, rates(spark)).collect()}
    assert constant["s"].loss_shallow == pytest.approx(3 * 1.5e-3 * 1000)
    assert curve_wide(curve).count() == 56
    none = annual_loss(hist, curve.filter("false")).collect()
    assert {(r.station, r.loss_deep) for r in none} == {("s", None), ("empty", None)}


def test_normalise_year(spark):
    df = spark.createDataFrame(
        [(0.5, 87600.0, 0.1), (0.5, 87840.0, 0.1), (0.0, 87600.0, 0.1)], "pct double, expected double, loss_deep double"
    )
    got = [r.loss_deep for r in normalise_year(df).collect()]
    assert got == [0.2, pytest.approx(0.2 * 365 / 366), None]
