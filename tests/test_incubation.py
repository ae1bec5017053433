from __future__ import annotations

import math
import statistics

import pytest
from pyspark.sql import functions as F

from sondera.operators.incubation import (
    AIRED,
    InstrumentSpec,
    cumulative,
    drop_aired,
    gas_production,
    rate_to_date,
    respired_fraction,
)
from sondera.operators.summary import mean_with_error, summarize_ci, summarize_se
from sondera.plans.network import incubation_results

GAS = (
    "bottle string, treatment string, depth string, rep string, day double, time_point string, time_order double, "
    "CO2_sys_ppm_p string, CH4_sys_ppm_p string, CO2_air_ppm double, CH4_air_ppm double, "
    "CO2_sys_ppm double, CH4_sys_ppm double"
)


def gas_rows():
    rows = []
    for treatment, speed in (("IB 20", 1.0), ("IB 30", 2.0)):
        for depth, share in (("S", 1.0), ("M", 0.6)):
            for rep in "123":
                name = f"{treatment}-{depth}{rep}"
                for day in (0, 3, 7, 20):
                    ppm = 400 + 900 * speed * share * day * (1 + 0.02 * int(rep))
                    prior = "n/a" if day == 3 else "410.5"
                    rows.append(
                        (name, treatment, depth, rep, float(day), f"T{day}", float(day),
                         prior, "2.5", 400.0, 2.0, ppm, 2.0 + day / 10)
                    )
                rows.append(
                    (name, treatment, depth, rep, 7.0, "T8", 8.0, AIRED, AIRED, 1.0, 1.0, 1.0, 1.0)
                )
    return rows


@pytest.fixture(scope="module")
def readings(spark):
    return spark.createDataFrame(gas_rows(), GAS)


@pytest.fixture(scope="module")
def carbon(spark):
    names = sorted({r[0] for r in gas_rows()})
    return spark.createDataFrame([(n, 0.008, 0.09) for n in names[:-1]], "bottle string, c_mol double, c_g double")


def test_headspace():
    assert InstrumentSpec().headspace_mol == pytest.approx(0.615 / (300.85 * 0.08206))


def test_gas_chain_by_hand(readings):
    spec = InstrumentSpec()
    kept = drop_aired(readings, "CO2_sys_ppm_p")
    assert kept.count() == len(gas_rows()) - 12
    table = gas_production(kept).filter("bottle = 'IB 20-S1'").orderBy("day").collect()
    for r in table:
        ppm = (r.CO2_sys_ppm - spec.vol_gga / spec.vol_total * 400) * spec.vol_total / spec.vol_hs
        assert r.CO2_bottle_umol == pytest.approx(ppm * spec.headspace_mol, abs=0.00501)
        assert r.CH4_bottle_umol == round(r.CH4_bottle_umol, 4)
    assert table[0].CO2_production_umol == 0.0
    assert table[1].CO2_production_umol is None  # prior reading is no number
    made = table[2].CO2_bottle_umol - 410.5 * spec.headspace_mol
    assert table[2].CO2_production_umol == pytest.approx(made, abs=0.00501)


def test_cumulative_skips_missing_amounts(readings):
    produced = gas_production(drop_aired(readings, "CO2_sys_ppm_p"))
    total = cumulative(produced, ["treatment", "depth", "rep"], ["day"], F.floor("day"))
    got = total.filter("bottle = 'IB 30-M2'").orderBy("day").collect()
    running = 0.0
    for r in got:
        running += r.CO2_production_umol or 0.0
        assert r.CO2_cumulative_umol == pytest.approx(running, abs=1e-9)


def test_fraction_both_ways_and_compat(readings, carbon):
    keys = ["treatment", "depth", "rep", "bottle"]
    produced = gas_production(drop_aired(readings, "CO2_sys_ppm_p"))
    bucket = F.floor("day")
    joined = respired_fraction(cumulative(produced, keys, ["day"], bucket), carbon)
    carried = respired_fraction(cumulative(produced, keys, ["day"], bucket, carbon=carbon))
    cols = ["bottle", "day", "c_mol", "respired_umol", "remaining_mol", "fraction"]
    a, b = (sorted(map(tuple, d.select(cols).collect())) for d in (joined, carried))
    assert a == b
    assert any(r[5] is None for r in a)  # one bottle has no carbon value
    row = carried.filter("bottle = 'IB 20-S1' and day = 20").first()
    assert row.fraction == pytest.approx(row.respired_umol / 8000)
    assert row.remaining_mol == pytest.approx(0.008 - row.respired_umol / 1e6)
    compat = respired_fraction(
        cumulative(produced, keys, ["day"], bucket, carbon=carbon), compat=True
    )
    row = compat.filter("bottle = 'IB 20-S1' and day = 20").first()
    assert row.remaining_mol == pytest.approx(0.008 - row.respired_umol / 1e7)


def test_rate_on_day_zero_is_null_but_counted(spark):
    df = spark.createDataFrame([(0.0, 0.0), (2.0, 0.5)], "day double, fraction double")
    out = rate_to_date(df).withColumn("g", F.lit(1))
    assert [r.rate for r in out.orderBy("day").collect()] == [None, 0.25]
    s = summarize_se(out, ["g"], "rate").first()
    assert (s.n, s["mean"], s.sd, s.se) == (2, 0.25, None, None)


def test_summaries(spark):
    values = [1.0, 2.0, 4.0, 8.0]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 3.0)], "g string, v double")
    got = {r.g: r for r in summarize_ci(df, ["g"], "v").collect()}
    sd = statistics.stdev(values)
    assert got["a"].sd == pytest.approx(sd)
    assert got["a"].ci == pytest.approx(sd / 2 * 3.1824463)
    assert got["b"].sd is None and got["b"].se is None and got["b"].ci is None


def test_mean_with_error_counts_null_values(spark):
    rows = [("NC", 1.0, 0.3, 0.97), ("NC", None, None, 0.99), ("NC", 5.0, 0.4, 0.5), ("SC", 2.0, 0.1, 0.2)]
    df = spark.createDataFrame(rows, "state string, x double, dx double, pct double")
    got = {r.state: r for r in mean_with_error(df, ["state"], ["x"], F.col("pct") >= 0.95).collect()}
    assert (got["NC"].n, got["NC"].x, got["NC"].dx) == (2, 1.0, pytest.approx(0.15))
    assert (got["SC"].n, got["SC"].x, got["SC"].dx) == (0, None, None)


def test_whole_analysis(readings, carbon):
    result = incubation_results(readings, carbon)
    q10 = {(r.day, r.depth): r for r in result["q10"].collect()}
    assert q10[0.0, "S"].q10 is None
    assert 1.5 < q10[20.0, "S"].q10 < 2.5
    assert q10[20.0, "S"].seq10 == pytest.approx(q10[20.0, "S"].dq10 / math.sqrt(6))
    rows = result["q10q"].collect()
    assert rows and all(r.k > 0 for r in rows)
    assert result["summary"].count() == 16


def test_both_crossing_forms_agree_where_fractions_hardly_fall(readings, carbon):
    rows = lambda compat: {
        (r.k, r.depth): (r.q10q, r.n) for r in incubation_results(readings, carbon, compat=compat)["q10q"].collect()
    }
    neighbours, extremes = rows(False), rows(True)
    assert neighbours.keys() == extremes.keys()
    for k, (ratio, n) in neighbours.items():
        assert n == extremes[k][1]
        assert (ratio is None) == (extremes[k][0] is None)
        assert ratio is None or ratio == pytest.approx(extremes[k][0], rel=1e-4)  # a trace of CH4 falls
