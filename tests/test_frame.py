from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sondera.operators import frame, layers


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(
        [("LA", 1.0, "2"), ("TX", None, "x"), ("NC", 5.0, None)], "state string, loss_deep double, Loss_text string"
    )


def test_picks(df):
    assert frame.columns_like(df, contains="LOSS") == ["loss_deep", "Loss_text"]
    assert frame.select_like(df, ["state"], startswith="loss").columns == ["state", "loss_deep", "Loss_text"]
    assert frame.everything_after(df, ["Loss_text"]).columns == ["Loss_text", "state", "loss_deep"]


def test_numbers_overrides_and_maximum(df):
    assert [r.Loss_text for r in frame.to_numeric(df, ["Loss_text"]).collect()] == [2.0, None, None]
    fixed = {r.state: r.loss_deep for r in frame.override(df, "state", "loss_deep", {"LA": 66459.0}).collect()}
    assert fixed == {"LA": 66459.0, "TX": None, "NC": 5.0}
    assert [r.state for r in frame.at_max(df, "loss_deep").collect()] == ["NC"]


def test_reshape(spark):
    long = spark.createDataFrame(
        [(1, "IB 20", 2.0), (1, "IB 30", 4.0), (2, "IB 20", 3.0)], "day int, treatment string, rate double"
    )
    wide = frame.cast_wide(long, ["day"], "treatment", "rate", {"IB 20": "cold", "IB 30": "warm"})
    assert sorted(map(tuple, wide.collect())) == [(1, 2.0, 4.0), (2, 3.0, None)]
    assert frame.melt(wide, ["day"], ["cold", "warm"]).count() == 4
    assert frame.melt(wide, ["day"], ["cold", "warm"], drop_null=True).count() == 3


def test_append_fills_missing_columns(spark):
    a = spark.createDataFrame([("x", 1)], "region string, n int")
    b = spark.createDataFrame([("y", "NC")], "region string, state string")
    assert sorted(map(tuple, frame.append(a, b).collect()), key=str) == [("x", 1, None), ("y", None, "NC")]


def test_label_and_extent(df):
    assert frame.label(df, {"loss_deep": "Deep (mol)"}).columns == ["Deep (mol)"]
    row = frame.extent(df, ["loss_deep"]).first()
    assert tuple(row) == (1.0, 5.0, 4.0)


def test_centroid_of_a_rectangle_cut_into_buckets(spark):
    corners = [(0, 0), (4, 0), (4, 1), (4, 2), (2, 2), (0, 2)]
    df = spark.createDataFrame([("r", i, float(x), float(y)) for i, (x, y) in enumerate(corners)], "key string, i int, x double, y double")
    for width in (1, 2, 100):
        row = layers.centroids(df, "key", "i", F.floor(F.col("i") / width)).first()
        assert (row.x, row.y) == (pytest.approx(2.0), pytest.approx(1.0))


def test_labels_and_fan_out(spark):
    outlines = spark.createDataFrame([("FL", -82.0, 28.0), ("NC", -79.0, 35.0), ("NH", -71.0, 43.0)], "state string, x double, y double")
    means = spark.createDataFrame(
        [("FL", "Atlantic", 0.28, 0.22), ("FL", "Gulf", 0.274, 0.2171), ("NC", "Atlantic", 0.19, 0.1424)],
        "state string, region string, shallow double, deep double",
    )
    rows = layers.state_labels(
        outlines,
        means,
        renames=[("FL", "Atlantic", "FL (Atlantic)"), ("FL", "Gulf", "FL (Gulf)")],
        positions=[("FL", "Atlantic", -80.650238, 27.5)],
    ).collect()
    got = {r.postal: r for r in rows}
    assert len(rows) == 4
    assert got["FL (Atlantic)"].x == -80.650238 and got["FL (Gulf)"].x == -82.0
    assert got["FL (Gulf)"].label_shallow == "FL (Gulf):\n27.4%"
    assert got["FL (Atlantic)"].label_mixed == "FL (Atlantic):\n24%"
    assert got["NH"].label_deep is None


def test_plot_series_and_axis(spark):
    df = spark.createDataFrame([("M", "IB 20", 0.5, 0.1), ("S", "IB 30", 0.2, None)], "depth string, treatment string, fraction double, se double")
    rows = layers.plot_series(df).collect()
    assert tuple(rows[0]) == ("Deep", "20° C", 0.5, 0.1, 0.4, 0.6)
    assert rows[1].depth == "Shallow" and rows[1].low is None
    axis = spark.createDataFrame([(0,), (5,), (10,)], "x int").select(layers.axis_label(F.col("x")))
    assert [r[0] for r in axis.collect()] == ["0%", "", "10%"]


def test_station_layer(spark):
    rows = [("a", "Gulf", 0.96, 0.3, 0.6), ("b", "Gulf", 0.5, 0.3, 0.6), ("c", "Atlantic", 1.0, 0.0, 0.3), ("d", "Gulf", None, 0.1, 0.1)]
    df = spark.createDataFrame(rows, "station string, region string, pct double, loss_shallow double, loss_deep double")
    got = {r.station: r.pct_mixed for r in layers.station_layer(df).collect()}
    assert got == {"a": pytest.approx(50.0), "c": pytest.approx(20.0)}
    assert [r.station for r in layers.station_layer(df, region="Gulf").collect()] == ["a"]
