from __future__ import annotations

import pytest

from sondera.operators.budget import (
    budget_long,
    budget_wide,
    roll_up,
    shoreline_lengths,
    state_budget,
    state_budget_wide,
)
from sondera.sources import readers, sinks

# Published state means (n, deep, sd, shallow, sd) and marsh
# shoreline lengths in km, and the published totals below.
MEANS = """
Atlantic ME 5 0.0564840985111093 0.00808959897195103 0.0873186327376241 0.00626941897194748
Atlantic MA 4 0.0834997088828516 0.00630295070896211 0.120152472846075 0.00472840130073201
Atlantic RI 4 0.0911639198344374 0.00645255631438789 0.129138338448243 0.00491888517785622
Atlantic CT 3 0.0869181544969427 0.00761362236036134 0.124161600037523 0.00578957824257149
Atlantic NY 5 0.0956068447807637 0.00590589079735533 0.134314543045756 0.00447321599920284
Atlantic NJ 5 0.101859512263694 0.00540397909732259 0.141500462369486 0.00407001896237258
Atlantic PA 4 0.110849505817771 0.00581465493161968 0.151824493515522 0.0043107015415857
Atlantic DE 4 0.109190085955216 0.00565938312631394 0.150316866986897 0.00411416464223722
Atlantic MD 7 0.121883951955465 0.00409073636931441 0.164789371217046 0.00296789685682035
Atlantic DC 1 0.121770355690731 0.0112421530999498 0.163684462269127 0.00849385686026486
Atlantic VA 6 0.130334221474458 0.00426844297326349 0.174796403356102 0.00295717655645929
Atlantic NC 6 0.142430051690696 0.00413635944842645 0.189983429692868 0.00260018057977204
Atlantic SC 1 0.160772031389956 0.0123222958269946 0.211102637274032 0.00776195017778086
Atlantic GA 1 0.177083025612436 0.010240254975703 0.229986726517672 0.00612765919422658
Atlantic FL 8 0.224605996820937 0.00453738350111221 0.281994641910781 0.00289543305929173
Gulf FL 13 0.217112540104415 0.00317288554446626 0.274232776011755 0.00201660364028214
Gulf AL 4 0.192066760749049 0.00546865931592443 0.245661546752741 0.00354678763707791
Gulf MS 2 0.19319246169493 0.00690730775142733 0.246932828884932 0.0044050169903941
Gulf LA 14 0.18423635481532 0.00289296055311001 0.236543697851044 0.00191120697868586
Gulf TX 27 0.195184259765972 0.00207034965635458 0.249404047070375 0.00132786820592098
Pacific CA 16 0.0946320411875124 0.00397579523942455 0.135922725490956 0.00246303012395656
Pacific OR 5 0.0692629279100665 0.00855232900752094 0.104398776123309 0.00612447409633216
Pacific WA 10 0.0641230412379788 0.00656513570806227 0.0978080083822123 0.00481747001457594
"""
LENGTHS = """
Atlantic CT 897
Atlantic DE 1565
Atlantic DC 0
Atlantic FL 3995
Atlantic GA 5844
Atlantic ME 0
Atlantic MD 8550
Atlantic MA 2042
Atlantic NH 263
Atlantic NJ 5328
Atlantic NY 2058
Atlantic NC 7579
Atlantic PA 44
Atlantic RI 504
Atlantic SC 7515
Atlantic VA 9535
Gulf AL 1169
Gulf FL 7913
Gulf LA 1551
Gulf MS 1973
Gulf TX 4332
Pacific CA 2135
Pacific OR 1274
Pacific WA 1388
Gulf LA 73745
"""
# region, bank, erosion: volume, carbon, loss, sd
PUBLISHED = {
    ("National", "Deep", "Large"): (12812580, 345939660, 62843782.4164651, 402745.208057748),
    ("National", "Shallow", "Large"): (4270860, 115313220, 24762386.783388, 125525.999251169),
    ("National", "Deep", "Small"): (4270860, 115313220, 20947927.472155, 402745.208057748),
    ("National", "Shallow", "Small"): (1423620, 38437740, 8254128.92779601, 41841.9997503898),
    ("Atlantic", "Deep", "Large"): (5014710, 135397170, 20813209.2890132, 226034.432490282),
    ("Atlantic", "Shallow", "Large"): (1671570, 45132390, 8315974.01131539, 69531.9012247357),
    ("Atlantic", "Shallow", "Small"): (557190, 15044130, 2771991.33710513, 23177.3004082452),
    ("Pacific", "Shallow", "Large"): (143910, 3885570, 452754.826024426, 9349.94309737602),
    ("Pacific", "Deep", "Large"): (431730, 11656710, 1067193.54414077, 28389.9715476212),
    ("Pacific", "Shallow", "Small"): (47970, 1295190, 150918.275341475, 3116.64769912534),
    ("Pacific", "Deep", "Small"): (143910, 3885570, 355731.181380258, 28389.9715476212),
}
STATES = {
    ("Atlantic", "CT", "Shallow", "Large"): (26910, 726570, 90212.0937392631, 4206.53386370517),
    ("Atlantic", "CT", "Deep", "Large"): (80730, 2179710, 216516.34076495, 11836.3627000869),
    ("Atlantic", "CT", "Deep", "Small"): (26910, 726570, 72172.1135883168, 11836.3627000869),
    ("Gulf", "LA", "Shallow", "Large"): (1993770, 53831790, 12733570.6685408, 102883.692723152),
    ("Gulf", "FL", "Shallow", "Large"): (237390, 6409530, 1757703.20483062, 12925.4815304976),
    ("Atlantic", "FL", "Deep", "Large"): (359550, 9707850, 2366148.11231661, 30824.0041008374),
}
MEASURES = ("erodedSedVolume", "erodedSedCarbon", "Decomp", "SD")


def lines(text):
    for line in text.split("\n"):
        if line:
            yield line.split()


@pytest.fixture(scope="module")
def means(spark):
    rows = [(r, s, int(n), *map(float, rest)) for r, s, n, *rest in lines(MEANS)]
    return spark.createDataFrame(
        rows, "region string, state string, n bigint, deep double, ddeep double, shallow double, dshallow double"
    )


@pytest.fixture(scope="module")
def shore(spark):
    rows = [(r, s, float(x)) for r, s, x in lines(LENGTHS)]
    return shoreline_lengths(spark.createDataFrame(rows, "region string, state string, length double"))


@pytest.fixture(scope="module")
def rolled(means, shore):
    # computed again by each use, and equal to the bit each time
    return roll_up(state_budget(shore, means, compat=True), exact=True)


@pytest.fixture(scope="module")
def wide(rolled):
    return budget_wide(rolled)


@pytest.fixture(scope="module")
def published(rolled):
    return budget_long(rolled).collect()


def test_shoreline_override_leaves_one_row(shore):
    assert [r.length for r in shore.filter("state = 'LA'").collect()] == [66459.0]
    assert shore.count() == 24


def test_row_counts(published):
    levels = [r.level for r in published]
    assert (levels.count("state"), levels.count("region"), levels.count("nation")) == (96, 12, 4)


def test_published_totals(published):
    got = {(r.region, r.BankHt, r.ErosionRate): r for r in published if r.level != "state"}
    for key, expected in PUBLISHED.items():
        assert [got[key][m] for m in MEASURES] == pytest.approx(expected, rel=1e-12)
    assert (got["Pacific", "Deep", "Large"].n, got["Pacific", "Deep", "Large"].marsh_shore) == (31, 4797)
    assert (got["National", "Deep", "Large"].n, got["National", "Deep", "Large"].marsh_shore) == (155, 142362)


def test_published_states(published):
    got = {(r.region, r.state, r.BankHt, r.ErosionRate): r for r in published if r.level == "state"}
    for key, expected in STATES.items():
        assert [got[key][m] for m in MEASURES] == pytest.approx(expected, rel=1e-12)
    nh = got["Atlantic", "NH", "Shallow", "Large"]
    assert (nh.erodedSedVolume, nh.n, nh.Decomp, nh.SD) == (pytest.approx(7890), None, None, None)
    assert got["Atlantic", "DC", "Deep", "Large"].Decomp == 0.0


def test_default_uses_the_errors_of_its_own_rate(means, shore):
    rows = roll_up(state_budget(shore, means)).collect()
    sd = {(r.region, r.erosion): r.sd for r in rows if r.level == "region" and r.bank == "Tall"}
    assert sd["Pacific", "Small"] == pytest.approx(sd["Pacific", "Large"] / 3)


def test_totals_over_missing_values_are_zero(spark, shore, means):
    only_nh = shore.filter("state = 'NH'")
    rows = roll_up(state_budget(only_nh, means)).collect()
    assert {(r.level, r.n, r.decomp, r.sd) for r in rows} == {
        ("state", None, None, None), ("region", 0, 0.0, 0.0), ("nation", 0, 0.0, 0.0)
    }


def test_headers(wide):
    assert len(sinks.SEDIMENT_HEADERS) == 16
    assert len(sinks.NATION_HEADERS) == 18
    assert len(sinks.REGION_HEADERS) == 19
    assert len(sinks.STATE_BUDGET_HEADERS) == 24
    assert list(sinks.SEDIMENT_HEADERS.values())[3] == (
        "Eroded Marsh Sediment Volume Shllow Bank & Small Erosion (m^3/yr)"
    )
    assert set(sinks.NATION_HEADERS) <= set(wide.columns)


def test_wide_and_long_agree(wide, published):
    banks = {"Deep": "Tall", "Shallow": "Short"}
    names = {"erodedSedVolume": "erodedSedVolume", "erodedSedCarbon": "erodedSedC", "Decomp": "Decomp", "SD": "dDecomp"}
    side = {(r.level, r.region, r.state): r for r in wide.collect()}
    assert len(side) == 24 + 3 + 1
    for r in published:
        row = side[r.level, r.region, r.state]
        for column, prefix in names.items():
            assert r[column] == row[f"{prefix}_{r.ErosionRate}{banks[r.BankHt]}"]


def test_publish(spark, rolled, means, tmp_path):
    stations = spark.createDataFrame([("a", 0.1, 0.2)], "station string, loss_deep double, loss_shallow double")
    hist = spark.createDataFrame([("a", 1, 5)], "station string, temp_c int, n bigint")
    places = sinks.publish(str(tmp_path / "out"), stations, hist, means, rolled, ["a"])
    read = {n: spark.read.csv(p, header=True, inferSchema=True) for n, p in places.items()}
    rows = {n: (df.count(), len(df.columns)) for n, df in read.items()}
    assert rows == {
        "stations": (1, 3), "state_means": (23, 7), "state_budget": (24, 24), "region_budget": (3, 19),
        "nation_budget": (1, 18), "long_budget": (112, 10), "temperatures": (1, 2),
    }
    assert read["state_budget"].columns == list(sinks.STATE_BUDGET_HEADERS.values())
    deep = "Deep Sed Annual Decomp (mol C/mol C)"
    got = {(r.Region, r.State): r[deep] for r in read["state_budget"].collect()}
    want = {(r.region, r.state): r.deep for r in means.collect()}
    assert got == {**dict.fromkeys(got), **want} and got["Atlantic", "NH"] is None
    total = read["nation_budget"].first()
    assert total["n stations"] == 155 and total["Marsh Shoreline (km)"] == 142362
    one = sinks.publish(str(tmp_path / "one"), stations, hist, means, rolled, only=["nation_budget"])
    assert list(one) == ["nation_budget"] and sorted(p.name for p in (tmp_path / "one").iterdir()) == ["nation_budget"]
    back = readers.read_published(spark, one["nation_budget"], sinks.NATION_HEADERS, {"n": "bigint"})
    assert back.first().n == 155 and set(back.columns) == set(sinks.NATION_HEADERS)


def test_state_rows_carry_their_means(rolled, means):
    rows = {(r.region, r.state): r for r in state_budget_wide(rolled, means).collect()}
    assert len(rows) == 24 and rows["Gulf", "TX"].shallow == 0.249404047070375
