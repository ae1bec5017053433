"""Top-k by inner product and hard negatives, against plain loops."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from sondera.llm import bond_negatives, voronoi_join
from sondera.llm.common import saved
from sondera.llm.vectors import Extent, from_bytes, to_bytes

SCHEMA = "vec_id long, label int, embedding array<float>, rank string, score double"


def whole(vector):
    return None if vector is None or any(x is None or not math.isfinite(x) for x in vector) else [math.floor(256 * x) for x in vector]


def product(a, b):
    return sum(x * y for x, y in zip(a, b))


def plain_top(rows, queries, k):
    data = [(r[0], whole(r[2])) for r in rows if r[0] is not None and whole(r[2]) is not None]
    asked = {}
    for r in sorted((q for q in queries if q[0] is not None and whole(q[2]) is not None), key=lambda r: r[2]):
        asked.setdefault(r[0], whole(r[2]))
    out = []
    for q, f in asked.items():
        found = sorted((-product(f, x), i) for i, x in data if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(found, 1)]
    return sorted(out)


def plain_negatives(rows, anchors, positives=5, negatives=3):
    ok = lambda r: None not in r[:2] and whole(r[2]) is not None
    data = [(r[0], r[1], whole(r[2])) for r in rows if ok(r)]
    asked = {}
    for r in sorted((a for a in anchors if ok(a)), key=lambda r: (r[1], r[2])):
        asked.setdefault(r[0], (r[1], whole(r[2])))
    out = []
    for a, (label, f) in asked.items():
        scored = [(-product(f, x), i, own) for i, own, x in data]
        near = sorted((s, i) for s, i, own in scored if own == label and i != a)[:positives]
        for p, i in near:
            hard = sorted((s, j) for s, j, own in scored if own != label and 50 * -p <= 100 * -s <= 95 * -p)
            out += [(a, i, n, j, -p, -s) for n, (s, j) in enumerate(hard[:negatives], 1)]
    return sorted(out)


def rows(n=400, width=12, seed=3, copies=60):
    """Random vectors, a tight cluster with a third of the rows, exact copies, and rows that take no part."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=width)
    out = []
    for i in range(n):
        x = centre + rng.normal(size=width) * 0.02 if i % 3 == 0 else rng.normal(size=width)
        if i < copies:
            x = centre
        out.append((i, int(rng.integers(0, 4)), [float(np.float32(v)) for v in x], "r", 0.5))
    out += [(n + 1, 1, None, "r", 0.5), (n + 2, 1, [1.0, None] + [0.0] * (width - 2), "r", 0.5), (None, 1, out[0][2], "r", 0.5)]
    out += [(n + 3, None, out[1][2], None, None), (n + 50, 2, [float("nan")] * width, "r", 0.5), (n + 100, 2, [float("inf")] * width, "r", 0.5)]
    return out


@pytest.mark.parametrize("pivots, group, block", [(1000, 512, 4096), (3, 4, 16), (20, 2, 50)])
def test_top_k(spark, pivots, group, block):
    r = rows()
    df = spark.createDataFrame(r, SCHEMA).repartition(3)
    found = voronoi_join.top_k(df.filter("vec_id % 5 = 0"), df, 5, pivots=pivots, group=group, block=block)
    assert sorted(map(tuple, found.collect())) == plain_top(r, [x for x in r if x[0] is not None and x[0] % 5 == 0], 5)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]


def test_bounds_leave_rows_out():
    rng = np.random.default_rng(1)
    near, far = rng.normal(size=(200, 8)) + 40, rng.normal(size=(200, 8)) * 3
    x = np.floor(np.concatenate([near, far]) * 256)
    pivots = x[[0, 300]]
    keys = np.arange(len(x))
    cell, distance = voronoi_join.nearest(x, pivots)
    order = np.lexsort((distance, cell))
    summary = [(int(cell[i]), float(distance[i]), int(keys[i])) for c in (0, 1) for i in [j for j in order if cell[j] == c][:6]]
    sure = voronoi_join.sure_scores(x[:100], keys[:100], pivots, summary, 5)
    exact = x[:100] @ x.T
    exact[np.arange(100), np.arange(100)] = -np.inf
    assert (sure <= np.sort(exact, axis=1)[:, -5] + 1e-6).all()
    cells = voronoi_join.Cells(pivots, np.array([0]), np.array([distance[:100].max()]), np.array([sure.min()]), np.array([0]))
    from sondera.llm.vectors import Extent

    needed = voronoi_join.needed(x, cells, Extent(400, 8, "<f8"))[:, 0]
    assert needed[:200].all() and not needed[200:].any()


def test_groups_of_cells():
    pivots = np.arange(10).reshape(-1, 1) * 1.0
    groups = voronoi_join.group_cells(pivots, {0: 5, 1: 4, 5: 100, 8: 1, 9: 2}, 10)
    assert sorted(c for g in groups for c in g) == [0, 1, 5, 8, 9]
    assert [5] in groups and any({0, 1} <= set(g) for g in groups)


def test_top_k_edge_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(50, 1, [1.0, 2.0], "a", 1.0), (50, 1, [1.0, 2.0], "a", 1.0), (51, 1, [3.0], "a", 1.0), (0, 1, [], "a", 0.0)], SCHEMA)
    assert voronoi_join.top_k(empty, empty).collect() == []
    assert voronoi_join.top_k(some, empty).collect() == []
    assert voronoi_join.top_k(empty, some).collect() == []
    got = sorted(map(tuple, voronoi_join.top_k(some, some, 5).collect()))
    # copies of a row are answers each, never to themselves
    assert got == [
        (0, 1, 50, 0), (0, 2, 50, 0), (0, 3, 51, 0),
        (50, 1, 51, 3 * 65536), (50, 2, 0, 0),
        (51, 1, 50, 3 * 65536), (51, 2, 50, 3 * 65536), (51, 3, 0, 0),
    ]
    one = spark.createDataFrame([(50, 1, [1.0], "a", 1.0)], SCHEMA)
    assert voronoi_join.top_k(one, one).collect() == []


def test_scores_beyond_doubles(spark):
    big = [(i, i % 2, [3e5 + i / 256.0, 1.0, -float(i)], "a", 1.0) for i in range(40)]
    schema = SCHEMA.replace("array<float>", "array<double>")
    df = spark.createDataFrame(big, schema)
    got = sorted(map(tuple, voronoi_join.top_k(df.filter("vec_id % 8 = 0"), df, 3).collect()))
    assert got == plain_top(big, big[::8], 3)
    found = bond_negatives.hard_negatives(df, df.filter("vec_id % 8 = 0"), percent=(50, 100))
    assert found.count() > 0
    with pytest.raises(ValueError):
        voronoi_join.top_k(df, spark.createDataFrame([(1, 1, [1e30], "a", 1.0)], schema))


@pytest.mark.parametrize("block, chunk", [(8192, 256), (20, 5), (64, 1)])
def test_hard_negatives(spark, block, chunk):
    r = rows()
    df = spark.createDataFrame(r, SCHEMA).repartition(3)
    found = bond_negatives.hard_negatives(df, df.filter("vec_id % 5 = 0"), block=block, chunk=chunk)
    expected = plain_negatives(r, [x for x in r if x[0] is not None and x[0] % 5 == 0])
    assert sorted(map(tuple, found.collect())) == expected and len(expected) > 100


def test_hard_negatives_broadcast_nothing(spark, monkeypatch):
    run = []

    def watched(df):
        df.collect()  # what is left then is the plan that ran
        run.append(df)
        return saved(df)

    monkeypatch.setattr(bond_negatives, "saved", watched)
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    # 21 blocks: Spark's estimate of the anchors' copies is that of one of them
    found = bond_negatives.hard_negatives(df, df.filter("vec_id % 5 = 0"), block=20, chunk=5)
    assert found.count() == len(found.collect()) > 100
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in [*run, found]]
    assert sum("SortMergeJoin" in p for p in plans) == 2 and not any("Broadcast" in p for p in plans)


def test_blocks_are_dealt_over_the_slots(spark):
    df = spark.range(0, 6400, 1, 64).selectExpr("id AS key", "id % 3 AS label", "array(1.0D, id / 100) AS vector")
    blocks = bond_negatives.vertical_blocks(df, Extent(6400, 2, "<f8"), 50, 100).select("slot").collect()
    # the least keys are all multiples of 100
    assert len(blocks) == 64 and max(Counter(b.slot for b in blocks).values()) <= 3


def test_hard_negatives_edge_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert bond_negatives.hard_negatives(empty, empty).collect() == []
    # ties, repeated rows, an anchor twice, a lone label, negative and zero scores
    r = [(0, 1, [1.0, 0.0]), (0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.7, 0.0]), (3, 2, [0.7, 5.0])]
    r += [(4, 1, [-1.0, 0.0]), (5, 3, [0.0, 1.0]), (6, 2, [0.7]), (7, 1, [0.0, 9.0]), (8, 2, [])]
    r = [(*x, "a", 1.0) for x in r]
    df = spark.createDataFrame(r, SCHEMA)
    padded = [(*x[:2], x[2] + [0.0] * (2 - len(x[2]))) for x in r]
    found = sorted(map(tuple, bond_negatives.hard_negatives(df, df).collect()))
    assert found == plain_negatives(padded, padded)


def test_vertical_scan_clears_and_stays_exact():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(3000, 64)) * 30)
    x[:40] = x[0] + np.floor(rng.normal(size=(40, 64)))
    columns, low, high = np.ascontiguousarray(x.T), x.min(axis=0), x.max(axis=0)
    seen = []
    shrink = bond_negatives.among_best(6)

    def watched(a, b):
        keep = shrink(a, b)
        exact = x @ x[0] if not seen else None
        if exact is not None:
            assert (a <= exact).all() and (exact <= b).all()
        seen.append(int(keep.sum()))
        return keep

    at, score = bond_negatives.vertical_scan(columns, low, high, x[0], watched)
    best = np.sort(x @ x[0])[::-1][:6]
    assert np.array_equal(np.sort(score)[::-1][:6], best)
    assert np.array_equal(score, (x @ x[0])[at])
    assert seen[0] == 3000 and seen[-2] < 100 and len(seen) == 8


def test_bytes_round_trip():
    for values in ([0, -1, 32767], [1 << 20, -5], [1 << 40], []):
        a = np.array(values, dtype=np.int64)
        assert np.array_equal(from_bytes(to_bytes(a), "<i8"), a)
