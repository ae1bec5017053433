from __future__ import annotations

import random

import numpy as np
import pytest

from corpus import near_classes
from sondera.llm import chosen_path as cp

SCHEMA = "doc_id long, text string, class_id string"


pieces = cp._pieces


def run(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    out = cp.near_duplicates(df)
    assert out.columns == ["doc_id", "class_id", "n_links"]
    rows = out.collect()
    assert len(rows) == len(texts)
    return {r.doc_id: (r.class_id, r.n_links) for r in rows}


def made(seed, groups, size, length=80, edits=4):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(5000)}"
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(r.randint(20, length))]
        for _ in range(r.randint(1, size)):
            own = list(base)
            for _ in range(r.randint(0, edits)):
                own[r.randrange(len(own))] = word()
            texts.append(" ".join(own))
    return texts


def test_against_all_pairs(spark):
    texts = made(1, 40, 12) + [None, "", " ", "a b", "a b", "a  b", "b a", None, "one", "x " * 400, "x " * 300]
    got = run(spark, texts)
    for i, (least, links) in enumerate(zip(*near_classes(texts))):
        assert got[i] == (least, links), texts[i]


@pytest.mark.parametrize("edits", [1, 3])
def test_groups_larger_than_a_leaf(spark, monkeypatch, edits):
    monkeypatch.setattr(cp, "LEAF", 20)
    r = random.Random(edits)
    word = lambda: f"w{r.randrange(5000)}"
    texts = ["common line of many words here " + t for t in made(4, 60, 1)]
    for _ in range(3):
        base = [word() for _ in range(100)]
        for _ in range(120):
            own = list(base)
            for _ in range(edits):
                own[r.randrange(100)] = word()
            texts.append(" ".join(own))
    got = run(spark, texts)
    roots, links = near_classes(texts)
    assert [got[i][0] for i in range(len(texts))] == roots
    assert [got[i][1] > 0 for i in range(len(texts))] == [n > 0 for n in links]
    # pairs of a bucket all meet; a pair at the threshold may share no bucket, by the recall
    assert all(got[i][1] <= links[i] for i in got)
    assert sum(got[i][1] for i in got) >= cp.RECALL * sum(links)


def test_near_copies_among_texts_with_a_shared_passage(spark, monkeypatch):
    monkeypatch.setattr(cp, "LEAF", 20)
    r = random.Random(5)
    prose = lambda n: " ".join(f"w{r.randrange(9000)}" for _ in range(n))
    passage = prose(150)
    texts = [f"{passage} {prose(45)}" for _ in range(240)]  # alike to about 0.6
    texts += [t.rsplit(" ", 2)[0] + " " + prose(2) for t in texts[::8]]
    got = run(spark, texts)
    roots, links = near_classes(texts)
    assert sum(n > 0 for n in links) == 60
    assert [got[i] for i in range(len(texts))] == list(zip(roots, links))


def test_no_split_reuses_a_coordinate(spark):
    r = random.Random(8)
    rows = [(p, sum(1 << c for c in r.sample(range(cp.COORDINATES), p % 12))) for p in range(300)]
    got = spark.createDataFrame(rows, "path long, used long").withColumn("drawn", cp.unused("path", "used")).collect()
    for x in got:
        assert sorted(x.drawn) == [c for c in range(cp.COORDINATES) if not x.used >> c & 1]
    assert len({x.drawn[0] for x in got}) == cp.COORDINATES


def leaf_rows(spark, values, n=900):
    r = random.Random(12)
    rows = [(i, [r.randrange(values) for _ in range(cp.COORDINATES)]) for i in range(n)]
    return cp._leaves(spark.createDataFrame(rows, "set_key long, coordinates array<int>"))


def test_unlike_sets_are_never_dense(spark, monkeypatch):
    monkeypatch.setattr(cp, "LEAF", 30)
    monkeypatch.setattr(cp, "_pieces", lambda b: pytest.fail("dense") if b.take(1) else pieces(b))
    # 90 sets in a bucket, one split on each branch
    assert leaf_rows(spark, 10).count() <= cp.RUNS * cp.BRANCHES * 900


def test_cost_of_buckets_that_splits_do_not_thin_out(spark, monkeypatch):
    """A third of the sets in each of three children: as many pairs as before, so pieces at once, not three times the rows a level."""
    monkeypatch.setattr(cp, "LEAF", 30)
    leaves = leaf_rows(spark, 3)
    pieces_each = -(-330 // (cp.PIECE * 30))
    assert leaves.count() <= cp.RUNS * 900 * pieces_each
    assert leaves.groupBy("leaf").count().agg({"count": "max"}).first()[0] <= 2 * 1.6 * cp.PIECE * 30


def test_recall_in_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(cp, "LEAF", 20)
    r = random.Random(3)
    rows = []
    for i in range(800):  # pairs at the threshold, in buckets of hundreds that need three splits
        c = [r.randrange(3) for _ in range(cp.COORDINATES)]
        rows.append((2 * i, c))
        rows.append((2 * i + 1, [x if r.random() < cp.THRESHOLD else (x + r.choice([1, 2])) % 3 for x in c]))
    leaves = cp._leaves(spark.createDataFrame(rows, "set_key long, coordinates array<int>"))
    buckets = {}
    for x in leaves.select("set_key", "bucket").distinct().collect():
        buckets.setdefault(x.set_key, set()).add(x.bucket)
    met = sum(bool(buckets.get(2 * i, set()) & buckets.get(2 * i + 1, set())) for i in range(800))
    assert met >= 0.99 * 800
    assert all(cp.recall(cp.RUNS, d) >= cp.RECALL for d in range(cp.DEPTH + 1))


def test_recall_at_the_threshold():
    assert 1 - (1 - cp.THRESHOLD) ** cp.RUNS >= cp.RECALL
    assert cp.RUNS <= cp.COORDINATES


def test_coordinates_agree_as_sets_do():
    agree = []
    for seed in range(60):
        t = np.random.default_rng(seed).integers(0, 1 << 62, 550, dtype=np.uint64)
        agree.append((cp.embedding(t[:500]) == cp.embedding(t[50:])).mean())
    assert np.mean(agree) == pytest.approx(450 / 550, abs=0.03)


def test_intersections():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 60, 30, dtype=np.uint64)) for _ in range(9)]
    both = cp.common_tokens(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j:
                assert both[i, j] == len(np.intersect1d(a, b))


def test_components(spark):
    r = random.Random(6)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    edges += [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    r.shuffle(edges)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    df = spark.createDataFrame([(b, a) for a, b in edges], "a long, b long")
    assert {x.node: x.label for x in cp.components(df).collect()} == {n: find(n) for n in list(root)}


def test_one_of_each_class(spark):
    texts = made(9, 10, 5) + [None, None]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    left = cp.first_of_class(df)
    assert left.columns == df.columns
    assert sorted(x.doc_id for x in left.collect()) == sorted({*near_classes(texts)[0]})


def test_one_row_of_repeated_and_nameless_copies(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, "a b  c d e f"), (5, "q r s t u v w")]
    rows += [(None, "only nameless words stand here"), (None, "only nameless words stand here"), (None, None), (None, " "), (7, None), (7, None)]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, class_id int")
    left = sorted(((x.doc_id, x.text) for x in cp.first_of_class(df).collect()), key=str)
    assert left == sorted([rows[0], rows[4], rows[5], *rows[7:]], key=str)
    assert cp.first_of_class(df.limit(0)).count() == 0


def test_a_very_long_text(spark):
    r = random.Random(1)
    long = [f"w{r.randrange(50_000)}" for _ in range(120_000)]
    texts = [" ".join(long), " ".join(long[:-10_000]), " ".join(long[60_000:]), " ".join(long[::-1])]
    assert [run(spark, texts)[i] for i in range(4)] == [(0, 1), (0, 1), (2, 0), (3, 0)]


def test_repeats_nulls_and_no_rows(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, None), (2, "q r s t u v")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    got = sorted((tuple(x) for x in cp.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 5, 2), (5, 5, 2), (None, 5, 2), (None, None, 0), (2, 2, 0)], key=str)
    assert cp.near_duplicates(df.limit(0)).count() == 0
