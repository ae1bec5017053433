from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sondera.llm import decontamination as dc


def norm(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def weights(w):
    return Counter({}) if len(w) < 5 else Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def similarity(a, b):
    a, b = weights(a), weights(b)
    size = lambda s: sum(map(len, s))
    return sum(size(s) * min(a[s], b[s]) for s in a | b) / sum(size(s) * max(a[s], b[s]) for s in a | b)


def brute(docs, items, least=0.8):
    """Best window of each document for each item, over all places where a shingle lies as in the item."""
    out = {}
    for doc, text in docs:
        w = norm(text)
        for item, body in items:
            own = norm(body)
            if len(own) < 5:
                continue
            best = 0.0
            places = {}
            for q in range(len(own) - 4):
                places.setdefault(tuple(own[q : q + 5]), []).append(q)
            starts = {
                p - q for p in range(len(w) - 4) for q in places.get(tuple(w[p : p + 5]), [])
            }
            for start in starts:
                window = w[max(start, 0) : max(start + len(own), 0)]
                if len(window) >= 5:
                    best = max(best, similarity(window, own))
            if best >= least:
                out[doc, item] = best
    return out


@pytest.fixture(scope="module")
def data():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    make = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(make(r.randint(12, 60)))) for i in range(8)] + [(8, "a b c"), (9, None), (10, "")]
    docs = [(i, " ".join(make(80))) for i in range(8)]
    for i, (item, body) in enumerate(items[:8]):
        w = body.split()
        docs.append((100 + i, " ".join(make(20)) + f"\n{body.upper()}.\n" + " ".join(make(20))))
        docs.append((200 + i, " ".join(w[: len(w) - 1] + make(9))))  # one word cut
        near = list(w)
        near[r.randrange(len(w))] = "other"
        docs.append((300 + i, " ".join(make(5) + near)))
        docs.append((400 + i, " ".join(make(30) + w[len(w) // 2 :] + make(30))))  # half of it
    docs += [(500, None), (501, ""), (502, "a b c"), (503, items[0][1]), (503, items[0][1])]
    return docs, items


def frames(spark, data):
    docs = spark.createDataFrame([(i, t, 1) for i, t in data[0]], "doc_id long, text string, item_id int")
    return docs, spark.createDataFrame(data[1], "item_id long, text string")


def test_against_all_windows(spark, data):
    docs, items = frames(spark, data)
    got = dc.contaminated(docs, items)
    assert got.columns == ["doc_id", "item_id", "start_word", "similarity"]
    found = {(r.doc_id, r.item_id): r for r in got.collect()}
    want = brute(*data)
    assert set(found) == set(want)
    for k, r in found.items():
        assert r.similarity == pytest.approx(want[k]) and r.start_word >= 0
    assert got.filter("doc_id = 503").count() == 2
    left = {r.doc_id for r in dc.clean(docs, items).collect()}
    assert left == {i for i, _ in data[0]} - {i for i, _ in want}
    assert dc.clean(docs, items).columns == docs.columns


def test_same_by_shuffle(spark, data, monkeypatch):
    docs, items = frames(spark, data)
    want = sorted(map(tuple, dc.contaminated(docs, items).collect()))
    monkeypatch.setattr(dc, "BROADCAST_SHINGLES", 0)
    monkeypatch.setattr(dc, "BROADCAST_HITS", 0)
    assert sorted(map(tuple, dc.contaminated(docs, items).collect())) == want


def test_every_fingerprint_within_the_radius_shares_a_filed_block():
    r = random.Random(9)
    for _ in range(2000):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), r.randint(0, dc.RADIUS)):
            b ^= 1 << bit
        blocks = [((a ^ b) >> 16 * k) & 0xFFFF for k in range(dc.BLOCKS)]
        assert any(x in dc.NEAR for x in blocks)


def test_simhash_bits(spark):
    rows = [([(5, 3), (6, 1), (-1, 1)],)]
    df = spark.createDataFrame(rows, "s array<struct<h:bigint,w:bigint>>")
    want = 0
    for b in range(64):
        total = sum(w if (h >> b) & 1 else -w for h, w in rows[0][0])
        want |= (total > 0) << b
    want -= (want >> 63) << 64
    assert df.select(dc.simhash("s").alias("x")).first().x == want


def test_no_rows(spark, data):
    docs, items = frames(spark, data)
    assert dc.contaminated(docs.limit(0), items).count() == 0
    assert dc.contaminated(docs, items.limit(0)).count() == 0
    assert dc.clean(docs, items.filter(F.lit(False))).count() == len(data[0])


def test_a_very_long_text(spark):
    r = random.Random(7)
    item = " ".join(f"i{k}" for k in range(40))
    far = " ".join(f"w{r.randrange(10**6)}" for _ in range(150_000))
    docs = spark.createDataFrame([(1, f"{far} {item} {far}")], "doc_id long, text string")
    items = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert [tuple(x) for x in dc.contaminated(docs, items).collect()] == [(1, 5, 150_000, 1.0)]


def edited(seed, n):
    """Items of 13 to 60 words, and documents with an edited copy: words cut at the end, or changed anywhere in the window."""
    r = random.Random(seed)
    make = lambda n: [f"w{r.randrange(10**5)}" for _ in range(n)]
    items, docs = [], []
    for i in range(n):
        w = make(r.randint(13, 60))
        own = list(w)
        if i % 3 == 0:
            own = own[: -max(1, len(w) // 12)] + make(max(1, len(w) // 12))
        else:
            for _ in range(max(1, len(w) // 45)):
                own[r.choice([0, 1, len(own) - 2, len(own) - 1, r.randrange(len(own))])] = make(1)[0]
        items.append(w)
        docs.append(" ".join(make(10) + own + make(12)))
    return list(enumerate(docs)), [(i, " ".join(w)) for i, w in enumerate(items)]


def test_windows_just_above_the_limit(spark):
    data = edited(11, 500)
    want = {k: s for k, s in brute(*data).items() if s < 0.9}
    low = {k for k, s in want.items() if s < 0.85}
    assert len(want) > 150 and len(low) > 60
    docs = spark.createDataFrame(data[0], "doc_id long, text string")
    items = spark.createDataFrame(data[1], "item_id long, text string")
    every = {(x.doc_id, x.item_id): x.similarity for x in dc.contaminated(docs, items, exact=True).collect()}
    assert {k for k, s in every.items() if s < 0.9} == set(want)
    # fingerprints alone
    found = {(x.doc_id, x.item_id) for x in dc.contaminated(docs, items).collect()}
    assert found <= set(every)
    assert len(found & set(want)) >= 0.99 * len(want) and len(found & low) >= 0.98 * len(low)


def test_repeated_items_and_long_items(spark):
    r = random.Random(2)
    long = " ".join(f"w{r.randrange(50)}" for _ in range(4000))
    items = [(1, long), (1, long), (1, "another text of the same name here"), (None, "an item without a name at all")]
    docs = [(1, "so " + long), (2, items[2][1]), (3, items[3][1]), (4, long[: len(long) // 2])]
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == [(1, 1, 1, 1.0), (2, 1, 0, 1.0), (3, None, 0, 1.0)]
