from __future__ import annotations

import base64
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from corpus import FOLDER
from sondera.llm import packing

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(packed, texts, encoder, length):
    """Every text's ids come back, and rows, ends and positions agree."""
    pieces, rows = {}, packed.collect()
    for r in rows:
        ids, places = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        ends = r.cu_seqlens
        assert len(ids) == len(places) == length and ends[0] == 0 and ends[-1] == r.n_tokens <= length
        assert (ids[r.n_tokens :] == 50256).all() and (places[r.n_tokens :] == 0).all()
        for a, b, doc, offset in zip(ends, ends[1:], r.doc_ids, r.offsets):
            assert (places[a:b] == np.arange(b - a)).all()
            pieces.setdefault(doc, []).append((offset, ids[a:b].tolist()))
    assert len({(r.shard, r.pack) for r in rows}) == len(rows)
    want = {}
    for doc, text in texts:
        if text:
            want.setdefault(doc, []).append(encoder.encode_ordinary(text))
    assert set(pieces) == set(want)
    for doc, own in want.items():
        found = sorted(pieces[doc])
        if len(own) == 1:
            assert [x for _, p in found for x in p] == own[0]
            assert [o for o, _ in found] == list(range(0, len(own[0]), length))
        else:
            assert sorted(p for _, p in found) == sorted(
                o[i : i + length] for o in own for i in range(0, len(o), length)
            )
    return rows


def test_round_trip(spark, encoder):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    packed = packing.pack_tokens(docs, PATH, P.PATTERN, length=256, shard_bytes=100_000)
    rows = check(packed, [tuple(r) for r in docs.collect()], encoder, 256)
    assert len({r.shard for r in rows}) > 2
    assert sum(r.n_tokens for r in rows) > 0.98 * 256 * len(rows)
    again = packing.pack_tokens(docs.repartition(9), PATH, P.PATTERN, length=256, shard_bytes=100_000)
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))


def test_best_fit_decreasing():
    r = random.Random(2)
    for _ in range(60):
        length = r.randint(1, 40)
        sizes = [r.randint(1, length) for _ in range(r.randint(0, 60))]
        room, rows = [], []
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            fits = [x for x in room if x >= sizes[i]]
            if fits:
                room.remove(min(fits))
                room.append(min(fits) - sizes[i])
            else:
                room.append(length - sizes[i])
        rows = packing.best_fit(sizes, length)
        assert sorted(i for row in rows for i in row) == list(range(len(sizes)))
        assert sorted(length - sum(sizes[i] for i in row) for row in rows) == sorted(room)


def test_nulls_repeats_long_and_no_rows(spark, encoder):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "x y z"), (3, "x y z"), (4, "<|endoftext|>"), (5, "long " * 5000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    check(packing.pack_tokens(df, PATH, P.PATTERN, length=64), rows, encoder, 64)
    assert packing.pack_tokens(df.limit(0), PATH, P.PATTERN).count() == 0


def test_shards_follow_the_order(spark, encoder):
    rows = [(i, "word " * (1 + i * 13 % 300), (i * 37) % 500) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, place int").repartition(6)
    packed = packing.pack_tokens(df, PATH, P.PATTERN, length=128, shard_bytes=5000, order=["place"])
    out = check(packed, [r[:2] for r in rows], encoder, 128)
    place = {i: p for i, _, p in rows}
    shards = {}
    for r in out:
        shards.setdefault(r.shard, []).extend(place[d] for d in r.doc_ids)
    assert list(shards) == sorted(shards) and len(shards) > 50
    ends = [(min(p), max(p)) for p in shards.values()]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


def test_a_row_that_occurs_very_often_is_spread(spark, encoder):
    rows = [(7, "again and again")] * 2000 + [(None, "no id")] * 300 + [(i, f"single {i}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    packed = packing.pack_tokens(df, PATH, P.PATTERN, length=64, shard_bytes=1000)
    out = check(packed, rows, encoder, 64)
    assert len({r.shard for r in out if 7 in r.doc_ids}) > 15
    again = packing.pack_tokens(df.repartition(2), PATH, P.PATTERN, length=64, shard_bytes=1000)
    assert sorted(map(str, again.collect())) == sorted(map(str, out))


def test_a_large_shard_is_written_early(spark, encoder, monkeypatch):
    rows = [(i, "some words here " * 20) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(packing, "EARLY", 0.1)
    check(packing.pack_tokens(df, PATH, P.PATTERN, length=128, shard_bytes=40_000), rows, encoder, 128)
