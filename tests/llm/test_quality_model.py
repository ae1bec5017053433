from __future__ import annotations

import zlib

import numpy as np
import pytest

from sondera.llm import quality_model as qm
from sondera.llm.queries import op10_quality_model


def test_held_out(spark):
    folder = "/root/testdata/sf0.01"
    rows = op10_quality_model(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(r.score, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    good = np.array([s for s, y in held if y == 1])
    bad = np.array([s for s, y in held if y == 0])
    assert (good[:, None] > bad).mean() > 0.97
    assert np.mean([(s >= 0.3) == y for s, y in held]) > 0.95


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")


def test_nulls_repeats_and_names(spark):
    words = ["good words in a row", "BAD!! BAD!! BAD!!", "fine text to read on", "UGLY!! THING!!"]
    docs = frame(spark, [(i, words[i % 4] * 3) for i in range(40)] + [(90, None), (91, ""), (None, "x"), (1, words[1])])
    rows = [(i, 1 - i % 2, None) for i in range(40)] + [(1, 0, 1), (77, 1, 0), (3, None, 0), (5, 9, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, text string")
    got = qm.quality_scores(docs, labels, "doc_id % 5 <> 0")
    assert got.columns == ["doc_id", "score", "predicted"]
    found = got.collect()
    assert len(found) == 44 and all(0 <= r.score <= 1 for r in found)
    score = {r.doc_id: r.score for r in found}
    assert score[0] > 0.5 > score[5] and score[90] == score[91]
    assert sorted(map(str, qm.quality_scores(docs, labels, "doc_id % 5 <> 0").collect())) == sorted(map(str, found))


def test_nothing_to_learn(spark):
    docs = frame(spark, [(1, "a b"), (2, None)])
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert {r.score for r in qm.quality_scores(docs, labels, "false").collect()} == {0.5}
    assert [r.score for r in qm.quality_scores(docs, labels, "true").collect()] == [pytest.approx(2 / 3)] * 2
    assert qm.quality_scores(docs.limit(0), labels, "true").count() == 0


def test_word_vectors_do_not_depend_on_the_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a, b = qm.word_vectors(docs), qm.word_vectors(docs.repartition(5))
    assert (a == b).all() and a.shape == (qm.TOKENS, qm.DIMS)
    norm = np.linalg.norm(a, axis=1)
    assert ((norm < 1e-6) | (abs(norm - 1) < 1e-5)).all()


def test_pooled_is_the_mean(spark):
    vectors = np.random.default_rng(0).normal(size=(qm.TOKENS, 4)).astype(np.float32)
    texts = ["a b a", "", None, "B!! b b", "c " * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in qm.pooled(df, vectors).collect():
        seq = qm.tokens(texts[r.doc_id])
        want = vectors[seq].mean(axis=0, dtype=float) if len(seq) else np.zeros(4)
        assert np.allclose(r.pooled, want, atol=1e-5)


def test_tokens():
    a = qm.tokens("word Word WORD word, word word").reshape(-1, 2)
    assert len(set(a[:, 0])) == 1
    assert a[0, 1] == qm.CORES and a[1, 1] == qm.SAME and a[2, 1] != qm.CORES and a[3, 1] != a[2, 1]
    assert a[5, 1] == qm.SAME


def plain_word(word, before):
    """Two tokens of a word, spelled out."""
    core = "".join(c for c in word if c.isalnum())
    rest = "".join(c for c in word if not c.isalnum())
    core, mark = (core, rest) if rest else (word, "")
    if len(core) > 1 and core.isupper():
        mark += "^"
    shape = 1 + zlib.crc32(mark.encode()) % (qm.SHAPES - 1) if mark else 0
    return zlib.crc32(core.lower().encode()) % qm.CORES, qm.SAME if word == before else qm.CORES + shape


def test_word_vectors_and_scores_by_hand(spark):
    """Sums over all pairs of neighbours, pooling, and both layers, in plain Python."""
    texts = ["one two three", "two two ONE!", None, "", "three, four (one) two", "x"] * 3 + ["one two " * 400]
    docs = frame(spark, [(i, t) for i, t in enumerate(texts)]).repartition(4)
    index, want = qm._index_vectors(8), {}
    for text in texts:
        seq = []
        split = (text or "").split()
        for i, w in enumerate(split):
            seq += plain_word(w, split[i - 1] if i else None)
        for k, gap in enumerate(qm.NEIGHBOURS):
            for i in range(len(seq) - gap):
                for at, other, code in ((seq[i], seq[i + gap], 2 * k), (seq[i + gap], seq[i], 2 * k + 1)):
                    entry = int(index[code][other])
                    cell = want.setdefault(at, [0] * 8)
                    cell[entry >> 1] += -1 if entry & 1 else 1
    got = qm.word_vectors(docs, dims=8)
    for token in range(qm.TOKENS):
        v = want.get(token, [0] * 8)
        size = max(sum(x * x for x in v) ** 0.5, 1)
        assert np.allclose(got[token], [x / size for x in v], atol=1e-6)
    net = qm.Network(hidden=3, epochs=2).fit(np.random.default_rng(1).normal(size=(40, 8)), np.arange(40) % 2.0)
    x = [0.3, -1.0, 0.5, 0.0, 2.0, -0.7, 0.1, 0.9]
    z = [(a - c) / s for a, c, s in zip(x, net.centre, net.spread)]
    w1, b1, w2, b2 = net.layers
    inner = [max(sum(z[i] * w1[i][j] for i in range(8)) + b1[j], 0) for j in range(3)]
    logit = sum(h * w for h, w in zip(inner, w2)) + b2[0]
    assert net.score(np.array([x]))[0] == pytest.approx(1 / (1 + np.exp(-logit / net.temperature)))


def test_a_very_long_text(spark):
    long = "good words in a row " * 100_000
    docs = frame(spark, [(1, long), (2, "good words in a row"), (3, long)])
    rows = qm.pooled(docs, qm.word_vectors(docs)).collect()
    assert np.allclose(rows[0].pooled, rows[2].pooled) and len(rows) == 3
