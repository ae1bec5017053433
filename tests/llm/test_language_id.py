from __future__ import annotations

import numpy as np

from sondera.llm import language_id
from sondera.llm.queries import op1_language_id


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op1_language_id(spark, folder).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_codewords_differ():
    for n in (2, 3, 7, 8, 40):
        code = language_id.codewords(n)
        assert len({tuple(c) for c in code}) == n
        if n > 3:
            assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= 3


def test_odd_texts(spark):
    train = spark.createDataFrame(
        [("the cat and the dog", "en"), ("le chat et le chien", "fr"), (None, "de"), ("x", None)],
        "text string, lang string",
    )
    model = language_id.fit(train)
    assert model.languages == ["en", "fr"]
    long = "the dog and the cat " * 120_000  # over two pieces
    rows = [(1, None), (2, ""), (3, "12 34 !"), (4, "the and the"), (5, long), (5, long)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")
    got = language_id.predict(df, model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "en", "en", "en"]
    assert [r.score for r in got][:3] == [0, 0, 0] and all(r.ambiguous for r in got[:3])
    assert language_id.predict(df.limit(0), model).count() == 0


def test_nothing_or_one_language_to_learn(spark):
    df = spark.createDataFrame([(1, "the dog", "en")], "doc_id long, text string, lang string")
    none = language_id.fit(df.filter("false"))
    assert language_id.predict(df, none).first().lang_pred == "und"
    one = language_id.fit(df)
    assert language_id.predict(df, one).first().lang_pred == "en"


def test_close_languages_are_flagged(spark):
    rows = [("aab", "one"), ("aac", "two")]
    train = spark.createDataFrame(rows, "text string, lang string")
    model = language_id.fit(train)
    df = spark.createDataFrame([("aaa",)], "text string")
    assert language_id.predict(df, model, ambiguous_below=0.9).first().ambiguous


def plain_shares(text, dims):
    """Share of each hashed byte n-gram, spelled out."""
    data, counts = text.encode(), {}
    for n in language_id.ORDERS:
        for i in range(len(data) - n + 1):
            gram = 0
            for b in data[i : i + n]:
                gram = (gram * 257 + b + 1) % 2**32
            slot = (gram * 2654435761 % 2**32) >> (32 - dims.bit_length() + 1)
            counts[slot] = counts.get(slot, 0) + 1
    total = max(sum(counts.values()), 1)
    return {s: c / total for s, c in counts.items()}


def test_training_and_decoding_by_hand(spark):
    """Sums by language, bit classifiers, trust and loss-weighted decoding in plain Python."""
    dims = 64
    train = [("the cat and the dog", "en"), ("a dog sat", "en"), ("le chat et le chien", "fr"), ("der hund und die katze", "de"), ("ein hund", "de")]
    asked = ["the dog", "le chien et", "die katze", "hund", "zzz qqq", "Le CHAT"]
    model = language_id.fit(spark.createDataFrame(train, "text string, lang string"), dims=dims)
    names = sorted({lang for _, lang in train})
    p = []
    for name in names:
        own = [0.0] * dims
        for text, lang in train:
            if lang == name:
                for s, x in plain_shares(text, dims).items():
                    own[s] += x
        p.append([x / sum(own) for x in own])
    code = language_id.codewords(3)
    bits = range(code.shape[1])
    weights = []
    for b in bits:
        yes = [np.mean([p[i][s] for i in range(3) if code[i][b] == 1]) + 0.05 / dims for s in range(dims)]
        no = [np.mean([p[i][s] for i in range(3) if code[i][b] == -1]) + 0.05 / dims for s in range(dims)]
        weights.append([np.log(y / n) for y, n in zip(yes, no)])
    margin = [[sum(x * w for x, w in zip(p[i], weights[b])) for b in bits] for i in range(3)]
    scale = [sum(abs(margin[i][b]) for i in range(3)) / 3 for b in bits]
    trust = [[max(margin[i][b] * code[i][b] / scale[b], 1e-3) for b in bits] for i in range(3)]
    trust = [[x / sum(row) for x in row] for row in trust]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.predict(df, model).collect()}
    for i, text in enumerate(asked):
        shares = plain_shares(text.lower(), dims)
        out = [sum(x * weights[b][s] for s, x in shares.items()) / scale[b] for b in bits]
        loss = [sum(np.exp(-min(max(out[b] * code[k][b], -8), 8)) * trust[k][b] for b in bits) for k in range(3)]
        best = min(range(3), key=lambda k: loss[k])
        assert got[i].lang_pred == names[best]
        assert abs(got[i].score - 1 / sum(np.exp(-4 * (x - loss[best])) for x in loss)) < 1e-4
        assert got[i].ambiguous == (1 - loss[best] / sorted(loss)[1] < 0.05)
