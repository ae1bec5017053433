from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus import removal_row, repeated_words
from sondera.llm import suffix_dedup as sd
from sondera.llm.common import python_tasks

SCHEMA = "doc_id long, text string, n_removed string"


def run(spark, texts, window=sd.WINDOW):
    python_tasks(spark)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    outputs = {"n_words": F.col("n_words"), "n_removed": sd.n_removed(), "h": F.sha2(sd.kept_text(), 256)}
    rows = sd.without_repeats(df, outputs, window=window).collect()
    assert len(rows) == len(texts)
    return {r.doc_id: (r.n_words, r.n_removed, r.h) for r in rows}


def same(spark, texts, window):
    got = run(spark, texts, window)
    for i, (w, gone) in enumerate(zip(*repeated_words(texts, window))):
        assert got[i] == removal_row(w, gone), i
    return got


def made(seed, words, count):
    """Texts with shared passages of all lengths around the window's."""
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(words)]
    prose = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passages = [prose(r.randint(8, 60)) for _ in range(8)]
    texts = []
    for _ in range(count):
        parts = prose(r.randint(0, 30))
        for _ in range(r.randint(0, 3)):
            p = list(r.choice(passages))
            if r.random() < 0.4:
                p[r.randrange(len(p))] = "edit"
            parts += p[r.randint(0, 5) :] + prose(r.randint(0, 20))
        texts.append(r.choice([" ", "\n", "\t "]).join(parts))
    return texts


@pytest.mark.parametrize("group", [2000, 2, 5])
def test_against_all_windows(spark, monkeypatch, group):
    monkeypatch.setattr(sd, "GROUP", group)
    got = same(spark, made(1, 400, 60) + made(2, 3, 12), 20)
    assert sum(n for _, n, _ in got.values()) > 500


def test_large_groups_are_split_until_they_fit(spark, monkeypatch):
    """Passages that agree for 8, 12, 20 or 35 words, in texts that all differ around them."""
    monkeypatch.setattr(sd, "GROUP", 6)
    r = random.Random(3)
    trunk = [f"t{i}" for i in range(50)]
    prose = lambda n: [f"q{r.randrange(10**6)}" for _ in range(n)]
    texts = []
    for same_words in (8, 11, 12, 15, 20, 30, 34, 35, 36, 50):
        for _ in range(9):
            texts.append(" ".join(prose(r.randint(0, 40)) + trunk[:same_words] + prose(40)))
    got = same(spark, texts, 35)
    assert sum(n > 0 for _, n, _ in got.values()) == 27  # 35, 36 and 50 words alike


def test_window_of_the_contract(spark):
    r = random.Random(5)
    body = [f"x{r.randrange(900)}" for _ in range(120)]
    texts = [" ".join(body[:35]), " ".join(body[1:36]), " ".join(body[40:75] + ["a"] + body[40:75]), " ".join(body[80:114])]
    texts += [" ".join(["z", *body[80:114], "y"]), "same " * 100, "a b", None, "", None, " ".join(body), " ".join(body)]
    got = same(spark, texts, 35)
    assert got[10][1] == 120 and got[3][1] == 0 and got[5][1] == 100


def test_no_rows_and_widths(spark):
    df = spark.createDataFrame([(1, "a", "x")], SCHEMA)
    assert sd.without_repeats(df.limit(0), {"n": F.col("n_words")}).count() == 0
    with pytest.raises(ValueError, match="window"):
        sd.repeated_spans(df, window=8)


def test_hashes_tell_words_apart():
    words = [b"a", b"b", b"ab", b"ba", b"aa", b"aaa", b"x" * 5000, b"x" * 5001, "é".encode(), b"\xc2\xa0"]
    hashes = sd.word_hashes(b"  " + b" \n\t".join(words) + b"\x0b\x0c")
    assert len(hashes) == len(words) == len(set(hashes.tolist()))
    assert (sd.word_hashes(b" ".join(words)) == hashes).all()
    assert len(sd.word_hashes(b"")) == len(sd.word_hashes(b" \n")) == 0


def test_deep_leaves_are_repeated_prefixes():
    r = np.random.default_rng(0)
    rows = r.integers(0, 2, (300, 7))
    for depth in range(1, 8):
        heads = [tuple(x[:depth]) for x in rows]
        want = np.array([heads.count(h) > 1 for h in heads])
        assert (sd.deep_leaves(rows, depth) == want).all()
