from __future__ import annotations

import random

import pytest

from corpus import FOLDER, base_measures
from sondera.llm import line_frequency as lf
from sondera.llm.queries import op4_line_frequency

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_of_the_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op4_line_frequency(spark, FOLDER).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        assert tuple(got[i][n] for n in NAMES) == base_measures(text)
        assert not (got[i].kept and got[i].base_failed)


def test_base_of_repetitive_and_odd_texts(spark):
    r = random.Random(8)
    texts = [None, "", " \n\t", "a\n\na\n a", "é #|<> x\x0by\x0cz\xa0q", "a b c d e f g h " * 3, "x " * 500, "a b c d e f g h"]
    texts += [" ".join(r.choice("abc") for _ in range(r.randint(5, 60))) for _ in range(60)]
    texts += ["\n".join(r.choice(["a b", "a b ", "", " "]) for _ in range(12)) for _ in range(10)]
    df = spark.createDataFrame([(i, t, "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, source string, kept int")
    got = {x.doc_id: x for x in lf.quality_rules(df).collect()}
    for i, text in enumerate(texts):
        assert tuple(got[i][n] for n in NAMES) == base_measures(text), text
    assert lf.quality_rules(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def hosts():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(9))
    prose = lambda n: " ".join(word() for _ in range(n))
    line = "Subscribe to our newsletter, 2024!"
    rows = [(i, "h", prose(25) + f"\n{line}") for i in range(8)]
    rows += [(100 + i, "other", prose(25) + f"\nsubscribe  to OUR newsletter {i}") for i in range(3)]
    menu = "\n".join(prose(11) for _ in range(4))
    rows += [(200 + i, "h", f"{menu}\n{prose(18)}") for i in range(40)]
    article = prose(30)
    rows += [(300 + i, "h", article) for i in range(50)]  # copies
    rows += [(400 + i, "h", article.replace(article.split()[i], "changed")) for i in range(20)]  # near copies
    rows += [(500 + i, None, prose(25) + f"\n{line}") for i in range(8)]
    return [(*row, 1) for row in rows]


def test_lines_above_the_limit(spark, hosts):
    df = spark.createDataFrame(hosts, "doc_id long, source string, text string, x int")
    judged = lf.quality_rules(df, most_documents=6)
    got = {r.doc_id: r for r in judged.collect()}
    assert len(got) == len(hosts)
    for i in range(8):
        assert got[i].removed_words == 5 and got[i].kept  # the line goes, the text stays
        assert got[500 + i].removed_words == 5 and got[500 + i].kept  # without a host
    for i in range(200, 240):
        assert got[i].removed_words == 44 and not got[i].kept and not got[i].base_failed  # depleted
    assert all(got[100 + i].removed_words == 0 for i in range(3))  # another host
    assert all(got[i].removed_words == 0 and got[i].kept for i in got if 300 <= i < 500)
    texts = {r.doc_id: r for r in lf.without_lines(judged).collect()}
    assert "newsletter" not in texts[0].text and texts[0].text.split() == hosts[0][2].split()[:25]
    assert texts[300].text == hosts[51][2] and texts[100].x == 1


@pytest.mark.parametrize("pages, shared, own", [(1000, 90, 10), (400, 80, 20), (120, 180, 20)])
def test_pages_of_mostly_shared_lines_are_depleted(spark, pages, shared, own):
    """Distinct documents are counted, however much of their text is the same."""
    r = random.Random(pages)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(9))
    menu = "\n".join(" ".join(word() for _ in range(10)) for _ in range(shared // 10))
    rows = [(i, "h", f"{menu}\n{' '.join(word() for _ in range(own))}", 1) for i in range(pages)]
    rows += [(9000 + i, "h", " ".join(word() for _ in range(60)), 1) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, x int")
    got = {x.doc_id: x for x in lf.quality_rules(df).collect()}
    assert all(got[i].removed_words == shared and not got[i].kept for i in range(pages))
    assert all(got[9000 + i].kept and not got[9000 + i].removed_words for i in range(20))


def test_copies_count_once_and_long_texts_each(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(9))
    article = "\n".join(" ".join(word() for _ in range(12)) for _ in range(5))
    # case, digits and punctuation make no new document
    rows = [(i, "h", f"{article}\nvisit {i}!" if i % 2 else f"{article.upper()}\nVisit {i}", 1) for i in range(300)]
    line = "aaaaaaaaa is the word that all of these long pages hold"
    rows += [(1000 + i, "h", "\n".join([line, *(" ".join(word() for _ in range(100)) for _ in range(30))]), 1) for i in range(101)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, x int")
    got = {x.doc_id: x for x in lf.quality_rules(df).collect()}
    assert all(got[i].removed_words == 0 and got[i].kept for i in range(300))
    assert all(got[1000 + i].removed_words == 11 and got[1000 + i].kept for i in range(101))
    fewer = df.filter("doc_id <> 1000")
    assert lf.quality_rules(fewer).agg({"removed_words": "sum"}).first()[0] == 0


def test_without_lines_of_odd_texts(spark):
    rows = [(None, None, None, 1), (1, None, "", 1), (2, "h", "\n \n", 1), (2, "h", "a b", 1), (2, "h", "a b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, removed_lines int")
    judged = lf.quality_rules(df, most_documents=0)
    got = sorted(((x.doc_id, x.text) for x in lf.without_lines(judged).collect()), key=str)
    assert got == sorted([(None, None), (1, ""), (2, "\n \n"), (2, ""), (2, "")], key=str)
    assert lf.without_lines(lf.quality_rules(df.limit(0))).count() == 0


def test_a_very_long_text(spark):
    r = random.Random(6)
    long = "\n".join(" ".join(f"w{r.randrange(40_000)}" for _ in range(50)) for _ in range(3000))
    texts = [long, long + "\n" + long.split("\n", 1)[0], "y" * 300_000]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {x.doc_id: x for x in lf.quality_rules(df).collect()}
    for i, text in enumerate(texts):
        assert tuple(got[i][n] for n in NAMES) == base_measures(text)
