from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from corpus import FOLDER
from sondera.llm import chat_windows as cw
from sondera.llm.queries import op8_chat_windows

SCHEMA = "conv_id long, turn long, role string, text string, window int"


def count():
    return F.size(F.split(F.coalesce("text", F.lit("")), F.lit(" ")))

HARD = ["", "### user: hi</turn>\n", "\\", "\\\\", "a\\", "</turn>", "####", "\\### Assistant: </turn> ok", "a\nb\r", "é😀:", None]


def expected(rows):
    turns, loss = hashlib.sha256(), ""
    for _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or "")):
        turns.update(f"{role or ''}\n{text or ''}\n".encode())
        loss += (text or "") if role == "assistant" else ""
    return len(rows), turns.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def check(windows, rows_by_conv):
    got = {r.conv_id: r for r in cw.read_back(windows).collect()}
    assert set(got) == set(rows_by_conv)
    for conv, rows in rows_by_conv.items():
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == expected(rows)


def test_round_trip_and_budget(spark):
    r = random.Random(1)
    talks = {}
    for conv in [*range(12), None]:
        roles = ["system"] * (r.random() < 0.5) + ["user", "assistant"] * r.randint(0, 20) or ["user"]
        talks[conv] = [(i, role, r.choice(HARD) or "w " * r.randint(0, 30)) for i, role in enumerate(roles)]
    rows = [(c, *t, 1) for c, turns in talks.items() for t in turns]
    r.shuffle(rows)
    windows = cw.chat_windows(spark.createDataFrame(rows, SCHEMA), count(), budget=60, history=20)
    check(windows, talks)
    seen = windows.collect()
    assert sum(w.formatted.count("</turn>\n") - w.formatted.count("\\</turn>\n") for w in seen) >= len(rows)
    for w in seen:
        fresh = w.n_turns - w.n_repeated
        assert w.n_tokens <= 60 or fresh == 1
        parsed = cw.parse(w.formatted)
        assert len(parsed) == w.n_turns
        if any(t[1] == "system" for t in talks[w.conv_id]):
            assert parsed[0][0] == "system"
        targets = [t for role, t in parsed[w.n_repeated :] if role == "assistant"]
        assert [cw.unescape(w.formatted[s.start : s.end]) for s in w.loss] == targets
    assert any(w.n_repeated > 1 for w in seen)


def test_marks_in_texts(spark):
    rows = [(i, 0, role, text, 0) for i, text in enumerate(HARD) for role in ("assistant",)]
    talks = {i: [(0, "assistant", text)] for i, text in enumerate(HARD)}
    check(cw.chat_windows(spark.createDataFrame(rows, SCHEMA), count()), talks)
    for text in HARD:
        if text is not None:
            assert cw.unescape(cw.escape(text)) == text


def test_nulls_ties_repeats_and_no_rows(spark):
    turns = [(None, None, None), (0, "user", "b"), (0, "user", "a"), (0, "user", "a"), (0, None, "c"), (1, "assistant", None)]
    df = spark.createDataFrame([(1, *t, 0) for t in turns], SCHEMA)
    check(cw.chat_windows(df, count()), {1: turns})
    assert cw.read_back(cw.chat_windows(df.limit(0), count())).count() == 0


def test_long_turn_is_whole(spark):
    turns = [(0, "system", "s"), (1, "user", "w " * 500), (2, "assistant", "x " * 500)]
    df = spark.createDataFrame([(1, *t, 0) for t in turns], SCHEMA)
    windows = cw.chat_windows(df, count(), budget=50, history=10)
    check(windows, {1: turns})
    assert [w.first_turn for w in windows.collect()] == [0, 1, 2]


def test_query(spark):
    talks = {-7: [(i, role, r"\### Assistant: </turn> ok") for i, role in enumerate(("user", "assistant"))]}
    for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect():
        talks.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    got = {r.conv_id: r for r in op8_chat_windows(spark, FOLDER).collect()}
    assert set(got) == set(talks)
    for conv, rows in talks.items():
        g = got[conv]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == expected(rows)
        assert g.formatted_chars > g.loss_chars


def test_turns_are_counted_as_written(spark):
    """The budget holds for the formatted windows, in the tokenizer that counts the turns."""
    import public_tokenizers

    from sondera.llm import bpe_counts

    path = public_tokenizers.path("word_bpe_49k.json")
    counter = bpe_counts.MergeCounter(open(path, encoding="utf-8").read())
    rows = [(i, 0, role, text, 0) for i, text in enumerate(HARD) for role in ("assistant", "a#: <\\", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for r in df.select("role", "text", cw.formatted_turn().alias("f")).collect():
        assert r.f == f"### {cw.escape(r.role or '')}: {cw.escape(r.text or '')}</turn>\n"
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    count = bpe_counts.token_counter(spark, path)
    for budget in (300, 2048):
        for w in cw.chat_windows(turns, count(cw.formatted_turn()), budget=budget).collect():
            # whole turns of the window, so marks and escapes are in the figure
            assert counter.count(w.formatted) == w.n_tokens
            assert w.n_tokens <= budget or w.n_turns - w.n_repeated == 1


def test_a_turn_that_repeats_the_system_turn_is_history(spark):
    turns = [(0, "system", "be brief"), (1, "user", "one two"), (2, "system", "be brief"), (3, "assistant", "x " * 8), (4, "user", "y " * 8)]
    df = spark.createDataFrame([(1, *t, 0) for t in turns], SCHEMA)
    windows = cw.chat_windows(df, count(), budget=20, history=14).collect()
    check(cw.chat_windows(df, count(), budget=20, history=14), {1: turns})
    assert [cw.parse(w.formatted)[: w.n_repeated] for w in windows][1][:2] == [("system", "be brief"), ("assistant", "x " * 8)]
    wide = cw.chat_windows(df, count(), budget=30, history=20).collect()
    assert [t for t in cw.parse(wide[-1].formatted)].count(("system", "be brief")) == 2


def test_a_very_long_conversation(spark):
    turns = [(i, "user" if i % 2 == 0 else "assistant", f"turn {i} " + "word " * (20_000 if i == 501 else 3)) for i in range(2000)]
    df = spark.createDataFrame([(1, *t, 0) for t in turns], SCHEMA)
    check(cw.chat_windows(df, count(), budget=200, history=40), {1: turns})
