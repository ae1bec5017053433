"""Conversations as training windows of a token budget, with loss masks.

A turn is written ``### role: text</turn>`` and a line end.  In roles and texts
a backslash goes before each of the characters that marks are made of, so a
text that looks like a mark is none, and taking the backslashes away gives the
text back.  Windows hold whole turns: running sums of turn tokens tell which
turns still fit.  Every window starts with the system turn, if there is one,
and the last turns of the window before, as far as their tokens stay within the
history budget.  Such repeats are outside the loss mask; so each assistant text
is a target once.

A partition is read turn by turn in order.  What is held is one window and the
history, never a conversation, so a conversation of any length fits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondera.llm.common import python_tasks

_MARKS = re.compile(r"[\\#<:]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:[^\\#<:]|\\.)*): ((?:[^\\#<:]|\\.)*)</turn>\n", re.DOTALL)

WINDOWS = (
    "conv_id long, window int, first_turn long, n_repeated int, n_turns int, n_tokens long, "
    "formatted string, loss array<struct<start: int, end: int>>"
)


def escape(text: str) -> str:
    return _MARKS.sub(r"\\\g<0>", text)


def formatted_turn() -> Column:
    """The turn as it is written, from the columns ``role`` and ``text``: what a token budget is about."""
    own = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"([\\#<:])", r"\\$1")
    return F.concat(F.lit("### "), own("role"), F.lit(": "), own("text"), F.lit("</turn>\n"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a window, unescaped."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


class Windows:
    """Cuts one conversation, given turn by turn, into windows."""

    def __init__(self, conv_id: int | None, budget: int, history: int, target: str) -> None:
        self.conv_id, self.budget, self.history, self.target = conv_id, budget, history, target
        self.system: list[tuple[str, str, int]] = []
        self.repeats: list[tuple[str, str, int]] = []
        self.fresh: list[tuple[str, str, int]] = []
        self.turns = self.window = 0
        self.held = 0  # tokens of the window so far, repeats included

    def add(self, role: str, text: str, tokens: int) -> dict | None:
        """Take a turn; the window that it closes, if it closes one."""
        closed = None
        if self.fresh and self.held + tokens > self.budget:
            closed = self.close(tokens)
        turn = role, text, tokens
        if self.turns == 0 and role == "system":
            self.system = [turn]
        self.fresh.append(turn)
        self.held += tokens
        self.turns += 1
        return closed

    def close(self, coming: int = 0) -> dict | None:
        """The open window; the next one begins with what it repeats beside ``coming`` tokens."""
        if not self.fresh:
            return None
        done = self._written()
        fixed = sum(t for *_, t in self.system)
        room = min(self.history, self.budget - fixed - coming)
        repeats: list[tuple[str, str, int]] = []
        for turn in reversed(self.repeats + self.fresh):
            room -= turn[2]
            if room < 0 or any(turn is s for s in self.system):  # a later turn may say the same
                break
            repeats.insert(0, turn)
        self.repeats, self.fresh = self.system + repeats, []
        self.held = sum(t for *_, t in self.repeats)
        self.window += 1
        return done

    def _written(self) -> dict:
        pieces, loss, at = [], [], 0
        turns = self.repeats + self.fresh
        for i, (role, text, _) in enumerate(turns):
            head, body = f"### {escape(role)}: ", escape(text)
            if i >= len(self.repeats) and role == self.target:
                loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
            pieces.append(f"{head}{body}</turn>\n")
            at += len(pieces[-1])
        return {
            "conv_id": self.conv_id,
            "window": self.window,
            "first_turn": self.turns - len(self.fresh),
            "n_repeated": len(self.repeats),
            "n_turns": len(turns),
            "n_tokens": self.held,
            "formatted": "".join(pieces),
            "loss": loss,
        }


_WINDOW_SCHEMA = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("window", pa.int32()),
        ("first_turn", pa.int64()),
        ("n_repeated", pa.int32()),
        ("n_turns", pa.int32()),
        ("n_tokens", pa.int64()),
        ("formatted", pa.string()),
        ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ]
)


def chat_windows(
    turns: DataFrame,
    tokens: Column,
    budget: int = 2048,
    history: int = 512,
    target: str = "assistant",
) -> DataFrame:
    """Windows of ``turns`` (conv_id, turn, role, text); other columns are not read.

    Turns go by ``turn``, ties by role and text; equal rows are all kept.  NULL
    roles and texts count as empty; rows without a conv_id are one conversation.
    A turn of more tokens than the budget has a window of its own, with the
    system turn, and is not cut.  A system turn is one that opens the
    conversation.  ``tokens`` counts a turn, an expression on the columns; count
    ``formatted_turn()`` if the budget is to hold for the windows as written.  The
    windows of a conversation lie together and in order.
    """
    python_tasks(turns.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, out, size = None, [], 0
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "tokens")]
            for conv, role, text, n in zip(*cols):
                if state is None or conv != state.conv_id:
                    if state is not None and (done := state.close()):
                        out.append(done)
                    state = Windows(conv, budget, history, target)
                if done := state.add(role, text, n):
                    out.append(done)
                    size += len(done["formatted"])
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema=_WINDOW_SCHEMA)
                        out, size = [], 0
        if state is not None and (done := state.close()):
            out.append(done)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_WINDOW_SCHEMA)

    return (
        turns.select(
            F.col("conv_id").cast("long"),
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
            tokens.alias("tokens"),
        )
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .mapInArrow(cut, WINDOWS)
    )


class Digest:
    """What the windows of one conversation say, hashed as they come."""

    def __init__(self, conv_id: int | None) -> None:
        self.row = {"conv_id": conv_id, "n_turns": 0, "loss_chars": 0, "formatted_chars": 0}
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, repeated: int, loss: list[dict]) -> None:
        fresh = parse(formatted)[repeated:]
        for role, text in fresh:
            self.turns.update(f"{role}\n{text}\n".encode())
        for span in loss:
            text = unescape(formatted[span["start"] : span["end"]])
            self.row["loss_chars"] += len(text)
            self.loss.update(text.encode())
        self.row["n_turns"] += len(fresh)
        self.row["formatted_chars"] += len(formatted)

    def close(self) -> dict:
        return self.row | {
            "turns_sha256": self.turns.hexdigest(),
            "loss_sha256": self.loss.hexdigest(),
        }


_DIGEST_SCHEMA = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)


def read_back(windows: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted text and masks of ``chat_windows`` alone.

    The windows of a conversation must lie together and in order, as
    ``chat_windows`` leaves them; there is no further shuffle.  A SHA-256 runs
    over a conversation from start to end, so one conversation is one task.
    """
    python_tasks(windows.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, out = None, []
        for batch in batches:
            names = ("conv_id", "formatted", "n_repeated", "loss")
            for conv, text, n, loss in zip(*(batch.column(c).to_pylist() for c in names)):
                if state is None or conv != state.row["conv_id"]:
                    if state is not None:
                        out.append(state.close())
                    state = Digest(conv)
                state.add(text, n, loss)
            if len(out) > 1000:
                yield pa.RecordBatch.from_pylist(out, schema=_DIGEST_SCHEMA)
                out = []
        if state is not None:
            out.append(state.close())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_DIGEST_SCHEMA)

    return windows.mapInArrow(
        read,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long",
    )
