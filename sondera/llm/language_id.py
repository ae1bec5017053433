"""Language identification with error-correcting output codes.

Every language gets a codeword of signs.  For each bit a binary classifier on
hashed byte n-grams tells the languages with +1 from those with -1.  A text is
given to the codeword with the least loss over all bits; a bit counts for a
language as far as it separated that language in training.  If a second
codeword is nearly as close, the row is flagged as ambiguous.

Training is one aggregation over the labelled rows: each task adds up the
n-gram frequencies of its texts per language, Spark adds up the tasks, and the
driver gets ``languages x dims`` numbers, whatever the size of the corpus.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondera.llm.common import python_tasks

DIMS = 8192
ORDERS = (1, 2, 3)
UNKNOWN = "und"
_PIECE = 1 << 20  # bytes handled at once
_MIX = np.uint32(2654435761)


def _frequencies(texts: list[bytes], dims: int) -> np.ndarray:
    """Share of each hashed n-gram in each text, (texts, dims).

    Texts lie in one buffer, separated by zeros that no n-gram crosses.
    """
    gap = max(ORDERS) - 1
    sizes = np.array([len(t) + gap for t in texts])
    buffer = np.frombuffer(b"".join(t + b"\0" * gap for t in texts), dtype=np.uint8)
    row = np.repeat(np.arange(len(texts)), sizes)
    total = np.zeros(len(texts) * dims)
    gram = np.zeros(len(buffer), dtype=np.uint32)
    for k in range(gap + 1):
        gram = gram[: len(buffer) - k] * np.uint32(257) + buffer[k:] + np.uint32(1)
        if k + 1 in ORDERS:
            slot = (gram * _MIX) >> np.uint32(32 - int(dims).bit_length() + 1)
            seen = (buffer[: len(gram)] != 0) & (buffer[k:] != 0)
            index = row[: len(gram)] * dims + slot
            total += np.bincount(index[seen], minlength=len(total))
    table = total.reshape(len(texts), dims)
    return table / np.maximum(table.sum(axis=1, keepdims=True), 1)


def _weighted(text: bytes, dims: int) -> np.ndarray:
    """The shares of one text; a long text is read in pieces of bounded size."""
    step = _PIECE
    parts = [text[i : i + step] for i in range(0, len(text), step)] or [b""]
    sizes = np.array([max(len(p), 1) for p in parts], dtype=float)
    return sum(_frequencies([p], dims)[0] * s for p, s in zip(parts, sizes)) / sizes.sum()


def _in_pieces(texts: list[bytes], dims: int) -> Iterator[np.ndarray]:
    """Frequencies of consecutive runs of texts, each run of bounded size."""
    run, size = [], 0
    for t in texts:
        if len(t) > _PIECE:
            if run:
                yield _frequencies(run, dims)
            yield _weighted(t, dims)[None, :]
            run, size = [], 0
            continue
        if run and (size + len(t) > _PIECE or len(run) >= 256):
            yield _frequencies(run, dims)
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield _frequencies(run, dims)


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """Signs (classes, bits): all distinct splits up to 7 classes, else random dense codes.

    Of 200 random tables the one with the greatest least distance is taken.
    """
    if classes < 2:
        return np.zeros((classes, 0))
    if classes <= 7:
        signs = itertools.product((1, -1), repeat=classes - 1)
        return np.array([(1, *s) for s in signs if -1 in s], dtype=float).T
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(classes)))
    tables = (rng.choice((-1.0, 1.0), (classes, bits)) for _ in range(200))
    far = lambda t: min((bits - t[i] @ t[:i].T).min() for i in range(1, classes))
    return max((t for t in tables if (np.abs(t.sum(axis=0)) < classes).all()), key=far)


class Codes:
    """The fitted model: languages, codewords, a classifier a bit, and its trust a language."""

    def __init__(self, languages: list[str], shares: np.ndarray, dims: int) -> None:
        self.languages, self.dims = languages, dims
        self.code = codewords(len(languages))
        p = shares / np.maximum(shares.sum(axis=1, keepdims=True), 1e-12)
        smooth = 0.05 / dims
        self.weights = np.zeros((dims, self.code.shape[1]))
        for b in range(self.code.shape[1]):
            yes, no = (p[self.code[:, b] == s].mean(axis=0) + smooth for s in (1, -1))
            self.weights[:, b] = np.log(yes / no)
        margin = p @ self.weights  # expected outputs for each language
        self.scale = np.maximum(np.abs(margin).sum(axis=0) / max(len(languages), 1), 1e-9)
        right = np.clip(margin * self.code / self.scale, 1e-3, None)
        self.trust = right / right.sum(axis=1, keepdims=True) if right.size else right

    def predict(self, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, score, share of the loss by which it leads."""
        n, k = len(shares), len(self.languages)
        if k < 2:
            return np.zeros(n, dtype=int), np.ones(n), np.ones(n)
        out = shares @ self.weights / self.scale
        loss = np.stack(
            [np.exp(-np.clip(out * c, -8, 8)) @ t for c, t in zip(self.code, self.trust)], axis=1
        )
        order = np.sort(loss, axis=1)
        lead = 1 - order[:, 0] / order[:, 1]
        p = np.exp(-4 * (loss - order[:, :1]))
        return loss.argmin(axis=1), 1 / p.sum(axis=1), lead


def fit(train: DataFrame, text: str = "text", lang: str = "lang", dims: int = DIMS) -> Codes:
    """Learn from all rows of ``train`` with a language and letters; other columns are not read.

    Every text weighs the same, however long.  Copies count as often as they occur.
    """
    python_tasks(train.sparkSession)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch["lang"].to_numpy()
            done = 0
            for shares in _in_pieces([t.encode() for t in batch["text"]], dims):
                own = langs[done : done + len(shares)]
                done += len(shares)
                for name in set(own):
                    sums[name] = sums.get(name, 0) + shares[own == name].sum(axis=0)
        for name, total in sums.items():
            slot = np.flatnonzero(total)
            yield pd.DataFrame({"lang": name, "slot": slot, "share": np.round(total[slot], 9)})

    rows = train.select(F.lower(text).alias("text"), F.col(lang).alias("lang")).filter(
        F.col("lang").isNotNull() & has_letter(F.col("text"))
    )
    # decimals, so that the sum does not depend on the order of the tasks
    sums = (
        rows.mapInPandas(add, "lang string, slot int, share double")
        .groupBy("lang", "slot")
        .agg(F.sum(F.col("share").cast("decimal(28,9)")).cast("double").alias("share"))
        .groupBy("lang")
        .agg(F.collect_list("slot").alias("slots"), F.collect_list("share").alias("shares"))
        .orderBy("lang")
        .collect()
    )
    table = np.zeros((len(sums), dims))
    for i, r in enumerate(sums):
        table[i, r["slots"]] = r["shares"]
    return Codes([r["lang"] for r in sums], table, dims)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(
    docs: DataFrame, model: Codes, text: str = "text", ambiguous_below: float = 0.05
) -> DataFrame:
    """``docs`` without the text, with ``lang_pred``, ``score`` and ``ambiguous``.

    Whole texts are read.  NULL, empty and letterless texts get ``und``, score
    0, ambiguous; so does every text if no labelled row was there to learn from.
    Equal losses go to the language first by code point.  Columns of the same
    names are replaced.
    """
    python_tasks(docs.sparkSession)
    names = np.array([*model.languages, UNKNOWN], dtype=object)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            at = np.full(len(texts), len(names) - 1)
            score, lead = np.zeros(len(texts)), np.zeros(len(texts))
            rows = np.flatnonzero(texts.notna().to_numpy())
            done = 0
            if len(names) > 1:
                for shares in _in_pieces([texts.iloc[i].encode() for i in rows], model.dims):
                    own = rows[done : done + len(shares)]
                    done += len(shares)
                    at[own], score[own], lead[own] = model.predict(shares)
            yield pd.DataFrame(
                {"lang_pred": names[at], "score": score, "ambiguous": lead < ambiguous_below}
            )

    lowered = F.lower(text)
    clean = docs.drop("lang_pred", "score", "ambiguous")
    given = F.when(has_letter(lowered), lowered)
    return clean.select(
        *[c for c in clean.columns if c != text], judge(given).alias("_judged")
    ).select("*", "_judged.*").drop("_judged")
