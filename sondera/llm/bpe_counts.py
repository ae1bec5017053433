"""Token counts of a byte-pair vocabulary without making the tokens.

A word is a doubly linked list of symbols.  A heap holds its adjacent pairs by
(merge rank, place); the lowest is popped, its two symbols become one, and the
pairs to its left and right go onto the heap.  The count of the word is its
number of symbols at the start less the number of merges.  Popping in heap
order costs n log n, so one word of a million characters is no trouble.

Only the vocabulary file decides the result: lower case, NFC, the split of a
text and the special strings are read from it or are those of its kind.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondera.llm.common import python_tasks

#: Words seen lately, so that frequent ones are merged once; emptied when full.
CACHED_WORDS, CACHED_LENGTH = 600_000, 48
_LOADED: dict[str, MergeCounter] = {}


def _byte_symbols() -> list[str]:
    """Byte to printable character, the convention of byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeCounter(dict):
    """Counts tokens of texts; as a dict it maps known words to their counts."""

    def __init__(self, spec: str) -> None:
        super().__init__()
        d = json.loads(spec)
        kinds = [n["type"] for n in d["normalizer"]["normalizers"]]
        split, level = d["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or d["model"]["type"] != "BPE":
            raise ValueError("not a lower-case word vocabulary with byte-pair merges")
        if level["add_prefix_space"] or level["use_regex"] or d["truncation"] or d["padding"]:
            raise ValueError("the vocabulary asks for steps that are not counted here")
        merges = [m.split(" ") if isinstance(m, str) else m for m in d["model"]["merges"]]
        self.ranks = {tuple(m): i for i, m in enumerate(merges)}
        self.end = d["model"]["end_of_word_suffix"] or ""
        self.symbols = _byte_symbols()
        self.pattern = regex.compile(split["pattern"]["Regex"])
        special = [a["content"] for a in d["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def __missing__(self, word: str) -> int:
        n = self.merged(word)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = n
        return n

    def merged(self, word: str) -> int:
        part: list[str | None] = [self.symbols[b] for b in word.encode()]
        n = len(part)
        if not n:
            return 0
        part[-1] += self.end
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.ranks
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if part[i] is not None else n
            if j >= n or ranks.get((part[i], part[j])) != r:
                continue  # one of the two has been merged meanwhile
            part[i] += part[j]
            part[j] = None
            after[i] = k = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if (r := ranks.get((part[i], part[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get((part[h], part[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return left

    def plain(self, text: str) -> int:
        if not text.isascii():
            # lower case is taken letter by letter, so a final sigma is like any other
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return sum(map(self.__getitem__, self.pattern.findall(text.lower())))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or "<|" not in text:
            return self.plain(text)
        pieces = self.special.split(text)
        return len(pieces) - 1 + sum(map(self.plain, pieces))


def loaded(spec: str) -> MergeCounter:
    """The counter of this Python worker; it stays for later tasks, with the words it knows."""
    if spec not in _LOADED:
        _LOADED.clear()
        _LOADED[spec] = MergeCounter(spec)
    return _LOADED[spec]


def token_counter(spark: SparkSession, vocabulary: str) -> Column:
    """A column function: token count of a text column; NULL counts as empty.

    ``vocabulary`` is the path of the file on the driver.  Its text is
    broadcast: a few MB, fixed by the vocabulary and not by the data.
    """
    python_tasks(spark)
    with open(vocabulary, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("long")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = loaded(spec.value)
        for texts in batches:
            yield pd.Series(np.fromiter(map(counter.count, texts), dtype=np.int64, count=len(texts)))

    return counts


def count_tokens(
    docs: DataFrame, vocabulary: str, text: str = "text", limit: int = 2048
) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` in place of the text.

    One pass without a shuffle; every row stands for itself.  A NULL or empty
    text has 0 bytes and 0 tokens; repeated rows give repeated rows; columns of
    the same names are replaced, others kept; an empty table gives none.
    """
    counter = token_counter(docs.sparkSession, vocabulary)
    clean = docs.drop("n_bytes", "n_tokens", "over_limit")
    return clean.select(
        *[c for c in clean.columns if c != text],
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        counter(F.col(text)).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
