"""Spelling variants: each word's near words, by search schemes on a bidirectional FM-index.

Two words are near if one insertion, deletion or replacement of a code point turns one into
the other.  Of the two halves of a word, one then stands unchanged in the near
word.  So each word is searched twice: the left half exactly and on to the right with
one error, and the right half exactly and on to the left with one error.  The index is a
pair of Burrows-Wheeler transforms of the vocabulary with a delimiter between words, one for
each direction.  A search holds intervals of suffix ranks; reading a symbol is two lookups
of ranks, and the delimiter at the end leaves just the word that was found.

The vocabulary is dealt to indexes of bounded size by the code points that
both words of a pair must share: the first two for searches to the right, the last
three for searches to the left.  What is still too large is cut into pieces, each
of which all words of the bucket are searched in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondera.llm.common import python_tasks, saved

LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST, FEWEST = 5, 3
#: Words in an index, and words searched at once.
GROUP, BATCH = 10_000, 4_000
#: Most tasks over which the indexes are dealt; beyond, a task builds several in turn.
TASKS = 10_000


def occurrences(docs: DataFrame, text: str = "text", key: str = "doc_id", slips: int = 97) -> DataFrame:
    """``word`` and its number ``n`` over all texts: runs of letters, A-Z in lower case.

    Where ``slips`` divides h, the crc32 of ``<key>:<run>``, the run loses its code point
    h % length, counted from 0 (a NULL key is written as nothing).  Words shorter
    than five code points are left out.
    """
    runs = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"({LETTERS}{{{SHORTEST},}})"), F.lit(1))
    run, length = F.col("run"), F.char_length("run")
    h = F.crc32(F.concat(F.coalesce(F.col("key"), F.lit("")), F.lit(":"), run).cast("binary"))
    place = (F.col("h") % length).cast("int")
    slipped = F.concat(F.substr(run, F.lit(1), place), F.substr(run, place + 2))
    return (
        docs.select(F.col(key).cast("string").alias("key"), F.explode(runs).alias("run"))
        .withColumn("h", h)
        .select(F.when(F.col("h") % slips == 0, slipped).otherwise(run).alias("word"))
        .filter(F.char_length("word") >= SHORTEST)
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )


class ReadingIndex:
    """Words that can be read from their start on, a symbol at a time, all of an interval at once.

    The text is every word backwards behind a delimiter, taken as a circle; suffixes are
    ranked by doubling.  Extending a suffix to its left then reads a word to its right.
    """

    def __init__(self, words: list[str]) -> None:
        codes, lengths = symbols(words)
        self.letters = np.unique(codes)
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        size = int(starts[-1])
        text = np.zeros(size, dtype=np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        inside = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        text[starts[word] + lengths[word] - inside] = np.searchsorted(self.letters, codes) + 1
        order = _ranked(text)
        self.last = text[order - 1]
        by_symbol = np.argsort(self.last, kind="stable")
        self.size, self.words = size, len(words)
        self.keys = self.last[by_symbol] * (size + 1) + by_symbol
        self.word_at = np.searchsorted(starts, order[: len(words)])

    def read(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals after one more symbol (0 is the end of the word)."""
        at = symbol * (self.size + 1)
        return np.searchsorted(self.keys, at + lo), np.searchsorted(self.keys, at + hi)

    def next_symbols(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of intervals and the letters that may follow there."""
        wide, kinds = hi - lo > len(self.letters), len(self.letters) + 1
        few, many = np.flatnonzero(~wide), np.flatnonzero(wide)
        width = (hi - lo)[few]
        each = np.repeat(few, width)
        rank = lo[each] + np.arange(len(each)) - np.repeat(np.cumsum(width) - width, width)
        found = np.unique(each * kinds + self.last[rank])
        found = np.concatenate([found, (many[:, None] * kinds + np.arange(1, kinds)).ravel()])
        found = found[found % kinds > 0]
        return found // kinds, found % kinds


def symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in a row, and the words' lengths."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    return codes, np.array([len(w) for w in words], dtype=np.int64)


def _ranked(text: np.ndarray) -> np.ndarray:
    """Starts of the rotations of a text in order, by doubling the length that is compared."""
    rank, reach = text, 1
    while True:
        key = rank * (len(text) + 1) + np.roll(rank, -reach)
        order = np.argsort(key, kind="stable")
        steps = np.diff(key[order]) != 0
        rank = np.empty(len(text), dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(steps)])
        if steps.all() or reach >= len(text):
            return order
        reach *= 2


def with_one_error(index: ReadingIndex, words: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in ``words``, place in the index) that differ by one edit after ``exact[i]`` equal symbols.

    The states of all searches move together: word, symbols read, interval and
    whether the error is spent.  The words of the index are distinct.
    """
    codes, lengths = symbols(words)
    known = np.searchsorted(index.letters, codes)
    known = np.minimum(known, len(index.letters) - 1)
    own = np.where(index.letters[known] == codes, known + 1, -1)
    starts = np.cumsum(lengths) - lengths
    padded = np.append(own, -1)
    w = np.arange(len(words))
    state = (w, np.zeros_like(w), np.zeros_like(w), np.full_like(w, index.words), np.zeros(len(w), dtype=bool))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(state[0]):
        w, at, lo, hi, spent = state
        ended = at == lengths[w]
        symbol = np.where(ended, -1, padded[np.minimum(starts[w] + at, len(own))])
        full = ended & spent
        if full.any():
            first, after = index.read(lo[full], hi[full], np.zeros(int(full.sum()), dtype=np.int64))
            hit = after > first
            found.append((w[full][hit], index.word_at[first[hit]]))
        parts = []
        go = np.flatnonzero(symbol > 0)
        parts.append((w[go], at[go] + 1, *index.read(lo[go], hi[go], symbol[go]), spent[go]))
        free = ~spent & (at >= exact[w])
        cut = np.flatnonzero(free & ~ended)
        parts.append((w[cut], at[cut] + 1, lo[cut], hi[cut], np.ones(len(cut), dtype=bool)))
        open_ = np.flatnonzero(free)
        which, other = index.next_symbols(lo[open_], hi[open_])
        i = open_[which]
        differs = other != symbol[i]
        i, other = i[differs], other[differs]
        a, b = index.read(lo[i], hi[i], other)
        spent_now = np.ones(len(i), dtype=bool)
        swap = ~ended[i]
        parts.append((w[i][swap], at[i][swap] + 1, a[swap], b[swap], spent_now[swap]))
        parts.append((w[i], at[i], a, b, spent_now))
        state = tuple(np.concatenate(x) for x in zip(*parts))
        alive = state[3] > state[2]
        state = tuple(x[alive] for x in state)
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    pairs = np.unique(np.concatenate([a * np.int64(index.words) + b for a, b in found]))
    return pairs // index.words, pairs % index.words


_PAIRS = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (forward, bucket, piece, searched): words of an index, then those searched in it."""
    own, held, counts, waiting, index = None, [], [], [], None

    def pairs(forward: bool) -> pa.RecordBatch:
        turned = waiting if forward else [w[::-1] for w in waiting]
        exact = np.array([len(w) // 2 if forward else len(w) - len(w) // 2 for w in waiting])
        a, b = with_one_error(index, turned, exact)
        columns = [[waiting[i] for i in a], [held[i] for i in b], [counts[i] for i in b]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PAIRS)], schema=_PAIRS)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("forward", "bucket", "piece", "searched", "word", "n")]
        for forward, bucket, piece, searched, word, n in zip(*columns):
            if (forward, bucket, piece) != own:
                if waiting:
                    yield pairs(own[0])
                own, held, counts, waiting, index = (forward, bucket, piece), [], [], [], None
            if not searched:
                held.append(word)
                counts.append(n)
                continue
            if index is None:
                index = ReadingIndex(held if forward else [w[::-1] for w in held])
            waiting.append(word)
            if len(waiting) >= BATCH:
                yield pairs(forward)
                waiting = []
    if waiting:
        yield pairs(own[0])


def near_words(vocabulary: DataFrame, group: int = GROUP) -> DataFrame:
    """``word``, ``near``, ``near_n`` for all near words of a vocabulary (distinct ``word``, ``n``).

    Words have five code points or more.
    """
    total = vocabulary.count()
    buckets = total // group + 1
    shared = F.when(F.col("forward"), F.substring("word", 1, SHORTEST // 2)).otherwise(
        F.expr(f"right(word, {SHORTEST - SHORTEST // 2})")
    )
    ways = vocabulary.withColumn("forward", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn(
        "bucket", F.pmod(F.xxhash64(shared), F.lit(buckets)).cast("int")
    )
    pieces = ways.groupBy("forward", "bucket").agg(F.ceil(F.count("*") / group).cast("int").alias("pieces"))
    ways = ways.join(pieces, ["forward", "bucket"])
    role = F.explode(
        F.concat(
            F.array(F.struct(F.lit(False).alias("searched"), F.pmod(F.xxhash64("word"), F.col("pieces")).cast("int").alias("piece"))),
            F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda p: F.struct(F.lit(True).alias("searched"), p.alias("piece"))),
        )
    )
    return (
        ways.withColumn("role", role)
        .select("forward", "bucket", "role.piece", "role.searched", "word", "n")
        # a group is much work for few bytes, so it is not left to their size how many share a task
        .repartition(min(2 * buckets, TASKS), "forward", "bucket", "piece")
        .sortWithinPartitions("forward", "bucket", "piece", "searched")
        .mapInArrow(_search, "word string, near string, near_n long")
        .distinct()
    )


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, the last of its forms, for (word, form); each step doubles the reach."""
    reach = saved(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = reach.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        after = saved(
            reach.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved"))
        )
        reach = after.select("word", "root")
        if not after.filter("_moved").take(1):
            return reach


def spelling_variants(
    docs: DataFrame, text: str = "text", key: str = "doc_id", fewest: int = FEWEST, group: int = GROUP
) -> DataFrame:
    """Words of the texts with the form that each is likely a variant of.

    A row for each ``word`` with ``fewest`` occurrences or more (see
    ``occurrences``): ``n``; ``n_near``, how many words differ from it by one edit; its
    ``form``, the near word of largest n (ties: the least), if that is twice the word's n or
    more, with ``form_n``; and ``root``, where the forms lead.  Numbers at
    least double along forms, so these end.  NULL, empty texts and texts without letters
    have no words; repeated rows count each; other columns are not read, so their
    names can't clash; an empty table gives none.
    """
    python_tasks(docs.sparkSession)
    vocabulary = saved(occurrences(docs, text, key).filter(F.col("n") >= fewest))
    near = near_words(vocabulary, group)
    best = near.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    enough = -F.col("best.less") >= 2 * F.col("n")
    formed = saved(
        vocabulary.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, F.col("best.near")).alias("form"),
            F.when(enough, -F.col("best.less")).alias("form_n"),
        )
    )
    ends = roots(formed.filter("form IS NOT NULL"))
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
