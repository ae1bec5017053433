"""Removal of passages that occur elsewhere, by subtrees of the corpus' suffix tree.

A passage is a window of ``window`` words (35).  Two equal windows are two
suffixes with a common prefix of that length: they lie under one internal node
of that depth.  The tree is never built as a whole:

* Of the suffixes only a sample is sorted into groups.  Each window chooses
  one place in itself, its *anchor*: the leftmost of the 8-word strings in it
  with the least hash.  Equal windows choose the same one at the same distance,
  so windows need to be compared only if their anchors begin with the same 8
  words.  About one suffix in 14 is an anchor.
* Groups are the anchors' prefixes of 8 words.  One aggregation tells which
  occur twice; the others are unique and are dropped.  Anchors whose whole
  surroundings (all words of all windows that chose them) are equal are
  repeats right away; in a group only different surroundings are compared.
* A group of up to ``GROUP`` different surroundings fits in a task.  There the
  suffixes from the starts of the windows are sorted, neighbours' common prefixes
  measured, and the nodes as deep as a window found: the subtree.
* The suffixes of a larger group are split by longer prefixes, 12 words, 20, and so on up to the
  window, until a part fits in a task; one that is alone with its prefix is dropped on the way.
  Each part's subtree is built like the others.  A part that is still too large
  when its prefix is the whole window hangs under one node of that depth, so all of it repeats.

Exact copies of a text are merged before their spans are made (all windows of a
text that occurs twice are repeats), and texts are shuffled once.  Keys of texts and of prefixes are
64-bit hashes; in the subtrees the words themselves are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondera.llm.common import python_tasks, saved

WINDOW, PREFIX, GROUP = 35, 8, 2000
#: Prefixes, in words, by which a group is split that is too large; the window comes last.
LADDER = (12, 20)
ALL = -1  # a mask: every window of the anchor
_RNG = np.random.default_rng(5)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_ODD = _RNG.integers(1, 1 << 63, 4096, dtype=np.uint64) | np.uint64(1)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word."""
    data = np.frombuffer(text, dtype=np.uint8)
    inside = ~_SPACE[data]
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    ends = np.flatnonzero(inside & ~np.concatenate((inside[1:], [False]))) + 1
    sizes = ends - starts
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    # a byte's place picks its factor; places recur in very long words, in other mixtures
    factor = _ODD[at % 4096] + (at // 4096).astype(np.uint64) * np.uint64(2)
    sums = np.add.reduceat(_BYTE[data[inside]] * factor, np.cumsum(sizes) - sizes)
    return _mixed(sums + sizes.astype(np.uint64))


def _anchors(words: np.ndarray, window: int) -> np.ndarray:
    """For each window of the text, the place of its anchor."""
    n = len(words) - PREFIX + 1
    return _prefixes_windows(_prefixes(words), window) if n >= window - PREFIX + 1 else np.zeros(0, int)


def _prefixes(words: np.ndarray) -> np.ndarray:
    n = len(words) - PREFIX + 1
    total = np.zeros(n, dtype=np.uint64)
    for j in range(PREFIX):
        total += words[j : n + j] * _ODD[j]
    return _mixed(total)


def _prefixes_windows(prefixes: np.ndarray, window: int) -> np.ndarray:
    inside = np.lib.stride_tricks.sliding_window_view(prefixes, window - PREFIX + 1)
    return inside.argmin(axis=1) + np.arange(len(inside))


def _surroundings(words: np.ndarray, places: np.ndarray, window: int) -> np.ndarray:
    """Hash of all words of all windows that can hold the anchor; text ends count as words."""
    left, right = window - PREFIX, window - 1
    padded = np.concatenate([np.full(left, 1, np.uint64), words, np.full(right, 2, np.uint64)])
    out = np.empty(len(places), dtype=np.uint64)
    for i in range(0, len(places), 20_000):
        own = places[i : i + 20_000, None] + np.arange(left + 1 + right)
        out[i : i + 20_000] = (padded[own] * _ODD[: own.shape[1]]).sum(axis=1)
    return _mixed(out)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    for i, text in enumerate(batch.column("text").cast(pa.binary())):
        yield i, text.as_py()


_ANCHORS = pa.schema(
    [("k", pa.int64()), ("pos", pa.int32()), ("h", pa.int64()), ("c", pa.int64())]
)


def _find_anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("k").to_numpy()
            cols: list[list[np.ndarray]] = [[], [], [], []]
            for i, text in _texts(batch):
                words = word_hashes(text)
                if len(words) < window:
                    continue
                prefixes = _prefixes(words)
                places = np.unique(_prefixes_windows(prefixes, window))
                found = (
                    np.full(len(places), key[i]),
                    places.astype(np.int32),
                    prefixes[places].view(np.int64),
                    _surroundings(words, places, window).view(np.int64),
                )
                for col, x in zip(cols, found):
                    col.append(x)
            if cols[0]:
                arrays = [pa.array(np.concatenate(c)) for c in cols]
                yield from pa.Table.from_arrays(arrays, schema=_ANCHORS).to_batches(50_000)

    return run


_SPANS = pa.schema(
    [("h", pa.int64()), ("c", pa.int64()), ("single", pa.bool_()), ("valid", pa.int64()), ("low", pa.int32()), ("words", pa.binary())]
)


def _cut_spans(window: int):
    """The words around listed anchors, as far as windows with that anchor reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed, out = batch.column("listed").to_pylist(), []
            for i, text in _texts(batch):
                anchor = _anchors(word_hashes(text), window)
                words = text.split()
                for a in listed[i]:
                    # the windows that chose the anchor are consecutive
                    first, last = np.searchsorted(anchor, (a["pos"], a["pos"] + 1))
                    valid = sum(1 << (a["pos"] - s) for s in range(first, last))
                    out.append(
                        {
                            "h": a["h"],
                            "c": a["c"],
                            "single": a["m"] < 2,
                            "valid": valid,
                            "low": int(a["pos"] - first),
                            "words": b" ".join(words[first : last - 1 + window]),
                        }
                    )
                if len(out) > 5000:
                    yield pa.RecordBatch.from_pylist(out, schema=_SPANS)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_SPANS)

    return run


def deep_leaves(suffixes: np.ndarray, depth: int) -> np.ndarray:
    """Which rows lie under an internal node of at least ``depth``.

    ``suffixes`` has a row of numbers for each suffix.  Sorted rows are the
    leaves of the tree in order; the common prefix of neighbours is the depth
    of the node where their paths part; a run of neighbours with ``depth`` or
    more in common are the leaves of one deep node.
    """
    rows = np.ascontiguousarray(suffixes.astype(">i4"))
    order = np.argsort(rows.view(np.dtype((np.void, 4 * rows.shape[1]))).ravel(), kind="stable")
    ordered = rows[order]
    common = np.cumprod(ordered[1:] == ordered[:-1], axis=1).sum(axis=1)
    deep = np.zeros(len(rows), dtype=bool)
    deep[order[1:]] |= common >= depth
    deep[order[:-1]] |= common >= depth
    return deep


_MASKS = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("mask", pa.int64())])


def _suffixes(spans: list[dict], window: int, names: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes from all windows' starts: owner, distance to the anchor, words as numbers."""
    owner, distance, rows = [], [], []
    for i, s in enumerate(spans):
        numbers = np.array([names.setdefault(w, len(names)) for w in s["words"].split()], np.int32)
        for o in range(s["low"] + 1):
            if s["valid"] >> o & 1:
                begin = s["low"] - o
                owner.append(i)
                distance.append(o)
                rows.append(numbers[begin : begin + window])
    return np.array(owner), np.array(distance), np.stack(rows)


def _build_subtrees(window: int):
    """Rows come sorted by group; consecutive groups that fit in memory are built together."""

    def masks(spans: list[dict]) -> pa.RecordBatch:
        owner, distance, rows = _suffixes(spans, window, {})
        group = np.unique([s["h"] for s in spans], return_inverse=True)[1]
        # the group and the distance come first, so suffixes of different groups part at once
        head = np.stack([group[owner], distance], axis=1).astype(np.int32)
        deep = deep_leaves(np.concatenate([head, rows], axis=1), window + 2)
        found = np.zeros(len(spans), dtype=np.int64)
        np.bitwise_or.at(found, owner[deep], np.int64(1) << distance[deep].astype(np.int64))
        keep = [i for i, s in enumerate(spans) if found[i] and s["single"]]
        cols = [[spans[i]["h"] for i in keep], [spans[i]["c"] for i in keep], found[keep]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=_MASKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if len(held) >= GROUP and row["h"] != held[-1]["h"]:
                    yield masks(held)
                    held = []
                held.append(row)
        if held:
            yield masks(held)

    return run


def ladder(window: int) -> list[int]:
    return [n for n in LADDER if n < window] + [window]


_LONG = pa.schema(
    [("h", pa.int64()), ("c", pa.int64()), ("single", pa.bool_()), ("o", pa.int32()), ("prefixes", pa.list_(pa.int64()))]
)


def _lengthen(window: int):
    """Hashes of the longer prefixes of each suffix, for groups too large for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s in batch.to_pylist():
                mixed = word_hashes(s["words"])
                for o in range(s["low"] + 1):
                    if s["valid"] >> o & 1:
                        own = mixed[s["low"] - o : s["low"] - o + window] * _ODD[:window]
                        sums = np.array([own[:n].sum() for n in ladder(window)], dtype=np.uint64)
                        row = {"h": s["h"], "c": s["c"], "single": s["single"], "o": o}
                        out.append(row | {"prefixes": _mixed(sums).view(np.int64).tolist()})
            if out:
                yield from pa.Table.from_pylist(out, schema=_LONG).to_batches(50_000)

    return run


_PART_SUFFIXES = pa.schema(
    [("part", pa.int64()), ("h", pa.int64()), ("c", pa.int64()), ("single", pa.bool_()), ("o", pa.int32()), ("words", pa.binary())]
)


def _cut_windows(window: int):
    """The window's words of each suffix that is in a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s in batch.to_pylist():
                words = s["words"].split()
                for p in s["places"]:
                    begin = s["low"] - p["o"]
                    row = {"part": p["part"], "h": s["h"], "c": s["c"], "single": s["single"], "o": p["o"]}
                    out.append(row | {"words": b" ".join(words[begin : begin + window])})
                if len(out) > 5000:
                    yield pa.RecordBatch.from_pylist(out, schema=_PART_SUFFIXES)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_PART_SUFFIXES)

    return run


def _build_parts(window: int):
    """Subtrees of parts, which come one after the other; as many together as fit in memory."""

    def masks(rows: list[dict]) -> pa.RecordBatch:
        names: dict[bytes, int] = {}
        numbers = np.stack([np.array([names.setdefault(w, len(names)) for w in r["words"].split()], np.int32) for r in rows])
        part = np.unique([r["part"] for r in rows], return_inverse=True)[1].astype(np.int32)
        deep = deep_leaves(np.concatenate([part[:, None], numbers], axis=1), window + 1)
        keep = [r for r, d in zip(rows, deep) if d and r["single"]]
        cols = [[r["h"] for r in keep], [r["c"] for r in keep], [1 << r["o"] for r in keep]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=_MASKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if len(held) >= GROUP and row["part"] != held[-1]["part"]:
                    yield masks(held)
                    held = []
                held.append(row)
        if held:
            yield masks(held)

    return run


def _split_groups(spans: DataFrame, window: int) -> DataFrame:
    """``h, c, mask``: repeats among the suffixes of groups that are too large for a task.

    Prefixes are lengthened over the distinct windows, each with its number of suffixes; the
    suffixes themselves meet the outcome once.
    """
    suffixes = saved(
        spans.mapInArrow(_lengthen(window), "h long, c long, single boolean, o int, prefixes array<long>")
        .withColumn("own", F.xxhash64("h", "o", F.element_at("prefixes", -1)))
    )
    left = suffixes.groupBy("own").agg(
        F.first("h").alias("h"), F.first("o").alias("o"), F.first("prefixes").alias("prefixes"), F.count("*").alias("times")
    )
    fitting = []
    for i in range(len(ladder(window))):
        keyed = left.withColumn("part", F.xxhash64("h", "o", F.get("prefixes", F.lit(i))))
        sizes = keyed.groupBy("part").agg(F.sum("times").alias("leaves")).filter("leaves >= 2")
        shared = saved(keyed.join(sizes, "part"))
        fitting.append(shared.filter(F.col("leaves") <= GROUP).select("own", "part"))
        left = shared.filter(F.col("leaves") > GROUP).drop("part", "leaves")
    # too many suffixes with one whole window: no part, all under one node
    outcome = left.select("own", F.lit(None).cast("long").alias("part"))
    for fits in fitting:
        outcome = outcome.unionByName(fits)
    placed = saved(suffixes.join(outcome, "own").select("h", "c", "single", "o", "part"))
    listed = (
        placed.filter("part IS NOT NULL").groupBy("h", "c").agg(F.collect_list(F.struct("o", "part")).alias("places"))
    )
    built = (
        spans.join(listed, ["h", "c"])
        .mapInArrow(_cut_windows(window), "part long, h long, c long, single boolean, o int, words binary")
        .repartition("part")
        .sortWithinPartitions("part")
        .mapInArrow(_build_parts(window), "h long, c long, mask long")
    )
    whole = placed.filter("part IS NULL AND single").select("h", "c", F.expr("shiftleft(1L, o)").alias("mask"))
    return built.unionByName(whole).groupBy("h", "c").agg(F.bit_or("mask").alias("mask"))


_REMOVED = pa.schema(
    [("k", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
)


def _cover(window: int):
    """Spans of removed words, from the verdicts on the anchors of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts, n = batch.column("verdicts").to_pylist(), batch.column("n").to_pylist()
            counts, spans = [], []
            for i, text in _texts(batch):
                if not verdicts[i]:
                    size = len(text.split())
                    counts.append(size)
                    spans.append([{"start": 0, "end": size}] if n[i] > 1 and size >= window else [])
                    continue
                words = word_hashes(text)
                counts.append(len(words))
                if n[i] > 1:
                    spans.append([{"start": 0, "end": len(words)}] if len(words) >= window else [])
                    continue
                anchor = _anchors(words, window)
                masks = np.zeros(len(words), dtype=np.int64)
                for v in verdicts[i]:
                    masks[v["pos"]] = v["mask"]
                starts = np.arange(len(anchor))
                repeated = (masks[anchor] >> (anchor - starts)) & 1
                change = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(change, starts[repeated == 1], 1)
                np.add.at(change, starts[repeated == 1] + window, -1)
                gone = np.concatenate(([0], (np.cumsum(change)[:-1] > 0).astype(np.int8), [0]))
                edge = np.diff(gone)
                spans.append(
                    [
                        {"start": int(a), "end": int(b)}
                        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k"),
                    batch.column("text"),
                    pa.array(counts, pa.int64()),
                    pa.array(spans, _REMOVED.field("removed").type),
                ],
                schema=_REMOVED,
            )

    return run


def repeated_spans(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per distinct text: ``k`` (its xxhash64), ``text``, ``n_words``, ``removed`` spans of words."""
    if not PREFIX < window <= PREFIX + 55:
        raise ValueError(f"window must be {PREFIX + 1} to {PREFIX + 55} words")
    python_tasks(docs.sparkSession)
    body = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn(
        "k", F.xxhash64("text")
    )
    # read by several branches with other columns each, so the words are hashed once only
    anchors = saved(body.mapInArrow(_find_anchors(window), "k long, pos int, h long, c long"))
    # saved, so that the join has nothing but two exchanges below it and hot prefixes are split
    repeated = saved(
        anchors.groupBy("h")
        .agg(F.count("*").alias("total"), F.min("c").alias("c1"), F.max("c").alias("c2"))
        .filter("total >= 2")
        .select("h", (F.col("c1") != F.col("c2")).alias("differ"))
    )
    groups = saved(anchors.join(repeated, "h"))
    same = groups.filter("NOT differ").select("k", "pos", F.lit(ALL).cast("long").alias("mask"))
    members = groups.filter("differ")
    kinds = saved(
        members.groupBy("h", "c").agg(
            F.count("*").alias("m"), F.min(F.struct("k", "pos")).alias("at")
        )
    )
    texts = body.groupBy("k").agg(F.first("text").alias("text"), F.count("*").alias("n"))
    large = kinds.groupBy("h").agg(F.count("*").alias("size")).filter(F.col("size") > GROUP)

    def spans(which: DataFrame) -> DataFrame:
        listed = which.groupBy(F.col("at.k").alias("k")).agg(
            F.collect_list(F.struct("at.pos", "h", "c", "m")).alias("listed")
        )
        return texts.join(listed, "k").mapInArrow(
            _cut_spans(window), "h long, c long, single boolean, valid long, low int, words binary"
        )

    subtrees = (
        spans(kinds.join(large, "h", "left_anti"))
        .repartition("h")
        .sortWithinPartitions("h", "c")
        .mapInArrow(_build_subtrees(window), "h long, c long, mask long")
    )
    split = _split_groups(saved(spans(kinds.join(large, "h", "left_semi"))), window)
    twice = kinds.filter("m >= 2").select("h", "c", F.lit(ALL).cast("long").alias("mask"))
    masks = twice.unionByName(subtrees).unionByName(split)
    judged = members.join(masks, ["h", "c"]).select("k", "pos", "mask")
    verdicts = (
        same.unionByName(judged)
        .distinct()  # copies of a text say the same
        .groupBy("k")
        .agg(F.collect_list(F.struct("pos", "mask")).alias("verdicts"))
    )
    return texts.join(verdicts, "k", "left").mapInArrow(
        _cover(window),
        "k long, text string, n_words long, removed array<struct<start: long, end: long>>",
    )


def _kept(texts: pd.Series, removed: pd.Series) -> pd.Series:
    out = []
    for text, spans in zip(texts, removed):
        data = text.encode().split()
        for s in reversed(list(spans)):
            del data[s["start"] : s["end"]]
        out.append(b" ".join(data).decode())
    return pd.Series(out, dtype=object)


def kept_text(text: str = "text", removed: str = "removed") -> Column:
    """The words outside the spans, joined by one blank."""
    return F.pandas_udf(_kept, "string")(F.col(text), F.col(removed))


def n_removed(removed: str = "removed") -> Column:
    return F.aggregate(removed, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def without_repeats(
    docs: DataFrame, outputs: dict[str, Column], text: str = "text", window: int = WINDOW
) -> DataFrame:
    """``docs`` without the text, with columns made from ``text``, ``n_words`` and ``removed``.

    A word is removed if a window of ``window`` words over it occurs anywhere
    else, in the same text or another row; every occurrence goes, the first as
    well.  Windows are those of the input.  Texts shorter than a window stay
    whole; a NULL text has no words; repeated rows are repeats of each other;
    columns of the outputs' names are replaced; an empty table gives none.
    ``outputs`` are computed once per distinct text.
    """
    made = repeated_spans(docs, text, window).select(
        F.col("k").alias("_k"), *[c.alias(name) for name, c in outputs.items()]
    )
    rows = docs.select(
        *[c for c in docs.columns if c != text and c not in outputs],
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_k"),
    )
    return rows.join(made, "_k").drop("_k")
