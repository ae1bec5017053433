"""Near-duplicate texts by a chosen-path join on shingles of five words.

Texts of the same shingle set form a *class of copies*, handled as one.  A set
is embedded by its least token under each of ``COORDINATES`` random orders: two
sets agree in a coordinate with the probability of their Jaccard similarity,
and then the least token is one that they share.  A run splits all sets on one
coordinate.  A bucket that is still too large for brute force is split again on each of
``BRANCHES`` coordinates drawn from those that its path has not used; small
buckets are leaves.  A split loses some pairs, and its branches make up for it:
branches and runs are such that a pair at the threshold meets with at least the
target recall, however often its buckets are split.

In a leaf the pairs that meet there for the first time are told from their
coordinates; then their texts are fetched and their true similarity computed.
A leaf reports sums and a spanning forest, never pairs, so a group of thousands
of near copies writes what its members cost.  A bucket of s sets is split only if the
pairs of its children, over all branches, are at most half of its own; so each level of
splits halves the pairs, and as only children above the size of a leaf go on, s sets are written
at most s (s / leaf)^0.62 times.  Otherwise the bucket is dense: its sets are alike, or
share a long passage.  It is cut into pieces, and each piece is compared with
itself and with every other, so all pairs of the bucket meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondera.llm.common import WORD, python_tasks, saved

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.995
COORDINATES, LEAF, DEPTH = 32, 200, 8
#: Coordinates on which a bucket is split at once.
BRANCHES = 3
#: A bucket is split if that leaves this share of its pairs at most, all branches together.
LEFT = 0.5
#: Sets in a piece of a dense bucket, and most in any other leaf, as a multiple of LEAF; a leaf may hold two pieces.
PIECE = 2
#: Sets alike to the threshold agree in fewer coordinates once in 30,000 times.
AGREEING = math.floor(
    COORDINATES * THRESHOLD - 4 * math.sqrt(COORDINATES * THRESHOLD * (1 - THRESHOLD))
)


def recall(runs: int, depth: int) -> float:
    """Chance of a pair at the threshold to meet, if each of its buckets is split ``depth`` times.

    The pair agrees in a binomial number of coordinates; ``kept`` is its chance
    to share a leaf below a bucket that it shares.
    """
    total = 0.0
    for k in range(COORDINATES + 1):
        agree, kept = k / COORDINATES, 1.0
        for _ in range(depth):
            kept = 1 - (1 - agree * kept) ** BRANCHES
        chance = math.comb(COORDINATES, k) * THRESHOLD**k * (1 - THRESHOLD) ** (COORDINATES - k)
        total += chance * (1 - (1 - agree * kept) ** runs)
    return total


#: As many as reach the recall at every depth.
RUNS = next(n for n in range(1, COORDINATES + 1) if min(recall(n, d) for d in range(DEPTH + 1)) >= RECALL)

_RNG = np.random.default_rng(23)
_ORDERS = _RNG.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)
_PLACES = _RNG.integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of each five words; of all words, if there are fewer."""
    n = min(WORDS, len(words))
    if not n:
        return np.zeros(0, dtype=np.uint64)
    rows = len(words) - n + 1
    total = np.full(rows, n, dtype=np.uint64)
    for j in range(n):
        total += words[j : rows + j] * _PLACES[j]
    return np.unique(_mixed(total))


def embedding(tokens: np.ndarray) -> np.ndarray:
    """The least token's hash under each order, 32 bits of it."""
    out = np.empty(COORDINATES, dtype=np.uint64)
    for i in range(0, len(tokens), 50_000):
        part = _mixed(tokens[i : i + 50_000, None] ^ _ORDERS).min(axis=0)
        out = part if i == 0 else np.minimum(out, part)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _words(column: pa.Array) -> Iterator[np.ndarray]:
    """64-bit words of each text, hashed by Spark."""
    values, ends = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
    for a, b in zip(ends, ends[1:]):
        yield values[a:b]


def _embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, coordinates = [], []
        for words in _words(batch.column("_words")):
            tokens = shingle_set(words)
            if len(tokens):
                key = _mixed(tokens).sum(keepdims=True) + np.uint64(len(tokens))
                keys.append(int(_mixed(key).view(np.int64)[0]))
                coordinates.append(embedding(tokens))
            else:
                keys.append(None)
                coordinates.append(None)
        batch = batch.drop_columns(["_words"])
        cols = [pa.array(keys, pa.int64()), pa.array(coordinates, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *cols], names=[*batch.schema.names, "set_key", "coordinates"]
        )


def _hashed_words(text: str):
    words = F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _leaves(sets: DataFrame) -> DataFrame:
    """``leaf``, ``bucket``, ``own``, ``piece``, ``set_key`` for every bucket of two sets or more, over all runs.

    All pairs of a bucket meet, each in one leaf: a small bucket is a leaf, a
    dense one has a leaf for each piece (``own``) and for each two pieces.
    """
    small = F.col("members") <= PIECE * LEAF
    own = sets.select("set_key", "coordinates")
    level = own.select(
        "set_key", F.posexplode(F.slice("coordinates", 1, RUNS)).alias("run", "value")
    ).select("set_key", F.xxhash64("run", "value").alias("path"), F.expr("shiftleft(1L, run)").alias("used"))
    counts = level.groupBy("path").agg(F.count("*").alias("members")).filter("members > 1")
    level = saved(level.join(counts, "path"))
    leaf = ["set_key", F.col("path").alias("leaf"), F.col("path").alias("bucket")]
    leaf += [F.lit(True).alias("own"), F.lit(0).alias("piece")]
    leaves = [level.filter(small).select(*leaf)]
    large = level.filter(~small)
    for _ in range(DEPTH):
        if not large.take(1):
            return _union(leaves)
        sizes = large.groupBy("path").agg(F.count("*").alias("size"), F.min("used").alias("used"))
        sizes = saved(sizes.withColumn("drawn", F.slice(unused("path", "used"), 1, BRANCHES)))
        child = lambda c: F.struct(
            F.xxhash64("parent", c, F.get("coordinates", c)).alias("path"),
            F.col("used").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), c)).alias("used"),
        )
        children = (
            large.select("set_key", "path")
            .join(sizes, "path")
            .withColumnRenamed("path", "parent")
            .join(own, "set_key")
            .select("set_key", "parent", "size", F.explode(F.transform("drawn", child)).alias("child"))
            .select("set_key", "parent", "size", "child.*")
        )
        counts = saved(children.groupBy("parent", "path", "size").agg(F.count("*").alias("members")))
        pairs = F.sum(F.col("members") * F.col("members"))
        dense = counts.groupBy("parent").agg((pairs > LEFT * F.first("size") * F.first("size")).alias("dense"))
        alike = dense.filter("dense").select(F.col("parent").alias("path"))
        leaves.append(_pieces(large.join(alike, "path", "left_semi")))
        split = counts.join(dense.filter("NOT dense"), "parent").filter("members > 1")
        level = saved(
            children.select("set_key", "path", "used").join(split.select("path", "members"), "path")
        )
        leaves.append(level.filter(small).select(*leaf))
        large = level.filter(~small)
    return _union([*leaves, _pieces(large)])


def unused(path: str, used: str) -> Column:
    """The coordinates whose bit of ``used`` is not set, in an order drawn from the path."""
    left = F.filter(
        F.sequence(F.lit(0), F.lit(COORDINATES - 1)),
        lambda c: F.col(used).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), c)) == 0,
    )
    drawn = F.transform(left, lambda c: F.struct(F.xxhash64(path, c).alias("h"), c.alias("c")))
    return F.transform(F.array_sort(drawn), lambda x: x["c"])


def _pieces(buckets: DataFrame) -> DataFrame:
    """Dense buckets as leaves: each piece by itself, and each two pieces together."""
    number = F.ceil(F.col("members") / (PIECE * LEAF)).cast("int")
    pieces = buckets.select(
        "set_key", "path", number.alias("number"), F.pmod(F.xxhash64("set_key"), number).alias("piece")
    )
    return pieces.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("number") - 1))).select(
        "set_key",
        F.xxhash64("path", F.least("piece", "other"), F.greatest("piece", "other")).alias("leaf"),
        F.col("path").alias("bucket"),
        (F.col("piece") == F.col("other")).alias("own"),
        F.col("piece").cast("int").alias("piece"),
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of a batch; lists as arrays, without an object for each value."""
    lists = {
        f.name: (batch.column(f.name).values.to_numpy(), batch.column(f.name).offsets.to_numpy())
        for f in batch.schema
        if pa.types.is_list(f.type)
    }
    for i, row in enumerate(batch.drop_columns(list(lists)).to_pylist()):
        yield row | {k: values[ends[i] : ends[i + 1]] for k, (values, ends) in lists.items()}


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Consecutive rows of the same key."""
    held: list[dict] = []
    for batch in batches:
        for row in _rows(batch):
            if held and row[key] != held[0][key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _first_here(rows: list[dict]) -> np.ndarray:
    """Pairs that a leaf compares: of its two pieces, if it has two, and of no earlier bucket."""
    bucket, places = rows[0]["bucket"], {}
    for i, r in enumerate(rows):
        for b in r["buckets"][r["buckets"] < bucket].tolist():
            places.setdefault(b, []).append(i)
    if rows[0]["own"]:
        pending = ~np.eye(len(rows), dtype=bool)
    else:
        piece = np.array([r["piece"] for r in rows])
        pending = piece[:, None] != piece
    for at in places.values():
        if len(at) > 1:
            pending[np.ix_(at, at)] = False
    return pending


def _pending(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of leaves with the partners to compare them with, as bits over the ``place`` of each."""
    schema = pa.schema(
        [("leaf", pa.int64()), ("set_key", pa.int64()), ("place", pa.int32()), ("partners", pa.binary())]
    )
    out = []
    for rows in _groups(batches, "leaf"):
        pairs = _first_here(rows)
        if pairs.any():
            c = np.stack([r["coordinates"] for r in rows])
            agree = np.stack([(c == x).sum(axis=1) for x in c])
            pairs &= agree >= AGREEING
        at = np.flatnonzero(pairs.any(axis=1))
        bits = np.packbits(pairs[np.ix_(at, at)], axis=1)
        for place, i in enumerate(at):
            key = rows[i]["set_key"]
            out.append({"leaf": rows[i]["leaf"], "set_key": key, "place": place, "partners": bits[place].tobytes()})
        if len(out) > 2000:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def common_tokens(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices over shared tokens."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    tokens, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    place = np.full(len(tokens), -1)
    place[shared] = np.arange(len(shared))
    at, out = place[column], np.zeros((len(sets), len(sets)), dtype=np.float64)
    for low in range(0, len(shared), 4096):
        here = (at >= low) & (at < low + 4096)
        block = np.zeros((len(sets), min(4096, len(shared) - low)), dtype=np.float32)
        block[owner[here], at[here] - low] = 1
        out += block @ block.T
    return out


def _roots(linked: np.ndarray) -> np.ndarray:
    """The least member of each member's component."""
    root = np.full(len(linked), -1)
    for i in range(len(linked)):
        if root[i] < 0:
            stack = [i]
            root[i] = i
            while stack:
                for j in np.flatnonzero(linked[stack.pop()] & (root < 0)):
                    root[j] = i
                    stack.append(j)
    return root


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """True similarities in a leaf: links of each member and the root of its component."""
    schema = pa.schema([("set_key", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])
    out = []
    for rows in _groups(batches, "leaf"):
        rows.sort(key=lambda r: r["set_key"])
        place = [r["place"] for r in rows]
        bits = np.stack([np.frombuffer(r["partners"], dtype=np.uint8) for r in rows])
        pairs = np.unpackbits(bits, axis=1)[:, place].astype(bool)
        sets = [shingle_set(r["words"].view(np.uint64)) for r in rows]
        size = np.array([len(s) for s in sets], dtype=np.float64)
        both = common_tokens(sets)
        linked = pairs & (both >= THRESHOLD * (size[:, None] + size - both) - 1e-9)
        copies = np.array([r["copies"] for r in rows], dtype=np.int64)
        links, root = linked @ copies, _roots(linked)
        for i in np.flatnonzero(linked.any(axis=1)):
            out.append({"set_key": rows[i]["set_key"], "root": rows[root[i]]["set_key"], "links": int(links[i])})
        if len(out) > 5000:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def components(edges: DataFrame) -> DataFrame:
    """``node`` and the least node of its component as ``label``, for edges (a, b).

    Labels spread along edges and jump to their label's label, until none changes.
    """
    both = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        after = saved(
            labels.join(near, "node")
            .join(jump, "label", "left")
            .select("node", F.least("label", "near", "far").alias("label"), F.col("label").alias("before"))
        )
        labels = after.select("node", "label")
        if not after.filter("label <> before").take(1):
            return labels


def _classified(docs: DataFrame, text: str, key: str, kept: list[str]) -> DataFrame:
    """``_0``, ``_1``, ... for the ``kept`` columns; ``key``, ``text_key``, ``label`` (none without words), ``class_id``, ``n_links``."""
    python_tasks(docs.sparkSession)
    body = docs.select(
        *[F.col(c).alias(f"_{i}") for i, c in enumerate(kept)],
        F.col(key).cast("long").alias("key"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"),
        _hashed_words(text).alias("_words"),
    )
    schema = body.select(
        *[c for c in body.columns if c != "_words"],
        F.lit(None).cast("long").alias("set_key"),
        F.lit(None).cast("array<int>").alias("coordinates"),
    ).schema
    rows = saved(body.mapInArrow(_embed, schema))
    sets = saved(
        rows.filter("set_key IS NOT NULL")
        .groupBy("set_key")
        .agg(
            F.count("*").alias("copies"),
            F.min("key").alias("first"),
            F.min("text_key").alias("text_key"),
            F.min("coordinates").alias("coordinates"),
        )
    )
    leaves = saved(_leaves(sets))
    lists = leaves.groupBy("set_key").agg(F.collect_set("bucket").alias("buckets"))
    members = leaves.join(
        lists.join(sets.select("set_key", "coordinates"), "set_key"), "set_key"
    )
    pending = saved(
        members.repartition("leaf")
        .sortWithinPartitions("leaf", "set_key")
        .mapInArrow(_pending, "leaf long, set_key long, place int, partners binary")
    )
    wanted = pending.join(sets.select("set_key", "text_key", "copies"), "set_key")
    texts = docs.select(
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"), F.col(text).alias("text")
    )
    needed = wanted.select("text_key").distinct()
    fetched = texts.join(needed, "text_key", "left_semi").dropDuplicates(["text_key"])
    verified = saved(
        wanted.join(fetched, "text_key")
        .repartition("leaf")
        .select("leaf", "set_key", "place", "partners", "copies", _hashed_words("text").alias("words"))
        .sortWithinPartitions("leaf")
        .mapInArrow(_verify, "set_key long, root long, links long")
    )
    edges = verified.filter("set_key <> root").select(
        F.col("set_key").alias("a"), F.col("root").alias("b")
    )
    labels = components(edges)
    linked = verified.groupBy("set_key").agg(F.sum("links").alias("links"))
    classes = (
        sets.join(labels.withColumnRenamed("node", "set_key"), "set_key", "left")
        .withColumn("label", F.coalesce("label", "set_key"))
        .join(linked, "set_key", "left")
        .select("set_key", "label", "first", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    names = classes.groupBy("label").agg(F.min("first").alias("class_id"))
    named = classes.join(names, "label").select("set_key", "label", "class_id", "n_links")
    return rows.join(named, "set_key", "left").select(
        *[f"_{i}" for i in range(len(kept))],
        "key",
        "text_key",
        "label",
        F.coalesce("class_id", "key").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )

def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without the text, with ``class_id`` and ``n_links``.

    Documents with a Jaccard similarity of 0.8 or more on shingles of five
    words are linked; linked documents are of one class, named by its least
    ``key``.  ``n_links`` counts the other documents linked to a document,
    copies included, in groups of any size.  Links are found at random: a pair at 0.8 is met
    with a probability of 0.996, a closer one more surely; what is reported is verified.  Texts of
    fewer than five words are one shingle; NULL and wordless texts are alike to
    nothing and have the class of their own key.  Repeated rows are copies.  Columns
    of the names added are replaced; an empty table gives none.
    """
    kept = [c for c in docs.columns if c not in (text, "class_id", "n_links")]
    return _classified(docs, text, key, kept).select(
        *[F.col(f"_{i}").alias(c) for i, c in enumerate(kept)], "class_id", "n_links"
    )


def first_of_class(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each class: one of the least key, NULL after all others.

    Exact and near copies are of one class whatever their keys, so of rows repeated under a
    key, or with NULL keys, one stays as well; of several that are equal in key
    and text it is any.  NULL and wordless texts are alike to nothing and all stay.  Columns
    stay as they are; an empty table gives none.
    """
    classes = _classified(docs.select(key, text), text, key, [])
    rank = F.struct(F.col("key").isNull().alias("none"), "key", "text_key", "n")
    first = saved(
        classes.filter("label IS NOT NULL")
        .groupBy("label", "key", "text_key")
        .agg(F.count("*").alias("n"))
        .groupBy("label")
        .agg(F.min(rank).alias("first"))
        .select(F.col("first.key").alias("_key"), F.col("first.text_key").alias("_text_key"), (F.col("first.n") > 1).alias("_many"))
    )
    keyed = docs.withColumn("_words", F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)) > 0)
    same = F.col(key).cast("long").eqNullSafe(first["_key"]) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == first["_text_key"])
    kept = keyed.filter("_words").join(first, same)
    several = kept.filter("_many").dropDuplicates(["_key", "_text_key"])
    parts = keyed.filter("NOT _words"), kept.filter("NOT _many"), several
    return parts[0].select(*docs.columns).unionByName(parts[1].select(*docs.columns)).unionByName(parts[2].select(*docs.columns))
