"""Documents that hold a benchmark item, by fingerprints of item-sized windows.

Everything runs as column expressions, aggregations and joins.

1. A window that shares no shingle of five words with the benchmark has
   similarity 0 with every item.  So only windows are built that share one,
   placed so that the shingle lies where it lies in the item, and as long as
   the item.  Windows of the same words are handled once.
2. Windows and items get a SimHash of 64 bits over weighted shingles.
3. The bits form four blocks of 16.  Two fingerprints that differ in at most
   ``RADIUS`` bits differ in at most a fourth of that in some block; so each
   item is filed, block by block, under all values within that distance, and a
   lookup by block value and length finds every fingerprint within the radius.
   Windows at similarity 0.8 differ in about 10 bits; one in some hundreds of those
   from 0.80 to 0.85 differs in more than the radius of 19.
4. Pairs found are compared exactly: sum of the lesser over sum of the greater
   weights.  A shingle weighs its letters times its occurrences.

With ``exact`` a second search adds the pairs that the radius misses.  A window at
the limit holds that share of the item's weight; so it holds one of any
shingles that weigh more than the rest, and the rarest such shingles find it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondera.llm.common import let, saved

SHINGLE = 5
BLOCKS, BLOCK_BITS, RADIUS = 4, 16, 19
#: More shingles, or hits, than this are joined by a shuffle instead of a broadcast (24 and 40 bytes each).
BROADCAST_SHINGLES, BROADCAST_HITS = 1_000_000, 300_000
#: Block values that differ from 0 in few enough bits.
NEAR = [x for x in range(1 << BLOCK_BITS) if x.bit_count() <= RADIUS // BLOCKS]


def normal_words(text: Column | str) -> Column:
    """Words in lower case, letters and digits only."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def _places(words: Column, one) -> Column:
    """``one`` of the five at each place of ``words``."""
    return F.transform(
        F.sequence(F.lit(0), F.size(words) - SHINGLE),
        lambda i: one([F.get(words, i + k) for k in range(SHINGLE)]),
    )


def parts(words: Column) -> Column:
    """Hash and length of each word."""
    return F.transform(
        words, lambda w: F.struct(F.xxhash64(w).alias("h"), F.char_length(w).alias("n"))
    )


def shingles(words: Column) -> Column:
    """Hash and weight of the five words at each place of ``parts``; none for fewer words."""

    def one(five: list[Column]) -> Column:
        letters = five[0]["n"]
        for x in five[1:]:
            letters = letters + x["n"]
        return F.struct(
            F.xxhash64(*[x["h"] for x in five]).alias("h"), letters.cast("long").alias("w")
        )

    none = F.array().cast("array<struct<h:bigint,w:bigint>>")
    return let(words, lambda p: F.when(F.size(p) >= SHINGLE, _places(p, one)).otherwise(none))


def shingle_hashes(words: Column) -> Column:
    """The hashes of ``shingles`` alone, from the words themselves."""
    none = F.array().cast("array<bigint>")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    one = lambda five: F.xxhash64(*five)
    return let(hashes, lambda h: F.when(F.size(h) >= SHINGLE, _places(h, one)).otherwise(none))


def simhash(weighted: str) -> Column:
    """64 signs, one for each bit of the hashes, as a long; ties count as 0."""
    total = (
        f"aggregate({weighted}, 0L, (_sum, _s) -> "
        "_sum + if(shiftright(_s.h, _bit) & 1L = 1L, _s.w, -_s.w))"
    )
    bits = f"transform(sequence(0, 63), _bit -> if({total} > 0L, shiftleft(1L, _bit), 0L))"
    return F.expr(f"aggregate({bits}, 0L, (_sum, _s) -> _sum | _s)")


def counted(df: DataFrame, key: str, shingles: str) -> DataFrame:
    """``key``, ``h``, ``w``, ``times``: the distinct shingles of each row, with their numbers."""
    return df.select(key, F.inline(shingles)).groupBy(key, "h", "w").agg(F.count("*").alias("times"))


def similar(pairs: DataFrame, contents: DataFrame, bench: DataFrame, least: float) -> DataFrame:
    """``pairs`` (content, item) with a ``similarity`` of ``least`` or more: weighted Jaccard, repeats counted.

    Shingles meet in joins, so the cost of a pair grows with its length and no faster.
    """
    asked = contents.join(pairs.select("content").distinct(), "content", "left_semi")
    own = counted(asked, "content", "own")
    theirs = counted(bench, "item", "shingles").select("item", "h", F.col("times").alias("item_times"))
    both = (
        pairs.join(own, "content")
        .join(theirs, ["item", "h"])
        .groupBy("content", "item")
        .agg(F.sum(F.col("w") * F.least("times", "item_times")).alias("both"))
    )
    share = F.col("both").cast("double") / (F.col("own_weight") + F.col("item_weight") - F.col("both"))
    return (
        both.join(asked.select("content", _weight("own").alias("own_weight")), "content")
        .join(bench.select("item", "item_id", "n", "item_weight"), "item")
        .withColumn("similarity", share)
        .filter(F.col("similarity") >= least)
        .select("content", "item_id", "n", "similarity")
    )


def _blocks(fingerprint: str) -> Column:
    value = lambda b: F.shiftright(F.col(fingerprint), b * BLOCK_BITS).bitwiseAND((1 << BLOCK_BITS) - 1)
    return F.array(
        *[F.struct(F.lit(b).alias("b"), value(b).cast("int").alias("v")) for b in range(BLOCKS)]
    )


def text_key(text: Column | str) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit(1), text).alias("_k2")]


def _weight(weighted: str) -> Column:
    return F.expr(f"aggregate({weighted}, 0L, (_sum, _s) -> _sum + _s.w)")


def rare_shingles(bench: DataFrame, least: float) -> DataFrame:
    """``item, n, h, item_weight``: the shingles, rare in all items, of which a window at ``least`` holds one."""
    own = (
        bench.select("item", "n", "item_weight", F.inline("shingles"))
        .groupBy("item", "n", "item_weight", "h")
        .agg(F.sum("w").alias("w"))
    )
    items = own.groupBy("h").agg(F.count("*").alias("items"))
    before = Window.partitionBy("item").orderBy("items", "h").rowsBetween(Window.unboundedPreceding, -1)
    return (
        own.join(items, "h")
        .withColumn("before", F.coalesce(F.sum("w").over(before), F.lit(0)))
        .filter(F.col("before") <= (1 - least) * F.col("item_weight") + 1e-9)
        .select("item", "n", "h", "item_weight")
    )


def within_radius(contents: DataFrame, bench: DataFrame) -> DataFrame:
    """``content, item``: all whose fingerprints differ in at most RADIUS bits, of the same length."""
    near = F.explode(F.transform(F.lit(NEAR), lambda x: x.bitwiseXOR(F.col("block.v"))))
    filed = bench.withColumn("block", F.explode(_blocks("item_print"))).select(
        "item", "n", "item_print", "block.b", near.alias("v")
    )
    # thousands of values for each item, more than its file's size tells: never broadcast
    return (
        contents.withColumn("block", F.explode(_blocks("own_print")))
        .select("content", "n", "own_print", "block.b", "block.v")
        .join(filed.hint("merge"), ["n", "b", "v"])
        .filter(F.bit_count(F.col("own_print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
        .select("content", "item")
        .distinct()
    )


def sharing_rare(contents: DataFrame, bench: DataFrame, least: float) -> DataFrame:
    """``content, item``: all that share a rare shingle and whose weights allow ``least``; none at ``least`` is missed."""
    weight, item_weight = F.col("own_weight"), F.col("item_weight")
    return (
        contents.select("content", "n", _weight("own").alias("own_weight"), F.explode("own.h").alias("h"))
        .join(rare_shingles(bench, least), ["n", "h"])
        .filter(F.least(weight, item_weight) >= least * F.greatest(weight, item_weight) - 1e-6)
        .select("content", "item")
        .distinct()
    )


def _windows(body: DataFrame, index: DataFrame) -> DataFrame:
    """``_k1, _k2, start, n, window`` (words): windows that share a shingle with the index.

    ``index`` has ``h``, its place ``q`` and the item's length ``n``.  Shingles
    travel alone, without the words of their text, so the cost of a text grows
    with its length and no faster; texts with hits are read once more.  The
    index, and the list of hits, are broadcast up to a size, and joined by a
    shuffle beyond.
    """
    small = index.count() <= BROADCAST_SHINGLES
    hits = saved(
        body.select("_k1", "_k2", F.posexplode(shingle_hashes(normal_words("_text"))).alias("p", "h"))
        .join(F.broadcast(index) if small else index, "h")
        .select("_k1", "_k2", (F.col("p") - F.col("q")).alias("start"), "n")
        .distinct()
    )
    few = hits.count() <= BROADCAST_HITS
    places = hits.groupBy("_k1", "_k2").agg(F.collect_set(F.struct("start", "n")).alias("places"))

    def cut(words: Column, at: Column) -> Column:
        first, short = F.greatest(at["start"], F.lit(0)) + 1, F.least(at["start"], F.lit(0))
        window = F.slice(words, first, at["n"] + short)
        return F.struct(at["start"].alias("start"), at["n"].alias("n"), window.alias("window"))

    windows = let(
        normal_words("_text"), lambda w: F.transform(F.col("places"), lambda at: cut(w, at))
    )
    return (
        body.join(F.broadcast(places) if few else places, ["_k1", "_k2"])
        .dropDuplicates(["_k1", "_k2"])
        .select("_k1", "_k2", windows.alias("windows"))
        .select("_k1", "_k2", F.inline("windows"))
    )


def matches(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    least: float = 0.8,
    item_key: str = "item_id",
    item_text: str = "text",
    exact: bool = False,
) -> DataFrame:
    """Items in texts: ``_k1, _k2`` (see ``text_key``), ``item_id``, ``start_word``, ``similarity``.

    One row per distinct text and item, for the window of the greatest
    similarity (the first of several).  A window at the edge of a text is as
    long as the text allows.
    """
    name = F.col(item_key)
    bench = saved(
        items.select(
            name.alias("item_id"),
            F.xxhash64(F.coalesce(name.cast("string"), F.lit("")), name.isNull(), item_text).alias("item"),
            shingles(parts(normal_words(item_text))).alias("shingles"),
        )
        .filter(F.size("shingles") > 0)
        .dropDuplicates(["item"])
        .withColumn("n", F.size("shingles") + SHINGLE - 1)
        .withColumn("item_weight", _weight("shingles"))
        .withColumn("item_print", simhash("shingles"))
    )
    index = saved(
        bench.select("n", F.posexplode("shingles"))
        .select(F.col("col.h").alias("h"), F.col("pos").alias("q"), "n")
        .distinct()
    )
    body = docs.select(F.col(text).alias("_text"), *text_key(text)).filter("_text IS NOT NULL")
    windows = saved(
        _windows(body, index).withColumn("content", F.xxhash64("window", "n"))
    )
    contents = saved(
        windows.dropDuplicates(["content"])
        .select("content", "n", shingles(parts(F.col("window"))).alias("own"))
        .filter(F.size("own") > 0)
        .withColumn("own_print", simhash("own"))
    )
    pairs = within_radius(contents, bench)
    if exact:
        pairs = pairs.unionByName(sharing_rare(contents, bench, least)).distinct()
    found = similar(saved(pairs), contents, bench, least)
    place = F.greatest("start", F.lit(0)).cast("long")
    return (
        windows.select("_k1", "_k2", "start", "n", "content")
        .join(found, ["content", "n"])
        .groupBy("_k1", "_k2", "item_id")
        .agg(F.max(F.struct("similarity", (-place).alias("back"))).alias("best"))
        .select(
            "_k1", "_k2", "item_id", (-F.col("best.back")).alias("start_word"), "best.similarity"
        )
    )


def contaminated(
    docs: DataFrame, items: DataFrame, text: str = "text", least: float = 0.8, exact: bool = False
) -> DataFrame:
    """``docs`` without the text, one row for each item that a document holds.

    Added are ``item_id``, ``start_word`` (of the window, counted in normalised
    words) and ``similarity``.  Clean documents have no row.  NULL and empty
    texts are clean; items of fewer than five words, which would hit by chance,
    are not searched; repeated rows are reported each; columns of the names
    added are replaced; an empty table on either side gives none.  ``exact`` also finds
    the few windows near the limit that the radius misses.
    """
    added = ("item_id", "start_word", "similarity")
    rows = docs.select(*[c for c in docs.columns if c not in (*added, text)], *text_key(text))
    found = matches(docs, items, text, least, exact=exact)
    return rows.join(found, ["_k1", "_k2"]).drop("_k1", "_k2")


def clean(
    docs: DataFrame, items: DataFrame, text: str = "text", least: float = 0.8, exact: bool = False
) -> DataFrame:
    """``docs`` without the contaminated ones; columns stay as they are.

    NULL and empty texts stay, repeated rows stay or go together, and so does every row of
    the same text; an empty table of items takes nothing away, an empty one of documents gives none.
    """
    found = matches(docs, items, text, least, exact=exact).select("_k1", "_k2").distinct()
    return docs.select("*", *text_key(text)).join(found, ["_k1", "_k2"], "left_anti").drop("_k1", "_k2")
