"""Quality rules: repeats within a text, and lines that many documents of a host share.

Everything runs as column expressions, aggregations and joins.

Lines are normalised (case, digits, punctuation, blanks) and hashed with their
host.  A line is above the limit if more than ``most_documents`` distinct
documents of the host hold it.  Copies of a document are not distinct: documents
of which all lines are equal when normalised count once, so the lines of an article
that was copied a thousand times are not taken for boilerplate.  Texts that
differ in a word are two documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondera.llm.common import WORD, let, saved, words

SYMBOLS = "[#*$%&|<>]"
WINDOW = 8


def _repeated_words(hashes: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that occur twice or more; first ones included."""

    def places(pairs: Column) -> Column:
        same = lambda p, i: (F.get(pairs, i - 1)["h"] == p["h"]) | (F.get(pairs, i + 1)["h"] == p["h"])
        return F.sort_array(
            F.filter(F.transform(pairs, lambda p, i: F.when(same(p, i), p["i"])), F.isnotnull)
        )

    def covered(at: Column) -> Column:
        own = F.transform(
            at, lambda p, i: F.coalesce(F.least(F.lit(WINDOW), F.get(at, i + 1) - p), F.lit(WINDOW))
        )
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, b: a + b)

    def count(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(
            F.size(F.array_distinct(windows)) < F.size(windows), let(let(pairs, places), covered)
        ).otherwise(F.lit(0).cast("long"))

    def joined(h: Column, gap: int) -> Column:
        """Each hash with the one ``gap`` places on."""
        n = F.size(h) - gap
        return F.zip_with(F.slice(h, 1, n), F.slice(h, 1 + gap, n), lambda a, b: F.xxhash64(a, b))

    # 2, 4 and then 8 words, each from two halves
    windows = let(joined(hashes, 1), lambda two: let(joined(two, 2), lambda four: joined(four, WINDOW // 2)))
    return F.when(F.size(hashes) > WINDOW, let(windows, count)).otherwise(F.lit(0).cast("long"))


def _normal(line: Column) -> Column:
    letters = F.regexp_replace(F.lower(line), r"[0-9]+", "0")
    return F.trim(F.regexp_replace(letters, r"[^\p{L}\p{N}]+", " "))


def base_measures(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """``docs`` with the measures of each text, and with its lines and its document's key (``_document``)."""
    body = F.coalesce(F.col(text), F.lit(""))
    own = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))
    key = F.xxhash64(F.coalesce(F.col(host), F.lit("")), F.col(host).isNull(), F.lit(0))

    def measures(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            let(F.transform(w, lambda x: F.xxhash64(x)), _repeated_words).alias("n_repeat_words"),
        )

    def lines(x: Column) -> Column:
        return F.struct(
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.transform(
                x,
                lambda line: F.struct(
                    F.xxhash64(key, _normal(line)).alias("key"),
                    F.regexp_count(line, F.lit(WORD)).alias("words"),
                ),
            ).alias("_lines"),
        )

    return (
        docs.withColumn("_measures", let(words(body), measures))
        .withColumn("_split", let(own, lines))
        .select(
            *docs.columns,
            F.char_length(F.regexp_replace(body, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
            F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            "_measures.*",
            "_split.*",
            F.xxhash64("_split._lines.key").alias("_document"),
        )
    )


def frequent_lines(measured: DataFrame, most_documents: int) -> DataFrame:
    """Hashes of (host, line) that more distinct documents hold than the limit."""
    return (
        measured.select(F.explode(F.array_distinct("_lines.key")).alias("key"), "_document")
        .groupBy("key", "_document")
        .agg(F.lit(1).alias("one"))
        .groupBy("key")
        .agg(F.count("*").alias("documents"))
        .filter(F.col("documents") > most_documents)
        .select("key")
    )


_OWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    most_documents: int = 100,
    least_share: float = 0.3,
    keep_text: bool = True,
) -> DataFrame:
    """``docs`` with measures, ``base_failed``, ``removed_lines``, ``removed_words`` and ``kept``.

    ``kept`` is false for texts under 20 words, texts with over 30 % of the
    words in repeated windows, and depleted ones: less than ``least_share`` of
    the words is left when lines above the limit are removed.  A NULL text is
    an empty one (and fails); rows without a host form a host of their own;
    repeated rows are judged each, and count once as documents; columns of the
    same names are replaced; an empty table gives none.
    ``removed_lines`` has the hashes of the lines to remove, for ``without_lines``.
    With ``keep_text=False`` the result has no text, and less is written on the way.
    """
    added = {*_OWN, "removed_lines", "removed_words", "kept"}
    docs = docs.select(*[c for c in docs.columns if c not in added])
    measured = base_measures(docs, text, host).withColumn("_row", F.monotonically_increasing_id())
    measured = saved(measured if keep_text else measured.drop(text))
    removed = (
        measured.select("_row", F.explode("_lines").alias("line"))
        .join(frequent_lines(measured, most_documents), F.col("line.key") == F.col("key"))
        .groupBy("_row")
        .agg(F.sum("line.words").alias("removed_words"), F.collect_set("key").alias("removed_lines"))
    )
    n, repeated = F.col("n_words"), F.col("n_repeat_words")
    left = n - F.col("removed_words")
    return (
        measured.drop("_lines", "_document")
        .join(removed, "_row", "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
        .withColumn("removed_lines", F.coalesce("removed_lines", F.array().cast("array<long>")))
        .withColumn("base_failed", (n < 20) | (100 * repeated > 30 * n))
        .withColumn("kept", ~F.col("base_failed") & (left >= least_share * n))
        .drop("_row")
    )


def without_lines(judged: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The texts of ``quality_rules`` without the lines above the limit; others stay as they are.

    NULL and empty texts stay so, lines without a word stay, repeated rows are treated alike,
    an empty table stays empty.
    """
    key = F.xxhash64(F.coalesce(F.col(host), F.lit("")), F.col(host).isNull(), F.lit(0))
    stays = lambda x: ~F.array_contains("removed_lines", F.xxhash64(key, _normal(x)))
    left = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x: stays(x) | ~x.rlike(WORD)), "\n")
    return judged.withColumn(text, F.when(F.size("removed_lines") > 0, left).otherwise(F.col(text)))
