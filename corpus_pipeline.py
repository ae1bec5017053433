"""A training corpus from the raw documents, in five stages.

Each stage takes all that its predecessor kept, and each is written as Parquet
and read again before the next one, so a lost executor costs one stage at most.
All but the last return the columns of ``documents``.

In every stage columns that ``documents`` has besides its own pass through, whatever
their names, and an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondera.llm import chosen_path, curriculum_mix, decontamination, line_frequency, packing
from sondera.llm.common import saved, table, written_order


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines above the limit.

    NULL and empty texts fail; NULL sources are a host of their own; repeated rows are judged each.
    ``n_chars`` follows the text where a line went.
    """
    judged = line_frequency.quality_rules(docs).filter("kept")
    cleaned = line_frequency.without_lines(judged)
    changed = F.size("removed_lines") > 0
    size = F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", size).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the least id.

    Of rows repeated under an id, or copies with NULL ids, one stays as well.  Texts without a
    word are alike to nothing and stay.
    """
    return chosen_path.first_of_class(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; NULL and empty texts hold none."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order.

    Texts without a word are not taken; NULL ids and sources count as values like others.
    """
    return curriculum_mix.training_order(docs, curriculum_mix.mix(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of token ids, shard by shard in training order.

    The mix returns the columns of documents alone, range-sorted; so its order is that of
    the files that it was written to.  NULL ids stay NULL; texts without tokens have no segment.
    """
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    placed = docs.select("doc_id", "text", *written_order())
    return packing.pack_tokens(placed, path, public_tokenizers.PATTERN, order=("_part", "_file", "_at"))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", pack),
]

#: Token ids and shingle joins are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
