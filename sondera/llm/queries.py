"""One query for each corpus operator, over its whole table, and the SQL of those that SQL can say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondera.llm import (
    bond_negatives,
    bpe_counts,
    chat_windows,
    chosen_path,
    curriculum_mix,
    decontamination,
    language_id,
    line_frequency,
    packing,
    quality_model,
    spelling_variants,
    suffix_dedup,
    voronoi_join,
)
from sondera.llm.common import python_tasks, table
from sondera.llm.sql import SQL


def id_rest(key: str, parts: int) -> Column:
    """crc32 of an id's digits, modulo ``parts``: the fixed split into folds."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn(
        "held_out", F.coalesce(id_rest("doc_id", 3) == 1, F.lit(False))
    )
    model = language_id.fit(docs.filter("NOT held_out"))
    return language_id.predict(docs.select("doc_id", "held_out", "text"), model)


def op2_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = curriculum_mix.mix(docs).withColumn("first_position", F.get("positions", F.lit(0)))
    copies = F.explode(F.array_repeat(F.lit(True), F.col("rows").cast("int")))
    return (
        mixed.withColumn("_row", copies)
        .repartitionByRange("first_position", "doc_id")
        .sortWithinPartitions("first_position", "doc_id")
        .select("doc_id", "source", "size", "source_size", "target", "copies", "taken", "first_position")
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"))


def op4_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    # what the query returns is needed only, so the texts are not saved with the measures
    return line_frequency.quality_rules(docs, keep_text=False).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "removed_words",
        "kept",
    )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    python_tasks(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    outputs = {
        "n_words": F.col("n_words"),
        "n_removed": suffix_dedup.n_removed(),
        "kept_sha256": F.sha2(suffix_dedup.kept_text(), 256),
    }
    return suffix_dedup.without_repeats(docs, outputs)


def op6_bpe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))


def op7_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    text = r"\### Assistant: </turn> ok"
    fixture = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(text).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    count = bpe_counts.token_counter(spark, public_tokenizers.path("word_bpe_49k.json"))
    tokens = count(chat_windows.formatted_turn())
    return chat_windows.read_back(chat_windows.chat_windows(turns.unionByName(fixture), tokens))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.pack_tokens(docs, path, public_tokenizers.PATTERN)


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce(id_rest("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "text"
    )
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality_model.quality_scores(docs, labels, train="NOT held_out")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_voronoi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return voronoi_join.top_k(vectors.filter("vec_id % 50 = 0"), vectors, k=5)


def op13_bond_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return bond_negatives.hard_negatives(vectors, vectors.filter("vec_id % 50 = 0"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_curriculum_mix": op2_curriculum_mix,
    "op3_decontamination": op3_decontamination,
    "op4_line_frequency": op4_line_frequency,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_bpe_counts": op6_bpe_counts,
    "op7_chosen_path": op7_chosen_path,
    "op8_chat_windows": op8_chat_windows,
    "op9_packing": op9_packing,
    "op10_quality_model": op10_quality_model,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_voronoi_join": op12_voronoi_join,
    "op13_bond_negatives": op13_bond_negatives,
}
__all__ = ["QUERIES", "SQL"]
