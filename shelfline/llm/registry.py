"""Queries and SQL of the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm import byte_bpe, language, lines, minhash, nearest, packing, quality, sql, substring, tool_calls, vectors
from shelfline.llm.common import load


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op2_cover_tree_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(load(spark, sf_dir, "embeddings"))


def op3_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.from_turns(load(spark, sf_dir, "conversations"))
    out = tool_calls.link(calls, results, tool_calls.TURN_SCHEMAS)
    return out.select(F.col("conv").alias("conv_id"), "call_id", "place", "status", "level", "valid", F.size("errors").alias("n_errors"), F.sha2(F.coalesce("json", F.lit("")), 256).alias("json_sha256"))


def op4_difference_cover_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(load(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.digest(load(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_collision_counting_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings")
    return nearest.nearest(rows, rows.where("vec_id % 20 = 0"))


def op7_deletion_neighbourhood_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = lines.dedup(load(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_super_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(load(spark, sf_dir, "documents"), width=4, percent=80)


def op9_mixture_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return language.identify(docs, language.learn(docs)).select("doc_id", "held_out", "lang_pred", "score")


def op10_positive_unlabelled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


QUERIES = (
    op1_cost_balanced_packing, op2_cover_tree_near_vectors, op3_tool_call_linking, op4_difference_cover_substring_dedup, op5_byte_bpe,
    op6_collision_counting_neighbours, op7_deletion_neighbourhood_line_dedup, op8_super_minhash_near_dedup, op9_mixture_language_id, op10_positive_unlabelled_quality,
)
ORACLES = {
    op2_cover_tree_near_vectors: sql.OP2,
    op3_tool_call_linking: sql.OP3,
    op4_difference_cover_substring_dedup: sql.OP4,
    op7_deletion_neighbourhood_line_dedup: sql.OP7,
    op8_super_minhash_near_dedup: sql.OP8,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: text for f, text in ORACLES.items()}
