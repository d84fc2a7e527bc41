"""Registered queries of the pipeline operators; each takes (spark, folder) and reads a whole table of the folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from encore.llm import (
    alignment, archives, decontaminate, extraction, hyperminhash, lines, packing, personal, quality, repair, shards,
    toolcalls, worlds)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_zip_archives(spark: SparkSession, folder: str) -> DataFrame:
    return archives.archived(table(spark, folder, "pages"))


def op2_tool_call_linking(spark: SparkSession, folder: str) -> DataFrame:
    messages = toolcalls.as_messages(table(spark, folder, "conversations"))
    return toolcalls.linked_calls(messages, toolcalls.tool_table(spark))


def op3_weak_supervision(spark: SparkSession, folder: str) -> DataFrame:
    return personal.private_spans(table(spark, folder, "documents"))


def op4_sum_of_squares(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_documents(table(spark, folder, "documents"))


def op5_seed_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op6_line_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(table(spark, folder, "documents"))


def op7_segment_join(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_classes(table(spark, folder, "documents"))


def op8_tree_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.main_texts(table(spark, folder, "pages"))


def op9_training_order(spark: SparkSession, folder: str) -> DataFrame:
    return shards.materialised(table(spark, folder, "documents"))


def op10_hyperminhash(spark: SparkSession, folder: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, folder, "documents"))


def op11_pair_bitmaps(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.aligned_documents(table(spark, folder, "documents"))


def op12_small_worlds(spark: SparkSession, folder: str) -> DataFrame:
    return worlds.near_vectors(table(spark, folder, "embeddings"))


def op13_path_ranking(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repaired_conversations(table(spark, folder, "conversations"))


QUERIES = {
    "op1_zip_archives": op1_zip_archives,
    "op2_tool_call_linking": op2_tool_call_linking,
    "op3_weak_supervision": op3_weak_supervision,
    "op4_sum_of_squares": op4_sum_of_squares,
    "op5_seed_alignment": op5_seed_alignment,
    "op6_line_rules": op6_line_rules,
    "op7_segment_join": op7_segment_join,
    "op8_tree_scoring": op8_tree_scoring,
    "op9_training_order": op9_training_order,
    "op10_hyperminhash": op10_hyperminhash,
    "op11_pair_bitmaps": op11_pair_bitmaps,
    "op12_small_worlds": op12_small_worlds,
    "op13_path_ranking": op13_path_ranking,
}
