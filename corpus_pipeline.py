"""From raw documents to packed training sequences, one written table a stage.

1. Quality rules: rejected documents go, failing lines go from the others.
2. Line deduplication: lines that an earlier line repeats go, and documents that lose all their words with them.
3. Near duplicates: of each group, one row with the smallest doc_id stays; rows without a doc_id all stay.
4. Decontamination: documents with a passage of the benchmark go.
5. Packing: every piece of every document that is left gets its place in a training sequence.

All stages but the last return the columns of documents, n_chars being that of the text as it then is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encore.llm import decontaminate, hyperminhash, lines, packing, quality
from encore.sources.stage import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(table: DataFrame) -> DataFrame:
    return table.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(quality.cleaned(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = _documents(lines.without_repeated_lines(docs))
    return left.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = staged(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    named = rows.filter("doc_id is not null")
    groups = hyperminhash.near_duplicates(named, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id")
    first = groups.join(named.select("_row", "doc_id"), "_row").groupBy("component_id").agg(
        F.min(F.struct("doc_id", "_row")).alias("first"))
    kept = first.select("first._row").union(rows.filter("doc_id is null").select("_row"))
    return rows.join(kept, "_row", "left_semi").select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL says the alignment and the packing; tests/llm holds the run against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
