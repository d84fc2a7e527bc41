"""Restricting tables to chosen ids, and repeatable samples."""

from pyspark.sql import DataFrame, Window as W, functions as F

from encore.functions.ids import in_hash_sample


def in_scope(table: DataFrame, ids: DataFrame, key: str = "pid") -> DataFrame:
    """Rows whose key appears in `ids`. A semi join, so the id list may be of any length."""
    return table.join(ids.select(key), key, "left_semi")


def hash_sample(table: DataFrame, key: str, fraction: float = 0.1) -> DataFrame:
    return table.filter(in_hash_sample(F.col(key).cast("string"), fraction))


def candidate_pool(tracks: DataFrame, seeds: DataFrame, fraction: float = 0.1) -> DataFrame:
    """A sample of the catalogue with the seed tracks added, every track once."""
    sampled = hash_sample(tracks, "tid", fraction)
    return sampled.unionByName(in_scope(tracks, seeds, "tid")).dropDuplicates(["tid"])


def exact_sample(table: DataFrame, key: str, size: int, by: list[str] | None = None) -> DataFrame:
    """`size` rows of the table, or of each group of `by`: those whose key has the smallest md5, ties by the key.

    Which rows these are depends on the keys alone. Tasks keep `size` rows of a group at most before anything is shuffled.
    """
    if size < 0:
        raise ValueError("size must not be negative")
    place = [F.md5(F.col(key).cast("string")), F.col(key)]
    if not by:
        return table.orderBy(*place).limit(size)
    return table.withColumn("_nth", F.row_number().over(W.partitionBy(*by).orderBy(*place))).filter(
        F.col("_nth") <= size).drop("_nth")


def merged_samples(left: DataFrame, right: DataFrame, key: str, size: int, by: list[str] | None = None) -> DataFrame:
    """The sample of two tables together, from their samples of the same size; a key in both counts once."""
    return exact_sample(left.unionByName(right).dropDuplicates([key, *(by or [])]), key, size, by)
