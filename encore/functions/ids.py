"""Identifiers and samples that repeat exactly from run to run."""

from pyspark.sql import Column, functions as F


def stable_id(value: Column) -> Column:
    """64-bit id of a text: the first 15 hex digits of its md5, so it never depends on partitioning."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("bigint")


def in_hash_sample(key: Column, fraction: float) -> Column:
    """True for about `fraction` of the keys, always the same ones."""
    if not 0.0 <= fraction <= 1.0:
        raise ValueError("fraction must lie in [0, 1]")
    if fraction == 1.0:
        return F.lit(True)
    bound = format(round(fraction * 2**32), "08x")
    return F.substring(F.md5(key), 1, 8) < bound
