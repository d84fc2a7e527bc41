"""Nested files to the five tables on disk."""

from pyspark.sql import SparkSession, functions as F

from encore.operators import ingest
from encore.sources.files import (
    CORRUPT, SLICE_PATTERN, Tables, read_challenge, read_slices, read_table, read_tables, write_table,
)
from encore.sources.large_slices import read_large_slices

REJECTS = "rejects"


def _kept(spark: SparkSession, raw, path: str):
    """The parsed rows of files, and (file, _corrupt_record) of those that did not parse, from one reading."""
    file = F.col("file") if "file" in raw.columns else F.input_file_name().alias("file")
    raw.select("playlists", CORRUPT, file).write.mode("overwrite").parquet(path)
    held = spark.read.parquet(path)
    return held.filter(F.col(CORRUPT).isNull()).select("playlists"), held.filter(F.col(CORRUPT).isNotNull()).select(
        "file", CORRUPT)


def build_tables(spark: SparkSession, slice_folder: str, challenge_path: str, output: str,
                 pattern: str = SLICE_PATTERN, skip_rejects: bool = False, large_files: bool = False) -> Tables:
    """Parse every file once, keep the parsed rows under `output`, then derive and write the five tables.

    The catalogue covers training and challenge entries, so that every challenge seed resolves, and is computed once:
    memberships join the written table. Files that do not parse are written to `output`/rejects and fail the build,
    unless `skip_rejects` says to go on without them. Two uris with one id fail it in any case. `large_files` reads each slice
    file by several tasks, and a playlist that does not parse is then a reject by itself.
    """
    staging = output.rstrip("/") + "/staging"
    read = read_large_slices if large_files else read_slices
    slices, bad_slices = _kept(spark, read(spark, slice_folder, pattern), f"{staging}/slices")
    challenge, bad_challenge = _kept(spark, read_challenge(spark, challenge_path), f"{staging}/challenge")
    rejects = f"{output.rstrip('/')}/{REJECTS}"
    bad_slices.union(bad_challenge).write.mode("overwrite").parquet(rejects)
    n_rejects = spark.read.parquet(rejects).count()
    if n_rejects and not skip_rejects:
        raise ValueError(f"{n_rejects} files did not parse, see {rejects}")

    train, seeds = ingest.entries(slices), ingest.entries(challenge)
    write_table(ingest.catalogue(train.unionByName(seeds)), "tracks", output)
    tracks = read_table(spark, "tracks", output)
    if not ingest.id_collisions(tracks).isEmpty():
        raise ValueError("two track uris have the same id")
    write_table(ingest.playlists(slices), "playlists_info", output)
    write_table(ingest.membership(train, tracks), "playlists_tracks", output)
    write_table(ingest.challenge_playlists(challenge), "playlists_test_info", output)
    write_table(ingest.membership(seeds, tracks), "playlists_test", output)
    return read_tables(spark, output)
