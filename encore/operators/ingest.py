"""Nested playlist records to flat tables."""

from pyspark.sql import DataFrame, functions as F

from encore import schemas
from encore.functions.ids import stable_id

METADATA = ["track_name", "album_name", "album_uri", "artist_name", "artist_uri", "duration_ms"]


def playlists(raw: DataFrame) -> DataFrame:
    """One row per playlist of the slices."""
    flat = raw.select(F.explode("playlists").alias("p")).select("p.*")
    return flat.withColumn("collaborative", F.col("collaborative").cast("boolean")).select(schemas.PLAYLIST_COLUMNS)


def challenge_playlists(raw: DataFrame) -> DataFrame:
    return raw.select(F.explode("playlists").alias("p")).select("p.*").select(schemas.CHALLENGE_COLUMNS)


def entries(raw: DataFrame) -> DataFrame:
    """One row per track entry with its playlist id. Playlists without tracks give no row."""
    return (
        raw.select(F.explode("playlists").alias("p"))
        .select(F.col("p.pid").alias("pid"), F.explode("p.tracks").alias("t"))
        .select("pid", "t.*"))


def catalogue(track_entries: DataFrame) -> DataFrame:
    """One row per track uri. Of several spellings the smallest one, field by field, is kept."""
    return (
        track_entries.filter(F.col("track_uri").isNotNull())
        .groupBy("track_uri").agg(F.min(F.struct(*METADATA)).alias("m"))
        .select(stable_id(F.col("track_uri")).alias("tid"), "track_uri", "m.*")
        .select(schemas.CATALOGUE_COLUMNS))


def membership(track_entries: DataFrame, tracks: DataFrame) -> DataFrame:
    """Entries with the catalogue's metadata. No broadcast hint: the catalogue grows with the data."""
    return (
        track_entries.select("pid", "pos", "track_uri").join(tracks, "track_uri", "left")
        .select(schemas.MEMBERSHIP_COLUMNS))


def conflicting_uris(track_entries: DataFrame) -> DataFrame:
    """Track uris that come with more than one spelling of their metadata."""
    return (
        track_entries.select("track_uri", *METADATA).distinct()
        .groupBy("track_uri").agg(F.count(F.lit(1)).alias("n_spellings"))
        .filter(F.col("n_spellings") > 1))


def id_collisions(tracks: DataFrame) -> DataFrame:
    """Track ids shared by several uris; must be empty."""
    return (tracks.groupBy("tid").agg(F.count_distinct("track_uri").alias("n_uris"))
            .filter(F.col("n_uris") > 1))
