"""Explicit schemas: nested playlist files and the five flat tables derived from them."""

from pyspark.sql import types as T

TRACK_ENTRY = T.StructType([
    T.StructField("pos", T.LongType()),
    T.StructField("track_uri", T.StringType()),
    T.StructField("track_name", T.StringType()),
    T.StructField("artist_uri", T.StringType()),
    T.StructField("artist_name", T.StringType()),
    T.StructField("album_uri", T.StringType()),
    T.StructField("album_name", T.StringType()),
    T.StructField("duration_ms", T.LongType()),
])

# `collaborative` arrives as the text "true"/"false" and is cast while flattening.
PLAYLIST = T.StructType([
    T.StructField("pid", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("collaborative", T.StringType()),
    T.StructField("modified_at", T.LongType()),
    T.StructField("num_artists", T.LongType()),
    T.StructField("num_albums", T.LongType()),
    T.StructField("num_tracks", T.LongType()),
    T.StructField("num_followers", T.LongType()),
    T.StructField("num_edits", T.LongType()),
    T.StructField("duration_ms", T.LongType()),
    T.StructField("tracks", T.ArrayType(TRACK_ENTRY)),
])

SLICE = T.StructType([
    T.StructField("info", T.StructType([
        T.StructField("slice", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("generated_on", T.StringType()),
    ])),
    T.StructField("playlists", T.ArrayType(PLAYLIST)),
])

CHALLENGE_PLAYLIST = T.StructType([
    T.StructField("pid", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("num_holdouts", T.LongType()),
    T.StructField("num_samples", T.LongType()),
    T.StructField("num_tracks", T.LongType()),
    T.StructField("tracks", T.ArrayType(TRACK_ENTRY)),
])

CHALLENGE = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("playlists", T.ArrayType(CHALLENGE_PLAYLIST)),
])

PLAYLIST_COLUMNS = [
    "pid", "name", "collaborative", "modified_at", "num_albums", "num_artists",
    "num_edits", "num_followers", "num_tracks", "duration_ms",
]
CHALLENGE_COLUMNS = ["pid", "name", "num_holdouts", "num_samples", "num_tracks"]
CATALOGUE_COLUMNS = [
    "tid", "track_uri", "track_name", "album_name", "album_uri",
    "artist_name", "artist_uri", "duration_ms",
]
MEMBERSHIP_COLUMNS = ["pid", "pos", *CATALOGUE_COLUMNS]
