"""Most frequent tracks, artists and albums, and keyword counts over playlist names."""

from pyspark.sql import DataFrame, Window as W, functions as F

# The keywords looked for in playlist names.
GENRES = ["rock", "pop", "hip-hop", "jazz", "classical"]


def _top(counted: DataFrame, key: str, names: DataFrame, name: str, k: int) -> DataFrame:
    """The k most frequent keys with one name each, ranked; ties go to the smaller key.

    The list has k rows, so it is the broadcast side of the name lookup whatever the data size.
    """
    top = counted.orderBy(F.desc("n"), key).limit(k)
    named = (names.select(key, name).join(F.broadcast(top.select(key)), key, "left_semi")
             .groupBy(key).agg(F.min(name).alias(name)))
    by_rank = W.orderBy(F.desc("n"), key)  # over the k listed rows only
    return (top.join(named, key, "left")
            .select(F.row_number().over(by_rank).cast("bigint").alias("rank"), key, name, "n")
            .orderBy("rank"))


def _counted(rows: DataFrame, key: str) -> DataFrame:
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def top_opening_tracks(membership: DataFrame, tracks: DataFrame, k: int = 10) -> DataFrame:
    return _top(_counted(membership.filter(F.col("pos") == 0), "track_uri"), "track_uri", tracks, "track_name", k)


def top_closing_tracks(membership: DataFrame, tracks: DataFrame, k: int = 10) -> DataFrame:
    """Last track of each playlist by one aggregate instead of a join back on the largest position."""
    closing = membership.groupBy("pid").agg(F.max_by("track_uri", "pos").alias("track_uri"))
    return _top(_counted(closing, "track_uri"), "track_uri", tracks, "track_name", k)


def top_tracks(membership: DataFrame, tracks: DataFrame, k: int = 10) -> DataFrame:
    return _top(_counted(membership, "track_uri"), "track_uri", tracks, "track_name", k)


def _top_owner(owner: str, membership, tracks, by: str, k: int) -> DataFrame:
    if by not in ("catalogue", "appearances"):
        raise ValueError("by must be 'catalogue' or 'appearances'")
    rows = tracks if by == "catalogue" else membership
    return _top(_counted(rows, f"{owner}_uri"), f"{owner}_uri", tracks, f"{owner}_name", k)


def top_artists(membership: DataFrame, tracks: DataFrame, by: str = "catalogue", k: int = 10) -> DataFrame:
    """Artists by number of catalogue tracks, or by appearances in playlists."""
    return _top_owner("artist", membership, tracks, by, k)


def top_albums(membership: DataFrame, tracks: DataFrame, by: str = "catalogue", k: int = 10) -> DataFrame:
    return _top_owner("album", membership, tracks, by, k)


def genre_counts(info: DataFrame, genres: list[str] = GENRES, ignore_case: bool = False) -> DataFrame:
    """Playlists whose name contains each keyword, all keywords in one pass."""
    name = F.lower("name") if ignore_case else F.col("name")
    counts = info.agg(*[
        F.count_if(name.contains(g.lower() if ignore_case else g)).alias(f"g{i}") for i, g in enumerate(genres)])
    rows = [F.struct(F.lit(g).alias("genre"), F.col(f"g{i}").alias("n_playlists")) for i, g in enumerate(genres)]
    return counts.select(F.inline(F.array(*rows)))


def n_playlists(info: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct("pid") if approximate else F.count_distinct("pid")
    return info.agg(count.alias("n_playlists"))
