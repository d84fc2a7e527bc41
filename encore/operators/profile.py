"""Averages, outlier handling and correlations of the playlist counts."""

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from encore.functions.numbers import capped
from encore.operators import distribution

FEATURES = ["num_followers", "num_artists", "num_albums", "num_tracks", "modified_at"]
CAP_QUANTILE = 0.99
MAX_TRACKS = 350

# The five reported pairs.
CORRELATED = {
    "artists_albums": ("num_artists", "num_albums"),
    "tracks_albums": ("num_tracks", "num_albums"),
    "artists_tracks": ("num_artists", "num_tracks"),
    "followers_tracks": ("num_followers", "num_tracks"),
    "modified_followers": ("modified_at", "num_followers"),
}


def averages(info: DataFrame) -> DataFrame:
    columns = ["num_followers", "num_artists", "num_albums", "num_tracks"]
    return info.agg(*[F.avg(c).alias(c.replace("num_", "avg_")) for c in columns])


def followers_threshold(info: DataFrame, quantile: float = CAP_QUANTILE) -> Column:
    """The exact quantile as a scalar subquery, so nothing is fetched while the plan is built."""
    return distribution.quantiles(
        distribution.value_counts(info, ["num_followers"]), {"threshold": quantile}).select("threshold").scalar()


def with_followers_capped(info: DataFrame, quantile: float = CAP_QUANTILE) -> DataFrame:
    """All columns, the threshold and the capped followers."""
    return info.withColumn("threshold", followers_threshold(info, quantile)).withColumn(
        "num_followers_capped", capped(F.col("num_followers"), F.col("threshold")))


def followers_capped(info: DataFrame, quantile: float = CAP_QUANTILE) -> DataFrame:
    return with_followers_capped(info, quantile).select("pid", "num_followers", "threshold", "num_followers_capped")


def without_follower_outliers(info: DataFrame, quantile: float = CAP_QUANTILE) -> DataFrame:
    return info.filter(F.col("num_followers") <= followers_threshold(info, quantile))


def outlier_filtered(info: DataFrame, quantile: float = CAP_QUANTILE, max_tracks: int = MAX_TRACKS) -> DataFrame:
    kept = without_follower_outliers(info, quantile).filter(F.col("num_tracks") <= max_tracks)
    return kept.select("pid", *FEATURES)


def correlations(info: DataFrame, quantile: float = CAP_QUANTILE) -> DataFrame:
    """The five reported Pearson correlations in one pass; pairs with a missing side are skipped."""
    return without_follower_outliers(info, quantile).agg(
        *[F.corr(a, b).alias(name) for name, (a, b) in CORRELATED.items()])


def pair_matrix(info: DataFrame, quantile: float = CAP_QUANTILE, max_tracks: int = MAX_TRACKS) -> DataFrame:
    """Correlation of every ordered pair of features, from one pass over the filtered playlists."""
    pairs = list(combinations(FEATURES, 2))
    one_row = outlier_filtered(info, quantile, max_tracks).agg(
        *[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs],
        *[F.corr(a, a).alias(f"{a}|{a}") for a in FEATURES])
    cells = [(a, b, f"{a}|{b}") for a, b in pairs] + [(b, a, f"{a}|{b}") for a, b in pairs]
    cells += [(a, a, f"{a}|{a}") for a in FEATURES]
    return one_row.select(F.inline(F.array(*[
        F.struct(F.lit(x).alias("feature_x"), F.lit(y).alias("feature_y"), F.col(f"`{c}`").alias("correlation"))
        for x, y, c in cells])))
