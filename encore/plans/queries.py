"""The registered queries: every operator over the whole star schema tables."""

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

from encore.operators import (
    challenge, distribution, features, ingest, metrics, names, playlist_pairs, profile, scope, toplists,
)
from encore.operators.feature_model import TrackFeatures, TrackFeaturesModel
from encore.operators.nearest import nearest_to_one
from encore.operators.playlist_neighbours import similar_playlists
from encore.operators.text_pairs import most_similar_by_text
from encore.operators.text_similarity import similar_by_text
from encore.operators.wide_nearest import nearest_of_every
from encore.plans import continuation
from encore.sources import star
from encore.sources.stage import discard, new_path, staged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

STOP_WORDS = ["and", "of", "ring", "the"]
BUCKETS = 48
NAME_KEYWORDS = ["ring", "gear", "plate", "rod", "widget"]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(table: DataFrame, digits: int = 6) -> DataFrame:
    return table.select(*[
        (F.round(f.name, digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name)
        for f in table.schema])


# --- nested records to tables -------------------------------------------------------------------

def _slices(spark, sf):
    """Nested records as file readers give them; reading files themselves is left to the tests."""
    return star.nested_slices(star.playlists_info(spark, sf), star.playlists_tracks(spark, sf))


def _challenge_parts(spark, sf):
    split = challenge.holdout_split(star.playlists_tracks(spark, sf))
    return challenge.challenge_info(star.playlists_info(spark, sf), split), split


def _challenge_records(spark, sf):
    info, split = _challenge_parts(spark, sf)
    return star.nested_challenge(info, split.filter(~F.col("holdout")))


@query
def ingest_playlists(spark, sf):
    return ingest.playlists(_slices(spark, sf))


@query
def ingest_membership(spark, sf):
    entries = staged(ingest.entries(_slices(spark, sf)), "entries")
    return ingest.membership(entries, ingest.catalogue(entries))


@query
def track_catalogue(spark, sf):
    return ingest.catalogue(star.playlists_tracks(spark, sf))


@query
def ingest_challenge(spark, sf):
    return ingest.membership(ingest.entries(_challenge_records(spark, sf)), star.tracks(spark, sf))


@query
def challenge_info(spark, sf):
    return ingest.challenge_playlists(_challenge_records(spark, sf))


@query
def holdout_split(spark, sf):
    return _challenge_parts(spark, sf)[1].select("pid", "pos", "tid", "holdout")


# --- top lists and counts -----------------------------------------------------------------------

@query
def top_opening_tracks(spark, sf):
    return toplists.top_opening_tracks(star.playlists_tracks(spark, sf), star.tracks(spark, sf))


@query
def top_closing_tracks(spark, sf):
    return toplists.top_closing_tracks(star.playlists_tracks(spark, sf), star.tracks(spark, sf))


@query
def top_tracks(spark, sf):
    return toplists.top_tracks(star.playlists_tracks(spark, sf), star.tracks(spark, sf))


def _top_owner(owner, by):
    def run(spark, sf):
        return getattr(toplists, f"top_{owner}s")(star.playlists_tracks(spark, sf), star.tracks(spark, sf), by=by)
    return run


QUERIES["top_artists"] = _top_owner("artist", "catalogue")
QUERIES["top_albums"] = _top_owner("album", "catalogue")
QUERIES["top_artists_by_appearances"] = _top_owner("artist", "appearances")
QUERIES["top_albums_by_appearances"] = _top_owner("album", "appearances")


@query
def genre_counts(spark, sf):
    return toplists.genre_counts(star.playlists_info(spark, sf), NAME_KEYWORDS)


@query
def n_playlists(spark, sf):
    return toplists.n_playlists(star.playlists_info(spark, sf))


@query
def playlists_in_scope(spark, sf):
    """Playlists that open with one of the ten most common opening tracks."""
    members = star.playlists_tracks(spark, sf)
    top = toplists.top_opening_tracks(members, star.tracks(spark, sf))
    opened = scope.in_scope(members.filter(F.col("pos") == 0), top, "track_uri")
    return scope.in_scope(star.playlists_info(spark, sf), opened).select("pid", "name", "num_tracks")


# --- profiles and distributions -----------------------------------------------------------------

@query
def profile_averages(spark, sf):
    return rounded(profile.averages(star.playlists_info(spark, sf)))


@query
def followers_cap(spark, sf):
    return rounded(profile.followers_capped(star.playlists_info(spark, sf)))


@query
def outlier_filtered(spark, sf):
    return profile.outlier_filtered(star.playlists_info(spark, sf))


@query
def correlations(spark, sf):
    return rounded(profile.correlations(star.playlists_info(spark, sf)))


@query
def pair_matrix(spark, sf):
    return rounded(profile.pair_matrix(star.playlists_info(spark, sf)))


def _capped_counts(spark, sf):
    capped = profile.followers_capped(star.playlists_info(spark, sf))
    return distribution.value_counts(capped, ["num_followers_capped"])


def _counts(spark, sf, *metrics):
    return distribution.value_counts(star.playlists_info(spark, sf), list(metrics))


@query
def hist_followers(spark, sf):
    return rounded(distribution.histogram(_capped_counts(spark, sf), 50).drop("metric"))


@query
def hist_artists(spark, sf):
    hist = distribution.histogram(_counts(spark, sf, "num_artists"), 30).drop("metric")
    return rounded(distribution.visible_bins(hist, 1, 250))


@query
def hist_albums(spark, sf):
    return rounded(distribution.histogram(_counts(spark, sf, "num_albums"), 30).drop("metric"))


@query
def hist_tracks(spark, sf):
    hist = distribution.histogram(_counts(spark, sf, "num_tracks"), 30).drop("metric")
    return rounded(distribution.visible_bins(hist, 1, 300))


@query
def kde_tracks(spark, sf):
    return rounded(distribution.density(_counts(spark, sf, "num_tracks")).drop("metric"))


@query
def kde_all(spark, sf):
    """Densities of all four counts, followers capped, and of the five features without outliers."""
    info = star.playlists_info(spark, sf)
    every = distribution.value_counts(
        profile.with_followers_capped(info), ["num_followers_capped", "num_artists", "num_albums", "num_tracks"])
    few = distribution.value_counts(profile.outlier_filtered(info), {
        f"filtered {c}": F.col(c) for c in ("num_followers", "num_artists", "num_albums", "num_tracks")
    } | {"filtered modified_days": F.col("modified_at") / 86400})
    return rounded(distribution.density(staged(every.unionByName(few), "density-counts")))


@query
def price_quantiles(spark, sf):
    """Quantiles of real numbers by three significant digits: of the orders' totals and of the prices of their lines."""
    wanted = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}
    orders = distribution.value_summary(star.table(spark, sf, "orders"), ["o_totalprice"], 3)
    lines = distribution.value_summary(star.table(spark, sf, "lineitem"), ["l_extendedprice"], 3)
    counts = distribution.summary_counts(distribution.merged_summaries(orders.unionByName(lines)))
    return rounded(distribution.quantiles(staged(counts, "price-counts"), wanted))


@query
def box_stats(spark, sf):
    table = profile.with_followers_capped(star.playlists_info(spark, sf))
    counts = distribution.value_counts(table, ["num_followers_capped", "num_artists", "num_albums", "num_tracks"])
    return rounded(distribution.box_summary(counts))


def _scatter(spark, sf):
    return distribution.scatter_sample(profile.without_follower_outliers(star.playlists_info(spark, sf)))


@query
def hash_sample(spark, sf):
    return _scatter(spark, sf)


@query
def exact_sample(spark, sf):
    """A thousand playlists, the same ones at every run."""
    return scope.exact_sample(star.playlists_info(spark, sf), "pid", 1000).select("pid", "name", "num_tracks")


@query
def exact_sample_each(spark, sf):
    """Twenty playlists of each length, or all where there are fewer."""
    return scope.exact_sample(star.playlists_info(spark, sf), "pid", 20, ["num_tracks"]).select("num_tracks", "pid")


@query
def joint_marginals(spark, sf):
    counts = distribution.value_counts(_scatter(spark, sf), ["num_tracks", "num_followers", "modified_at"])
    return rounded(distribution.histogram(counts, 50))


def _hexbin(x):
    def run(spark, sf):
        return rounded(distribution.hexbin(_scatter(spark, sf), x, "num_followers"))
    return run


QUERIES["hexbin"] = _hexbin("num_tracks")
QUERIES["hexbin_modified"] = _hexbin("modified_at")


# --- features -----------------------------------------------------------------------------------

@query
def string_index_features(spark, sf):
    return features.index_features(star.tracks(spark, sf)).select("tid", *features.INDEXED.values())


@query
def scaled_features(spark, sf):
    parts = ["album", "artist", "track", "duration"]
    return rounded(features.scaled_features(star.tracks(spark, sf)).select(
        "tid", *[F.col("scaled")[i].alias(f"{p}_scaled") for i, p in enumerate(parts)],
        *[F.col("vector")[i].alias(f"{p}_unit") for i, p in enumerate(parts)]))


@query
def tfidf_track_text(spark, sf):
    return rounded(features.tfidf_terms(star.tracks(spark, sf), "tid", features.TEXT_FIELDS))


@query
def tfidf_documents(spark, sf):
    return rounded(features.tfidf_terms(star.table(spark, sf, "documents"), "doc_id", ["text"]))


@query
def tfidf_unit(spark, sf):
    """Tracks as unit vectors of their texts without stop words, and their scaled duration."""
    return rounded(features.unit_tfidf(star.tracks(spark, sf), stop_words=STOP_WORDS))


@query
def model_features(spark, sf):
    """All tracks by a model that was fitted on the challenge seeds' tracks, saved and loaded."""
    tracks = star.tracks(spark, sf)
    seeds = _challenge_parts(spark, sf)[1].filter(~F.col("holdout"))
    path = new_path(spark, "feature-model")
    TrackFeatures().fit(staged(scope.in_scope(tracks, seeds, "tid"), "known-tracks")).write().save(path)
    return rounded(TrackFeaturesModel.load(path).transform(tracks).select(
        "tid", *features.INDEXED.values(), *[F.col("vector")[i].alias(f"unit{i}") for i in range(4)]))


@query
def hashed_term_weights(spark, sf):
    """TF-IDF of the tracks' texts by bucket of the words' md5, with the words that share a bucket."""
    return rounded(features.hashed_terms(star.tracks(spark, sf), "tid", features.TEXT_FIELDS, BUCKETS))


@query
def hashed_track_vectors(spark, sf):
    """The same as Spark ML vectors, read back: how many values are set, their sum and their length."""
    terms = features.hashed_terms(star.tracks(spark, sf), "tid", features.TEXT_FIELDS, BUCKETS)
    read = features.hashed_vectors(terms, "tid", BUCKETS).withColumn("values", vector_to_array("vector"))
    return rounded(read.select("tid", "field", F.size("values").alias("size"),
                               F.size(F.filter("values", lambda x: x != 0)).alias("n_set"),
                               F.aggregate("values", F.lit(0.0), lambda s, x: s + x).alias("total"),
                               F.sqrt(F.aggregate("values", F.lit(0.0), lambda s, x: s + x * x)).alias("length")))


# --- similarity ---------------------------------------------------------------------------------

def _tables(spark, sf, columns=("*",)):
    """Playlists and membership as tables on disk, which is how the longer jobs expect them; of membership the columns used."""
    return staged(star.playlists_info(spark, sf), "info"), staged(star.playlists_tracks(spark, sf).select(*columns), "membership")


def _pairs(weights=None):
    def run(spark, sf):
        info, members = _tables(spark, sf, ["pid", *[f"{s}_uri" for s in playlist_pairs.SETS]])
        return rounded(playlist_pairs.most_similar_pairs(members, info, weights=weights))
    return run


QUERIES["playlist_similarity_topk"] = _pairs()
QUERIES["playlist_overlap_topk"] = _pairs({f"{s}_similarity": 1 / 3 for s in playlist_pairs.SETS})
QUERIES["name_similarity_topk"] = _pairs({"name_similarity": 1.0})


@query
def similar_playlists_each(spark, sf):
    """The ten most alike playlists of every playlist."""
    info, members = _tables(spark, sf)
    return rounded(similar_playlists(members, info))


@query
def nearest_playlist_by_name(spark, sf):
    """For every challenge playlist without seeds, the playlist with tracks whose name is closest."""
    info, members = _tables(spark, sf)
    targets = challenge.challenge_info(info, challenge.holdout_split(members)).filter(F.col("num_samples") == 0)
    return rounded(names.nearest_by_name(targets, info.filter(F.col("num_tracks") > 0)))


@query
def nearest_name_of_every_playlist(spark, sf):
    """For every playlist the other playlist with tracks whose name is closest."""
    info, _ = _tables(spark, sf)
    return rounded(names.nearest_by_name(info, info.filter(F.col("num_tracks") > 0)))


@query
def similar_tracks(spark, sf):
    """The 500 tracks most similar to each of the ten most common opening tracks."""
    tracks = star.tracks(spark, sf)
    top = toplists.top_opening_tracks(star.playlists_tracks(spark, sf), tracks)
    return rounded(continuation.similar_tracks(tracks, scope.in_scope(tracks, top, "track_uri")))


@query
def similar_tracks_tfidf(spark, sf):
    """The 500 tracks closest in words and duration to the most common opening track."""
    tracks = star.tracks(spark, sf)
    top = toplists.top_opening_tracks(star.playlists_tracks(spark, sf), tracks, k=1)
    return rounded(similar_by_text(tracks, staged(scope.in_scope(tracks, top, "track_uri").select("tid"), "seed")))


@query
def text_similarity_topk(spark, sf):
    """The 1,000 pairs of tracks most alike in words and duration."""
    return rounded(most_similar_by_text(features.unit_tfidf(star.tracks(spark, sf), stop_words=STOP_WORDS), 1000))


@query
def track_similarity_topk(spark, sf):
    return rounded(continuation.most_similar_tracks(star.tracks(spark, sf)))


@query
def embedding_topk(spark, sf):
    """The 500 given vectors closest to the one with the smallest id."""
    items = star.table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    return rounded(nearest_to_one(items, items.orderBy("item_id").limit(1), 500))


@query
def embedding_neighbours(spark, sf):
    """The ten given vectors closest to each of them."""
    items = star.table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    return rounded(nearest_of_every(items, 10))


# --- continuation and its quality ---------------------------------------------------------------

@query
def candidate_pool(spark, sf):
    """A tenth of the catalogue with every challenge seed added."""
    seeds = _challenge_parts(spark, sf)[1].filter(~F.col("holdout"))
    return scope.candidate_pool(star.tracks(spark, sf).drop("part_key"), seeds)


def _split(spark, sf):
    return staged(
        challenge.holdout_split(star.playlists_tracks(spark, sf)).select("pid", "pos", "tid", "holdout"), "split")


def _seeded(spark, sf, split, k, use="mean", of=continuation.recommend, relevant=None):
    seeds = split.filter(~F.col("holdout")).select("pid", "pos", "tid")
    return of(seeds, continuation.track_vectors(star.tracks(spark, sf)), k, use, relevant=relevant)


@query
def continue_seeded(spark, sf):
    """Ten tracks for every challenge playlist with seeds."""
    return rounded(_seeded(spark, sf, _split(spark, sf), 10))


@query
def continue_first_seed(spark, sf):
    """Ten tracks for every challenge playlist with seeds, by its first seed alone."""
    return rounded(_seeded(spark, sf, _split(spark, sf), 10, "first"))


@query
def continue_seeded_lists(spark, sf):
    """The full lists of 500 for every challenge playlist with seeds, one row a playlist: length, order and scores."""
    found = _seeded(spark, sf, _split(spark, sf), 500, of=continuation.recommended_lists).filter(F.size("found") > 0)
    return rounded(found.select(
        "pid", F.size("found").cast("bigint").alias("n_tracks"),
        F.md5(F.array_join(F.col("found.tid").cast("array<string>"), ",")).alias("tids_md5"),
        F.aggregate("found.score", F.lit(0.0), lambda total, x: total + x).alias("score_sum")), 5)


@query
def continue_seedless(spark, sf):
    """500 tracks for every challenge playlist without seeds."""
    info, members = _tables(spark, sf)
    split = challenge.holdout_split(members)
    without = staged(challenge.challenge_info(info, split).filter(F.col("num_samples") == 0), "seedless")
    seeds = split.filter(~F.col("holdout")).join(without, "pid", "left_semi")
    return rounded(continuation.continue_playlists(without, seeds, info, members, star.tracks(spark, sf)))


@query
def eval_metrics(spark, sf):
    split = _split(spark, sf)
    held_out = staged(split.filter("holdout").join(split.filter("not holdout"), "pid", "left_semi").select("pid", "tid"), "held-out")
    return rounded(metrics.ranking_metrics(_seeded(spark, sf, split, 10, relevant=held_out), held_out, [1, 5, 10]))


@query
def eval_metrics_all(spark, sf):
    """Metrics of the full lists over every playlist with held-out tracks, those without seeds among them."""
    info, split = staged(star.playlists_info(spark, sf), "info"), _split(spark, sf)
    every = staged(challenge.challenge_info(info, split), "challenge")
    seeds, held_out = split.filter("not holdout"), split.filter("holdout")
    found = continuation.continued_lists(every, seeds, info, split, star.tracks(spark, sf), relevant=held_out)
    discard(info), discard(every)
    return rounded(metrics.ranking_metrics(found, held_out, [1, 10, 100, 500]))
