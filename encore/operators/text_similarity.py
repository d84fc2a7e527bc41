"""Tracks similar to one track by the words of their names, albums and artists and by duration."""

from pyspark.sql import DataFrame, Window as W, functions as F

from encore.functions.numbers import ratio
from encore.operators.features import TEXT_FIELDS, tfidf_terms
from encore.operators.nearest import only_row
from encore.sources.stage import staged

DIGITS = 9


def similar_by_text(tracks: DataFrame, seed: DataFrame, k: int = 500, stop_words: list[str] | None = None) -> DataFrame:
    """(tid, cosine_similarity, rank): the k tracks closest to the one track of `seed` (tid).

    A track is the vector of its TF-IDF weights in three fields and its min-max scaled duration.
    The seed's few words meet each track's words once; every track takes part, shared words or not. Several seeds
    are refused.
    """
    one = only_row(seed, "tid").select("one.tid").filter("tid IS NOT NULL")
    terms = staged(
        tfidf_terms(tracks, "tid", TEXT_FIELDS, stop_words).select("tid", "field", "token", "tfidf"), "track-terms")
    limits = tracks.agg(F.struct(F.min("duration_ms").alias("lo"), F.max("duration_ms").alias("hi")).alias("s")).scalar()
    span = (limits["hi"] - limits["lo"]).cast("double")
    duration = F.when(span == 0, F.lit(0.5)).otherwise(ratio(F.col("duration_ms") - limits["lo"], span))

    # The words of one track: as small as its three names, whatever the size of the catalogue.
    asked = terms.join(F.broadcast(one), "tid", "left_semi").select("field", "token", F.col("tfidf").alias("asked"))
    sums = (
        terms.join(F.broadcast(asked), ["field", "token"], "left").groupBy("tid")
        .agg(F.sum(F.col("tfidf") * F.coalesce("asked", F.lit(0.0))).alias("dot"),
             F.sum(F.col("tfidf") * F.col("tfidf")).alias("energy")))
    placed = staged(
        tracks.select("tid", duration.alias("duration")).join(sums.hint("shuffle_hash"), "tid", "left").fillna(0.0, ["dot", "energy"]),
        "text-vectors")
    own = (placed.join(F.broadcast(one), "tid", "left_semi")
           .select(F.struct("tid", "duration", "energy").alias("s")).scalar())

    def length(v):
        return F.sqrt(v("energy") + v("duration") * v("duration"))

    compared = placed.withColumn("own", own).filter(F.col("tid") != F.col("own.tid"))
    dot = F.col("dot") + F.col("duration") * F.col("own.duration")
    cosine = ratio(dot, length(F.col) * length(lambda c: F.col(f"own.{c}")))
    best = (compared.select("tid", F.round(cosine, DIGITS).alias("cosine_similarity"))
            .orderBy(F.desc("cosine_similarity"), "tid").limit(k))
    in_order = W.orderBy(F.desc("cosine_similarity"), "tid")  # over the k listed rows only
    return best.withColumn("rank", F.row_number().over(in_order).cast("bigint"))
