"""Track features: frequency ranks of names, scaled and normalised vectors, TF-IDF of the texts."""

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    HashingTF, IDF, MinMaxScaler, Normalizer, StopWordsRemover, Tokenizer, VectorAssembler,
)
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from encore.functions.ids import stable_id
from encore.functions.text import whitespace_tokens
from encore.functions.vectors import l2_normalised
from encore.sources.stage import staged

# Field -> column of its frequency rank, in the order they enter the vector before the duration.
INDEXED = {"album_name": "album_index", "artist_name": "artist_index", "track_name": "track_index"}
TEXT_FIELDS = ["track_name", "album_name", "artist_name"]
HASH_BUCKETS = 10_000


def frequency_index(table: DataFrame, columns: list[str], ranges: int | None = None) -> DataFrame:
    """(field, value, index) for several columns: 0 for a column's most frequent value, ties alphabetical.

    The order is global but no task sees more than one range of it: Spark cuts the order into ranges, as many as
    its shuffle partitions or `ranges`; the rows before a range come from per-range counts.
    """
    cells = [F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns]
    counted = staged(
        table.select(F.inline(F.array(*cells))).filter(F.col("value").isNotNull())
        .groupBy("field", "value").agg((-F.count(F.lit(1))).alias("place")), "value-counts")
    key = ["field", "place", "value"]
    spread = counted.repartitionByRange(ranges, *key) if ranges else counted.repartitionByRange(*key)
    ranged = staged(spread.withColumn("range", F.spark_partition_id()), "value-ranges")
    before = W.partitionBy("field").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    # At most one row per range and column.
    offsets = ranged.groupBy("field", "range").agg(F.count(F.lit(1)).alias("size")).select(
        "field", "range", F.coalesce(F.sum("size").over(before), F.lit(0).cast("bigint")).alias("offset"))
    within = W.partitionBy("field", "range").orderBy("place", "value")
    return (
        ranged.withColumn("nth", F.row_number().over(within))
        .join(F.broadcast(offsets), ["field", "range"])
        .select("field", "value", (F.col("offset") + F.col("nth") - 1).cast("bigint").alias("index")))


def index_features(tracks: DataFrame) -> DataFrame:
    """Tracks with their three frequency ranks. A missing name takes the first rank after all names."""
    index = staged(frequency_index(tracks, list(INDEXED)), "frequency-index")
    known = index.agg(F.struct(*[F.count_if(F.col("field") == f).alias(f) for f in INDEXED]).alias("s")).scalar()

    def add(table, item):
        field, name = item
        ranks = index.filter(F.col("field") == field).select(F.col("value").alias(field), F.col("index").alias(name))
        return table.join(ranks, field, "left").withColumn(
            name, F.coalesce(name, known[field]).cast("double"))

    return reduce(add, INDEXED.items(), tracks).select(*tracks.columns, *INDEXED.values())


def min_max(column: Column, lo: Column, hi: Column) -> Column:
    """Scaled to [0, 1]; a constant column becomes 0.5."""
    return F.when(hi == lo, F.lit(0.5)).otherwise((column - lo) / (hi - lo))


def scaled_features(tracks: DataFrame) -> DataFrame:
    """Min-max scaled and unit-length vectors of (album, artist, track rank, duration)."""
    indexed = staged(index_features(tracks).withColumn(
        "duration", F.coalesce("duration_ms", F.lit(0).cast("bigint")).cast("double")), "track-index")
    parts = [*INDEXED.values(), "duration"]
    limits = indexed.agg(
        *[F.min(p).alias(f"{p}_lo") for p in parts], *[F.max(p).alias(f"{p}_hi") for p in parts]
    ).select(F.struct("*")).scalar()
    scaled = F.array(*[min_max(F.col(p), limits[f"{p}_lo"], limits[f"{p}_hi"]) for p in parts])
    return (
        indexed.withColumn("scaled", scaled)
        .withColumn("vector", l2_normalised(F.col("scaled"))).drop("duration"))


def tfidf_terms(table: DataFrame, key: str, fields: list[str], stop_words: list[str] | None = None) -> DataFrame:
    """(key, field, token, tf, idf, tfidf) on exact terms; idf = ln((m + 1) / (df + 1)).

    m counts the rows of the table. Empty tokens count as terms, as the tokenizer keeps them. The terms are joined with
    their document frequencies by hash, neither sorted by token nor with a vocabulary sent to the driver.
    """
    rows = table.agg(F.count(F.lit(1))).scalar()
    cells = [F.struct(F.lit(f).alias("field"), whitespace_tokens(F.col(f)).alias("tokens")) for f in fields]
    tokens = table.select(key, F.inline(F.array(*cells))).select(key, "field", F.explode("tokens").alias("token"))
    if stop_words:
        tokens = tokens.filter(~F.col("token").isin(stop_words))
    terms = tokens.groupBy(key, "field", "token").agg(F.count(F.lit(1)).alias("tf"))
    spread = terms.groupBy("field", "token").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((rows + 1).cast("double") / (F.col("df") + 1))
    return (
        terms.join(spread.hint("shuffle_hash"), ["field", "token"])
        .select(key, "field", "token", "tf", idf.alias("idf"), (F.col("tf") * idf).alias("tfidf")))


def unit_tfidf(tracks: DataFrame, fields: list[str] = TEXT_FIELDS, stop_words: list[str] | None = None) -> DataFrame:
    """(tid, field, token, weight): each track as a vector of unit length, of the TF-IDF of its texts' exact terms and
    its scaled duration (field `duration`, token empty). A track without length has weights of 0."""
    limits = tracks.agg(F.struct(F.min("duration_ms").alias("lo"), F.max("duration_ms").alias("hi")).alias("s")).scalar()
    scaled = min_max(F.coalesce("duration_ms", F.lit(0).cast("bigint")).cast("double"),
                      limits["lo"].cast("double"), limits["hi"].cast("double"))
    terms = tfidf_terms(tracks, "tid", fields, stop_words).select("tid", "field", "token", F.col("tfidf").alias("weight"))
    parts = staged(terms.unionByName(tracks.select(
        "tid", F.lit("duration").alias("field"), F.lit("").alias("token"), scaled.alias("weight"))), "tfidf-parts")
    length = parts.groupBy("tid").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    return parts.join(length, "tid").select("tid", "field", "token", F.coalesce(
        F.try_divide("weight", "length"), F.lit(0.0)).alias("weight"))


def tfidf_stages(field: str, buckets: int = HASH_BUCKETS) -> list:
    return [
        Tokenizer(inputCol=field, outputCol=f"{field}_tokens"),
        StopWordsRemover(inputCol=f"{field}_tokens", outputCol=f"{field}_filtered"),
        HashingTF(inputCol=f"{field}_filtered", outputCol=f"{field}_counts", numFeatures=buckets),
        IDF(inputCol=f"{field}_counts", outputCol=f"{field}_tfidf"),
    ]


def fit_tfidf(tracks: DataFrame, fields: list[str] = TEXT_FIELDS, buckets: int = HASH_BUCKETS) -> PipelineModel:
    """Hashed TF-IDF of the text fields with the scaled duration, as one saved and reused model.

    What reaches the driver are the idf weights and the duration range: fixed size, whatever the data.
    """
    duration = [
        VectorAssembler(inputCols=["duration_ms"], outputCol="duration_raw"),
        MinMaxScaler(inputCol="duration_raw", outputCol="duration_scaled"),
    ]
    joined = [
        VectorAssembler(inputCols=[f"{f}_tfidf" for f in fields] + ["duration_scaled"], outputCol="features"),
        Normalizer(inputCol="features", outputCol="normalized", p=2.0),
    ]
    stages = [s for f in fields for s in tfidf_stages(f, buckets)] + duration + joined
    return Pipeline(stages=stages).fit(_without_missing(tracks, fields))


def hashed_tfidf(tracks: DataFrame, model: PipelineModel, fields: list[str] = TEXT_FIELDS) -> DataFrame:
    return model.transform(_without_missing(tracks, fields))


def _without_missing(tracks: DataFrame, fields: list[str]) -> DataFrame:
    filled = {f: F.coalesce(F.col(f), F.lit("")) for f in fields}
    return tracks.withColumns({**filled, "duration_ms": F.coalesce("duration_ms", F.lit(0).cast("bigint"))})


def hashed_terms(table: DataFrame, key: str, fields: list[str], buckets: int = HASH_BUCKETS,
                 stop_words: list[str] | None = None) -> DataFrame:
    """(key, field, bucket, tf, idf, tfidf, terms): term frequencies by bucket of the term's md5, whatever the engine.

    terms is how many different terms of the whole table fell into the bucket: more than one is a collision.
    """
    exact = tfidf_terms(table, key, fields, stop_words).select(
        key, "field", "token", "tf", F.pmod(stable_id(F.col("token")), F.lit(buckets)).cast("int").alias("bucket"))
    exact = staged(exact, "hashed-terms")
    rows = table.agg(F.count(F.lit(1))).scalar()
    held = exact.groupBy(key, "field", "bucket").agg(F.sum("tf").alias("tf"))
    spread = held.groupBy("field", "bucket").agg(F.count(F.lit(1)).alias("df"))
    terms = exact.select("field", "bucket", "token").distinct().groupBy("field", "bucket").agg(
        F.count(F.lit(1)).alias("terms"))
    idf = F.log((rows + 1).cast("double") / (F.col("df") + 1))
    return held.join(spread.join(terms, ["field", "bucket"]), ["field", "bucket"]).select(
        key, "field", "bucket", "tf", idf.alias("idf"), (F.col("tf") * idf).alias("tfidf"), "terms")


def hashed_vectors(terms: DataFrame, key: str, buckets: int) -> DataFrame:
    """(key, field, vector): the rows of `hashed_terms` as Spark ML vectors of `buckets` values."""
    values = F.map_from_entries(F.collect_list(F.struct("bucket", "tfidf")))
    dense = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda i: F.coalesce(F.try_element_at("values", i), F.lit(0.0)))
    return terms.groupBy(key, "field").agg(values.alias("values")).select(key, "field", array_to_vector(dense).alias("vector"))
