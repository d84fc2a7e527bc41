"""The playlist model over a sales star schema: orders are playlists, parts are tracks.

| model            | star schema                                             |
| ---------------- | ------------------------------------------------------- |
| track            | part; artist = brand, album = brand and type            |
| playlist         | order; name = name of its first part and the segment    |
| membership       | line item, positions from the line order                |
| followers, time  | order total in thousands, order date                    |
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from encore.functions.ids import stable_id

# Declared, so that opening a table costs no job of its own.
SCHEMAS = {
    "orders": "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_retailprice double",
    "customer": "c_custkey long, c_mktsegment string",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
}
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _track_columns(key: str) -> list[Column]:
    uri = F.concat(F.lit("part:"), F.col(key).cast("string"))
    album = F.concat("p_brand", F.lit("/"), "p_type")
    return [
        stable_id(uri).alias("tid"),
        uri.alias("track_uri"),
        F.col("p_name").alias("track_name"),
        album.alias("album_name"),
        F.concat(F.lit("album:"), album).alias("album_uri"),
        F.col("p_brand").alias("artist_name"),
        F.concat(F.lit("artist:"), "p_brand").alias("artist_uri"),
        F.round(F.col("p_retailprice") * 10).cast("bigint").alias("duration_ms"),
    ]


def tracks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(*_track_columns("p_partkey"), F.col("p_partkey").alias("part_key"))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with their parts, gathered by order.

    The columns are those of the tables: what is derived from them is longer, and follows after the shuffle. Playlists
    and their tracks need the same ones, so a plan with both shuffles them once.
    """
    lines, parts = table(spark, folder, "lineitem"), table(spark, folder, "part")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        "l_orderkey", *LINE_ORDER, "p_name", "p_brand", "p_type", "p_retailprice").repartition("l_orderkey")


def playlists_tracks(spark: SparkSession, folder: str) -> DataFrame:
    in_order = W.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    position = F.row_number().over(in_order).cast("bigint") - F.lit(1)
    return _lines(spark, folder).withColumn("pos", position).select(
        F.col("l_orderkey").alias("pid"), "pos", *_track_columns("l_partkey"))


def playlists_info(spark: SparkSession, folder: str) -> DataFrame:
    album = F.concat("p_brand", F.lit("/"), "p_type")
    summary = _lines(spark, folder).groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_tracks"),
        F.size(F.collect_set("p_brand")).alias("n_artists"),
        F.size(F.collect_set(album)).alias("n_albums"),
        F.sum(F.round(F.col("p_retailprice") * 10).cast("bigint")).alias("total_ms"),
        F.max("l_linenumber").alias("edits"),
        F.min_by("p_name", F.struct(*LINE_ORDER)).alias("first_name"),
    )
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")

    def counted(name):
        return F.coalesce(F.col(name).cast("bigint"), F.lit(0).cast("bigint"))

    return (
        orders.join(customers, orders.o_custkey == customers.c_custkey)
        .join(summary, orders.o_orderkey == summary.l_orderkey, "left")
        .select(
            F.col("o_orderkey").alias("pid"),
            F.concat(F.coalesce(F.concat("first_name", F.lit(" ")), F.lit("")), "c_mktsegment").alias("name"),
            (F.col("o_orderpriority") == "1-URGENT").alias("collaborative"),
            F.unix_timestamp("o_orderdate").alias("modified_at"),
            counted("n_albums").alias("num_albums"),
            counted("n_artists").alias("num_artists"),
            counted("edits").alias("num_edits"),
            F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("num_followers"),
            counted("n_tracks").alias("num_tracks"),
            counted("total_ms").alias("duration_ms"),
        )
    )


def nested_slices(info: DataFrame, membership: DataFrame, per_slice: int = 1000) -> DataFrame:
    """The model in its file shape: one row per slice of `per_slice` consecutive playlists."""
    entry = F.struct("pos", "track_uri", "track_name", "artist_uri", "artist_name",
                     "album_uri", "album_name", "duration_ms")
    entries = membership.groupBy("pid").agg(F.sort_array(F.collect_list(entry)).alias("tracks"))
    playlist = F.struct(
        "pid", "name", F.lit(None).cast("string").alias("description"),
        F.col("collaborative").cast("string").alias("collaborative"), "modified_at",
        "num_artists", "num_albums", "num_tracks", "num_followers", "num_edits", "duration_ms",
        F.coalesce("tracks", F.array().cast(entries.schema["tracks"].dataType)).alias("tracks"))
    first = F.floor(F.col("pid") / per_slice).cast("bigint") * per_slice
    label = F.concat(first.cast("string"), F.lit("-"), (first + (per_slice - 1)).cast("string"))
    return (
        info.join(entries, "pid", "left")
        .groupBy(label.alias("slice")).agg(F.collect_list(playlist).alias("playlists"))
        .select(F.struct("slice", F.lit("v1").alias("version"), F.lit("").alias("generated_on")).alias("info"),
                "playlists"))


def nested_challenge(info: DataFrame, seeds: DataFrame) -> DataFrame:
    """Challenge playlists in their file shape, one row per playlist record."""
    entry = F.struct("pos", "track_uri", "track_name", "artist_uri", "artist_name",
                     "album_uri", "album_name", "duration_ms")
    entries = seeds.groupBy("pid").agg(F.sort_array(F.collect_list(entry)).alias("tracks"))
    playlist = F.struct(
        "pid", "name", "num_holdouts", "num_samples", "num_tracks",
        F.coalesce("tracks", F.array().cast(entries.schema["tracks"].dataType)).alias("tracks"))
    return info.join(entries, "pid", "left").select(
        F.lit("").alias("date"), F.lit("v1").alias("version"), F.array(playlist).alias("playlists"))
