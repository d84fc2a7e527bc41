"""The most alike pairs of tracks by the words of their texts and their duration, exactly and without forming all pairs.

A track is a sparse vector of length 1 (TF-IDF of its texts and the scaled duration), a pair's score the cosine.

1. Equal vectors are interchangeable; a list of k pairs uses at most their k + 1 smallest ids.
2. Tracks with the same words are neighbours in the order of duration; those pairs are scored, as are the first with the
   same rarest words. The k-th best score is a floor.
3. A track's coordinates are taken from the most frequent token down. As long as their length, and their product with
   the largest weights anywhere, stays below the floor, a pair that shares no rarer token can't reach it; so two tracks that
   do reach it share one of the tokens beyond, which are few.
4. Vectors that reach the floor lie within one known distance, and so do their weights of every token: tracks meet only in
   neighbouring cells of the shared token's weight and of the duration. So a token in every track does not
   bring all of them together.
5. What a pair has in common before its rarest shared token is at most the product of both lengths there. Only pairs
   whose bound reaches the floor are scored in full.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from encore.sources.stage import staged

DIGITS = 9
SLACK = 2e-9
TOKEN = ["field", "token"]


def _signature(words_only: bool = False) -> list[Column]:
    """Hashes of a track's coordinates, whatever their order."""
    counted = F.when(F.col("field") != "duration", F.xxhash64(*TOKEN, "weight")) if words_only else F.xxhash64(*TOKEN, "weight")
    again = F.xxhash64("weight", *TOKEN, F.lit(1))
    if words_only:
        again = F.when(F.col("field") != "duration", F.xxhash64(*TOKEN))
        counted = F.when(F.col("field") != "duration", F.xxhash64("token", "field"))
    return [F.bit_xor(counted), F.bit_xor(again), F.count(F.lit(1))]


def _points(vectors: DataFrame, k: int) -> DataFrame:
    """The coordinates of the k + 1 smallest ids of equal vectors; tracks without length are left out."""
    same = ["h1", "h2", "n"]
    tracks = vectors.groupBy("tid").agg(*[c.alias(n) for c, n in zip(_signature(), same)])
    salt = F.pmod(F.xxhash64("tid"), F.lit(64))
    for keys in ([*same, "salt"], same):
        tracks = tracks.withColumn("salt", salt).withColumn(
            "copy", F.row_number().over(W.partitionBy(*keys).orderBy("tid"))).filter(F.col("copy") <= k + 1)
    return vectors.join(tracks.select("tid"), "tid", "left_semi")


def scored(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id_a, id_b, cosine_similarity) of given pairs."""
    a = vectors.select(F.col("tid").alias("id_a"), *TOKEN, F.col("weight").alias("w_a"))
    b = vectors.select(F.col("tid").alias("id_b"), *TOKEN, F.col("weight").alias("w_b"))
    return pairs.join(a, "id_a").join(b, ["id_b", *TOKEN]).groupBy("id_a", "id_b").agg(
        F.round(F.sum(F.col("w_a") * F.col("w_b")), DIGITS).alias("cosine_similarity"))


def _likely(points: DataFrame) -> DataFrame:
    """Neighbours by duration among tracks of the same words, and the first two tracks of each rarest token."""
    duration = F.coalesce(F.max(F.when(F.col("field") == "duration", F.col("weight"))), F.lit(0.0)).alias("duration")
    tracks = points.groupBy("tid").agg(*[c.alias(n) for c, n in zip(_signature(True), ("h1", "h2", "n"))], duration)
    in_order = W.partitionBy("h1", "h2").orderBy("duration", "tid")
    beside = tracks.select("tid", F.lead("tid").over(in_order).alias("other"))
    heaviest = points.filter("field <> 'duration'").groupBy("tid").agg(
        F.max_by(F.struct(*TOKEN), F.struct("weight", *TOKEN)).alias("heaviest"))
    first = heaviest.groupBy("heaviest").agg(F.min("tid").alias("tid"), F.max("tid").alias("other")).select("tid", "other")
    return beside.union(first).filter("other <> tid").select(
        F.least("tid", "other").alias("id_a"), F.greatest("tid", "other").alias("id_b")).distinct()


def candidates(points: DataFrame, floor: Column) -> DataFrame:
    """(id_a, id_b): all pairs whose cosine may reach the floor, a positive number."""
    held = points.groupBy(*TOKEN).agg(F.count(F.lit(1)).alias("df"), F.max("weight").alias("most"))
    frequent_first = W.partitionBy("tid").orderBy(F.desc("df"), *TOKEN)
    upto = frequent_first.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = frequent_first.rowsBetween(W.unboundedPreceding, -1)
    square = F.col("weight") * F.col("weight")
    placed = points.join(held, TOKEN).select(
        "tid", *TOKEN, "weight", floor.alias("floor"),
        F.least(F.sqrt(F.sum(square).over(upto)), F.sum(F.col("weight") * F.col("most")).over(upto)).alias("reached"),
        F.coalesce(F.sqrt(F.sum(square).over(before)), F.lit(0.0)).alias("length"),
        F.max(F.when(F.col("field") == "duration", F.col("weight")).otherwise(0.0)).over(W.partitionBy("tid")).alias("duration"))
    # coordinates of two vectors of length 1 with this cosine differ by no more than their distance
    width = F.sqrt(F.greatest(F.lit(2.0) - 2.0 * F.col("floor"), F.lit(0.0)) + SLACK)
    rare = staged(placed.filter(F.col("reached") >= F.col("floor") - SLACK).withColumns({
        "cell": F.floor(F.col("weight") / width).cast("bigint"),
        "at": F.floor(F.col("duration") / width).cast("bigint")}), "rare-words")

    def side(name, *columns):
        return rare.select(F.col("tid").alias(f"id_{name}"), *TOKEN, *[F.col(c).alias(f"{c}_{name}") for c in ("weight", "length")], *columns)

    steps = F.array(*[F.lit(i).cast("bigint") for i in (-1, 0, 1)])
    asking = (side("a", "floor", "cell", "at").withColumn("step", F.explode(steps)).withColumn("cell", F.col("cell") + F.col("step"))
              .withColumn("step", F.explode(steps)).withColumn("at", F.col("at") + F.col("step")).drop("step"))
    bound = F.col("weight_a") * F.col("weight_b") + F.col("length_a") * F.col("length_b")
    # each pair is formed at every rare token it shares; the bound holds at the rarest
    return asking.join(side("b", "cell", "at"), [*TOKEN, "cell", "at"]).filter(
        (F.col("id_a") < F.col("id_b")) & (bound >= F.col("floor") - SLACK)).select("id_a", "id_b").distinct()


def most_similar_by_text(vectors: DataFrame, k: int = 20) -> DataFrame:
    """(id_a, id_b, cosine_similarity): the k pairs with the highest cosine among (tid, field, token, weight) of length 1.

    Ties go to the smaller ids. Pairs with a cosine of 0 are not listed.
    """
    held = staged(vectors.filter("weight > 0"), "text-vectors")
    points = staged(_points(held, k), "text-points")
    ranking = [F.desc("cosine_similarity"), "id_a", "id_b"]
    likely = staged(scored(_likely(points), points).orderBy(*ranking).limit(k), "likely-texts")
    floor = likely.agg(F.greatest(F.when(F.count(F.lit(1)) == k, F.min("cosine_similarity")).otherwise(0.0), F.lit(1e-9))).scalar()
    return scored(candidates(points, floor), points).orderBy(*ranking).limit(k)
