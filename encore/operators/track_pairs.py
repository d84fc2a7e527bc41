"""The most alike pairs of tracks by cosine, exactly and without forming all pairs.

On unit vectors a cosine is a distance, so the list is a search for the closest pairs:

1. Equal vectors are interchangeable; a list of k pairs uses at most their k + 1 smallest ids.
2. Pairs that share a cell of grids of several widths are scored; their k-th best cosine is a floor.
3. Vectors that reach the floor lie within one known radius, hence in neighbouring cells of a grid
   of that width. Only such pairs are formed.
"""

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from encore.sources.stage import staged

DIGITS = 9
SLACK = 2e-9
GRID_BITS = (0, 2, 4, 6, 8, 10, 12, 14)


def _dot(a: list[Column], b: list[Column]) -> Column:
    return F.round(reduce(Column.__add__, [x * y for x, y in zip(a, b)]), DIGITS)


def most_similar_pairs(items: DataFrame, k: int = 20, dimensions: int = 4) -> DataFrame:
    """(id_a, id_b, cosine_similarity) of the k closest pairs among (item_id, vector of length 1 or 0).

    Ties go to the smaller ids. A zero vector has cosine 0 with everything.
    """
    v = [f"v{i}" for i in range(dimensions)]
    copies = W.partitionBy(*v).orderBy("item_id")
    points = staged(
        items.select("item_id", *[F.col("vector")[i].alias(c) for i, c in enumerate(v)])
        .withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).drop("copy"), "points")
    ranking = [F.desc("cosine_similarity"), "id_a", "id_b"]

    cells = F.array(*[
        F.struct(F.lit(bits).alias("bits"), F.array(*[F.floor(F.col(c) * 2 ** bits).cast("bigint") for c in v]).alias("cell"))
        for bits in GRID_BITS])
    in_cell = W.partitionBy("bits", "cell").orderBy("item_id")
    few = (points.select("item_id", *v, F.inline(cells))
           .withColumn("nth", F.row_number().over(in_cell)).filter(F.col("nth") <= k + 1))
    held = F.struct("item_id", *v)
    grouped = (few.groupBy("bits", "cell").agg(F.min_by(held, "nth").alias("a"), F.collect_list(held).alias("all"))
               .select("a", F.explode("all").alias("b")))  # at most k + 1 of a cell
    likely = staged(
        grouped.filter(F.col("a.item_id") < F.col("b.item_id"))
        .select(F.col("a.item_id").alias("id_a"), F.col("b.item_id").alias("id_b"),
                _dot([F.col(f"a.{c}") for c in v], [F.col(f"b.{c}") for c in v]).alias("cosine_similarity"))
        .distinct().orderBy(*ranking).limit(k), "likely-tracks")
    full = F.count(F.lit(1)) == k
    floor = likely.agg(F.when(full, F.min("cosine_similarity")).otherwise(F.lit(-1.0))).scalar()
    last = likely.agg(F.max(F.struct(-F.col("cosine_similarity"), "id_a"))["id_a"]).scalar()

    # A zero vector lies 1 away from any unit vector, so it is in reach whenever the floor is 0 or less.
    width = F.sqrt(F.greatest(F.lit(2.0) - 2.0 * floor, F.lit(0.0)) + SLACK)
    axes = v[:3]
    gridded = points.withColumns({"width": width, "floor": floor, "last": last}).withColumns(
        {f"cell{i}": F.floor(F.col(c) / F.col("width")).cast("bigint") for i, c in enumerate(axes)})
    around = F.array(*[F.struct(*[F.lit(o).alias(f"step{i}") for i, o in enumerate(offset)])
                       for offset in product((-1, 0, 1), repeat=len(axes))])
    left = (
        gridded.filter((F.col("floor") < 1.0) | (F.col("item_id") <= F.col("last")))
        .select(F.col("item_id").alias("id_a"), "floor", *[F.col(c).alias(f"{c}_a") for c in v],
                *[F.col(f"cell{i}").alias(f"at{i}") for i in range(len(axes))], F.inline(around))
        .select("id_a", "floor", *[f"{c}_a" for c in v],
                *[(F.col(f"at{i}") + F.col(f"step{i}")).alias(f"cell{i}") for i in range(len(axes))]))
    right = gridded.select(F.col("item_id").alias("id_b"), *[F.col(c).alias(f"{c}_b") for c in v],
                           *[f"cell{i}" for i in range(len(axes))])
    met = left.join(right, [f"cell{i}" for i in range(len(axes))]).filter(F.col("id_a") < F.col("id_b"))
    return (
        met.withColumn("cosine_similarity", _dot([F.col(f"{c}_a") for c in v], [F.col(f"{c}_b") for c in v]))
        .filter(F.col("cosine_similarity") >= F.col("floor"))
        .select("id_a", "id_b", "cosine_similarity").orderBy(*ranking).limit(k))
