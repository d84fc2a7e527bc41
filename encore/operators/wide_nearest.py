"""The k nearest vectors of every vector by cosine, for many dimensions, exactly.

Vectors gather around centroids, a sample of them of bounded size that does not depend on how the rows lie. A cluster's radius is
the widest angle between its centroid and a member. Every vector first searches its own cluster; the k-th best
cosine found there says how far it still has to look. A cluster whose centroid lies further away than that and the radius
together can't hold a nearer vector and is left out; the members of the others are compared. How many clusters that
spares depends on the data: on vectors without any clusters the bound spares none, and all are compared.

Of equal vectors a list can use the k + 1 smallest ids. Clusters are split into parts of about `PART` vectors, so one
cluster may hold any share of them, and a task compares one part with the vectors that ask for it, `ASKING` at a time.
For the other clusters, small ones share a block of `BLOCK` parts' vectors; a block of vectors that ask meets a block of
members in one task, which writes only those at least as near as the k-th of the own cluster. So n vectors that all must
be compared are sent 2 n / (PART * BLOCK) times, in groups of bounded size, instead of once for each cluster.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from encore.functions.vectors import l2_normalised
from encore.sources.stage import staged

CENTROIDS, PART, ASKING, SALTS = 1024, 8192, 4096, 64
BLOCK, CELLS = 4, 1 << 22
DIGITS = 9
SLACK = 2e-9


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return rows.flatten().to_numpy().reshape(len(rows), -1)


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def _centroids(units: DataFrame, most: int) -> np.ndarray:
    """At most `most` vectors, those with the smallest md5 of their ids, and no more than the root of their number."""
    n = units.count()
    if n == 0:
        return np.zeros((0, 0))
    wanted = min(most, int(np.ceil(np.sqrt(n))))
    rows = units.orderBy(F.md5(F.col("item_id").cast("string")), "item_id").limit(wanted).select("unit").toArrow()
    return _matrix(rows.column("unit"))


def _assigned(units: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(item_id, unit, cluster, angle): every vector with its nearest centroid."""
    kind = dict(units.dtypes)["item_id"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cosines = _matrix(batch.column(1)) @ centroids.T
                best = cosines.argmax(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(best.astype(np.int32)), pa.array(_angles(cosines.max(axis=1)))],
                    ["item_id", "unit", "cluster", "angle"])

    return units.select("item_id", "unit").mapInArrow(of, f"item_id {kind}, unit array<double>, cluster int, angle double")


def _best_of_parts(asking: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(query_id, item_id, score): of each part a vector asks for, the k + 1 nearest members."""
    kind = dict(items.dtypes)["item_id"]

    def of(asking: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        if asking.num_rows and held.num_rows:
            held = held.sort_by("item_id")
            vectors, ids = _matrix(held.column("unit")), held.column("item_id")
            for a in range(0, asking.num_rows, ASKING):
                some = asking.slice(a, ASKING)
                scores = np.round(_matrix(some.column("unit")) @ vectors.T, DIGITS)
                # a stable order of ids already sorted gives ties to the smaller id
                order = np.argsort(-scores, axis=1, kind="stable")[:, :k + 1]
                row = np.repeat(np.arange(len(scores)), order.shape[1])
                out.append(pa.table([some.column("query_id").take(pa.array(row)), ids.take(pa.array(order.ravel())),
                                     np.take_along_axis(scores, order, 1).ravel()], ["query_id", "item_id", "score"]))
        if out:
            return pa.concat_tables(out)
        return pa.table([pa.array([], held.schema.field("item_id").type)] * 2 + [pa.array([], pa.float64())],
                        ["query_id", "item_id", "score"])

    return asking.groupBy("c", "p").cogroup(items.groupBy("cluster", "part")).applyInArrow(
        of, f"query_id {kind}, item_id {kind}, score double")


def _blocks(n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first block, number of blocks) of each cluster: small ones share a block of at most `most` vectors."""
    first, copies = np.zeros(len(n), dtype=np.int64), -(-n // most)
    block, held = 0, 0
    for i, size in enumerate(n.tolist()):
        if held and held + size > most:
            block, held = block + 1, 0
        first[i], held = block, held + size
        if copies[i] > 1:
            block, held = block + int(copies[i]), 0
    return first, copies


def _best_of_blocks(asking: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(query_id, item_id, score): of each block, the k + 1 nearest members of other clusters that reach the floor."""
    kind = dict(items.dtypes)["item_id"]

    def of(asking: pa.Table, held: pa.Table) -> pa.Table:
        out = [pa.table([pa.array([], held.schema.field("item_id").type)] * 2 + [pa.array([], pa.float64())],
                        ["query_id", "item_id", "score"])]
        if asking.num_rows and held.num_rows:
            held = held.sort_by("item_id")
            vectors, ids, clusters = _matrix(held.column("unit")), held.column("item_id"), held.column("cluster").to_numpy()
            step = max(1, CELLS // held.num_rows)
            for a in range(0, asking.num_rows, step):
                some = asking.slice(a, step)
                scores = np.round(_matrix(some.column("unit")) @ vectors.T, DIGITS)
                near = scores >= some.column("floor").to_numpy()[:, None]
                near &= clusters != some.column("cluster").to_numpy()[:, None]
                row, at = np.nonzero(near)
                score = scores[row, at]
                # members are sorted by id, and so are those of a row: a stable order gives ties to the smaller id
                order = np.lexsort((at, -score, row))
                row, at, score = row[order], at[order], score[order]
                best = np.arange(len(row)) - np.searchsorted(row, row) <= k
                out.append(pa.table([some.column("query_id").take(pa.array(row[best])), ids.take(pa.array(at[best])),
                                     score[best]], ["query_id", "item_id", "score"]))
        return pa.concat_tables(out)

    return asking.groupBy("asks", "block").cogroup(items.groupBy("asks", "block")).applyInArrow(
        of, f"query_id {kind}, item_id {kind}, score double")


def nearest_of_every(items: DataFrame, k: int = 10, most_centroids: int = CENTROIDS, part: int = PART) -> DataFrame:
    """(query_id, item_id, cosine_similarity, rank): for each of (item_id, vector) the k others with the highest cosine.

    Ties go to the smaller ids. A vector without length, or with a missing or infinite value, takes no part; ids are unique.
    """
    whole = F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    units = staged(
        items.filter(whole).select("item_id", l2_normalised(F.col("vector").cast("array<double>")).alias("unit"))
        .filter(F.exists("unit", lambda x: x != 0)), "unit-vectors")
    # equal vectors ask once, for all of them, and are asked for as their smallest ids
    classes = units.groupBy("unit").agg(F.min("item_id").alias("rep"))
    members = staged(units.join(classes, "unit").select("item_id", "rep"), "vector-classes")
    few = members.withColumn("salt", F.pmod(F.xxhash64("item_id"), F.lit(SALTS)))
    for keys in (["rep", "salt"], ["rep"]):
        few = few.withColumn("nth", F.row_number().over(W.partitionBy(*keys).orderBy("item_id"))).filter(F.col("nth") <= k + 1)
    points = staged(units.join(members.filter("item_id = rep").select("item_id"), "item_id", "left_semi"), "points")
    centroids = _centroids(points, most_centroids)
    if not len(centroids):
        return units.select(F.col("item_id").alias("query_id"), "item_id", F.lit(0.0).alias("cosine_similarity"),
                            F.lit(0).cast("bigint").alias("rank"))
    placed = staged(_assigned(points, centroids), "assigned")
    clusters = placed.groupBy("cluster").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n"))
    facts = clusters.toArrow()  # one row for each centroid
    cluster, radius, n = (facts.column(c).to_numpy() for c in ("cluster", "radius", "n"))
    parts = -(-n // part)
    parts_of = F.element_at(F.create_map(*[F.lit(int(x)) for pair in zip(cluster, parts) for x in pair]), F.col("cluster"))
    held = staged(placed.withColumn("part", F.pmod(F.xxhash64("item_id"), parts_of).cast("int")).drop("angle"), "parts")
    kind = dict(held.dtypes)["item_id"]

    # first the own cluster: its k-th other member says how far to look
    own = placed.select(F.col("item_id").alias("query_id"), "unit", F.col("cluster").alias("c"),
                        F.explode(F.sequence(F.lit(0), (parts_of - 1).cast("int"))).alias("p"))
    near = staged(_best_of_parts(own, held, k), "own-cluster")
    floors = near.filter("item_id <> query_id").withColumn("nth", F.row_number().over(
        W.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))).filter(F.col("nth") == k).select("query_id", "score")
    asking = placed.select(F.col("item_id").alias("query_id"), "unit", "cluster").join(floors, "query_id", "left").select(
        "query_id", "unit", "cluster", F.coalesce("score", F.lit(-1.0)).alias("floor"))

    # clusters along a line through all, so that near ones share a block
    along = np.argsort(centroids[cluster] @ centroids[0], kind="stable")
    cluster, radius, n = cluster[along], radius[along], n[along]
    first, copies = _blocks(n, BLOCK * part)
    askers = int(-(-n.sum() // (BLOCK * part)))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            angles = _angles(_matrix(batch.column(1)) @ centroids[cluster].T)
            reach = np.cos(np.maximum(angles - radius, 0.0))
            asks = reach >= batch.column(3).to_numpy()[:, None] - SLACK
            asks &= cluster != batch.column(2).to_numpy()[:, None]
            row, at = np.nonzero(asks)
            times = copies[at]
            row, at = np.repeat(row, times), np.repeat(at, times)
            block = first[at] + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            # clusters of one block ask for it once
            row, block = np.unique(np.stack([row, block]), axis=1)
            for a in range(0, len(row), 1 << 14):
                some = slice(a, a + (1 << 14))
                yield pa.RecordBatch.from_arrays(
                    [*batch.take(pa.array(row[some])).columns, pa.array(block[some].astype(np.int32))],
                    ["query_id", "unit", "cluster", "floor", "asks", "block"])

    def placed_at(values):
        return F.element_at(F.create_map(*[F.lit(int(x)) for pair in zip(cluster, values) for x in pair]), F.col("cluster"))

    asking = asking.withColumn("asks", F.pmod(F.xxhash64("query_id"), F.lit(askers)).cast("int"))
    wider = asking.mapInArrow(others, f"query_id {kind}, unit array<double>, cluster int, floor double, asks int, block int")
    blocks = held.select(
        "item_id", "unit", "cluster", F.explode(F.sequence(F.lit(0), F.lit(askers - 1))).alias("asks"),
        (placed_at(first) + F.pmod(F.xxhash64("item_id"), placed_at(copies))).cast("int").alias("block"))
    found = near.unionByName(staged(_best_of_blocks(wider, blocks, k), "other-clusters"))
    ranking = [F.desc("score"), "item_id"]
    by_class = (
        found.select(F.col("query_id").alias("asking"), F.col("item_id").alias("rep"), "score")
        .withColumn("nth", F.row_number().over(W.partitionBy("asking").orderBy(F.desc("score"), "rep")))
        .filter(F.col("nth") <= k + 1).drop("nth").join(few.select("rep", "item_id"), "rep").drop("rep")
        .withColumn("nth", F.row_number().over(W.partitionBy("asking").orderBy(*ranking))).filter(F.col("nth") <= k + 1))
    return (
        members.select(F.col("item_id").alias("query_id"), F.col("rep").alias("asking")).join(by_class, "asking")
        .filter(F.col("query_id") != F.col("item_id"))
        .withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*ranking)).cast("bigint"))
        .filter(F.col("rank") <= k).select("query_id", "item_id", F.col("score").alias("cosine_similarity"), "rank"))
