"""Groups of near copies from buckets of nodes, without forming the pairs of a bucket.

A search puts every node into buckets such that two linked nodes share one. `grouped` finds the groups that all links
together make:

1. In each bucket every node is checked against one hub, the node that shares most with others: in a crowd of near
   copies that is the text they come from, and most of them are linked with it.
2. Small buckets that still hold several groups: pairs of nodes of different groups are checked. A bucket of at most
   `SMALL` nodes gives each node that many pairs at most.
3. Large buckets that still hold several groups: the nodes outside a bucket's largest group are its strays. The
   largest group, the strays of all buckets where it is the largest, and the other nodes there make a crowd; strays are
   compared with the whole crowd block by block, as a query set with all rows. Rows are dealt out by block. Within a
   block a link joins two groups at once, and what leaves the block is one pair for each group that it has joined to
   others: the groups of its rows with the smallest among them, those of its strays likewise, and the two smallest.
   Blocks of the same rows or strays mostly give the same pairs, so the distinct ones grow with the crowd, not with its
   square.

So every pair that shares a bucket is either checked or already in one group, and n near copies cost about n checks
and a comparison with the strays among them. Two nodes of one group need no check, as their link could not change
anything. Minima and counts combine before the shuffle, and the joins are plain ones that adaptive execution can split.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.sources.stage import staged

MAX_ROUNDS = 60
#: Buckets up to this size are small. A block holds about so many strays, and so many rows of a crowd.
SMALL = 24
STRAYS, ROWS = 128, 512
Compare = Callable[..., Iterator[tuple[int, int]]]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (a, b): the smallest node that can be reached, itself included.

    Alternating large-star and small-star steps; a round shortens every path to about its logarithm, and each
    round's edges are written, so the lineage stays short. Empty edges give an empty table.
    """
    edges = staged(_sorted_pairs(edges), "edges")
    for _ in range(MAX_ROUNDS):
        if _are_stars(edges):
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
                edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low"))
        large = both.join(low.select("a", F.least("a", "low").alias("low")), "a").filter(F.col("b") > F.col("a"))
        large = _sorted_pairs(large.select("b", F.col("low").alias("a")))
        low = large.groupBy("b").agg(F.min("a").alias("low"))
        small = large.join(low, "b")
        small = small.filter(F.col("a") != F.col("low")).select(F.col("low").alias("a"), F.col("a").alias("b")).union(
            small.select(F.col("low").alias("a"), "b"))
        edges = staged(_sorted_pairs(small), "edges")
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every larger end has one smaller end, which is no larger end itself; each root is then its group's smallest."""
    ends = edges.select(F.col("b").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(
        edges.select(F.col("a").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    each = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return each.filter("below > 1 or below + above > 1").isEmpty()


def _sorted_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def grouped(buckets: DataFrame, prepare: Callable[[DataFrame], DataFrame],
            linked: Callable[[DataFrame, DataFrame], DataFrame], payload: str, compare: Compare,
            spared: bool = False, pairs: DataFrame | None = None) -> DataFrame:
    """(node, root) of all nodes that have a link; root is the smallest node of the group.

    buckets: (bucket, node), each row once or more. prepare: gets the nodes that share a bucket with others, returns
    a written table with what a check needs of them. linked: gets distinct pairs (a, b) with a < b and that table,
    returns the pairs that are links. compare: gets the column `payload` of two lists of nodes, and gives the pairs of
    positions that are links. With `spared` it gets a third argument, which says of a position in the first list and
    positions in the second whether they are in different groups as yet; the others need no look. `pairs`: the
    nodes (a, b) of buckets that hold two; `buckets` then has the others of several nodes, written, without repeated
    rows, and with a column `size` by which buckets weigh.
    """
    if pairs is not None:
        shared, measured = buckets.select("bucket", "node"), buckets
        pairs = staged(_sorted_pairs(pairs), "pairs")
    else:
        several = buckets.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high")
        shared = staged(buckets.join(several.select("bucket"), "bucket", "left_semi").distinct(), "shared-buckets")
        measured = shared.join(shared.groupBy("bucket").agg(F.count("*").alias("size")), "bucket")
    nodes = shared.select("node")
    if pairs is not None:
        nodes = nodes.union(pairs.select("a")).union(pairs.select("b"))
    held = prepare(nodes.distinct())

    weight = measured.groupBy("node").agg(F.sum("size").alias("weight"))
    hubs = shared.join(weight, "node").groupBy("bucket").agg(
        F.max_by("node", F.struct("weight", "node")).alias("hub"))
    tested = shared.join(hubs, "bucket").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    tested = staged(_sorted_pairs(tested if pairs is None else tested.union(pairs)), "hub-pairs")
    links = staged(linked(tested, held).select("a", "b"), "links")
    roots = components(links)

    placed = shared.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    counts = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("bucket").agg(
        F.max_by("root", F.struct("n", "root")).alias("largest"), F.sum("n").alias("size"),
        F.count("*").alias("roots")).filter("roots > 1")
    open_rows = staged(placed.join(mixed.select("bucket", "largest", "size"), "bucket"), "open-buckets")
    small = open_rows.filter(F.col("size") <= SMALL).select("bucket", "node", "root", "largest")
    few = small.filter("root <> largest").select("bucket", F.col("node").alias("x"), F.col("root").alias("rx"))
    met = few.join(small, "bucket").filter((F.col("rx") != F.col("root")) & (
        (F.col("root") == F.col("largest")) | (F.col("x") < F.col("node"))))
    across = _sorted_pairs(met.select(F.col("x").alias("a"), F.col("node").alias("b")))
    across = staged(across.join(tested, ["a", "b"], "left_anti"), "cross-pairs")
    more = staged(linked(across, held).select("a", "b").union(
        _within_crowds(open_rows.filter(F.col("size") > SMALL), held, payload, compare, spared)), "links")
    return roots if more.isEmpty() else components(roots.toDF("a", "b").union(more))


class Groups:
    """The groups of a block's strays and rows by their roots, joined as links between them are found."""

    def __init__(self, strays: list, rows: list):
        self.strays = len(strays)
        self.roots, self.own = np.unique(np.array(strays + rows), return_inverse=True)
        self.now = np.arange(len(self.roots))

    def apart(self, i: int, others):
        """Whether stray i and each of those rows are in different groups as yet."""
        return self.now[self.own[self.strays + others]] != self.now[self.own[i]]

    def join(self, i: int, j: int) -> None:
        old, new = sorted((self.now[self.own[i]], self.now[self.own[self.strays + j]]), reverse=True)
        self.now[self.now == old] = new

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of roots that join what the links have joined, with one smallest root for the strays and one for the rows."""
        several = np.bincount(self.now, minlength=len(self.roots))[self.now] > 1
        smallest, found = [], []
        for side in (self.own[:self.strays], self.own[self.strays:]):
            side = np.unique(side)
            side = side[several[side]]
            # roots are in order, so the first of a group is its smallest
            group, first = np.unique(self.now[side], return_index=True)
            smallest.append(side[first])
            found.append((side[first][np.searchsorted(group, self.now[side])], side))
        # a joined group has both strays and rows, so the two lists of smallest ones go by the same groups
        a, b = (np.concatenate(x) for x in zip(*found, smallest))
        return self.roots[a[a != b]], self.roots[b[a != b]]


def _within_crowds(rows: DataFrame, held: DataFrame, payload: str, compare: Compare, spared: bool) -> DataFrame:
    """Distinct pairs (a, b) of roots that links between strays and nodes of other groups join; rows: (bucket, node, root, largest)."""
    crowd = rows.groupBy("largest", "node").agg(
        F.first("root").alias("root"), F.max(F.col("root") != F.col("largest")).alias("stray"))
    crowd = staged(crowd.withColumnRenamed("largest", "crowd"), "crowds")
    blocks = crowd.groupBy("crowd").agg(
        F.ceil(F.count("*") / ROWS).cast("int").alias("row_blocks"),
        F.ceil(F.count_if("stray") / STRAYS).cast("int").alias("stray_blocks"))
    every = crowd.join(blocks, "crowd").join(held.select("node", F.col(payload).alias("payload")), "node")
    own = F.xxhash64("node")

    def dealt(table, asking, mine, other):
        part = F.pmod(own, F.col(f"{mine}_blocks")).cast("int").alias(f"{mine}_block")
        all_of = F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)).alias(f"{other}_block")
        return table.select("crowd", "node", "root", "payload", F.lit(asking).alias("asks"), part, all_of)

    both = dealt(every.filter("stray"), True, "stray", "row").unionByName(dealt(every, False, "row", "stray"))
    kind = dict(rows.dtypes)["node"]

    def of(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        a, b = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
        groups = Groups(*(x.column("root").to_pylist() for x in (a, b)))
        lists = [x.column("payload").to_pylist() for x in (a, b)]
        for i, j in compare(*lists, groups.apart) if spared else compare(*lists):
            if groups.apart(i, j):
                groups.join(i, j)
        return pa.table([pa.array(x, table.schema.field("node").type) for x in groups.pairs()], ["a", "b"])

    found = both.groupBy("crowd", "row_block", "stray_block").applyInArrow(of, f"a {kind}, b {kind}")
    return _sorted_pairs(found)
