"""Near-duplicate vectors by hierarchical navigable small-world graphs, one for each shard.

Vectors are compared only with those of their label and length. Equal vectors become one node with a weight, so a
crowd of copies is one node whatever its size. The nodes of a label are dealt by hash into shards of about
`shard_rows`. Each shard's graph is built once and written: every node has a random height, and on each layer up to that
height it is linked with near and mutually distant nodes. Every node then searches every shard of its label: descending
from the top layer with a beam, then on the lowest layer with a beam of `width` nodes. All nodes found within `slack` of
the threshold are searched from as well, so a crowd of near copies is followed to its end however wide the beam is. Of
two shards one searches the other, as the cosine is the same both ways.

Before a pair of shards is done, up to `AUDIT` of its queries are also compared with the whole shard. Where the search
found less than `RECALL` of their links, beam and slack are doubled and all queries search again; beyond an eighth of the
shard the beam is as wide as the shard, meets every node and misses nothing. Links are those whose cosine in double precision reaches the threshold.

Links are counted where they are found, and only a spanning forest of them leaves a task: at most one row for each node
of the two shards. Components are united over those rows. A task holds two shards, one graph and a bit for each of their
pairs. A label of k shards costs k (k + 1) / 2 such tasks and moves each of its nodes k + 1 times.

Defined cases: null, zero or empty vectors, those with null or non-finite components, and those without a label link
with nothing. Every row is a vector of its own; rows that repeat a vec_id are different vectors, of equal ids or not. A
null vec_id is never the smallest of a component that holds an id; kept tells whether vec_id equals component_id, both
null counting as equal. Extra columns are ignored, an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.llm.links import components
from encore.sources.stage import staged

THRESHOLD = 0.93
SHARD_ROWS = 1 << 14
#: Links of a node on the upper layers, twice as many on the lowest; candidates while building, and of a search.
DEGREE, BUILD_WIDTH, WIDTH, UPPER_WIDTH = 16, 64, 48, 8
SLACK = 0.03
AUDIT, RECALL = 1024, 0.99
#: Nodes inserted at once, queries at once, pairs compared at once.
BATCH, QUERIES, PAIRS = 512, 256, 1 << 16
#: A beam goes on from so many of its nodes at once.
STEP = 4


class Graph:
    """Layers of links over unit vectors; links[layer] has a row for each node, -1 where there is none."""

    def __init__(self, vectors: np.ndarray, links: list[np.ndarray], entry: int):
        self.vectors, self.links, self.entry = vectors, links, entry

    def beam(self, asked: np.ndarray, layer: int, start: np.ndarray, width: int, seen: np.ndarray | None = None,
             near: np.ndarray | None = None, least: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """The `width` nearest nodes that a beam reaches from `start`, and their cosines, the nearest first.

        seen: marks the nodes that each query met; near: those with a cosine of `least` or more.
        """
        n, q = len(self.vectors), len(asked)
        seen = np.zeros((q, n), dtype=bool) if seen is None else seen
        row = np.repeat(np.arange(q), start.shape[1])
        node = start.ravel()
        row, node = row[node >= 0], node[node >= 0]
        ids = np.full((q, width), -1, dtype=np.int64)
        cosines = np.full((q, width), -np.inf)
        done = np.ones((q, width), dtype=bool)
        links = self.links[layer]
        rows = np.arange(q)
        while len(row):
            met = row * n + node
            met = np.sort(met[~seen.ravel()[met]])
            met = met[np.append(True, met[1:] != met[:-1])[:len(met)]]
            seen.ravel()[met] = True
            row, node = met // n, met % n
            value = self._cosines(asked, row, node)
            if near is not None:
                near.ravel()[met[value >= least]] = True
            # those that beat the last of the beam, as columns beside the beam
            better = value > cosines[row, -1]
            row, node, value = row[better], node[better], value[better]
            if len(row):
                first = np.searchsorted(row, rows)
                place = np.arange(len(row)) - first[row]
                more = int(place.max()) + 1
                wide_ids = np.concatenate((ids, np.full((q, more), -1, dtype=np.int64)), axis=1)
                wide_cosines = np.concatenate((cosines, np.full((q, more), -np.inf)), axis=1)
                wide_done = np.concatenate((done, np.ones((q, more), dtype=bool)), axis=1)
                wide_ids[row, width + place], wide_cosines[row, width + place] = node, value
                wide_done[row, width + place] = False
                order = np.argsort(-wide_cosines, axis=1, kind="stable")[:, :width]
                ids, cosines, done = (np.take_along_axis(x, order, 1) for x in (wide_ids, wide_cosines, wide_done))
            waiting = ~done
            turn = waiting & (np.cumsum(waiting, axis=1) <= STEP)
            done |= turn
            row, at = np.nonzero(turn)
            ends = links[ids[row, at]]
            row, node = np.repeat(row, ends.shape[1]), ends.ravel()
            row, node = row[node >= 0], node[node >= 0]
        return ids, cosines

    def _cosines(self, asked: np.ndarray, row: np.ndarray, node: np.ndarray) -> np.ndarray:
        out = np.empty(len(row))
        for a in range(0, len(row), PAIRS):
            part = slice(a, a + PAIRS)
            out[part] = np.einsum("ij,ij->i", asked[row[part]], self.vectors[node[part]])
        return out

    def within(self, asked: np.ndarray, own: np.ndarray | None, width: int, slack: float, least: float) -> np.ndarray:
        """For each query the nodes with a cosine of `least` or more that the search finds, as a mask.

        own: the queries' own nodes, where they are nodes of this graph.
        """
        n, q = len(self.vectors), len(asked)
        if width >= n:
            return asked @ self.vectors.T >= least
        start = np.full((q, 1), self.entry)
        for layer in range(len(self.links) - 1, 0, -1):
            start = self.beam(asked, layer, start, UPPER_WIDTH)[0]
        if own is not None:
            start = np.concatenate((start, own[:, None]), axis=1)
        seen, near = np.zeros((q, n), dtype=bool), np.zeros((q, n), dtype=bool)
        ids, _ = self.beam(asked, 0, start, width, seen, near, least - slack)
        gone = np.zeros((q, n), dtype=bool)
        row, at = np.nonzero(ids >= 0)
        gone[row, ids[row, at]] = True
        while True:
            row, node = np.nonzero(near & ~gone)
            if not len(row):
                break
            gone[row, node] = True
            fresh = np.zeros((q, n), dtype=bool)
            for a in range(0, len(row), PAIRS):
                ends = self.links[0][node[a:a + PAIRS]]
                held = ends >= 0
                fresh[np.repeat(row[a:a + PAIRS], held.sum(axis=1)), ends[held]] = True
            fresh &= ~seen
            seen |= fresh
            row, node = np.nonzero(fresh)
            value = self._cosines(asked, row, node)
            near[row[value >= least - slack], node[value >= least - slack]] = True
        row, node = np.nonzero(near)
        far = self._cosines(asked, row, node) < least
        near[row[far], node[far]] = False
        return near


def _apart(vectors: np.ndarray, ids: np.ndarray, cosines: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates, nearest first, those nearer to the row's node than to any taken before, then the others."""
    out = np.full((len(ids), most), -1, dtype=np.int64)
    for a in range(0, len(ids), BATCH):
        some, value = ids[a:a + BATCH], cosines[a:a + BATCH]
        held = vectors[some]
        between = held @ held.transpose(0, 2, 1)
        taken = np.zeros(some.shape, dtype=bool)
        count = np.zeros(len(some), dtype=np.int64)
        for j in range(some.shape[1]):
            free = (some[:, j] >= 0) & (count < most) & ~(taken & (between[:, j, :] >= value[:, j:j + 1])).any(axis=1)
            taken[:, j] = free
            count += free
        # those taken come first, then the nearest of the others as far as there is room
        order = np.argsort(np.where(taken, 0, np.where(some >= 0, 1, 2)), axis=1, kind="stable")[:, :most]
        out[a:a + BATCH, :order.shape[1]] = np.take_along_axis(some, order, 1)
    return out


def _nearest_first(ids: np.ndarray, cosines: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-cosines, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(cosines, order, 1)


def build(vectors: np.ndarray, seed: int = 0) -> Graph:
    """A graph over unit vectors, inserted in random order, in batches no larger than what is there already."""
    n = len(vectors)
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    height = np.minimum((-np.log(1 - rng.random(n)) / np.log(DEGREE)).astype(int), 12)
    links = [np.full((n, 2 * DEGREE if layer == 0 else DEGREE), -1, dtype=np.int64)
             for layer in range(int(height.max(initial=0)) + 1)]
    graph = Graph(vectors, links, int(order[0]))
    top, at = int(height[order[0]]), 1
    while at < n:
        batch = order[at:at + min(at, BATCH)]
        at += len(batch)
        start = np.full((len(batch), 1), graph.entry)
        for layer in range(max(top, int(height[batch].max())), -1, -1):
            placed = height[batch] >= layer
            width = BUILD_WIDTH if layer == 0 else 2 * UPPER_WIDTH
            ids = np.full((len(batch), 1), -1, dtype=np.int64)
            cosines = np.full((len(batch), 1), -np.inf)
            if layer <= top:
                ids, cosines = graph.beam(vectors[batch], layer, start, min(width, at))
                start = ids[:, :UPPER_WIDTH]
            if not placed.any():
                continue
            mine = batch[placed]
            among = vectors[mine] @ vectors[mine].T
            np.fill_diagonal(among, -np.inf)
            peers, likeness = _nearest_first(np.broadcast_to(mine, among.shape), among, DEGREE)
            peers = np.where(np.isfinite(likeness), peers, -1)
            ids, cosines = _nearest_first(np.concatenate((ids[placed], peers), axis=1),
                                          np.concatenate((cosines[placed], likeness), axis=1), width)
            chosen = _apart(vectors, ids, cosines, DEGREE)
            links[layer][mine, :DEGREE] = chosen
            _link_back(graph, layer, mine, chosen)
        best = int(batch[np.argmax(height[batch])])
        if height[best] > top:
            graph.entry, top = best, int(height[best])
    return graph


def _link_back(graph: Graph, layer: int, mine: np.ndarray, chosen: np.ndarray) -> None:
    links, vectors = graph.links[layer], graph.vectors
    most = links.shape[1]
    row, at = np.nonzero(chosen >= 0)
    end, new = chosen[row, at], mine[row]
    value = np.einsum("ij,ij->i", vectors[end], vectors[new])
    order = np.lexsort((-value, end))
    end, new, value = end[order], new[order], value[order]
    ends, first, count = np.unique(end, return_index=True, return_counts=True)
    place = np.arange(len(end)) - np.repeat(first, count)
    fits = place < most
    side = np.full((len(ends), most), -1, dtype=np.int64)
    side[np.repeat(np.arange(len(ends)), count)[fits], place[fits]] = new[fits]
    ids = np.concatenate((links[ends], side), axis=1)
    # a node of the batch may have chosen its peer as well
    ids.sort(axis=1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    size = (ids >= 0).sum(axis=1)
    cosines = np.where(ids >= 0, np.einsum("ijk,ik->ij", vectors[ids], vectors[ends]), -np.inf)
    ids, cosines = _nearest_first(ids, cosines, 2 * most)
    links[ends] = ids[:, :most]
    full = size > most
    if full.any():
        links[ends[full]] = _apart(vectors, ids[full], cosines[full], most)


def _unit(cells: pa.ChunkedArray, dimensions: int) -> np.ndarray:
    vectors = np.frombuffer(b"".join(cells.to_pylist()), dtype="<f8").reshape(-1, dimensions)
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    vectors = vectors / largest
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def _rows(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(row, vec_id, label, size, vector, digest) of every row; vector and digest are null where nothing can be linked."""
    plain = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"),
                           F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    kind = dict(plain.dtypes)["label"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, sizes = [], []
            for label, vector in zip(batch.column(2), batch.column(3)):
                values = np.zeros(0)
                if label.is_valid and vector.is_valid:
                    values = vector.values.to_numpy(zero_copy_only=False).astype("<f8")
                good = len(values) > 0 and np.isfinite(values).all() and values.any()
                cells.append(values.tobytes() if good else None), sizes.append(len(values) if good else 0)
            digests = [None if c is None else hashlib.sha256(c).digest() for c in cells]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sizes, pa.int32()), pa.array(cells, pa.binary()),
                 pa.array(digests, pa.binary())], ["row", "vec_id", "label", "size", "vector", "digest"])

    return plain.mapInArrow(of, f"row long, vec_id long, label {kind}, size int, vector binary, digest binary")


def _graphs(nodes: DataFrame, seed: int) -> DataFrame:
    """(label, size, shard, node, weight, vector, at, entry, links): every node with its links, layer by layer."""
    kinds = ", ".join(f"{n} {dict(nodes.dtypes)[n]}" for n in ("label", "size", "shard", "node", "weight", "vector"))

    def of(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        graph = build(_unit(table.column("vector"), table.column("size")[0].as_py()), seed)
        cells = [np.concatenate([layer[i] for layer in graph.links]).astype("<i4").tobytes()
                 for i in range(table.num_rows)]
        out = table.select(["label", "size", "shard", "node", "weight", "vector"])
        out = out.append_column("at", pa.array(np.arange(table.num_rows, dtype=np.int32)))
        out = out.append_column("entry", pa.array(np.full(table.num_rows, graph.entry, dtype=np.int32)))
        return out.append_column("links", pa.array(cells, pa.binary()))

    return nodes.groupBy("label", "size", "shard").applyInArrow(of, f"{kinds}, at int, entry int, links binary")


def _held(table: pa.Table, linked: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, Graph | None]:
    """Nodes, weights, unit vectors and graph of a shard."""
    table = table.sort_by("at")
    vectors = _unit(table.column("vector"), table.column("size")[0].as_py())
    graph = None
    if linked:
        flat = np.frombuffer(b"".join(table.column("links").to_pylist()), dtype="<i4").reshape(len(vectors), -1)
        cuts = [0, *range(2 * DEGREE, flat.shape[1] + 1, DEGREE)]
        graph = Graph(vectors, [flat[:, a:b].astype(np.int64) for a, b in zip(cuts[:-1], cuts[1:])],
                      table.column("entry")[0].as_py())
    return table.column("node").to_numpy(), table.column("weight").to_numpy(), vectors, graph


def searched(graph: Graph, asked: np.ndarray, same: bool, least: float, width: int, slack: float,
             audit: int = AUDIT, recall: float = RECALL) -> np.ndarray:
    """The links of all queries, as packed bits [query, node]; beams are widened until the audit passes."""
    n = len(graph.vectors)
    found = np.zeros((len(asked), -(-n // 8)), dtype=np.uint8)
    tested = np.unique(np.linspace(0, len(asked) - 1, min(audit, len(asked))).astype(int))
    truth = np.concatenate([np.packbits(asked[some] @ graph.vectors.T >= least, axis=1)
                            for some in np.array_split(tested, -(-len(tested) // QUERIES))])
    wanted = np.unpackbits(truth).sum()
    while True:
        for a in range(0, len(asked), QUERIES):
            own = np.arange(a, min(a + QUERIES, len(asked))) if same else None
            found[a:a + QUERIES] |= np.packbits(graph.within(asked[a:a + QUERIES], own, width, slack, least), axis=1)
        if width >= n or np.unpackbits(found[tested] & truth).sum() >= recall * wanted:
            return found
        width, slack = 2 * width if 16 * width < n else n, 2 * slack


def _merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`root`, the smallest member of each node's group, after the groups of a[i] and b[i] became one."""
    while True:
        low = np.minimum(root[a], root[b])
        if (low == root[a]).all() and (low == root[b]).all():
            return root
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]


def _links(graphs: DataFrame, least: float, width: int, slack: float) -> DataFrame:
    """(node, links, root): the weight of a node's links in a pair of shards, and the smallest node they lead to there."""
    shards = graphs.groupBy("label", "size").agg((F.max("shard") + 1).alias("shards"))
    every = graphs.join(shards, ["label", "size"])
    asked = every.toDF(*every.columns).withColumn("other", F.explode(F.sequence("shard", F.col("shards") - 1))).select(
        F.col("label").alias("l"), F.col("size").alias("d"), F.col("shard").alias("i"), F.col("other").alias("j"),
        "size", "node", "weight", "vector", "at")
    held = every.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shard")))).select(
        "label", "size", F.col("other").alias("i"), F.col("shard").alias("j"), "node", "weight", "vector", "at",
        "entry", "links")

    def of(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:  # the hash has left a shard empty
            return pa.table({n: pa.array([], pa.int64()) for n in ("node", "links", "root")})
        same = asked.column("i")[0].as_py() == asked.column("j")[0].as_py()
        mine, my_weights, queries, _ = _held(asked, False)
        nodes, weights, _, graph = _held(held, True)
        q, n = len(mine), len(nodes)
        found = searched(graph, queries, same, least, width, slack)
        base = 0 if same else q
        counts = np.zeros(base + n, dtype=np.int64)
        # places are in the order of nodes, so that the smallest place is the smallest node
        names = nodes if same else np.concatenate((mine, nodes))
        rank = np.argsort(np.argsort(names))
        root = np.arange(base + n)
        for a in range(0, q, QUERIES):
            z = min(a + QUERIES, q)
            bits = np.unpackbits(found[a:z], axis=1, count=n).astype(bool)
            if same:
                # a link found from either end counts for both
                bits |= np.unpackbits(found[:, a // 8:-(-z // 8)], axis=1)[:, :z - a].astype(bool).T
                bits[np.arange(z - a), np.arange(a, z)] = False
            row, node = np.nonzero(bits)
            counts[a:z] += np.bincount(row, weights[node], z - a).astype(np.int64)
            if not same:
                counts[q:] += np.bincount(node, my_weights[a + row], n).astype(np.int64)
            root = _merged(root, rank[a + row], rank[base + node])
        at = np.flatnonzero(counts)
        inverse = np.argsort(rank)
        return pa.table({"node": names[at], "links": counts[at], "root": names[inverse[root[rank[at]]]]})

    return asked.groupBy("l", "d", "i", "j").cogroup(held.groupBy("label", "size", "i", "j")).applyInArrow(
        of, "node long, links long, root long")


def near_vectors(vectors: DataFrame, least: float = THRESHOLD, width: int = WIDTH, slack: float = SLACK,
                 shard_rows: int = SHARD_ROWS, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label", seed: int = 0) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    rows = staged(_rows(vectors, id_col, vector_col, label_col), "vectors")
    valid = rows.filter("digest is not null")
    # the smallest row stands for all copies of a vector
    classes = staged(valid.groupBy("label", "size", "digest").agg(
        F.min("row").alias("node"), F.count("*").alias("weight"), F.min("vec_id").alias("low")), "vector-classes")
    shards = classes.groupBy("label", "size").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    nodes = classes.join(valid.select(F.col("row").alias("node"), "vector"), "node").join(
        shards, ["label", "size"]).withColumn("shard", F.pmod(F.xxhash64("node"), "shards").cast("int"))
    graphs = staged(_graphs(nodes, seed), "graphs")
    links = staged(_links(graphs, least, width, slack), "vector-links")
    roots = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    found = links.groupBy("node").agg(F.sum("links").alias("links"))
    placed = classes.join(roots, "node", "left").join(found, "node", "left").select(
        "label", "size", "digest", "weight", "low", F.coalesce("root", "node").alias("root"),
        F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    smallest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    members = placed.join(smallest, "root").select(
        "label", "size", "digest", (F.col("links") + F.col("weight") - 1).alias("n_links"), "component_id")
    linked = valid.select("vec_id", "label", "size", "digest").join(members, ["label", "size", "digest"]).select(
        "vec_id", "n_links", "component_id")
    alone = rows.filter("digest is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
