"""Near vectors against all pairs."""

import math

import numpy as np

from encore.llm import worlds
from encore.llm.queries import QUERIES

NAN, INF = float("nan"), float("inf")


def brute(rows, least=worlds.THRESHOLD):
    """(vec_id, n_links, component_id, kept) of rows (vec_id, vector, label), from all pairs."""
    def good(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n = len(rows)
    unit = [np.array(v) / np.linalg.norm(np.array(v)) if good(v, label) else None for _, v, label in rows]
    groups = {}
    for i, (_, v, label) in enumerate(rows):
        if unit[i] is not None:
            groups.setdefault((label, len(v)), []).append(i)
    links = [[] for _ in range(n)]
    for some in groups.values():
        x = np.array([unit[i] for i in some])
        for a, b in np.argwhere(x @ x.T >= least):
            if a != b:
                links[some[a]].append(some[b])
    root = [None] * n
    for i in range(n):
        if root[i] is None:
            todo, seen = [i], {i}
            while todo:
                for j in links[todo.pop()]:
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
            for j in seen:
                root[j] = (low,)
    return sorted(((r[0], len(links[i]), root[i][0], r[0] == root[i][0]) for i, r in enumerate(rows)), key=repr)


def collected(table):
    return sorted((tuple(r) for r in table.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def test_all_embeddings(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    assert collected(QUERIES["op12_small_worlds"](spark, small)) == brute(rows)
    assert sum(r[1] for r in brute(rows, 0.3))
    assert collected(worlds.near_vectors(table, least=0.3)) == brute(rows, 0.3)


def crowds():
    """Two crowds of near copies, many copies of one vector, and strangers; in three labels."""
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(2, 24))
    x = [*(centre[0] + 0.1 * rng.normal(size=(150, 24))), *(centre[1] + 0.25 * rng.normal(size=(120, 24))),
         *([centre[0]] * 60), *rng.normal(size=(200, 24))]
    return [(int(i), [float(v) for v in x[j]], int(j % 3)) for i, j in enumerate(rng.permutation(len(x)))]


def test_shards_search_each_other(spark):
    rows = crowds()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = brute(rows)
    for shard_rows in (worlds.SHARD_ROWS, 40):
        assert collected(worlds.near_vectors(table.repartition(5), shard_rows=shard_rows)) == want


def test_odd_rows(spark):
    rows = [
        (1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [NAN, 1.0], 0), (6, [INF, 1.0], 0),
        (7, [1.0, 0.0], None), (8, [1.0, 0.0], 0), (9, [2.0, 0.0], 0), (9, [2.0, 0.0], 0), (None, [3.0, 0.1], 0),
        (None, [0.0, 1.0], 0), (10, [1.0, 0.0], 1), (11, [1.0, 0.0, 0.0], 0), (12, [-1.0, 0.0], 0), (13, [1e-30, 0.0], 0),
        (None, None, None), (8, [0.0, -1.0], 5), (14, [-0.0, -1.0], 5)]
    table = spark.createDataFrame(
        [(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, node string, row int")
    assert collected(worlds.near_vectors(table)) == brute(rows)
    assert collected(worlds.near_vectors(table, shard_rows=2)) == brute(rows)
    assert worlds.near_vectors(table.limit(0)).collect() == []


def test_audit_widens_a_poor_search(spark):
    x = np.array([v for _, v, _ in crowds()])
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = worlds.build(x)
    graph.links[0][:, 1:] = -1  # a graph that leads nearly nowhere
    truth = x @ x.T >= worlds.THRESHOLD
    def of(**audit):
        return np.unpackbits(worlds.searched(graph, x, True, worlds.THRESHOLD, 4, 0.0, **audit), axis=1, count=len(x))
    assert of(recall=0.0).sum() < 0.9 * truth.sum()
    assert (of() == truth).all()


def test_recall_of_graphs():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 64))
    x = centres[rng.integers(0, 60, 3000)] + 0.2 * rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = worlds.build(x)
    truth = x @ x.T >= worlds.THRESHOLD
    found = np.concatenate([graph.within(x[a:a + 200], None, worlds.WIDTH, worlds.SLACK, worlds.THRESHOLD)
                            for a in range(0, len(x), 200)])
    assert truth.sum() > 10 * len(x)
    assert not (found & ~truth).any() and (found & truth).sum() >= 0.99 * truth.sum()
