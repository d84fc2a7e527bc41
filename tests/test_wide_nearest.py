import numpy as np
import pytest

from encore.operators import wide_nearest
from encore.operators.wide_nearest import nearest_of_every

ITEMS = "item_id long, vector array<double>"


def brute(rows, k):
    held = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and None not in v and np.any(v) and np.all(np.isfinite(v))}
    ids = sorted(held)
    x = np.array([held[i] for i in ids])
    scores = np.round(x @ x.T, 9) if ids else x
    return {(i, ids[j], r + 1) for a, i in enumerate(ids)
            for r, j in enumerate([j for j in np.argsort(-scores[a], kind="stable") if j != a][:k])}


def clustered(seed, n=400, d=32, centres=12):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(centres, d))[rng.integers(0, centres, n)] + 0.3 * rng.normal(size=(n, d))
    x[rng.random(n) < 0.2] = x[0]  # a hot group of equal vectors
    return [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]


def found(table, **options):
    return {(r.query_id, r.item_id, r["rank"]) for r in nearest_of_every(table, **options).collect()}


@pytest.mark.parametrize("part", [30, wide_nearest.PART])
def test_same_as_all_pairs(spark, part):
    rows = clustered(3)
    assert found(spark.createDataFrame(rows, ITEMS).repartition(5), k=7, part=part) == brute(rows, 7)


def test_vectors_without_clusters_and_long_lists(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=20).tolist()) for i in range(90)]
    for k in (3, 200):
        assert found(spark.createDataFrame(rows, ITEMS), k=k) == brute(rows, k)


def test_odd_vectors(spark):
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [1.0, 0.0]), (6, [2.0, 0.0]), (7, [0.0, -1.0])]
    assert found(spark.createDataFrame(rows, ITEMS), k=2) == brute(rows, 2)
    assert found(spark.createDataFrame(rows[:4], ITEMS)) == set() == found(spark.createDataFrame([], ITEMS))


def test_clusters_are_spared(spark, monkeypatch):
    """On vectors in clusters, far fewer are compared than all with all."""
    asked, plain = [], wide_nearest._best_of_parts

    def counted(asking, items, k):
        size = items.groupBy("cluster", "part").count().withColumnsRenamed({"cluster": "c", "part": "p"})
        asked.append(asking.groupBy("c", "p").count().withColumnRenamed("count", "asks").join(size, ["c", "p"]).selectExpr(
            "sum(asks * count)").first()[0] or 0)
        return plain(asking, items, k)

    monkeypatch.setattr(wide_nearest, "_best_of_parts", counted)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 64))[rng.integers(0, 30, 1500)] + 0.05 * rng.normal(size=(1500, 64))
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    assert found(spark.createDataFrame(rows, ITEMS), k=5) == brute(rows, 5)
    assert sum(asked) < 0.3 * 1500 ** 2


def test_small_clusters_share_a_block():
    n = np.array([3, 4, 2, 9, 25, 2, 8, 1])
    first, copies = wide_nearest._blocks(n, 10)
    assert first.tolist() == [0, 0, 0, 1, 2, 5, 5, 6] and copies.tolist() == [1, 1, 1, 1, 3, 1, 1, 1]


def test_blocks_of_several_clusters(spark):
    """Vectors without clusters, in many blocks, against all pairs."""
    values = np.random.default_rng(4).normal(size=(300, 12))
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "item_id long, vector array<double>")
    got = wide_nearest.nearest_of_every(items, k=4, part=9).collect()
    units = values / np.linalg.norm(values, axis=1, keepdims=True)
    scores = np.round(units @ units.T, 9)
    np.fill_diagonal(scores, -2)
    for r in got:
        assert np.argsort(-scores[r.query_id], kind="stable")[r["rank"] - 1] == r.item_id
    assert len(got) == 1200
