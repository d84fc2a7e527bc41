"""Shards: the permutation is one, and what was written is what is read."""

import zlib

import numpy as np

from conftest import collected
from encore.llm import shards
from encore.llm.queries import QUERIES
from encore.llm.tokens import document_ids, encoder
from encore.sources.stage import new_path


def test_permutation():
    for total in (1, 2, 3, 5, 64, 1000, 4097):
        for key in (0, 7):
            assert sorted(shards.slots(np.arange(total), total, key).tolist()) == list(range(total))
    assert shards.slots(np.arange(1000), 1000, 1).tolist() != shards.slots(np.arange(1000), 1000, 2).tolist()
    assert np.abs(np.corrcoef(shards.slots(np.arange(5000), 5000, 1), np.arange(5000))[0, 1]) < 0.1


def streams(rows, length):
    encode = encoder()
    ids = np.concatenate([document_ids(t, encode) for _, t in rows])
    return np.concatenate([ids, np.zeros(-len(ids) % length, dtype=ids.dtype)]).reshape(-1, length).astype("<u2")


def test_all_documents(spark, small, rows):
    got = collected(QUERIES["op9_training_order"](spark, small))
    want = streams(rows, shards.LENGTH)
    assert [r[0] for r in got] == list(range(len(want)))
    order = shards.slots(np.arange(len(want)), len(want), shards.KEY)
    assert [r[5] for r in got] == [zlib.crc32(want[i].tobytes()) for i in np.argsort(order)]
    assert {d for r in got for d in r[4]} == {d for d, _ in rows}


def test_reading_goes_on_at_any_slot(spark, rows):
    folder = new_path(spark, "shards")
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    n = shards.materialised(docs, folder, length=64, per_shard=50).count()
    every = shards.read_slots(folder, 0, n, 64, 50)
    assert sorted(map(bytes, every)) == sorted(map(bytes, streams(rows, 64)))
    assert (shards.read_slots(folder, 37, 120, 64, 50) == every[37:157]).all()
    again = shards.materialised(docs, folder, length=64, per_shard=50)
    assert again.count() == n and (shards.read_slots(folder, 0, n, 64, 50) == every).all()


def test_odd_rows(odd, odd_rows):
    got = collected(shards.materialised(odd, per_shard=10))
    encode = encoder()
    assert sum(r[3] for r in got) == sum(len(document_ids(t, encode)) for _, t in odd_rows)


def test_empty_table(none):
    assert shards.materialised(none).collect() == []


def test_rows_of_the_shards_are_not_broadcast(spark, small):
    found = QUERIES["op9_training_order"](spark, small)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
