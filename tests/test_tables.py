"""Samples of exact size, and tables in buckets."""

import hashlib

import pytest
from pyspark.sql import functions as F

from encore.operators import scope
from encore.sources import files, star


def test_sample_is_the_same_however_rows_lie(spark):
    table = spark.range(500).withColumn("g", F.col("id") % 3)
    def place(i):
        return hashlib.md5(str(i).encode()).hexdigest()
    want = sorted(sorted(range(500), key=place)[:40])
    for parts in (1, 7):
        assert sorted(r.id for r in scope.exact_sample(table.repartition(parts), "id", 40).collect()) == want
    by_group = scope.exact_sample(table.repartition(5), "id", 10, ["g"]).collect()
    assert sorted(r.id for r in by_group) == sorted(
        i for g in range(3) for i in sorted(range(g, 500, 3), key=place)[:10])
    halves = [scope.exact_sample(table.filter(c), "id", 40) for c in ("id < 300", "id >= 250")]
    assert sorted(r.id for r in scope.merged_samples(*halves, "id", 40).collect()) == want
    assert scope.exact_sample(table, "id", 0).isEmpty() and scope.exact_sample(table, "id", 900).count() == 500
    with pytest.raises(ValueError):
        scope.exact_sample(table, "id", -1)


@pytest.fixture
def bucketed(spark, small, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS buckets LOCATION '{tmp_path}/db'")
    info, members = star.playlists_info(spark, small), star.playlists_tracks(spark, small)
    files.write_bucketed(info, "playlists_info", str(tmp_path), 4, "buckets")
    files.write_bucketed(members, "playlists_tracks", str(tmp_path), 4, "buckets")
    spark.sql("DROP TABLE buckets.playlists_tracks")
    held = (spark.table("buckets.playlists_info"), files.open_bucketed(spark, "playlists_tracks", str(tmp_path), 4, "buckets"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield info, members, *held
    for k, v in before.items():
        spark.conf.set(k, v)
    spark.sql("DROP DATABASE buckets CASCADE")


def exchanges(table):
    return table._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_joins_by_playlist_need_no_shuffle(spark, bucketed):
    info, members, held_info, held_members = bucketed
    joined = held_members.join(held_info.select("pid", "name"), "pid")
    scoped = scope.in_scope(held_members, held_info.filter("num_tracks > 5"))
    counted = held_members.groupBy("pid").count()
    assert [exchanges(t) for t in (joined, scoped, counted)] == [0, 0, 0]
    assert exchanges(members.join(info.select("pid", "name"), "pid")) > 0
    assert joined.count() == members.count() == held_members.count()
    want = scope.in_scope(members, info.filter("num_tracks > 5"))
    assert scoped.select("pid", "pos").exceptAll(want.select("pid", "pos")).isEmpty() and scoped.count() == want.count()
    # of a list of playlists only the list moves
    ids = spark.createDataFrame([(1,), (2,)], "pid long")
    assert exchanges(scope.in_scope(held_members, ids)) <= 1


def test_tables_without_pid_are_refused(spark, small, tmp_path):
    with pytest.raises(ValueError):
        files.write_bucketed(star.tracks(spark, small), "tracks", str(tmp_path), 4)
