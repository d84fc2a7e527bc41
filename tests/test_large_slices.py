import json
import random

import pytest
from pyspark.sql import functions as F

from encore.operators import ingest
from encore.plans.build import build_tables
from encore.sources.files import CORRUPT, read_slices
from encore.sources.large_slices import read_large_slices
from test_ingest import playlist, track

NAMES = ['plain', 'with "quotes" and {braces}', "back\\slash \\", "] and [", "línea   ünï", "", "tab\tnew\nline", '"playlists": [{']


def made(seed, n):
    rng = random.Random(seed)
    return [playlist(seed * 1000 + i, [track(p, f"t{rng.randrange(90)}", name=rng.choice(NAMES)) for p in range(rng.randrange(12))],
                     name=rng.choice(NAMES)) for i in range(n)]


def write(folder, name, lists, indent=1, **other):
    held = {"info": {"slice": name, "version": "v1", "generated_on": "[{"}, "notes": [{"pid": 5, "tracks": []}, {"pid": 6}],
            "playlists": lists, "others": [{"pid": 7}], **other}
    (folder / f"set.slice.{name}.json").write_text(json.dumps(held, indent=indent))


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def same(spark, folder):
    whole, split = read_slices(spark, str(folder)), read_large_slices(spark, str(folder))
    assert split.filter(F.col(CORRUPT).isNotNull()).isEmpty()
    for part in (ingest.playlists, ingest.entries):
        want = sorted(map(tuple, part(whole).collect()), key=repr)
        assert sorted(map(tuple, part(split).collect()), key=repr) == want and want


def test_one_file_is_read_by_several_tasks(spark, tmp_path, small_splits):
    write(tmp_path, "0-199", made(1, 200))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    same(spark, tmp_path)


@pytest.mark.parametrize("indent", [None, 0, 3])
def test_several_files_of_any_layout(spark, tmp_path, small_splits, indent):
    for i in range(3):
        write(tmp_path, f"{i}", made(i, 15 * i), indent)
    write(tmp_path, "9", [playlist(9, [track(p, f"long{p}", name="x" * 3000) for p in range(9)])], 1)  # longer than splits
    same(spark, tmp_path)


def test_rejects_are_kept(spark, tmp_path, small_splits):
    write(tmp_path, "0", made(1, 60))
    text = (tmp_path / "set.slice.0.json").read_text()
    (tmp_path / "set.slice.1.json").write_text(text.replace('"num_edits": 2', '"num_edits": two', 1).replace('"pid": 1', '"pid": 2'))
    (tmp_path / "set.slice.2.json").write_text(text[:len(text) // 2])
    rows = read_large_slices(spark, str(tmp_path))
    bad = [r[CORRUPT] for r in rows.filter(F.col(CORRUPT).isNotNull()).collect()]
    assert len(bad) == 2 and sum("two" in b for b in bad) == 1 and sum("set.slice.2.json" in b for b in bad) == 1
    assert ingest.playlists(rows).count() == 60 + 59


def test_tables_from_large_files(spark, tmp_path, small_splits):
    write(tmp_path, "0", made(4, 40))
    challenge = tmp_path / "challenge_set.json"
    challenge.write_text(json.dumps({"playlists": [{"pid": 1000000, "tracks": [track(0, "new")]}]}))
    one, other = (build_tables(spark, str(tmp_path), str(challenge), str(tmp_path / f"out{large}"), large_files=large)
                  for large in (False, True))
    for name in ("playlists_info", "tracks", "playlists_tracks", "playlists_test"):
        assert sorted(map(repr, getattr(one, name).collect())) == sorted(map(repr, getattr(other, name).collect()))
