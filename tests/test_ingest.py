import json

import pytest
from pyspark.sql import functions as F

from encore import schemas
from encore.operators import ingest
from encore.plans.build import build_tables
from encore.sources import files


def track(pos, uri, name="Song", artist="Band", album="Record", ms=1000):
    return {"pos": pos, "track_uri": f"track:{uri}", "track_name": name, "artist_uri": f"artist:{artist}",
            "artist_name": artist, "album_uri": f"album:{album}", "album_name": album, "duration_ms": ms}


def playlist(pid, tracks, **other):
    return {"pid": pid, "name": f"list {pid}", "collaborative": "false", "modified_at": 1493424000, "num_artists": 1,
            "num_albums": 1, "num_tracks": len(tracks), "num_followers": 1, "num_edits": 2, "duration_ms": 5,
            "tracks": tracks, **other}


@pytest.fixture
def folder(tmp_path):
    info = {"slice": "0-1", "version": "v1", "generated_on": "now"}
    first = [playlist(0, [track(0, "a"), track(1, "b", name="Other"), track(2, "a")], description="text"),
             playlist(1, [], collaborative="true")]
    second = [playlist(2, [track(0, "a", name="SONG"), track(1, "c", artist=None)], name=None)]
    challenge = [{"pid": 1000000, "name": "x", "num_holdouts": 1, "num_samples": 1, "num_tracks": 2,
                  "tracks": [track(0, "new")]},
                 {"pid": 1000001, "num_holdouts": 3, "num_samples": 0, "num_tracks": 3, "tracks": []}]
    for name, lists in (("set.slice.0-1.json", first), ("set.slice.2-2.json", second)):
        (tmp_path / name).write_text(json.dumps({"info": info, "playlists": lists}, indent=2))
    (tmp_path / "challenge_set.json").write_text(
        json.dumps({"date": "2018", "version": "v1", "playlists": challenge}, indent=2))
    return tmp_path


def test_five_tables(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    for _ in range(2):  # a second run replaces the first
        tables = build_tables(spark, str(folder), str(folder / "challenge_set.json"), out)
    info = {r.pid: r for r in tables.playlists_info.collect()}
    assert sorted(info) == [0, 1, 2]  # the challenge file in the same folder is not training data
    assert info[1].collaborative is True and info[0].collaborative is False and info[2].name is None
    assert tables.playlists_info.columns == schemas.PLAYLIST_COLUMNS

    tracks = {r.track_uri: r for r in tables.tracks.collect()}
    assert sorted(tracks) == ["track:a", "track:b", "track:c", "track:new"]
    assert tracks["track:a"].track_name == "SONG"  # the smallest of two spellings, one row only
    assert tables.tracks.count() == 4

    members = tables.playlists_tracks.orderBy("pid", "pos").collect()
    assert [(r.pid, r.pos, r.track_uri) for r in members] == [
        (0, 0, "track:a"), (0, 1, "track:b"), (0, 2, "track:a"), (2, 0, "track:a"), (2, 1, "track:c")]
    assert {r.tid for r in members if r.track_uri == "track:a"} == {tracks["track:a"].tid}

    test_info = {r.pid: r for r in tables.playlists_test_info.collect()}
    assert test_info[1000001].name is None and test_info[1000001].num_holdouts == 3
    seed, = tables.playlists_test.collect()
    assert (seed.pid, seed.tid) == (1000000, tracks["track:new"].tid)
    assert ingest.id_collisions(tables.tracks).count() == 0


def test_conflicting_spellings_are_reported(spark, folder):
    entries = ingest.entries(files.read_slices(spark, str(folder)))
    assert [(r.track_uri, r.n_spellings) for r in ingest.conflicting_uris(entries).collect()] == [("track:a", 2)]


def test_ids_do_not_depend_on_partitioning(spark, folder):
    entries = ingest.entries(files.read_slices(spark, str(folder)))
    one, many = (ingest.catalogue(entries.repartition(n)) for n in (1, 7))
    assert one.exceptAll(many).count() == 0


def test_unreadable_file_is_kept_apart(spark, folder):
    (folder / "set.slice.3-3.json").write_text("{ not json")
    raw = files.read_slices(spark, str(folder)).cache()
    assert ingest.playlists(raw).count() == 3
    bad, = files.unreadable_files(raw).collect()
    assert "not json" in bad[files.CORRUPT]


def test_playlist_without_tracks_has_no_entry(spark, folder):
    raw = files.read_slices(spark, str(folder))
    assert ingest.entries(raw).filter(F.col("pid") == 1).count() == 0


@pytest.mark.parametrize("broken", ["set.slice.2-2.json", "challenge_set.json"])
def test_truncated_file_fails_the_build(spark, folder, tmp_path, broken):
    text = (folder / broken).read_text()
    (folder / broken).write_text(text[:len(text) // 2])
    out, challenge = str(tmp_path / "out"), str(folder / "challenge_set.json")
    with pytest.raises(ValueError, match="1 files did not parse"):
        build_tables(spark, str(folder), challenge, out)
    reject, = spark.read.parquet(f"{out}/rejects").collect()
    assert reject.file.endswith(broken)
    tables = build_tables(spark, str(folder), challenge, out, skip_rejects=True)
    assert tables.playlists_info.count() == (2 if "slice" in broken else 3)


def test_id_collision_fails_the_build(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "stable_id", lambda uri: F.length(uri).cast("bigint"))
    with pytest.raises(ValueError, match="same id"):
        build_tables(spark, str(folder), str(folder / "challenge_set.json"), str(tmp_path / "out"))


def test_line_items_are_not_expanded_nor_derived_before_their_shuffle(spark, small, capsys):
    from encore.sources import star
    star.playlists_info(spark, small).explain()
    assert "Expand" not in capsys.readouterr().out
    star.playlists_tracks(spark, small).explain()
    plan = capsys.readouterr().out
    assert "md5" in plan[:plan.index("Exchange hashpartitioning(l_orderkey")]
    assert "md5" not in plan[plan.index("Exchange hashpartitioning(l_orderkey"):]
