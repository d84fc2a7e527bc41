import json

from encore.sources.files import slice_fields


def track(**other):
    return {"pos": 0, "track_uri": "t", "track_name": "Song", "artist_uri": "a", "artist_name": "A", "album_uri": "b",
            "album_name": "B", "duration_ms": 5, **other}


def playlist(**other):
    held = {"pid": 1, "name": "x", "description": "d", "collaborative": "false", "modified_at": 1, "num_artists": 1,
            "num_albums": 1, "num_tracks": 1, "num_followers": 1, "num_edits": 1, "duration_ms": 5, "tracks": [track()], **other}
    return {k: v for k, v in held.items() if v != "gone"}


def write(folder, name, lists, **other):
    info = {"slice": "0-1", "version": "v1", "generated_on": "now"}
    (folder / f"set.slice.{name}.json").write_text(json.dumps({"info": info, "playlists": lists, **other}, indent=1))


def found(spark, folder):
    return {(r.level, r.field, r.found, r.status): (r.expected, r.n_records, r.n_files)
            for r in slice_fields(spark, str(folder)).collect()}


def test_two_drifting_slices(spark, tmp_path):
    write(tmp_path, "0", [playlist(), playlist(mood="calm", num_edits="three"), playlist(name=None)])
    write(tmp_path, "1", [playlist(description="gone", mood=["calm"], collaborative=True),
                          playlist(tracks=[track(isrc="X", duration_ms=1.5), track(album_uri=None)])], source="export")
    rows = found(spark, tmp_path)
    odd = {k: v for k, v in rows.items() if k[3] != "known"}
    p, t = "playlists[]", "playlists[].tracks[]"
    assert odd == {
        ("$", "source", "STRING", "new"): (None, 1, 1),
        (p, "mood", "STRING", "new"): (None, 1, 1), (p, "mood", "ARRAY", "new"): (None, 1, 1),
        (p, "num_edits", "STRING", "retyped"): ("BIGINT", 1, 1),
        (p, "collaborative", "BOOLEAN", "retyped"): ("STRING", 1, 1),
        (p, "description", None, "missing"): ("STRING", 1, None),
        (t, "isrc", "STRING", "new"): (None, 1, 1), (t, "duration_ms", "DECIMAL", "retyped"): ("BIGINT", 1, 1)}
    assert rows[p, "pid", "BIGINT", "known"] == ("BIGINT", 5, 2) and rows[p, "name", "VOID", "known"] == ("STRING", 1, 1)
    assert rows[t, "album_uri", "VOID", "known"] == ("STRING", 1, 1) and rows[t, "pos", "BIGINT", "known"] == ("BIGINT", 6, 2)


def test_playlists_that_are_no_objects(spark, tmp_path):
    write(tmp_path, "0", [playlist(), 7, None, playlist(tracks=None)])
    write(tmp_path, "1", "none")
    rows = found(spark, tmp_path)
    assert rows["playlists[]", "", None, "retyped"] == ("OBJECT", 2, None)
    assert rows["$", "playlists", "STRING", "retyped"] == ("ARRAY", 1, 1)
    assert rows["playlists[].tracks[]", "pos", "BIGINT", "known"] == ("BIGINT", 1, 1)
