import pytest

from encore.operators.feature_model import TrackFeatures, TrackFeaturesModel
from encore.operators.features import hashed_terms, hashed_vectors, scaled_features
from encore.sources import star
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

TRACKS = "tid long, track_name string, album_name string, artist_name string, duration_ms long"


def rows_of(table):
    return {r.tid: ([round(x, 12) for x in r.scaled], [round(x, 12) for x in r.vector]) for r in table.collect()}


def test_same_as_features_of_the_whole_catalogue(spark, small):
    tracks = star.tracks(spark, small)
    want = rows_of(scaled_features(tracks))
    assert rows_of(TrackFeatures().fit(tracks).transform(tracks)) == want


def test_missing_names_and_constants(spark):
    tracks = spark.createDataFrame(
        [(1, "a", None, "x", 5), (2, "b", "m", "x", None), (3, "a", "m", "x", 5), (4, None, None, "x", 7)], TRACKS)
    assert rows_of(TrackFeatures().fit(tracks).transform(tracks)) == rows_of(scaled_features(tracks))


def test_saved_model_scores_new_tracks(spark, tmp_path):
    known = spark.createDataFrame([(1, "a", "m", "x", 10), (2, "a", "n", "y", 20), (3, "b", "m", "x", 30)], TRACKS)
    model = TrackFeatures(vectorCol="unit").fit(known)
    model.write().save(str(tmp_path / "model"))
    with pytest.raises(Exception):
        model.write().save(str(tmp_path / "model"))
    model.write().overwrite().save(str(tmp_path / "model"))
    loaded = TrackFeaturesModel.load(str(tmp_path / "model"))
    assert loaded.uid == model.uid and loaded.getOrDefault("vectorCol") == "unit"
    new = spark.createDataFrame([(9, "new", "m", "y", 25), (10, None, "n", "x", 99), (11, "b", None, None, -4)], TRACKS)
    got = {r.tid: (r.track_index, r.album_index, r.artist_index, list(r.scaled)) for r in loaded.transform(new).collect()}
    assert got == {9: (2.0, 0.0, 1.0, [0.0, 1.0, 1.0, 0.75]), 10: (2.0, 1.0, 0.0, [1.0, 0.0, 1.0, 1.0]),
                   11: (1.0, 2.0, 2.0, [1.0, 1.0, 1.0, 0.0])}
    assert loaded.transform(new).columns[:5] == new.columns


def test_estimator_is_saved_too(spark, tmp_path):
    TrackFeatures(scaledCol="s").write().save(str(tmp_path / "estimator"))
    assert TrackFeatures.load(str(tmp_path / "estimator")).getOrDefault("scaledCol") == "s"


def test_nothing_to_learn(spark):
    with pytest.raises(ValueError):
        TrackFeatures().fit(spark.createDataFrame([], TRACKS))


def test_hashed_terms_and_vectors(spark):
    table = spark.createDataFrame([(1, "red red blue"), (2, "blue green"), (3, None)], "id long, text string")
    terms = hashed_terms(table, "id", ["text"], 4)
    by_id = {}
    for r in terms.collect():
        by_id.setdefault(r.id, {})[r.bucket] = (r.tf, r.terms, r.tfidf)
    assert sum(tf for tf, _, _ in by_id[1].values()) == 3 and sum(tf for tf, _, _ in by_id[2].values()) == 2
    assert sum(n for n in {b: n for held in by_id.values() for b, (_, n, _) in held.items()}.values()) == 3
    read = hashed_vectors(terms, "id", 4).select("id", vector_to_array("vector").alias("v")).collect()
    assert {r.id: r.v for r in read} == {
        i: [held.get(b, (0, 0, 0.0))[2] for b in range(4)] for i, held in by_id.items()}
    assert hashed_terms(table, "id", ["text"], 1).filter(F.col("terms") != 3).isEmpty()
