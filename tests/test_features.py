import math

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import IDF, CountVectorizer, MinMaxScaler, Normalizer, StringIndexer, Tokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from encore.operators import features
from encore.sources import star


@pytest.fixture(scope="module")
def tracks(spark, small):
    return star.tracks(spark, small).cache()


def test_index_and_scaling_equal_the_ml_transformers(tracks):
    names = list(features.INDEXED)
    ml = StringIndexer(inputCols=names, outputCols=["a", "b", "c"]).fit(tracks).transform(tracks)
    ml = VectorAssembler(inputCols=["a", "b", "c", "duration_ms"], outputCol="f").transform(ml)
    ml = MinMaxScaler(inputCol="f", outputCol="s").fit(ml).transform(ml)
    ml = Normalizer(inputCol="s", outputCol="u", p=2.0).transform(ml)
    want = ml.select("tid", "a", "b", "c", vector_to_array("s").alias("s"), vector_to_array("u").alias("u"))
    rows = features.scaled_features(tracks).join(want, "tid").collect()
    assert len(rows) == tracks.count()
    for r in rows:
        assert (r.album_index, r.artist_index, r.track_index) == (r.a, r.b, r.c)
        assert r.scaled == pytest.approx(r.s) and r.vector == pytest.approx(r.u)


@pytest.mark.parametrize("ranges", [1, 3, 500])
def test_index_does_not_depend_on_the_ranges(tracks, ranges):
    base = features.frequency_index(tracks, ["track_name", "artist_name"])
    assert features.frequency_index(tracks, ["track_name", "artist_name"], ranges).exceptAll(base).count() == 0


def test_constant_column_missing_name_and_zero_vector(spark):
    rows = [(1, "x", "n", "al", 5), (2, "x", None, "al", 5), (3, "x", "n", "al", 5)]
    tracks = spark.createDataFrame(
        rows, "tid long, track_name string, artist_name string, album_name string, duration_ms long")
    got = {r.tid: r for r in features.scaled_features(tracks).collect()}
    assert got[1].scaled == [0.5, 0.0, 0.5, 0.5] and got[2].scaled == [0.5, 1.0, 0.5, 0.5]
    flat = tracks.withColumn("duration_ms", F.col("tid")).withColumn("album_name", F.col("tid").cast("string")).withColumn(
        "track_name", F.col("tid").cast("string")).withColumn("artist_name", F.col("tid").cast("string"))
    zero = {r.tid: r.vector for r in features.scaled_features(flat).collect()}[1]
    assert zero == [0.0, 0.0, 0.0, 0.0]


def test_terms_equal_the_ml_idf(tracks):
    words = Tokenizer(inputCol="track_name", outputCol="w").transform(tracks)
    counter = CountVectorizer(inputCol="w", outputCol="tf").fit(words)
    vectors = counter.transform(words)
    ml = IDF(inputCol="tf", outputCol="x").fit(vectors).transform(vectors)
    want = {(r.tid, counter.vocabulary[i]): v for r in ml.collect() for i, v in zip(r.x.indices, r.x.values)}
    got = {(r.tid, r.token): r.tfidf for r in features.tfidf_terms(tracks, "tid", ["track_name"]).collect()}
    assert got == pytest.approx({k: v for k, v in want.items()})


def test_empty_tokens_stay_and_stop_words_go(spark):
    table = spark.createDataFrame([(1, "The  Live"), (2, "the end")], "tid long, t string")
    rows = features.tfidf_terms(table, "tid", ["t"]).collect()
    assert sorted((r.tid, r.token) for r in rows) == [(1, ""), (1, "live"), (1, "the"), (2, "end"), (2, "the")]
    idf = {r.token: r.idf for r in rows}
    assert idf["the"] == 0.0 and idf["end"] == pytest.approx(math.log(3 / 2))
    kept = features.tfidf_terms(table, "tid", ["t"], ["the"]).collect()
    assert "the" not in {r.token for r in kept}


def test_hashed_model_is_saved_and_reused(spark, tracks, tmp_path):
    model = features.fit_tfidf(tracks, buckets=64)
    model.write().overwrite().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    one, two = (features.hashed_tfidf(tracks, m).select("tid", vector_to_array("normalized").alias("v"))
                for m in (model, again))
    assert one.exceptAll(two).count() == 0
    lengths = one.select(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x).alias("l")).distinct().collect()
    assert all(r.l == pytest.approx(1.0) for r in lengths)


def test_terms_meet_their_frequencies_by_hash(spark):
    """No sort of all terms by token, and no vocabulary on the driver, however small it looks."""
    rows = spark.createDataFrame([(1, "a b a"), (2, "b c"), (2, "c"), (None, "a")], "id long, text string")
    terms = features.tfidf_terms(rows, "id", ["text"])
    plan = terms._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan and "SortMergeJoin" not in plan
    assert sorted((r.id or 0, r.token, r.tf) for r in terms.collect()) == [
        (0, "a", 1), (1, "a", 2), (1, "b", 1), (2, "b", 1), (2, "c", 2)]
