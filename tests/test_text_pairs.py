import random
from collections import defaultdict

import pytest

from encore.operators.features import unit_tfidf
from encore.operators.text_pairs import candidates, most_similar_by_text
from encore.sources import star
from pyspark.sql import functions as F

VECTORS = "tid long, field string, token string, weight double"
FIELDS = ["track_name", "album_name", "artist_name"]


def brute(rows, k):
    held = defaultdict(dict)
    for tid, field, token, w in rows:
        if w > 0:
            held[tid][field, token] = w
    out = []
    for a in sorted(held):
        for b in sorted(held):
            if a < b and held[a].keys() & held[b].keys():
                out.append((-round(sum(w * held[b].get(t, 0.0) for t, w in held[a].items()), 9), a, b))
    return sorted(out)[:k]


def made(seed, n=120, words=9):
    rng = random.Random(seed)
    tracks = []
    for tid in range(n):
        def text(most):
            return " ".join(f"w{min(rng.randrange(words), rng.randrange(words))}" for _ in range(rng.randrange(1, most)))
        tracks.append((tid, text(5), text(3) if rng.random() < 0.8 else None, "hot" if rng.random() < 0.5 else "rare",
                       rng.choice([0, 10, 10, 20, 90])))
    return tracks


def vectors(spark, tracks):
    return unit_tfidf(spark.createDataFrame(tracks, "tid long, track_name string, album_name string, artist_name string, "
                                                    "duration_ms long"))


@pytest.mark.parametrize("k", [1, 15, 400, 10_000])
def test_same_as_all_pairs(spark, k):
    table = vectors(spark, made(k))
    want = brute([tuple(r) for r in table.select("tid", "field", "token", "weight").collect()], k)
    got = [(-r.cosine_similarity, r.id_a, r.id_b) for r in most_similar_by_text(table, k).collect()]
    assert [g[1:] for g in got] == [w[1:] for w in want]
    assert [g[0] for g in got] == pytest.approx([w[0] for w in want], abs=2e-9)


def test_copies_and_one_word_for_all(spark):
    rows = [(t, "name", "hot", 0.6) for t in range(300)] + [
        (t, "duration", "", 0.8) if t < 150 else (t, "name", f"own{t}", 0.8) for t in range(300)]
    got = most_similar_by_text(spark.createDataFrame(rows, VECTORS), 5).collect()
    assert [(r.id_a, r.id_b, r.cosine_similarity) for r in got] == [(0, b, 1.0) for b in range(1, 6)]


def test_vectors_without_length(spark):
    rows = [(1, "name", "x", 0.0), (2, "name", "x", 0.0), (3, "name", "y", 1.0)]
    assert most_similar_by_text(spark.createDataFrame(rows, VECTORS)).collect() == []
    assert most_similar_by_text(spark.createDataFrame([], VECTORS)).collect() == []


def test_few_pairs_are_scored(spark, small):
    points = unit_tfidf(star.tracks(spark, small)).filter("weight > 0")
    n = points.select("tid").distinct().count()
    floor = F.lit(0.9)
    met = candidates(points, floor)
    rows = [tuple(r) for r in points.select("tid", "field", "token", "weight").collect()]
    reach = {(a, b) for s, a, b in brute(rows, n * n) if -s >= 0.9}
    found = {(r.id_a, r.id_b) for r in met.collect()}
    assert reach and reach <= found and len(found) < 0.2 * n * (n - 1) / 2
