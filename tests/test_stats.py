import math

import numpy as np
import pandas as pd
import pytest

from encore.operators import distribution as d
from encore.operators import profile, scope, toplists

INFO = "pid long, name string, num_followers long, num_artists long, num_albums long, num_tracks long, modified_at long"


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(5)
    n = 400
    return pd.DataFrame({
        "pid": range(n), "name": rng.choice(["rock", "Rock pop", "pop", "hip-hop jazz"], n),
        "num_followers": (rng.pareto(1.0, n) * 3).astype(int), "num_artists": rng.integers(1, 40, n),
        "num_albums": rng.integers(1, 60, n), "num_tracks": rng.integers(1, 500, n),
        "modified_at": rng.integers(1_400_000_000, 1_500_000_000, n)})


@pytest.fixture(scope="module")
def info(spark, pdf):
    return spark.createDataFrame(pdf, INFO)


def test_averages(info, pdf):
    row, = profile.averages(info).collect()
    assert row.avg_followers == pytest.approx(pdf.num_followers.mean())
    assert row.avg_tracks == pytest.approx(pdf.num_tracks.mean())


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.99, 1.0])
def test_quantile_interpolates_like_pandas(info, pdf, q):
    row, = d.quantiles(d.value_counts(info, ["num_followers"]), {"q": q}).collect()
    assert row.q == pytest.approx(pdf.num_followers.quantile(q), rel=1e-12)


def test_cap_keeps_missing_values_missing(spark):
    info = spark.createDataFrame([(1, 1), (2, None), (3, 100)], "pid long, num_followers long")
    got = {r.pid: r.num_followers_capped for r in profile.followers_capped(info, 0.5).collect()}
    assert got == {1: 1.0, 2: None, 3: 50.5}


def test_correlations_after_outliers(info, pdf):
    kept = pdf[pdf.num_followers <= pdf.num_followers.quantile(0.99)]
    row, = profile.correlations(info).collect()
    assert row.followers_tracks == pytest.approx(kept.num_followers.corr(kept.num_tracks))
    few = kept[kept.num_tracks <= 350]
    matrix = {(r.feature_x, r.feature_y): r.correlation for r in profile.pair_matrix(info).collect()}
    assert len(matrix) == 25 and matrix["num_tracks", "num_tracks"] == pytest.approx(1.0)
    assert matrix["modified_at", "num_albums"] == pytest.approx(few.modified_at.corr(few.num_albums))


def test_correlation_skips_pairs_with_a_missing_side(spark):
    rows = [(i, i, i, i, i, v) for i, v in enumerate([1, 2, None, 4, 6])]
    info = spark.createDataFrame(
        rows, "pid long, num_followers long, num_artists long, num_albums long, modified_at long, num_tracks long")
    row, = profile.correlations(info, 1.0).collect()
    assert row.artists_tracks == pytest.approx(np.corrcoef([0, 1, 3, 4], [1, 2, 4, 6])[0, 1])


def test_histogram_like_numpy(info, pdf):
    rows = d.histogram(d.value_counts(info, ["num_tracks"]), 30).orderBy("bin").collect()
    counts, edges = np.histogram(pdf.num_tracks, 30)
    assert [r.n for r in rows] == counts.tolist()
    assert [r.bin_lo for r in rows] == pytest.approx(edges[:-1])
    shown = d.visible_bins(d.histogram(d.value_counts(info, ["num_tracks"]), 30), 1, 100)
    assert 0 < shown.count() < 30


def test_histogram_of_a_constant(spark):
    rows = d.histogram(d.value_counts(spark.createDataFrame([(3,), (3,)], "x long"), ["x"]), 4).collect()
    assert sum(r.n for r in rows) == 2 and len(rows) == 4


@pytest.mark.parametrize("cut", [0.0, 3.0])
def test_density(info, pdf, cut):
    rows = d.density(d.value_counts(info, ["num_artists"]), 50, cut).orderBy("point").collect()
    x = pdf.num_artists.to_numpy()
    h = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min() - cut * h, x.max() + cut * h, 50)
    want = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(axis=1) / (len(x) * h * math.sqrt(2 * math.pi))
    assert [r.density for r in rows] == pytest.approx(want.tolist())
    assert [r.x for r in rows] == pytest.approx(grid.tolist())


def test_box_summary(info, pdf):
    row, = d.box_summary(d.value_counts(info, ["num_followers"])).collect()
    q1, q2, q3 = pdf.num_followers.quantile([0.25, 0.5, 0.75])
    inside = pdf.num_followers[pdf.num_followers.between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))]
    assert (row.q1, row["median"], row.q3) == pytest.approx((q1, q2, q3))
    assert (row.whisker_lo, row.whisker_hi) == (inside.min(), inside.max())
    assert row.n_outliers == len(pdf) - len(inside)


def test_hexagons_hold_every_point_at_its_nearest_centre(info, pdf):
    rows = d.hexbin(info, "num_tracks", "num_artists", 10).collect()
    assert sum(r.n for r in rows) == len(pdf)
    sx, sy = (np.ptp(pdf[c]) / n for c, n in (("num_tracks", 10), ("num_artists", 5)))
    x0, y0 = pdf.num_tracks.min(), pdf.num_artists.min()
    centres = [(i + s, j + s) for i in range(-1, 12) for j in range(-1, 7) for s in (0, 0.5)]
    tally = {}
    for x, y in zip(pdf.num_tracks, pdf.num_artists):
        u, v = (x - x0) / sx, (y - y0) / sy
        c = min(centres, key=lambda c: (u - c[0]) ** 2 + 3 * (v - c[1]) ** 2)
        tally[c] = tally.get(c, 0) + 1
    got = {(round((r.x_center - x0) / sx, 6), round((r.y_center - y0) / sy, 6)): r.n for r in rows}
    assert sum(abs(got.get(c, 0) - tally.get(c, 0)) for c in set(got) | set(tally)) <= 4  # equal distances


def test_hash_sample_repeats_and_has_the_wanted_size(spark):
    ids = spark.range(20000).withColumnRenamed("id", "pid")
    one, two = (scope.hash_sample(ids.repartition(n), "pid", 0.1) for n in (1, 5))
    assert one.exceptAll(two).count() == 0 and 1800 < one.count() < 2200
    assert scope.hash_sample(ids, "pid", 1.0).count() == 20000


def test_candidate_pool_holds_each_track_once(spark):
    tracks = spark.range(1000).withColumnRenamed("id", "tid")
    seeds = spark.createDataFrame([(1,), (2,), (2,)], "tid long")
    pool = [r.tid for r in scope.candidate_pool(tracks, seeds).collect()]
    assert len(pool) == len(set(pool)) and {1, 2} <= set(pool) and len(pool) < 200


def test_genres(info, pdf):
    got = {r.genre: r.n_playlists for r in toplists.genre_counts(info).collect()}
    assert got["rock"] == pdf.name.str.contains("rock").sum() and got["classical"] == 0
    loose = {r.genre: r.n_playlists for r in toplists.genre_counts(info, ["ROCK"], ignore_case=True).collect()}
    assert loose["ROCK"] == pdf.name.str.lower().str.contains("rock").sum()


def test_number_of_playlists(info):
    assert toplists.n_playlists(info.union(info)).first()[0] == 400
    assert toplists.n_playlists(info, approximate=True).first()[0] == pytest.approx(400, rel=0.1)


def test_top_lists(spark):
    tracks = spark.createDataFrame(
        [(f"t{i}", f"T{i}", f"a{i % 2}", f"A{i % 2}", "b", "B") for i in range(5)],
        "track_uri string, track_name string, artist_uri string, artist_name string, album_uri string, album_name string")
    rows = [(1, 0, "t3"), (1, 1, "t1"), (2, 0, "t2"), (2, 1, "t1"), (3, 0, "t3"), (4, 0, "t2")]
    members = spark.createDataFrame(rows, "pid long, pos long, track_uri string").join(tracks, "track_uri")

    def listed(table, key):
        return [(r["rank"], r[key], r.n) for r in table.collect()]

    assert listed(toplists.top_opening_tracks(members, tracks), "track_uri") == [(1, "t2", 2), (2, "t3", 2)]
    assert listed(toplists.top_closing_tracks(members, tracks), "track_uri") == [(1, "t1", 2), (2, "t2", 1), (3, "t3", 1)]
    assert listed(toplists.top_tracks(members, tracks, k=1), "track_name") == [(1, "T1", 2)]
    assert listed(toplists.top_artists(members, tracks), "artist_uri") == [(1, "a0", 3), (2, "a1", 2)]
    assert listed(toplists.top_artists(members, tracks, by="appearances"), "artist_uri") == [(1, "a1", 4), (2, "a0", 2)]
