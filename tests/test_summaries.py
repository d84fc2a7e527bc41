import math
import random

import numpy as np
import pytest

from encore.operators import distribution as d

WANTED = {f"p{int(1000 * p)}": p for p in (0.0, 0.001, 0.1, 0.5, 0.77, 0.999, 1.0)}


def rows_of(spark, values, parts=4):
    return spark.createDataFrame([(v,) for v in values], "x double").repartition(parts)


def quantiles(spark, summary):
    return d.quantiles(d.summary_counts(summary), WANTED).first()


def made(seed, n=4000):
    rng = random.Random(seed)
    return [rng.choice([-1, 1, 1]) * math.exp(rng.gauss(0, 6)) for _ in range(n)] + [0.0] * 50


@pytest.mark.parametrize("digits", [2, 3, 5])
def test_quantiles_within_the_stated_error(spark, digits):
    values = made(digits)
    got = quantiles(spark, d.value_summary(rows_of(spark, values), ["x"], digits))
    for name, p in WANTED.items():
        exact = float(np.quantile(values, p))
        at = p * (len(values) - 1)
        ends = [abs(sorted(values)[f(at)]) for f in (math.floor, math.ceil)]
        assert abs(got[name] - exact) <= 0.5 * 10 ** (1 - digits) * max(ends) + 1e-12


def test_merged_parts_are_the_summary_of_the_whole(spark):
    values = made(7)
    whole = d.value_summary(rows_of(spark, values), ["x"], 3)
    parts = [d.value_summary(rows_of(spark, values[i::3], 2), ["x"], 3) for i in range(3)]
    merged = d.merged_summaries(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    columns = ["metric", "side", "place", "cell", "lo", "hi", "n"]
    key = lambda t: sorted(map(tuple, t.select(columns).collect()))
    assert key(merged) == key(whole)
    assert len(key(whole)) <= 18 * 100 * len({r[2] for r in key(whole)})


def test_exact_where_values_are_few(spark):
    values = [0.1, 0.2, 0.30000001, 5.0, 5.0, 1e9, -3.0, 1000.0, 999.0]
    got = quantiles(spark, d.value_summary(rows_of(spark, values), ["x"], 4))
    for name, p in WANTED.items():
        assert got[name] == pytest.approx(float(np.quantile(values, p)), rel=1e-12)


def test_powers_of_ten_and_odd_values(spark):
    values = [10.0 ** i for i in range(-20, 21)] + [float("nan"), float("inf"), None]
    rows = d.value_summary(rows_of(spark, values), ["x"], 3).collect()
    # next to a small power of ten, which has no exact value, either neighbour is right
    assert len(rows) == 41 and all(r.lo == r.hi and r.cell in (99, 100, 999, 1000) for r in rows)
    assert all(r.cell == 100 for r in rows if r.lo >= 1)
    assert d.value_summary(rows_of(spark, [None, float("nan")]), ["x"]).isEmpty()
