"""Line classes against all pairs of lines."""

import random

import numpy as np

import brute
from conftest import collected
from encore.llm import lines
from encore.llm.queries import QUERIES


def edited(s, n, rng, letters):
    s = list(s)
    for _ in range(n):
        i = rng.randint(0, len(s))
        kind = rng.choice("idr")
        if kind == "i" or not s:
            s.insert(i, rng.choice(letters))
        elif kind == "d":
            s.pop(min(i, len(s) - 1))
        else:
            s[min(i, len(s) - 1)] = rng.choice(letters)
    return "".join(s)


def test_all_documents(spark, small, rows):
    assert collected(QUERIES["op7_segment_join"](spark, small)) == brute.line_classes(rows)


def test_edited_lines(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randint(38, 70))).strip() for _ in range(60)]
    rows = [(d, "\n".join(edited(rng.choice(base), rng.randint(0, 4), rng, "abcde") for _ in range(5))) for d in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collected(lines.line_classes(docs))
    assert got == brute.line_classes(rows) and sum(not r[5] for r in got) > 100
    left = collected(lines.without_repeated_lines(docs))
    assert left == sorted(brute.without_repeated_lines(rows))


def test_distance_within_a_band():
    rng = random.Random(3)
    for _ in range(5000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))
        b, k = edited(a, rng.randint(0, 4), rng, "abc"), rng.choice([1, 2, 3])
        assert lines.within(a, b, k) == (brute.edit_distance(a, b, 20) <= k)


def test_close_lines_share_a_bucket():
    rng = random.Random(8)

    def keys(s, k):
        return {(int(n[0]), i, s[int(a[0]):int(b[0])])
                for n, i, a, b, valid in lines.probes(np.array([len(s)]), k) if valid[0]}

    for _ in range(5000):
        k = rng.choice([1, 2, 3])
        a = "".join(rng.choice("ab") for _ in range(rng.randint(9, 24)))
        b = edited(a, k, rng, "ab")
        if brute.edit_distance(a, b, 20) <= k:
            assert keys(a, k) & keys(b, k)


def test_linked_lines_share_a_bucket(spark):
    """Lines of few and many words, about the lengths at which other keys are used."""
    rng = random.Random(5)
    pairs = []
    for n in [10, 18, 19, 20, 21, 37, 38, 39, 40, 41, 42, 57, 58, 59, 60, 61, 79, 80, 82, 88, 90, 100, 120, 135, 140, 210]:
        for i in range(30):
            words = [rng.choice(["a", "b", "cd", "longer", f"q{rng.randrange(30)}"]) for _ in range(n)]
            x, y = " ".join(words), edited(" ".join(words), rng.randint(1, 2), rng, "ab  ").strip()
            if i % 2:
                for _ in range(max(1, n // 20)):
                    words[rng.randrange(n)] = rng.choice(["other", "c d", ""])
                y = " ".join(" ".join(words).split())
            if x != y and lines.close(x, y, 2):
                pairs.append((x, y))
    docs = spark.createDataFrame([(i, x) for i, p in enumerate(pairs) for x in p], "doc_id long, text string")
    keys = {}
    for bucket, node in lines.buckets(docs, 2).collect():
        keys.setdefault(node, set()).add(bucket)
    assert len(pairs) > 500
    for p in pairs:
        a, b = (keys[int(h)] for h in lines.hashed(p))
        assert a & b, p


def test_close_ones_of_crowds():
    rng = random.Random(6)
    base = [" ".join(rng.choice(["a", "bc", "é😀", "word", f"q{rng.randrange(9)}"]) for _ in range(n)) for n in (1, 9, 22, 45, 90)]
    some, held = ([edited(rng.choice(base), rng.randint(0, 4), rng, "ab é") for _ in range(90)] + [""] for _ in range(2))
    found = list(lines.close_ones(some, held, 2))
    assert found == [(i, j) for i, x in enumerate(some) for j, y in enumerate(held) if lines.close(x, y, 2)]
    assert len(found) > 300 and list(lines.close_ones([], held, 2)) == list(lines.close_ones(some, [], 2)) == []


def test_shared_buckets_of_two_are_one_row(spark):
    rows = [(1, 5), (2, 7), (2, 5), (2, 7), (3, 1), (3, 2), (3, 3), (3, 1), (4, 9), (4, 9)]
    found = lines.shared_buckets(spark.createDataFrame(rows, "bucket long, node long"))
    assert sorted(tuple(r) for r in found.collect()) == [(2, 5, 7, 2), (3, 1, 1, 3), (3, 2, 2, 3), (3, 3, 3, 3)]


def test_crowd_of_strays(spark):
    """Lines that share a stretch of words, in groups of near copies that no one line joins."""
    rng = random.Random(8)
    common = " ".join(f"c{i}" for i in range(30))
    rows = []
    for k in range(12):
        own = [f"g{k}w{rng.randrange(50)}" for _ in range(35)]
        for i in range(8):
            words = own[:]
            words[rng.randrange(35)] = f"x{k}y{i}"
            rows.append((len(rows), common + " " + " ".join(words)))
    got = collected(lines.line_classes(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute.line_classes(rows) and len({r[3] for r in got}) == 12


def test_few_rows_a_line(spark, small):
    """Lines enter 15 buckets on average, not 30, and their rows are made and shuffled once to find the shared ones."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    made = lines.buckets(docs, 2)
    n = made.select("node").distinct().count()
    assert n > 300 and made.count() < 18 * n
    plan = lines.shared_buckets(made)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_odd_rows(odd, odd_rows):
    got = collected(lines.line_classes(odd))
    named = dict(r for r in odd_rows if r[0] is not None)
    assert sorted({r for r in got if r[0] is not None}) == brute.line_classes(list(named.items()))
    assert all(r[5] for r in got if r[0] is None)
    left = lines.without_repeated_lines(odd)
    assert left.columns == odd.columns and left.count() == len(odd_rows)


def test_empty_table(none):
    assert lines.line_classes(none).collect() == []
    assert lines.without_repeated_lines(none).collect() == []
