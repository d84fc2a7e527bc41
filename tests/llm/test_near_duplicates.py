"""Near duplicates against all pairs; the sketches; crowds in a bucket."""

import numpy as np
from pyspark.sql import functions as F

import brute
from conftest import collected
from encore.llm import hyperminhash, links
from encore.llm.queries import QUERIES
from encore.llm.texts import shingles, word_hashes
import pyarrow as pa


def test_all_documents(spark, small, rows):
    assert collected(QUERIES["op10_hyperminhash"](spark, small)) == brute.near_duplicates(rows)


def test_odd_rows(odd, odd_rows):
    got = collected(hyperminhash.near_duplicates(odd))
    named = dict(r for r in odd_rows if r[0] is not None)
    want = {r[0]: r for r in brute.near_duplicates(list(named.items()))}
    assert [r for r in got if r[0] is not None] == sorted(want[d] for d, _ in odd_rows if d is not None)
    assert [(r[2], r[3]) for r in got if r[0] is None] == [(None, True)] * 2


def test_empty_table(none):
    assert hyperminhash.near_duplicates(none).collect() == []


def test_words_are_those_of_the_rule():
    texts = ["A\x0bb\x0cc\x1cd É\xa0é x", "", None, " ab  AB\n", "\xe9"]
    held = list(word_hashes(pa.array([None if t is None else t.encode() for t in texts], pa.binary())))
    assert [len(h) for h in held] == [len(brute.words(t)) for t in texts]
    assert held[3][0] == held[3][1]


def test_estimate_is_near_the_similarity():
    rng = np.random.default_rng(5)
    order = hyperminhash.orders(hyperminhash.REGISTERS)
    for share in (0.5, 0.75, 0.9):
        off = []
        for _ in range(40):
            both = rng.integers(0, 2**64 - 1, 3000, dtype=np.uint64)
            n = int(1000 * (1 - share))
            a, b = np.unique(both[:2000 - n]), np.unique(both[n:2000])
            exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            same = (hyperminhash.sketch(a, 160, order) == hyperminhash.sketch(b, 160, order)).sum()
            off.append((same - hyperminhash.expected_collisions(len(a), len(b), 160)) / 160 - exact)
        assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06


def test_few_words_share_a_band():
    order = hyperminhash.orders(hyperminhash.REGISTERS)
    missed = 0
    for i in range(300):
        words = [f"{i}-{k}" for k in range(8)]
        sets = [shingles(next(word_hashes(pa.array([" ".join(w).encode()]))), 5) for w in (words, words[:-1])]
        a, b = (hyperminhash.sketch(s, 160, order).reshape(-1, 4) for s in sets)
        missed += not (a == b).all(axis=1).any()
    assert missed == 0


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(1)
    edges = [tuple(map(int, x)) for x in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    got = dict(links.components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = brute.components({x for e in edges for x in e}, edges)
    assert got == {n: want[n] for e in edges if e[0] != e[1] for n in e}


def crowd(spark, n, linked):
    """Roots of n nodes in 20 buckets, each node in most of them, node 77 in all; and how many checks it took."""
    rng, asked = np.random.default_rng(2), []
    rows = [(b, i) for i in range(n) for b in range(20) if i == 77 or rng.random() < 0.8]
    buckets = spark.createDataFrame([(int(b), int(i)) for b, i in rows], "bucket long, node long")

    def of_pairs(pairs, held):
        asked.append(pairs.count())
        return spark.createDataFrame([p for p in pairs.select("a", "b").collect() if linked(*p)], "a long, b long")

    roots = links.grouped(
        buckets, lambda nodes: nodes.withColumn("number", F.col("node")), of_pairs, "number",
        lambda one, two: ((i, j) for i, x in enumerate(one) for j, y in enumerate(two) if x != y and linked(*sorted((x, y)))))
    return dict(roots.collect()), sum(asked)


def test_crowd_is_checked_in_linear_time(spark):
    """Copies that are linked with the text they come from only take a check each."""
    for n in (200, 400):
        roots, asked = crowd(spark, n, lambda a, b: 77 in (a, b))
        assert roots == dict.fromkeys(range(n), 0) and asked == n - 1


def test_links_outside_the_hub_are_found(spark):
    """Chains and stray groups in a crowd, against union-find over all pairs."""
    def linked(a, b):
        return (77 in (a, b) and (a + b) % 3 > 0) or (a % 10 == 4 and b == a + 10) or (a, b) == (150, 156)

    roots, asked = crowd(spark, 300, linked)
    pairs = [(a, b) for a in range(300) for b in range(a + 1, 300) if linked(a, b)]
    want = brute.components({x for p in pairs for x in p}, pairs)
    assert roots == {x: want[x] for p in pairs for x in p} and asked < 600


def in_one_bucket(spark, n, linked, **more):
    """Roots of n nodes in one bucket, and what components were built from."""
    built, own = [], links.components
    buckets = spark.range(n).selectExpr("1L as bucket", "id as node")

    def compare(one, two, apart=lambda i, j: True):
        return ((i, j) for i, x in enumerate(one) for j, y in enumerate(two) if apart(i, j) and x != y and linked(x, y))

    def counted(edges):
        edges = spark.createDataFrame([tuple(r) for r in edges.collect()], "a long, b long")
        built.append(edges.count())
        return own(edges)

    links.components = counted
    try:
        roots = dict(links.grouped(buckets, lambda nodes: nodes.withColumn("number", F.col("node")),
                                   lambda pairs, held: pairs.limit(0), "number", compare, **more).collect())
    finally:
        links.components = own
    return roots, max(built)


def test_links_of_a_crowd_are_not_written_in_pairs(spark):
    """Strays that are all linked with one another: no hub joins them, and what leaves the blocks grows with their number."""
    for n, more in ((600, {}), (1200, {}), (1200, {"spared": True})):
        roots, built = in_one_bucket(spark, n, lambda a, b: True, **more)
        assert roots == dict.fromkeys(range(n), 0) and built < 3 * n


def test_groups_in_blocks_equal_union_find(spark):
    def linked(a, b):
        return abs(a - b) == 7 and a % 5 > 0 or {a, b} == {3, 590}

    pairs = [(a, b) for a in range(700) for b in range(a + 1, 700) if linked(a, b) or linked(b, a)]
    want = brute.components({x for p in pairs for x in p}, pairs)
    for more in ({}, {"spared": True}):
        assert in_one_bucket(spark, 700, lambda a, b: linked(a, b) or linked(b, a), **more)[0] == {
            x: want[x] for p in pairs for x in p}


def test_buckets_of_two_as_pairs(spark):
    """Pairs beside the larger buckets give the same groups as buckets of two among them."""
    rows = [(b, 5 * b + i) for b in range(40) for i in range(8)]
    two = [(100 + k, n) for k in range(60) for n in (k, 3 * k + 20)]
    near = "(a + b) % 4 = 1"
    args = [lambda nodes: nodes.withColumn("number", F.col("node")), lambda pairs, held: pairs.filter(near), "number",
            lambda one, two: iter(())]
    whole = links.grouped(spark.createDataFrame(rows + two, "bucket long, node long"), *args)
    pairs = spark.createDataFrame([(k, 3 * k + 20) for k in range(60)], "a long, b long")
    larger = spark.createDataFrame([(*r, 8) for r in rows], "bucket long, node long, size long")
    got = dict(links.grouped(larger, *args, pairs=pairs).collect())
    assert got == dict(whole.collect()) and len(got) > 100


def test_small_buckets_are_checked(spark):
    buckets = spark.createDataFrame([(b, 10 * b + i) for b in range(30) for i in range(12)], "bucket long, node long")
    near = "(a % 10 < 3 and b = a + 1) or (a % 10 = 5 and b = a + 4)"
    roots = links.grouped(buckets, lambda nodes: nodes.withColumn("number", F.col("node")),
                          lambda pairs, held: pairs.filter(near), "number", lambda one, two: iter(()))
    shared = {(a, b) for k in range(30) for a in range(10 * k, 10 * k + 12) for b in range(a + 1, 10 * k + 12)}
    pairs = [(a, b) for a, b in shared if (a % 10 < 3 and b == a + 1) or (a % 10 == 5 and b == a + 4)]
    want = brute.components({x for p in pairs for x in p}, pairs)
    assert dict(roots.collect()) == want
