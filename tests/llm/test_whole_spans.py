"""Base matches at the edge of their pattern."""

import hashlib

import brute
from encore.llm import personal


def test_addresses_that_end_in_a_hyphen(spark):
    rows = [(1, "write to bob@site.org- today"), (2, "bob@site.org--see 1.2.3.4"), (3, "a@b.c- and d@e.f"), (4, "x@y-")]
    got = {r.doc_id: r for r in personal.private_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, t in rows:
        held = [f"{k}:{a}:{b}" for a, _, b, k in brute.base_spans(t)]
        assert got[d].n_email == sum(x.startswith("email") for x in held)
        assert got[d].base_sha256 == hashlib.sha256(",".join(held).encode()).hexdigest()
        assert set(held) <= set(got[d].spans.split(",")) | {""}
    assert [got[d].n_email for d in range(1, 5)] == [1, 1, 2, 0]
