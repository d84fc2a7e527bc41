"""Packing: every piece in place, nothing overlaps, close to the least number of sequences."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from conftest import collected
from encore.llm import packing
from encore.llm.queries import QUERIES


@pytest.fixture(scope="module")
def ids_of():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [2]


def check(got, rows, ids_of, capacity=1024):
    """got: (doc_id, piece, start, length, ids_crc32, sequence_id, offset) of rows with distinct ids."""
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r[0], []).append(r)
        by_sequence.setdefault(r[5], []).append((r[6], r[3]))
    assert set(by_doc) == {d for d, _ in rows}
    for d, text in rows:
        ids, at = ids_of(text), 0
        for n, piece in enumerate(sorted(by_doc[d], key=lambda r: r[1])):
            part = np.array(ids[at:at + piece[3]], dtype="<u4")
            assert piece[1:5] == (n, at, len(part), zlib.crc32(part.tobytes())) and 0 < len(part) <= capacity
            assert n == 0 or len(part) == capacity
            at += len(part)
        assert at == len(ids) and (len(ids) > capacity or len(by_doc[d]) == 1)
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_all_documents(spark, small, rows, ids_of):
    got = collected(QUERIES["op4_sum_of_squares"](spark, small))
    n = check(got, rows, ids_of)
    assert n <= 1.03 * (sum(r[3] for r in got) / 1024 + 1)


def test_rule_by_hand():
    # 6 opens (gap 4); 4 fills it; 5 opens (gap 5); 5 fills it rather than open another
    assert packing.sum_of_squares(np.array([6, 4, 5, 5]), 10).tolist() == [0, 0, 1, 1]


def test_rule_keeps_the_sum_smallest():
    rng = np.random.default_rng(3)
    lengths, capacity = rng.integers(1, 13, 200), 12
    got, gaps = packing.sum_of_squares(lengths, capacity), {}
    total = lambda g: sum(n * n for n in np.bincount([x for x in g if 0 < x < capacity], minlength=1))
    for length, number in zip(lengths.tolist(), got.tolist()):
        choices = [{**gaps, k: v - length} for k, v in gaps.items() if v >= length] + [{**gaps, -1: capacity - length}]
        chosen = {**gaps, number: gaps.get(number, capacity) - length}
        assert total(chosen.values()) == min(total(c.values()) for c in choices)
        gaps = chosen


def test_sequences_hold_their_capacity():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 1024, 5000)
    number = packing.sequences(lengths, 1024)
    filled = np.bincount(number, weights=lengths)
    assert filled.max() <= 1024 and (filled > 0).sum() <= 1.04 * lengths.sum() / 1024


def test_groups_grow_with_the_input(spark):
    table = spark.range(5000).selectExpr("id AS doc_id", "id % 1023 + 1 AS length")
    got = packing.pack(table, group_rows=1000)
    assert got.selectExpr("shiftright(sequence_id, 32) AS g").distinct().count() == 5 and got.count() == 5000


def test_odd_rows(odd, odd_rows, ids_of):
    got = collected(packing.packed_documents(odd))
    assert sum(r[3] for r in got) == sum(len(ids_of(t)) for _, t in odd_rows)
    once = [(d, t) for d, t in odd_rows if d is not None and d != 4]
    assert sorted({r[0] for r in got if r[0] is not None}) == sorted({d for d, _ in odd_rows if d is not None})
    assert {d: len(ids_of(t)) for d, t in once} == {d: sum(r[3] for r in got if r[0] == d) for d, _ in once}


def test_special_token_in_a_text(spark, ids_of):
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>"), (3, " naïve 日本 \n\n  x")]
    check(collected(packing.packed_documents(spark.createDataFrame(rows, "doc_id long, text string"))), rows, ids_of)


def test_empty_table(none):
    assert packing.packed_documents(none).collect() == []
