"""Rows without an id and repeated ids."""

import corpus_pipeline
from conftest import PROSE, collected
from encore.llm import decontaminate

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def words(n):
    return " ".join(f"{n}w{i}" for i in range(60))


def documents(spark, rows):
    return spark.createDataFrame([(d, t, None, "s", None) for d, t in rows], DOCUMENT)


def test_near_copies_are_judged_by_row(spark, small):
    a, b, c = words("a"), words("b"), words("c")
    rows = [(None, a), (None, a), (None, c), (5, a), (5, a), (5, b), (3, a + " end"), (7, b), (8, None), (8, c), (9, c)]
    out = corpus_pipeline.near_dedup(spark, documents(spark, rows), small)
    assert out.columns == corpus_pipeline.COLUMNS
    assert collected(out.select("doc_id", "text")) == [
        (None, a), (None, a), (None, c), (3, a + " end"), (5, b), (8, None), (8, c)]


def test_leaking_rows_without_an_id_go(spark):
    rows = [(None, PROSE), (None, words("a")), (None, None), (1, PROSE), (2, words("b"))]
    held = spark.createDataFrame([(1, PROSE)], "item_id long, text string")
    left = decontaminate.without_leaks(documents(spark, rows), held)
    assert collected(left.select("doc_id", "text")) == [(None, None), (None, words("a")), (2, words("b"))]
