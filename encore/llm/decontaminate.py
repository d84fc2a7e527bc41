"""Benchmark items in training documents, also edited ones: rare n-gram seeds, then Smith-Waterman alignment.

1. How many documents hold each three-word gram of the benchmark is counted over the whole corpus.
2. Of every two neighbouring grams of an item the rarer one becomes a seed, so each four words in a row that a
   document shares with an item hold a seed, however common its words are.
3. Words around the seeds of a document make passages: a seed reaches as far as the longest item, and passages that
   touch are one. They are joined to the items by seed.
4. The best local alignment of passage and item (match 2, mismatch -1, gap -1 by words) is divided by the item's
   alignment with itself. `least` of it makes a leak.

Grams of the benchmark are sent to the tasks in blocks of at most `block_grams`, one pass over the documents for each
block, so a large benchmark costs passes, not memory. Words are runs of letters, digits and non-ASCII characters, in lower
case. Defined cases: an item of fewer than three words has no seed and is never found; null and blank texts match
nothing; rows of a repeated doc_id or item_id are matched each; a null doc_id is kept; extra columns are ignored by
`leaks` and kept by `without_leaks`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from encore.llm.texts import BARE, grams, run_words, word_hashes
from encore.sources.stage import staged

SEED_WORDS = 3
WINDOW = 2
LEAST = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_GRAMS = 1 << 20


def _plain(table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return table.select(F.col(id_col).cast("long").alias("id"), F.lower(F.col(text_col).cast("string")).cast("binary").alias("text"))


def item_table(benchmark: DataFrame, seed_words: int) -> DataFrame:
    """(item, item_id, words, grams): words are hashes of 8 bytes each; item numbers the rows."""

    def of(batches):
        for batch in batches:
            own = list(word_hashes(batch.column(2), BARE))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x.tobytes() for x in own], pa.binary()),
                 pa.array([grams(x, seed_words).view(np.int64) for x in own], pa.list_(pa.int64()))],
                ["item", "item_id", "words", "grams"])

    return benchmark.withColumn("item", F.monotonically_increasing_id()).select("item", "id", "text").mapInArrow(
        of, "item long, item_id long, words binary, grams array<long>")


def _blocks(wanted: DataFrame, block_grams: int) -> Iterator[np.ndarray]:
    """Sorted distinct grams, at most about block_grams at a time."""
    wanted = staged(wanted.select("gram").distinct(), "grams")
    blocks = max(1, -(-wanted.count() // block_grams))
    for b in range(blocks):
        part = wanted.filter(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == b)
        held = np.sort(np.array([r[0] for r in part.toLocalIterator()], dtype=np.int64).view(np.uint64))
        if len(held):
            yield held


def _found(hashes: np.ndarray, cuts: np.ndarray, size: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position among all words, gram) of the wanted grams that lie within a row, in order."""
    every = grams(hashes, size)
    at = np.searchsorted(wanted, every)
    hit = np.flatnonzero(wanted[np.minimum(at, len(wanted) - 1)] == every)
    row = np.searchsorted(cuts, hit, side="right") - 1
    inside = hit + size <= cuts[row + 1]
    return row[inside], hit[inside], every[hit[inside]]


def document_counts(docs: DataFrame, wanted: DataFrame, size: int, block_grams: int) -> DataFrame:
    """(gram, n): how many rows of (id, text) hold each wanted gram, if any does."""
    spark, out = docs.sparkSession, None
    for block in _blocks(wanted, block_grams):
        sent = spark.sparkContext.broadcast(block)

        def of(batches, sent=sent):
            wanted = sent.value
            total = np.zeros(len(wanted), dtype=np.int64)
            for batch in batches:
                for _, hashes, cuts in run_words(batch.column(0), BARE):
                    row, _, gram = _found(hashes, cuts, size, wanted)
                    if len(row):
                        once = np.unique(row.astype(np.uint64) * np.uint64(len(wanted))
                                         + np.searchsorted(wanted, gram).astype(np.uint64))
                        np.add.at(total, (once % np.uint64(len(wanted))).astype(np.int64), 1)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(wanted[some].view(np.int64)), pa.array(total[some])], ["gram", "n"])

        part = staged(docs.select("text").mapInArrow(of, "gram long, n long").groupBy("gram").agg(
            F.sum("n").alias("n")), "gram-counts")
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], "gram long, n long")


def seeds(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """(gram, item): the rarest gram of each `window` neighbouring grams of an item."""
    each = items.select("item", F.posexplode("grams").alias("at", "gram")).join(counts, "gram", "left")
    rank = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")
    ahead = Window.partitionBy("item").orderBy("at").rowsBetween(0, window - 1)
    best = each.select("item", F.min(rank).over(ahead)["gram"].alias("gram"))
    return best.distinct()


def passages(docs: DataFrame, wanted: DataFrame, size: int, reach: int, block_grams: int) -> DataFrame:
    """(doc_id, start, words, seeds): word runs around seeds; start counts the document's words before the run."""
    spark, out = docs.sparkSession, None
    for block in _blocks(wanted, block_grams):
        sent = spark.sparkContext.broadcast(block)

        def of(batches, sent=sent):
            for batch in batches:
                for first, hashes, cuts in run_words(batch.column(1), BARE):
                    row, at, gram = _found(hashes, cuts, size, sent.value)
                    if not len(row):
                        continue
                    low, high = np.maximum(at - reach, cuts[row]), np.minimum(at + size + reach, cuts[row + 1])
                    new = np.concatenate(([True], (row[1:] != row[:-1]) | (low[1:] > high[:-1])))
                    begin = np.flatnonzero(new)
                    end = np.append(begin[1:], len(row))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(first + row[begin])),
                         pa.array((low[begin] - cuts[row[begin]]).astype(np.int64)),
                         pa.array([hashes[low[a]:high[b - 1]].tobytes() for a, b in zip(begin, end)], pa.binary()),
                         pa.array([np.unique(gram[a:b]).view(np.int64) for a, b in zip(begin, end)],
                                  pa.list_(pa.int64()))],
                        ["doc_id", "start", "words", "seeds"])

        part = docs.select("id", "text").mapInArrow(of, "doc_id long, start long, words binary, seeds array<long>")
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], "doc_id long, start long, words binary, seeds array<long>")


def best_alignment(p: np.ndarray, t: np.ndarray) -> tuple[int, int]:
    """Score of the best local alignment of two word sequences, and where it ends in t."""
    best, end = 0, 0
    steps = np.arange(len(t) + 1) * -GAP
    row = np.zeros(len(t) + 1, dtype=np.int64)
    for x in p:
        new = np.zeros(len(t) + 1, dtype=np.int64)
        np.maximum(row[:-1] + np.where(t == x, MATCH, MISMATCH), row[1:] + GAP, out=new[1:])
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + steps) - steps
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def scored(p: np.ndarray, t: np.ndarray, least: float) -> tuple[float, int, int] | None:
    """(score, start, end in t) of item p in passage t, if the score reaches `least`."""
    full = MATCH * len(p)
    if MATCH * np.isin(p, t).sum() < least * full:
        return None
    score, end = best_alignment(p, t)
    if score < least * full:
        return None
    back, length = best_alignment(p[::-1], t[:end][::-1])
    return score / full, end - length, end


def leaks(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_id_col="item_id",
          item_text_col="text", seed_words=SEED_WORDS, window=WINDOW, least=LEAST, block_grams=BLOCK_GRAMS) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): the best alignment of each passage and item that is a leak."""
    docs = _plain(docs, id_col, text_col)
    items = staged(item_table(_plain(benchmark, item_id_col, item_text_col), seed_words), "items")
    every = items.select(F.explode("grams").alias("gram"))
    chosen = staged(seeds(items, document_counts(docs, every, seed_words, block_grams), window), "seeds")
    reach = items.agg(F.max(F.length("words") / 8).cast("int")).first()[0] or 0
    held = staged(passages(docs, chosen, seed_words, reach, block_grams), "passages").withColumn(
        "passage", F.monotonically_increasing_id())
    pairs = (held.select("passage", F.explode("seeds").alias("gram")).join(chosen, "gram")
             .select("passage", "item").distinct())
    both = (pairs.join(held.select("passage", "doc_id", "start", "words"), "passage")
            .join(items.select("item", "item_id", F.col("words").alias("item_words")), "item")
            .select("doc_id", "start", "words", "item_id", "item_words"))

    def of(batches):
        for batch in batches:
            rows = []
            for doc_id, start, words, item_id, own in zip(*(c.to_pylist() for c in batch.columns)):
                hit = scored(np.frombuffer(own, dtype=np.uint64), np.frombuffer(words, dtype=np.uint64), least)
                if hit:
                    rows.append((doc_id, item_id, hit[0], start + hit[1], start + hit[2]))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows) if rows else ((),) * 5, kinds)],
                ["doc_id", "item_id", "score", "start_word", "end_word"])

    return both.mapInArrow(of, "doc_id long, item_id long, score double, start_word long, end_word long")


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", **of) -> DataFrame:
    """The rows in which no item was found, those without an id among them."""
    key = next(n for i in count() if (n := f"row_{i}") not in docs.columns)
    rows = staged(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    found = leaks(rows, benchmark, key, **of).select(F.col("doc_id").alias(key)).distinct()
    return rows.join(found, key, "left_anti").select(*docs.columns)
