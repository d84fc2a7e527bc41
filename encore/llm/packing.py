"""Packing documents into sequences of fixed capacity by the sum-of-squares rule.

Each piece goes where the sum over all gaps g of N(g)^2 becomes smallest, N(g) being the number of open sequences
with g tokens left; opening a new sequence is one of the choices, and of equal choices the smallest gap wins. Pieces
come in a shuffled order, under which the rule wastes little whatever the lengths are. Sequences that are still open
at the end are taken apart and packed again longest first, each piece into the fullest sequence with room. Only documents longer than the capacity are cut: whole sequences from the end, what is left over
first.

Pieces are dealt evenly into groups of `group_rows`, whose number grows with the input; each group is packed by
itself, so no task sees more than a group, and only a group's last open sequences stay partly filled. Pieces that fill
a sequence need no packing.

Defined cases: a null or empty text is one piece that holds the end token. Repeated rows are packed once each. A null
doc_id is kept. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.llm.tokens import END_OF_TEXT, VOCABULARY, document_ids, encoder
from encore.sources.stage import staged

CAPACITY = 1024
GROUP_ROWS = 1 << 16


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    first = n % capacity if n > capacity else n
    starts = list(range(first, n, capacity))
    return ([(0, first)] if first else []) + [(s, capacity) for s in starts]


def sum_of_squares(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The number of the sequence of each piece, in the order given; 0 < length <= capacity."""
    # with -1/2 for full and 1/2 for new sequences, the change of the sum is 2 (N[g - length] - N[g]) + 2 for every g
    counts = np.zeros(capacity + 1)
    counts[0], counts[capacity] = -0.5, 0.5
    usable = np.full(capacity + 1, -np.inf)
    usable[capacity] = 0.5
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, made = np.empty(len(lengths), dtype=np.int64), 0
    for i, length in enumerate(lengths.tolist()):
        gap = length + int(np.argmin(counts[:capacity + 1 - length] - usable[length:]))
        if gap == capacity:
            out[i], made = made, made + 1
        else:
            out[i] = waiting[gap].pop()
            counts[gap] -= 1
            usable[gap] = counts[gap] if counts[gap] > 0 else -np.inf
        left = gap - length
        if left:
            waiting[left].append(int(out[i]))
            counts[left] += 1
            usable[left] = counts[left]
    return out


def longest_first(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The number of the sequence of each piece: the longest first, into the fullest sequence that has room."""
    open_gaps: list[tuple[int, int]] = []
    out, made = np.empty(len(lengths), dtype=np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        at = bisect.bisect_left(open_gaps, (length, -1))
        if at == len(open_gaps):
            gap, number, made = capacity, made, made + 1
        else:
            gap, number = open_gaps.pop(at)
        out[i] = number
        if gap > length:
            bisect.insort(open_gaps, (gap - length, number))
    return out


def sequences(lengths: np.ndarray, capacity: int, seed: int = 0) -> np.ndarray:
    """The number of the sequence of each piece: sum of squares, then the open sequences packed again."""
    order = np.random.default_rng(seed).permutation(len(lengths))
    number = np.empty(len(lengths), dtype=np.int64)
    number[order] = sum_of_squares(lengths[order], capacity)
    filled = np.bincount(number, weights=lengths)
    again = np.flatnonzero(filled[number] < capacity)
    packed = longest_first(lengths[again], capacity)
    if len(again) and packed.max() + 1 < (filled < capacity).sum():
        number[again] = len(filled) + packed
    return number


def pieces(docs: DataFrame, capacity=CAPACITY, id_col="doc_id", text_col="text", vocabulary=VOCABULARY,
           end=END_OF_TEXT) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = document_ids(text.as_py(), encode, end)
                for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[start:start + length].tobytes())))
            columns = zip(*rows) if rows else ((),) * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(of, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(table: DataFrame, capacity=CAPACITY, group_rows=GROUP_ROWS) -> DataFrame:
    """`table` with sequence_id and offset; its `length` lies between 1 and the capacity."""
    table = staged(table, "pieces").withColumn("at", F.monotonically_increasing_id())
    whole = F.col("length") == capacity
    groups = -(-table.filter(~whole).count() // group_rows) or 1
    part = table.filter(~whole).withColumn("group", F.pmod(F.xxhash64("at"), F.lit(groups)))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.drop("at").schema.fields)

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        group = int(rows["group"].iloc[0])
        rows = rows.sort_values("at")
        number = sequences(rows["length"].to_numpy(), capacity, group)
        before = rows.groupby(number)["length"].cumsum() - rows["length"]
        return rows.drop(columns=["at", "group"]).assign(sequence_id=(group << 32) + number, offset=before)

    packed = part.repartition(groups, "group").groupBy("group").applyInPandas(
        of, f"{kinds}, sequence_id long, offset long")
    alone = table.filter(whole).withColumn("sequence_id", -1 - F.col("at")).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(alone.drop("at"))


def packed_documents(docs: DataFrame, capacity=CAPACITY, group_rows=GROUP_ROWS, **of) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    return pack(pieces(docs, capacity, **of), capacity, group_rows)
