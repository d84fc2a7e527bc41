"""Near-duplicate documents by HyperMinHash sketches.

A document's set holds its distinct five-word shingles. The sketch has `registers` registers; every shingle falls
into one, and a register keeps of its smallest hash only the number of leading zeros (6 bits) and the bits after
them (10 bits). Empty registers borrow from the first filled one in a fixed order of their own. Bands of four
registers form one 64-bit key each; documents that share a key are candidates. The share of equal registers, less the
equal registers that chance alone gives, estimates the similarity; what lies six standard errors below the threshold
goes, and everything else is confirmed on the full sets.

With 40 bands of four, a pair at similarity 0.75 shares none with a chance of 0.684^40, about 3 in 10^7.

Defined cases: a null or blank text has an empty set and is linked with nothing. A text of fewer than five words has
the whole sequence as its one shingle. Equal sets are one node, so repeated rows and exact copies are never paired.
Rows without a doc_id are kept, take part in no group and have a null component. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.llm.links import grouped
from encore.llm.texts import MIX_2, digest, mixed, shingles, word_hashes
from encore.sources.stage import staged

SHINGLE = 5
THRESHOLD = 0.75
REGISTERS = 160
ROWS = 4
MANTISSA_BITS = 10
EMPTY = np.uint16(0xFFFF)


def orders(registers: int) -> np.ndarray:
    """Row r: the order in which an empty register r asks the others."""
    at = np.arange(registers, dtype=np.uint64)
    return np.argsort(mixed(at[:, None] * np.uint64(MIX_2) + mixed(at)[None, :]), axis=1)


def sketch(values: np.ndarray, registers: int, order: np.ndarray) -> np.ndarray:
    """Compressed registers of a set of shingle hashes."""
    if len(values) == 0:
        return np.full(registers, EMPTY, dtype=np.uint16)
    bucket = ((values >> np.uint64(32)) * np.uint64(registers)) >> np.uint64(32)
    key = np.sort((bucket << np.uint64(54)) | (mixed(values) >> np.uint64(10)))
    edges = np.searchsorted(key, np.arange(registers + 1, dtype=np.uint64) << np.uint64(54))
    full = edges[1:] > edges[:-1]
    least = key[np.minimum(edges[:-1], len(key) - 1)] & np.uint64((1 << 54) - 1)
    # the float's exponent gives the leading zeros; one is added so that a zero has a logarithm
    zeros = 53 - np.minimum(np.frexp((least + np.uint64(1)).astype(np.float64))[1] - 1, 53)
    zeros = np.minimum(zeros, 53 - MANTISSA_BITS)
    shift = (53 - MANTISSA_BITS - zeros).astype(np.uint64)
    mantissa = (least >> shift) & np.uint64((1 << MANTISSA_BITS) - 1)
    out = (zeros.astype(np.uint64) << np.uint64(MANTISSA_BITS) | mantissa).astype(np.uint16)
    if not full.all():
        lacking = np.flatnonzero(~full)
        ask = order[lacking]
        out[lacking] = out[ask[np.arange(len(lacking)), full[ask].argmax(axis=1)]]
    return out


def expected_collisions(n, m, registers: int):
    """Registers that two disjoint sets of n and m shingles have equal by chance (Yu and Weber's approximation)."""
    n, m = np.maximum(n, m).astype(float), np.maximum(np.minimum(n, m), 1).astype(float)
    ratio = 4 * (n / m) / ((1 + n / m) ** 2)
    return 0.169919487159739 * registers * 2.0 ** -MANTISSA_BITS * ratio


def sketches(docs: DataFrame, id_col="doc_id", text_col="text", shingle=SHINGLE, registers=REGISTERS) -> DataFrame:
    """(doc_id, n_shingles, node, registers): node is 128 bits of the whole set, registers 2 bytes each."""
    schema = "doc_id long, n_shingles long, node binary, registers binary"

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = orders(registers)
        for batch in batches:
            rows = [(len(s), digest(s), sketch(s, registers, order).tobytes())
                    for s in (shingles(h, shingle) for h in word_hashes(batch.column(1)))]
            n, node, held = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(held, pa.binary())],
                ["doc_id", "n_shingles", "node", "registers"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return plain.mapInArrow(of, schema)


def bands(nodes: DataFrame, rows=ROWS) -> DataFrame:
    """(bucket, node): one row for each band of `rows` registers of each node."""

    def of(batches):
        for batch in batches:
            held = [np.frombuffer(x, dtype=np.uint16) for x in batch.column(1).to_pylist()]
            if not held:
                continue
            parts = np.array(held, dtype=np.uint64)
            parts = parts[:, :parts.shape[1] // rows * rows].reshape(len(held), -1, rows)
            key = np.repeat(np.arange(parts.shape[1], dtype=np.uint64)[None, :], len(held), axis=0)
            for i in range(rows):
                key = mixed(key * np.uint64(MIX_2) + parts[:, :, i])
            take = np.repeat(np.arange(len(held)), parts.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.reshape(-1).view(np.int64)), batch.column(0).take(pa.array(take))], ["bucket", "node"])

    return nodes.select("node", "registers").mapInArrow(of, "bucket long, node binary")


def _likely(pairs: DataFrame, held: DataFrame, threshold: float, registers: int) -> DataFrame:
    """Pairs whose estimate leaves the threshold within reach."""
    side = held.select("node", "n_shingles", "registers")
    both = pairs.join(side.toDF("a", "n_a", "r_a"), "a").join(side.toDF("b", "n_b", "r_b"), "b")
    floor = threshold - 6 * math.sqrt(threshold * (1 - threshold) / registers)

    def of(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            r_a, r_b = ([np.frombuffer(x, dtype=np.uint16) for x in column[c].to_pylist()] for c in ("r_a", "r_b"))
            n_a, n_b = column["n_a"].to_numpy(), column["n_b"].to_numpy()
            same = (np.array(r_a) == np.array(r_b)).sum(axis=1)
            estimate = (same - expected_collisions(n_a, n_b, registers)) / registers
            # registers of small sets repeat few shingles, so their estimate is too rough to decide on
            rough = np.minimum(n_a, n_b) < 2 * registers
            sizes = np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b)
            keep = pa.array(sizes & (rough | (estimate >= floor)))
            yield pa.RecordBatch.from_arrays([column[c].filter(keep) for c in ("a", "b")], ["a", "b"])

    return both.mapInArrow(of, "a binary, b binary")


def _own_texts(held: DataFrame, shingle: int) -> DataFrame:
    """The rows whose text is the node's own; a doc_id with several texts has others too."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.schema.fields)

    def of(batches):
        for batch in batches:
            sets = (shingles(h, shingle) for h in word_hashes(batch.column("text")))
            own = [digest(s) == node for s, node in zip(sets, batch.column("node").to_pylist())]
            yield batch.filter(pa.array(own, pa.bool_()))

    return held.mapInArrow(of, kinds).dropDuplicates(["node"])


def _confirmed(likely: DataFrame, held: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    whole = int(round(100 * threshold))
    side = held.select("node", "text")
    both = (likely.join(side.toDF("b", "text_b"), "b").join(side.toDF("a", "text_a"), "a")
            .select("a", "b", "text_a", "text_b"))

    def of(batches):
        for batch in batches:
            keep = []
            sets_b = (shingles(h, shingle) for h in word_hashes(batch.column(3)))
            sets_a = (shingles(h, shingle) for h in word_hashes(batch.column(2)))
            for s, t in zip(sets_a, sets_b):
                common = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * common >= whole * (len(s) + len(t) - common) and common > 0)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], ["a", "b"])

    return both.mapInArrow(of, "a binary, b binary")


def similar_sets(asking: list[np.ndarray], others: list[np.ndarray], whole: int) -> Iterator[tuple[int, int]]:
    """Positions of pairs of sets whose similarity is `whole` hundredths or more."""
    sizes = np.array([len(x) for x in others], dtype=np.int64)
    flat = np.concatenate(others) if others else np.zeros(0, dtype=np.uint64)
    ends = np.cumsum(sizes)
    for i, x in enumerate(asking):
        if not len(x):
            continue
        held = x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat
        upto = np.concatenate(([0], np.cumsum(held)))
        common = upto[ends] - upto[ends - sizes]
        for j in np.flatnonzero((common > 0) & (100 * common >= whole * (len(x) + sizes - common))):
            yield i, int(j)


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", shingle=SHINGLE, threshold=THRESHOLD,
                    registers=REGISTERS, rows=ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of docs.

    component_id is the smallest doc_id that links lead to, itself included; kept says doc_id = component_id, which
    repeated rows of that doc_id share. `threshold` is used in whole hundredths.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    held = staged(sketches(texts, shingle=shingle, registers=registers), "sketches")
    filled = held.filter("n_shingles > 0 and doc_id is not null")
    nodes = staged(filled.groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"),
        F.first("registers").alias("registers")), "nodes")

    def prepare(shared):
        own = nodes.drop("copies").join(shared, "node", "left_semi").join(texts, "doc_id")
        return staged(_own_texts(own, shingle), "candidates")

    def linked(pairs, candidates):
        likely = staged(_likely(pairs, candidates, threshold, registers), "likely")
        return _confirmed(likely, candidates, shingle, threshold)

    def compare(asking, others):
        return similar_sets(*([shingles(h, shingle) for h in word_hashes(pa.array(x, pa.binary()))]
                              for x in (asking, others)), int(round(100 * threshold)))

    roots = grouped(bands(nodes, rows), prepare, linked, "text", compare)
    first = roots.join(nodes.select("node", "doc_id"), "node").groupBy("root").agg(F.min("doc_id").alias("component"))
    linked_nodes = roots.join(first, "root").select("node", "component")
    copied = nodes.filter("copies > 1").select("node", "doc_id")
    named = (copied.join(linked_nodes, "node", "full")
             .select("node", F.coalesce("component", "doc_id").alias("component")))
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    component = F.coalesce(component, "doc_id")
    return (held.select("doc_id", "n_shingles", "node").join(named, "node", "left")
            .select("doc_id", "n_shingles", component.alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
