"""Token sequences on disk in training order.

1. Each task joins its documents' ids, every document with its end token, to one stream and cuts it into sequences of
   `length` ids; only a task's last sequence may be shorter and is padded with zeros. Blocks of sequences are staged,
   compressed, so the texts are tokenised once.
2. The sequences of all tasks are numbered through from the counts of the tasks. A keyed Feistel permutation over the
   next even number of bits, walked along its cycle until it falls below the number of sequences, gives each sequence
   its slot, without a table and without a sort.
3. Sequences travel to the range of slots of their shard, compressed by shard, and each range writes one file: slot s
   lies in shard s // per_shard at byte (s % per_shard) * stride. A file is written under a name of its own and then
   renamed, so a repeated task only replaces equal bytes.

A trainer reads shards front to back, and finds any slot again by its number alone (`read_slots`). The counts, one
number a task, are all that the driver holds.

Defined cases: a null or empty text is its end token; repeated rows are written each; a null doc_id is a null in
doc_ids; no rows give no shards; extra columns are ignored; a document of any length spans sequences.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.llm.archives import file_system
from encore.llm.texts import mixed
from encore.llm.tokens import END_OF_TEXT, VOCABULARY, document_ids, encoder
from encore.sources.stage import new_path, staged

LENGTH = 1024
PER_SHARD = 8192
KEY = 20240229
ROUNDS = 4
BLOCK = 512
HELD_BYTES = 1 << 26
ID = np.dtype("<u2")
LEVEL = 3


def feistel(x: np.ndarray, bits: int, key: int) -> np.ndarray:
    """A keyed one-to-one map of the numbers below 2^bits; bits is even."""
    half = np.uint64(bits // 2)
    low = np.uint64((1 << bits // 2) - 1)
    left, right = x >> half, x & low
    for i in range(ROUNDS):
        salt = mixed(np.array([key * ROUNDS + i], dtype=np.uint64))[0]
        left, right = right, left ^ (mixed(right ^ salt) & low)
    return left << half | right


def slots(index: np.ndarray, total: int, key: int) -> np.ndarray:
    """The slots of sequences below `total`: all different, all below `total`."""
    bits = max(2, (max(total - 1, 1)).bit_length())
    bits += bits % 2
    out = feistel(index.astype(np.uint64), bits, key)
    while len(far := np.flatnonzero(out >= total)):
        out[far] = feistel(out[far], bits, key)
    return out.astype(np.int64)


def sequence_blocks(docs: DataFrame, length: int, vocabulary: str, end: int) -> DataFrame:
    """(task, first, n_tokens, doc_ids, ids): runs of a task's sequences; ids are compressed, with padding."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pack = encoder(vocabulary), zstandard.ZstdCompressor(level=LEVEL)
        task, first = TaskContext.get().partitionId(), 0
        block, sizes, owners = [], [], []
        here, room, held = [], length, []

        def ready():
            nonlocal block, sizes, owners, first
            out = pa.RecordBatch.from_arrays(
                [pa.array([task], pa.int32()), pa.array([first], pa.int64()), pa.array([sizes], pa.list_(pa.int32())),
                 pa.array([owners], pa.list_(pa.list_(pa.int64()))),
                 pa.array([pack.compress(np.concatenate(block).tobytes())], pa.binary())],
                ["task", "first", "n_tokens", "doc_ids", "ids"])
            first += len(sizes)
            block, sizes, owners = [], [], []
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = document_ids(text.as_py(), encode, end).astype(ID)
                while len(ids):
                    here.append(ids[:room])
                    held.append(doc_id)
                    room, ids = room - len(here[-1]), ids[room:]
                    if room == 0:
                        block += here
                        sizes.append(length)
                        owners.append(held)
                        here, room, held = [], length, []
                        if len(sizes) == BLOCK:
                            yield ready()
        if here:
            block += here + [np.zeros(room, dtype=ID)]
            sizes.append(length - room)
            owners.append(held)
        if sizes:
            yield ready()

    plain = docs.select(F.col("id"), F.col("text"))
    return plain.mapInArrow(
        of, "task int, first long, n_tokens array<int>, doc_ids array<array<long>>, ids binary")


def numbered(blocks: DataFrame) -> tuple[dict[int, int], int]:
    """Number of the first sequence of each task, and the number of all sequences."""
    counts = blocks.groupBy("task").agg(F.sum(F.size("n_tokens")).alias("n")).orderBy("task").collect()
    start, at = {}, 0
    for task, n in counts:
        start[task] = at
        at += n
    return start, at


def places(blocks: DataFrame, start, total: int, key: int) -> DataFrame:
    """(slot, n_tokens, doc_ids) of every sequence."""

    def of(batches):
        for batch in batches:
            for task, first, sizes, owners in zip(*(c.to_pylist() for c in batch.columns)):
                at = slots(start.value[task] + first + np.arange(len(sizes)), total, key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at), pa.array(sizes, pa.int32()), pa.array(owners, pa.list_(pa.int64()))],
                    ["slot", "n_tokens", "doc_ids"])

    return blocks.select("task", "first", "n_tokens", "doc_ids").mapInArrow(
        of, "slot long, n_tokens int, doc_ids array<long>")


def by_shard(blocks: DataFrame, start, total: int, key: int, length: int, per_shard: int) -> DataFrame:
    """(shard, at, ids): sequences bound for a shard, their places in it, and their ids compressed together."""

    def of(batches):
        pack, unpack = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for task, first, ids in zip(*(c.to_pylist() for c in batch.columns)):
                rows = np.frombuffer(unpack.decompress(ids), dtype=ID).reshape(-1, length)
                held.append((slots(start.value[task] + first + np.arange(len(rows)), total, key), rows))
                size += rows.nbytes
                if size >= HELD_BYTES:
                    yield from sent(held, pack)
                    held, size = [], 0
        yield from sent(held, pack)

    def sent(held, pack):
        if not held:
            return
        at = np.concatenate([x for x, _ in held])
        rows = np.concatenate([x for _, x in held])
        order = np.argsort(at)
        at, shard = at[order], at[order] // per_shard
        edges = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(at)]))
        for a, b in zip(edges[:-1], edges[1:]):
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard[a]], pa.int32()), pa.array([at[a:b] % per_shard], pa.list_(pa.int32())),
                 pa.array([pack.compress(rows[order[a:b]].tobytes())], pa.binary())], ["shard", "at", "ids"])

    return blocks.select("task", "first", "ids").mapInArrow(of, "shard int, at array<int>, ids binary")


def write_shards(parts: DataFrame, folder: str, total: int, length: int, per_shard: int) -> DataFrame:
    """(shard, path, n): one file for each shard; a partition holds one shard."""
    n_shards = -(-total // per_shard)

    def of(batches):
        unpack = zstandard.ZstdDecompressor()
        shard, data, filled = None, None, 0
        for batch in batches:
            for number, at, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if shard is None:
                    shard = number
                    data = np.zeros((min(per_shard, total - shard * per_shard), length), dtype=ID)
                if number != shard:
                    raise ValueError("two shards in one partition")
                data[at] = np.frombuffer(unpack.decompress(ids), dtype=ID).reshape(-1, length)
                filled += len(at)
        if shard is None:
            return
        if filled != len(data):
            raise ValueError(f"shard {shard} got {filled} of {len(data)} sequences")
        system, place = file_system(folder)
        system.create_dir(place, recursive=True)
        name = f"shard-{shard:08d}.bin"
        own = f"{place}/.{name}-{uuid.uuid4().hex}"
        with system.open_output_stream(own) as out:
            out.write(data)
        system.move(own, f"{place}/{name}")
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([len(data)], pa.int64())],
            ["shard", "path", "n"])

    return staged(parts.repartitionById(max(1, n_shards), "shard").mapInArrow(of, "shard int, path string, n long"),
                  "shard-list")


def read_slots(folder: str, first: int, count: int, length: int = LENGTH, per_shard: int = PER_SHARD) -> np.ndarray:
    """The sequences of consecutive slots, for a trainer that starts or goes on at slot `first`."""
    system, place = file_system(folder)
    stride, out = length * ID.itemsize, []
    while count > 0:
        shard, at = divmod(first, per_shard)
        n = min(count, per_shard - at)
        with system.open_input_file(f"{place}/shard-{shard:08d}.bin") as file:
            file.seek(at * stride)
            out.append(np.frombuffer(file.read(n * stride), dtype=ID).reshape(-1, length))
        first, count = first + n, count - n
    return np.concatenate(out) if out else np.zeros((0, length), dtype=ID)


def shard_rows(files: DataFrame, length: int, per_shard: int) -> DataFrame:
    """(slot, shard, byte_offset, ids_crc32) of every slot, from the files; the hash is over the whole stride."""
    stride = length * ID.itemsize

    def of(batches):
        for batch in batches:
            for shard, path, n in zip(*(c.to_pylist() for c in batch.columns)):
                system, place = file_system(path)
                with system.open_input_stream(place) as file:
                    crc = [zlib.crc32(file.read(stride)) for _ in range(n)]
                at = np.arange(n, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at + shard * per_shard), pa.array(np.full(n, shard, dtype=np.int32)),
                     pa.array(at * stride), pa.array(crc, pa.int64())], ["slot", "shard", "byte_offset", "ids_crc32"])

    return files.select("shard", "path", "n").mapInArrow(
        of, "slot long, shard int, byte_offset long, ids_crc32 long")


def materialised(docs: DataFrame, folder: str | None = None, length=LENGTH, per_shard=PER_SHARD, key=KEY,
                 id_col="doc_id", text_col="text", vocabulary=VOCABULARY, end=END_OF_TEXT) -> DataFrame:
    """Write the shards and return one row a sequence, hashed as read back from them.

    (slot, shard, byte_offset, n_tokens, doc_ids, ids_crc32); doc_ids are those of the documents in the sequence, in
    order.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "shards")
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = staged(sequence_blocks(plain, length, vocabulary, end), "sequence-blocks")
    first, total = numbered(blocks)
    start = spark.sparkContext.broadcast(first)
    files = write_shards(by_shard(blocks, start, total, key, length, per_shard), folder, total, length, per_shard)
    # the list of shards is short, but their rows are as many as the sequences: never a side to broadcast
    held = shard_rows(files, length, per_shard).hint("merge")
    return places(blocks, start, total, key).join(held, "slot").select(
        "slot", "shard", "byte_offset", "n_tokens", "doc_ids", "ids_crc32")
