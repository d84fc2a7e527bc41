"""Nested files of any size, each read by as many tasks as it has splits.

A JSON reader needs a nested file whole. Here it is read as lines, which Spark splits by bytes, and cut between the elements
of its array of playlists. No string of valid JSON holds a line break, so a line can be scanned by itself; what a split does
not know is how deep it starts. So first every split counts its brackets, and sums over the splits before it give the depth.
Then every split cuts out the elements that lie in it whole, and the pieces of those that cross its bounds; the pieces
of an element, numbered by the elements that start before them, are put together. Each element is parsed on its own.

A task holds one element at a time. A file without line breaks is one split. An element that does not parse, and
a file whose brackets do not match, are kept as corrupt records.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql import types as T

from encore import schemas
from encore.sources.files import CORRUPT, SLICE_PATTERN
from encore.sources.stage import staged

TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|[{}\[\]]')
DEEPER = {"{": 1, "[": 1, "}": -1, "]": -1}
#: Elements lie in an array of the file's one object: {"playlists": [ element, ...
INSIDE = 2
PIECES = "file string, split long, nth int, kind string, name string, text string"


def _pieces(lines: Iterator[tuple[str, int, int, str]]) -> Iterator[tuple]:
    """(file, split, nth, kind, name, text) of lines (file, split, depth at the split's start, line).

    kind: whole, begins, goes on (an element that began before the split), or ends with an array's name (text null).
    name: of the array, null where it began before the split.
    """
    at, depth, nth, name, key, held, began = None, 0, 0, None, None, None, False

    def closed():
        if at is not None and held is not None:
            yield (*at, nth, "begins" if began else "goes on", name, "\n".join(held))
        if at is not None and name is not None:
            yield (*at, nth, "array", name, None)

    for file, split, start, line in lines:
        if (file, split) != at:
            yield from closed()
            at, depth, nth, name, key = (file, split), start, 0, None, None
            held, began = ([], False) if depth > INSIDE else (None, False)
        first = 0
        for found in TOKEN.finditer(line):
            token = found[0]
            if token[0] == '"':
                if depth == 1:
                    key = token[1:-1]
            elif token in "{[":
                if depth == 1 and token == "[":
                    name = key
                elif depth == INSIDE and held is None:
                    held, began, first, nth = [], True, found.start(), nth + 1
                depth += 1
            else:
                depth -= 1
                if depth == INSIDE and held is not None:
                    held.append(line[first:found.end()])
                    yield (*at, nth, "whole" if began else "goes on", name, "\n".join(held))
                    held, began = None, False
        if held is not None:
            held.append(line[first:])
    yield from closed()


def read_large_slices(spark: SparkSession, folder: str, pattern: str = SLICE_PATTERN, array: str = "playlists") -> DataFrame:
    """(file, playlists, _corrupt_record): one row for each element of the files' array, as an array of one.

    The rows stand for those of `read_slices`, with a row for each element in place of one for each file.
    """
    lines = spark.read.text(f"{folder.rstrip('/')}/{pattern}").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")

    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[tuple[str, int], int] = {}
            for file, split, line in zip(*(c.to_pylist() for c in batch.columns)):
                total[file, split] = total.get((file, split), 0) + sum(DEEPER.get(t, 0) for t in TOKEN.findall(line))
            if total:
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, zip(*total)), pa.array(total.values(), pa.int64())], ["file", "split", "change"])

    counted = lines.mapInArrow(changes, "file string, split long, change long")
    splits = staged(counted.groupBy("file", "split").agg(F.sum("change").alias("change")), "splits")
    before = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    placed = splits.select("file", "split", F.coalesce(F.sum("change").over(before), F.lit(0)).cast("long").alias("depth"),
                           F.sum("change").over(W.partitionBy("file")).alias("left"))
    broken = placed.filter("left <> 0").select("file").distinct()

    # a table of one row for each split; the lines keep their order, as a broadcast moves none of them
    opened = lines.join(F.broadcast(placed.filter("left = 0").select("file", "split", "depth")), ["file", "split"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PIECES.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("file", "split", "depth", "value"))))
        some, size = [], 0
        for piece in _pieces(rows):
            some.append(piece)
            size += len(piece[5] or "")
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], names)
                some, size = [], 0
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], names)

    pieces = staged(opened.select("file", "split", "depth", "value").mapInArrow(of, PIECES), "pieces")
    # what a split's pieces inherit: the array that was open, and how many elements began before
    known = placed.select("file", "split").join(
        pieces.groupBy("file", "split").agg(
            F.max(F.when(F.col("kind") == "array", F.col("name"))).alias("last"),
            F.max("nth").alias("begun")), ["file", "split"], "left")
    known = known.select(
        "file", "split", F.last("last", ignorenulls=True).over(before).alias("inherited"),
        F.coalesce(F.sum("begun").over(before), F.lit(0)).alias("earlier"))
    elements = pieces.filter("kind <> 'array'").join(known, ["file", "split"]).select(
        "file", "split", "kind", F.coalesce("name", "inherited").alias("name"), "text",
        (F.col("earlier") + F.col("nth")).alias("number"))
    apart = elements.filter("kind <> 'whole'").groupBy("file", "number").agg(
        F.sort_array(F.collect_list(F.struct("split", "name", "text"))).alias("parts")).select(
        "file", F.get("parts.name", 0).alias("name"), F.array_join("parts.text", "\n").alias("text"))
    texts = elements.filter("kind = 'whole'").select("file", "name", "text").unionByName(apart).filter(F.col("name") == array)

    element = next(f for f in schemas.SLICE.fields if f.name == array).dataType.elementType
    readable = T.StructType([*element.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = texts.select("file", F.from_json("text", readable, {"columnNameOfCorruptRecord": CORRUPT}).alias("p"))
    good = F.when(F.col(f"p.{CORRUPT}").isNull(), F.array(F.struct(*[F.col(f"p.{f.name}") for f in element.fields])))
    lost = broken.select("file", F.lit(None).cast(T.ArrayType(element)).alias("playlists"),
                         F.concat(F.lit("brackets do not match in "), "file").alias(CORRUPT))
    return parsed.select("file", good.alias("playlists"), F.col(f"p.{CORRUPT}").alias(CORRUPT)).unionByName(lost)
