"""Web archives packaged as ZIP files: written by Spark tasks, read by range without unpacking.

An archive holds two stored (uncompressed) members: `archive/data.warc.gz`, WARC records that are gzip members each,
and `indexes/index.cdxj`, one line a record with its place. Reading goes from the end of the file: end record, ZIP64
locator and end record where there is one, central directory, the local header of each member. The index gives
every record's place, near records become one range, ranges are dealt out to tasks, and each task reads just its
ranges. Any file system that pyarrow knows by its address will do, as long as all executors see it.

Each attempt of a task writes files of its own names, and only the names that a finished task returns are read, so
lost or repeated tasks do no harm. Of payloads that are equal and not short, the one with the smallest id is a
`response` record, the others are `revisit` records without a payload that refer to it.

Defined cases: a null payload is empty; a null id or address is written as such and comes back null; rows that repeat
the smallest id of a payload are all responses; no rows give no archives; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.sources.stage import new_path, staged

MIN_BYTES = 100
ARCHIVE_BYTES = 1 << 28
RANGE_BYTES = 1 << 22
RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2000-01-01T00:00:00Z"
ID = "urn:page:"
#: Fixed values of the formats: signatures and layouts of ZIP parts, the profile of revisit records.
END, END_64, LOCATOR_64, ENTRY, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
END_LAYOUT, END_64_LAYOUT, LOCATOR_LAYOUT = "<4s4H2LH", "<4sQ2H2L4Q", "<4sLQL"
ENTRY_LAYOUT, LOCAL_LAYOUT = "<4s6H3L5H2L", "<4s5H3L2H"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PLACES = "archive string, start long, offsets array<long>, lengths array<long>"
RECORD = ("record_type string, record_id string, refers_to string, target_uri string, payload_digest string, "
          "payload binary")


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(path)


# ---- writing

def classed(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(id, url, payload, digest, first): first is the id of the response that a revisit refers to, else null."""
    hashed = pages.withColumn("digest", F.sha2("payload", 256))
    long = hashed.filter(F.length("payload") >= min_bytes)
    first = long.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    joined = hashed.join(first, "digest", "left")
    return joined.select("id", "url", "payload", "digest", F.when(
        F.col("least").isNotNull() & ~F.col("id").eqNullSafe(F.col("least")), F.col("least")).alias("first"))


def record(name: str, url: str | None, payload: bytes, digest: str, first: str | None) -> bytes:
    """One WARC record; a revisit has the header of the HTTP answer only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <{name}>",
             f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(url.splitlines()))
    if first is not None:
        lines += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: <{first}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archive(path: str, rows: Iterator[tuple], limit: int) -> tuple[int, bool]:
    """Write (id, url, payload, digest, first) rows until the records take `limit` bytes: (records, whether rows ended)."""
    system, place = file_system(path)
    index, at, ended = io.StringIO(), 0, False
    with system.open_output_stream(place) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
        written = 0
        with archive.open(zipfile.ZipInfo(RECORDS), "w", force_zip64=True) as member:
            while at < limit:
                row = next(rows, None)
                if row is None:
                    ended = True
                    break
                key, url, payload, digest, first = row
                data = gzip.compress(record(f"{ID}{key}", url, payload or b"", digest,
                                            None if first is None else f"{ID}{first}"), 6, mtime=0)
                member.write(data)
                index.write(json.dumps({"id": f"{ID}{key}", "offset": at, "length": len(data)}) + "\n")
                at, written = at + len(data), written + 1
        archive.writestr(zipfile.ZipInfo(INDEX), index.getvalue())
    return written, ended


def write_archives(pages: DataFrame, folder: str, id_col="page_id", url_col="url", payload_col="html",
                   min_bytes=MIN_BYTES, archive_bytes=ARCHIVE_BYTES) -> DataFrame:
    """Write all pages; (archive, n_records), one row for each file that was finished."""
    plain = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                         F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))

    def of(batches):
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        first = next(rows, None)
        if first is None:
            return
        system, place = file_system(folder)
        system.create_dir(place, recursive=True)
        task = TaskContext.get()
        rows, ended, k = chained(first, rows), False, 0
        while not ended:
            name = f"{folder}/part-{task.partitionId():05d}-{uuid.uuid4().hex[:12]}-{k:03d}.zip"
            n, ended = write_archive(name, rows, archive_bytes)
            k += 1
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], ["archive", "n_records"])

    def chained(first, rest):
        yield first
        yield from rest

    return staged(classed(plain, min_bytes).mapInArrow(of, "archive string, n_records long"), "archives")


# ---- reading

def read_range(file, start: int, length: int) -> bytes:
    file.seek(start)
    return file.read(length)


def central_directory(file, size: int) -> Iterator[dict]:
    """name, method, size, start of every member of a ZIP file; start is where its bytes begin."""
    tail_at = max(0, size - (1 << 16) - struct.calcsize(END_LAYOUT))
    tail = read_range(file, tail_at, size - tail_at)
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("no end of central directory")
    _, _, _, _, entries, length, start, _ = struct.unpack_from(END_LAYOUT, tail, at)
    back = struct.calcsize(LOCATOR_LAYOUT)
    if tail_at + at >= back:
        before = read_range(file, tail_at + at - back, back)
        if before[:4] == LOCATOR_64:
            _, _, end_at, _ = struct.unpack(LOCATOR_LAYOUT, before)
            end = read_range(file, end_at, struct.calcsize(END_64_LAYOUT))
            if end[:4] != END_64:
                raise ValueError("no ZIP64 end of central directory")
            *_, entries, length, start = struct.unpack(END_64_LAYOUT, end)
    held, place = read_range(file, start, length), 0
    for _ in range(entries):
        part = struct.unpack_from(ENTRY_LAYOUT, held, place)
        if part[0] != ENTRY:
            raise ValueError("broken central directory")
        method, packed, plain, n_name, n_extra, n_comment, header = part[4], *part[8:13], part[16]
        place += struct.calcsize(ENTRY_LAYOUT)
        name = held[place:place + n_name].decode("utf-8", "replace")
        packed, plain, header = wide_values(held[place + n_name:place + n_name + n_extra], plain, packed, header)
        place += n_name + n_extra + n_comment
        local = struct.unpack(LOCAL_LAYOUT, read_range(file, header, struct.calcsize(LOCAL_LAYOUT)))
        if local[0] != LOCAL:
            raise ValueError(f"no local header of {name}")
        yield {"name": name, "method": method, "size": packed,
               "start": header + struct.calcsize(LOCAL_LAYOUT) + local[9] + local[10]}


def wide_values(extra: bytes, plain: int, packed: int, header: int) -> tuple[int, int, int]:
    """(packed, plain, header) with what the ZIP64 extra field holds in place of full 32-bit fields, in its order."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<2H", extra, at)
        if kind == 1:
            values = iter(struct.unpack_from(f"<{length // 8}Q", extra, at + 4))
            plain, packed, header = (next(values) if v == 0xFFFFFFFF else v for v in (plain, packed, header))
        at += 4 + length
    return packed, plain, header


def members(archives: DataFrame) -> DataFrame:
    """(archive, name, method, size, start) of every member of every archive."""

    def of(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = file_system(path)
                with system.open_input_file(place) as file:
                    rows = [{"archive": path} | m for m in central_directory(file, file.size())]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(
                    [("archive", pa.string()), ("name", pa.string()), ("method", pa.int32()), ("size", pa.int64()),
                     ("start", pa.int64())]))

    return archives.select("archive").mapInArrow(of, "archive string, name string, method int, size long, start long")


def record_ranges(members: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(archive, start, offsets, lengths): neighbouring records by the index, `range_bytes` and a record at most."""
    kind = F.when(F.col("name") == INDEX, "i").when(F.col("name") == RECORDS, "r")
    paired = members.withColumn("kind", kind).filter("kind is not null").groupBy("archive").agg(
        *[F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{k}_{c}") for k in "ri" for c in ("start", "size", "method")])
    columns = ["archive", "r_start", "r_method", "i_start", "i_size", "i_method"]

    def of(batches):
        for batch in batches:
            for path, records, method, start, size, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if None in (records, start) or method or packed:
                    raise ValueError(f"{path}: records and index must both be there as stored members")
                yield from ranges(path, records, start, size)

    def ranges(path, records, start, size):
        system, place = file_system(path)
        with system.open_input_file(place) as file:
            offsets, lengths, rest, read = [], [], b"", 0
            while read < size:
                chunk = read_range(file, start + read, min(range_bytes, size - read))
                read += len(chunk)
                *lines, rest = (rest + chunk).split(b"\n")
                for line in lines:
                    entry = json.loads(line)
                    if offsets and (entry["offset"] + entry["length"] - offsets[0] > range_bytes
                                    or entry["offset"] != offsets[-1] + lengths[-1]):
                        yield one(path, records, offsets, lengths)
                        offsets, lengths = [], []
                    offsets.append(entry["offset"])
                    lengths.append(entry["length"])
            if offsets:
                yield one(path, records, offsets, lengths)

    def one(path, records, offsets, lengths):
        return pa.RecordBatch.from_arrays(
            [pa.array([path]), pa.array([records + offsets[0]]),
             pa.array([[x - offsets[0] for x in offsets]], pa.list_(pa.int64())),
             pa.array([lengths], pa.list_(pa.int64()))], ["archive", "start", "offsets", "lengths"])

    return paired.select(columns).mapInArrow(of, PLACES)


def parsed(data: bytes) -> tuple:
    """The columns of RECORD from the bytes of one record."""
    head, block = data.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    block = block[:int(fields["Content-Length"])]
    kind = fields["WARC-Type"]
    payload = block.split(b"\r\n\r\n", 1)[1] if kind == "response" else None
    bare = lambda x: None if x is None else x.strip("<>")
    return (kind, bare(fields.get("WARC-Record-ID")), bare(fields.get("WARC-Refers-To")), fields.get("WARC-Target-URI"),
            fields.get("WARC-Payload-Digest"), payload)


def read_records(ranges: DataFrame) -> DataFrame:
    """The records at the given places, with the columns of RECORD."""

    def of(batches):
        for batch in batches:
            for path, start, offsets, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                system, place = file_system(path)
                with system.open_input_file(place) as file:
                    data = read_range(file, start, offsets[-1] + lengths[-1])
                rows = [parsed(gzip.decompress(data[a:a + n])) for a, n in zip(offsets, lengths)]
                kinds = [pa.string()] * 5 + [pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                    ["record_type", "record_id", "refers_to", "target_uri", "payload_digest", "payload"])

    # a range is a few megabytes, so a task each for some dozens of them
    return ranges.repartition(F.xxhash64("archive", "start")).mapInArrow(of, RECORD)


def payload_digests(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): revisits have those of their response."""

    def of(batches):
        for batch in batches:
            held = batch.column(5).to_pylist()
            size = pa.array([None if x is None else len(x) for x in held], pa.int64())
            digest = pa.array([None if x is None else hashlib.sha256(x).hexdigest() for x in held], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), size, digest],
                ["record_type", "record_id", "refers_to", "size", "digest"])

    seen = staged(records.mapInArrow(
        of, "record_type string, record_id string, refers_to string, size long, digest string"), "records")
    response = seen.filter("record_type = 'response'")
    full = response.groupBy(F.col("record_id").alias("refers_to")).agg(
        F.first("size").alias("size"), F.first("digest").alias("digest"))
    # only revisits are joined: responses refer to nothing, and their null would be one key
    revisit = seen.filter("record_type <> 'response'").drop("size", "digest").join(full, "refers_to", "left")
    page = lambda c: F.expr(f"try_cast(substr({c}, {len(ID) + 1}) AS long)")
    return response.unionByName(revisit).select(
        page("record_id").alias("page_id"), F.col("size").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))


def archived(pages: DataFrame, **of) -> DataFrame:
    """Write archives of the pages to the shared folder and return what reading them back gives."""
    archives = write_archives(pages, new_path(pages.sparkSession, "web-archives"), **of)
    return payload_digests(read_records(record_ranges(members(archives))))


#: `archived` over the table pages, in DuckDB's SQL.
SQL = f"""
WITH digests AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
firsts AS (
  SELECT payload_digest, min(page_id) AS least FROM digests WHERE payload_bytes >= {MIN_BYTES} GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN least <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN least <> page_id THEN least END AS refers_to
FROM digests LEFT JOIN firsts USING (payload_digest)
"""
