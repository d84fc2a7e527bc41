"""Alignment of two tokenizers by inverted pair bitmaps.

Every text is cut by a byte-level vocabulary (A) and by a sentence-piece vocabulary (B); both see a space before the
text. Byte offsets where tokens of A and of B both end cut the tokens into groups, and every A token is linked with
every B token whose bytes overlap its own.

An inverted index answers how many documents hold a pair of ids linked. Documents are gathered into chunks of bounded
links. For each pair and chunk, a compressed bitmap says which of the chunk's documents hold the pair, and further
planes of bitmaps hold the bits of how often beyond once. A task ORs what it finds into the bitmaps of its chunk, and
chunks hold different documents, so a pair's document count is the sum of its popcounts, and its link count the sum
over planes of popcount times the plane's weight. The scores of a pair then travel back over its postings to the
documents, chunk by chunk.

Both vocabularies cut a text wherever a space follows a character that is no space, so equal stretches between such
places are tokenized once for each task as long as they are remembered.

Nothing is sampled or capped. A pair in every document has one bitmap for each chunk; counts combine before the
shuffle, and the join of bitmaps with scores has one row per pair on one side, so adaptive execution can split it.
Memory of a task: one chunk (`CHUNK_LINKS` links or one document, if that has more).

Defined cases: a null or empty text, or one that a vocabulary does not give back byte by byte, has no tokens: zeros and
an empty digest. Every row is a document of its own, repeated rows and null ids included. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.sources.stage import staged

BYTE_VOCABULARY = "byte_bpe_50k.tiktoken"
PIECE_VOCABULARY = "piece_bpe_32k.model"
#: A chunk ends at so many links or documents; texts are tokenized in runs of so many characters.
CHUNK_LINKS, CHUNK_DOCS, RUN_CHARS = 1 << 22, 1 << 16, 1 << 20
#: Stretches are forgotten when those remembered hold so many tokens.
REMEMBERED = 1 << 21
#: The forms of a bitmap: gaps of one byte, positions of two bytes, plain bits.
GAPS, POSITIONS, BITS = 0, 1, 2

_FACTS = "chunk long, low int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_POSTINGS = "a_id int, b_id int, plane int, form int, docs int, bits binary"
_RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
           "groups_sha256 string")


class Vocabularies:
    """Both vocabularies: the bytes of every id, and the ids of a text that starts with a space."""

    def __init__(self, byte_path: str, piece_path: str, pattern: str):
        import sentencepiece
        import tiktoken

        with open(byte_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self._a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.a_lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            self.a_lengths[i] = len(token)
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, self._b.id_to_piece(i)) for i in range(self._b.get_piece_size()))]
        self.b_lengths = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        #: whether B, too, never joins a space to a character before it
        self.cuts = not any("▁" in self._b.id_to_piece(i).lstrip("▁") for i in range(len(self.b_bytes)))

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of both, or None where their bytes are not those of the text."""
        a = np.array(self._a.encode_ordinary(text), dtype=np.int64)
        b = self._b.encode(text[1:])
        data = text.encode()
        if self.a_lengths[a].sum() != len(data) or b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return None
        return a, np.array(b, dtype=np.int64)


@functools.cache
def vocabularies(a: str = BYTE_VOCABULARY, b: str = PIECE_VOCABULARY) -> Vocabularies:
    """One for each Python worker."""
    import public_tokenizers

    return Vocabularies(public_tokenizers.path(a), public_tokenizers.path(b), public_tokenizers.PATTERN)


class Stretches:
    """What alignment says of stretches of text, each tokenized once; numbered as they come."""

    def __init__(self, held: Vocabularies):
        self.held, self.number = held, {}
        self.a_text = [f"{i}," for i in range(len(held.a_lengths))], [f"{i}|" for i in range(len(held.a_lengths))]
        self.b_text = [f"{i}," for i in range(len(held.b_lengths))], [f"{i};" for i in range(len(held.b_lengths))]
        self.forget()

    def forget(self):
        self.number.clear()
        self.size, self.groups, self.good = 0, [], []
        self.counts, self.links, self.starts = [], [], []
        self.flat, self.flat_upto = None, 0

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of the stretches of each text; every text starts with a space."""
        cut = re.compile(r"(?<=\S) (?=\S)").split if self.held.cuts else lambda text: [text]
        parts = [cut(t[1:]) for t in texts]
        fresh = list(dict.fromkeys(p for some in parts for p in some if p not in self.number))
        plain = [p for p in fresh if p and not p[-1].isspace() and "▁" not in p]
        self._learn(plain)
        for p in fresh:
            if p not in self.number:
                self._learn([p])
        get = self.number.__getitem__
        return [np.fromiter(map(get, some), np.int64, len(some)) for some in parts]

    def _learn(self, parts: list[str]) -> None:
        if not parts:
            return
        first = len(self.groups)
        found = self.held.ids(" " + " ".join(parts))
        if found is None and len(parts) > 1:
            for p in parts:
                self._learn([p])
            return
        self.number.update(zip(parts, range(first, first + len(parts))))
        self.good.append(np.full(len(parts), found is not None))
        if found is None:
            self.groups.append("")
            self.counts.append(np.zeros((1, 4), dtype=np.int64))
            self.links.append(np.zeros(0, dtype=np.int64))
            return
        a, b = found
        a_ends, b_ends = np.cumsum(self.held.a_lengths[a]), np.cumsum(self.held.b_lengths[b])
        ends = np.cumsum([len(p.encode()) + 1 for p in parts])
        shared = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_group, b_group = np.searchsorted(shared, a_ends), np.searchsorted(shared, b_ends)
        low = np.searchsorted(b_ends, a_ends - self.held.a_lengths[a], side="right")
        high = np.searchsorted(b_ends - self.held.b_lengths[b], a_ends, side="left")
        width = high - low
        which = np.repeat(np.arange(len(a)), width)
        other = np.arange(len(which)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(low, width)
        a_at, b_at = (np.concatenate(([0], np.searchsorted(x, ends, side="right"))) for x in (a_ends, b_ends))
        g_at = np.concatenate(([0], np.searchsorted(shared, ends, side="right")))
        l_at = np.concatenate(([0], np.cumsum(width)))[a_at]
        self.counts.append(np.column_stack([np.diff(x) for x in (a_at, b_at, g_at, l_at)]))
        self.links.append((a[which] << 32) | b[other])
        self.size += len(a) + len(b)

        # ids as text, a group's A ids before its B ids, each with the mark that follows it
        a_last = np.append(a_group[1:] != a_group[:-1], True)
        b_last = np.append(b_group[1:] != b_group[:-1], True)
        order = np.argsort(np.concatenate((a_group * 2, b_group * 2 + 1)), kind="stable")
        a_words = [self.a_text[last][i] for i, last in zip(a.tolist(), a_last.tolist())]
        words = np.array(a_words + [self.b_text[last][i] for i, last in zip(b.tolist(), b_last.tolist())], dtype=object)
        words, at = words[order].tolist(), (a_at + b_at).tolist()
        self.groups.extend("".join(words[s:e]) for s, e in zip(at[:-1], at[1:]))

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Counts (n_a, n_b, n_groups, n_links), whether good, link ids, and where each stretch's links start."""
        self.counts, self.good, self.links = ([np.concatenate(x)] for x in (self.counts, self.good, self.links))
        return self.counts[0], self.good[0], self.links[0], np.concatenate(([0], np.cumsum(self.counts[0][:, 3])))


def ranges(starts: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... widths[0] numbers of it, then those of the next."""
    before = np.cumsum(widths) - widths
    return np.arange(widths.sum()) + np.repeat(starts - before, widths)


def bitmaps(owner: np.ndarray, low: np.ndarray, docs: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array]]:
    """Compressed bitmaps of the positions `low` of each owner; both sorted, by owner first, no position twice.

    Gives (form, owners, popcounts, bytes) for each form that is used.
    """
    if len(owner) == 0:
        return
    starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    counts = np.diff(np.append(starts, len(owner)))
    gap = np.diff(low, prepend=0)
    gap[starts] = low[starts]
    form = np.where(counts * 8 > docs, BITS, np.where(np.maximum.reduceat(gap, starts) < 256, GAPS, POSITIONS))
    for kind, values, size in ((GAPS, gap, np.uint8), (POSITIONS, low, np.uint16)):
        mine = np.flatnonzero(form == kind)
        if len(mine):
            data = values[ranges(starts[mine], counts[mine])].astype(size)
            bounds = np.concatenate(([0], np.cumsum(counts[mine]))) * data.itemsize
            yield kind, owner[starts[mine]], counts[mine], _binary(bounds, data)
    mine = np.flatnonzero(form == BITS)
    if len(mine):
        width = -(-docs // 8)
        grid = np.zeros((len(mine), width * 8), dtype=bool)
        grid[np.repeat(np.arange(len(mine)), counts[mine]), low[ranges(starts[mine], counts[mine])]] = True
        yield BITS, owner[starts[mine]], counts[mine], _binary(
            np.arange(len(mine) + 1) * width, np.packbits(grid, axis=1, bitorder="little"))


def _binary(bounds: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1,
                                 [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data.tobytes())])


def positions(form: int, counts: np.ndarray, cells: pa.Array) -> np.ndarray:
    """The positions in bitmaps of one form, one bitmap after the other."""
    if len(counts) == 0:
        return np.zeros(0, dtype=np.int64)
    data = b"".join(cells.to_pylist())
    if form == POSITIONS:
        return np.frombuffer(data, dtype=np.uint16).astype(np.int64)
    if form == GAPS:
        total = np.cumsum(np.frombuffer(data, dtype=np.uint8), dtype=np.int64)
        before = np.concatenate(([0], total))[np.cumsum(counts) - counts]
        return total - np.repeat(before, counts)
    grid = np.frombuffer(data, dtype=np.uint8).reshape(len(counts), -1)
    return np.nonzero(np.unpackbits(grid, axis=1, bitorder="little"))[1]


def _index(docs: DataFrame, id_col: str, text_col: str, names: tuple[str, str], chunk_links: int) -> DataFrame:
    """One pass over the texts: a row of facts for each document, and the bitmaps of each chunk."""
    plain = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                        F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([
        ("chunk", pa.int64()), ("low", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
        ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("a_id", pa.int32()),
        ("b_id", pa.int32()), ("plane", pa.int32()), ("form", pa.int32()), ("docs", pa.int32()), ("bits", pa.binary())])

    def batch(rows: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema],
            schema=schema)

    def postings(chunk: int, held: list[tuple[int, np.ndarray]], number: int, seen: Stretches):
        _, _, links, starts = seen.table()
        stretch = np.concatenate([x for _, x in held])
        low = np.repeat([k for k, _ in held], [len(x) for _, x in held])
        both, often = np.unique((stretch << 16) | low, return_counts=True)
        stretch, low = both >> 16, both & 0xFFFF
        width = np.diff(starts)[stretch]
        pair = links[ranges(starts[stretch], width)]
        ids, pair = np.unique(pair, return_inverse=True)
        both = (pair << 16) | np.repeat(low, width)
        order = np.argsort(both)
        both, often = both[order], np.repeat(often, width)[order]
        # OR: one bit for each pair and document, whatever the number of stretches it comes from
        first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))[:len(both)])
        extra = np.add.reduceat(often, first) - 1 if len(first) else often
        pair, low = both[first] >> 16, both[first] & 0xFFFF
        planes = [(0, np.ones(len(pair), dtype=bool))]
        planes += [(k + 1, (extra >> k) & 1 == 1) for k in range(int(extra.max(initial=0)).bit_length())]
        for plane, mine in planes:
            for form, owner, counts, bits in bitmaps(pair[mine], low[mine], number):
                yield batch(len(owner), chunk=np.full(len(owner), chunk), a_id=(ids[owner] >> 32).astype(np.int32),
                            b_id=(ids[owner] & 0xFFFFFFFF).astype(np.int32),
                            plane=np.full(len(owner), plane, dtype=np.int32),
                            form=np.full(len(owner), form, dtype=np.int32), docs=counts.astype(np.int32), bits=bits)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Stretches(vocabularies(*names))
        chunk, number, held, links = None, 0, [], 0

        def ended():
            nonlocal chunk, number, held, links
            if held:
                yield from postings(chunk, held, number, seen)
            chunk, number, held, links = None, 0, [], 0
            if seen.size > REMEMBERED:
                seen.forget()

        for rows, ids, texts in _runs(batches):
            found = seen.of([" " + t for t in texts])
            counts, good, _, _ = seen.table()
            facts = []
            for row, doc_id, text, mine in zip(rows, ids, texts, found):
                if text and not good[mine].all():
                    seen._learn([text])
                    counts, good, _, _ = seen.table()
                    mine = np.array([seen.number[text]])
                if chunk is None:
                    chunk = row
                if text and good[mine].all():
                    n_a, n_b, n_groups, n_links = counts[mine].sum(axis=0).tolist()
                    spelt = "".join([seen.groups[i] for i in mine.tolist()])[:-1]
                    facts.append((chunk, number, doc_id, n_a, n_b, n_groups, n_links,
                                  hashlib.sha256(spelt.encode()).hexdigest()))
                    held.append((number, mine))
                    links += n_links
                else:
                    facts.append((chunk, number, doc_id, 0, 0, 0, 0, ""))
                number += 1
                if links >= chunk_links or number == CHUNK_DOCS:
                    yield batch(len(facts), **dict(zip(schema.names, zip(*facts))))
                    facts = []
                    # stretches keep their numbers until the end of the run
                    yield from postings(chunk, held, number, seen) if held else ()
                    chunk, number, held, links = None, 0, [], 0
            if facts:
                yield batch(len(facts), **dict(zip(schema.names, zip(*facts))))
            if seen.size > REMEMBERED:
                yield from ended()
        yield from ended()

    return plain.mapInArrow(of, f"{_FACTS}, {_POSTINGS}")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
    """(rows, ids, texts) of runs of about RUN_CHARS characters; nulls as empty texts."""
    for batch in batches:
        rows, ids, texts, size = [], [], [], 0
        for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            text = text.as_py() or ""
            rows.append(row), ids.append(doc_id), texts.append(text)
            size += len(text)
            if size >= RUN_CHARS:
                yield rows, ids, texts
                rows, ids, texts, size = [], [], [], 0
        if rows:
            yield rows, ids, texts


def pair_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               names: tuple[str, str] = (BYTE_VOCABULARY, PIECE_VOCABULARY), chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """The written index: facts of documents (a_id null) and bitmaps of pairs (low null)."""
    return staged(_index(docs, id_col, text_col, names, chunk_links), "pair-index")


def pair_scores(index: DataFrame) -> DataFrame:
    """(a_id, b_id, n_docs, n_links, best): how many documents hold a pair, its links, whether it is its A id's best."""
    weight = F.expr("if(plane = 0, 1L, shiftleft(1L, plane - 1))")
    counted = staged(index.filter("a_id is not null").groupBy("a_id", "b_id").agg(
        F.sum(F.when(F.col("plane") == 0, F.col("docs")).otherwise(0)).alias("n_docs"),
        F.sum(F.col("docs") * weight).alias("n_links")), "pair-counts")
    top = counted.groupBy("a_id").agg(F.max("n_docs").alias("top"))
    return counted.join(top, "a_id").select("a_id", "b_id", "n_docs", "n_links", (F.col("n_docs") == F.col("top")).alias("best"))


def document_scores(index: DataFrame, scores: DataFrame) -> DataFrame:
    """Each document's tokens, groups, links, links to the best partner of their A id, and the sum of their counts."""
    postings = index.filter("a_id is not null").select("chunk", "a_id", "b_id", "plane", "form", "docs", "bits").join(
        scores.select("a_id", "b_id", "n_docs", "best"), ["a_id", "b_id"]).drop("a_id", "b_id")
    facts = index.filter("low is not null").select(
        F.col("chunk").alias("of_chunk"), "low", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")

    def of(facts: pa.Table, postings: pa.Table) -> pa.Table:
        low = facts.column("low").to_numpy()
        size = int(low.max(initial=-1)) + 1
        best, total = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        if postings.num_rows:
            forms = postings.column("form").to_numpy()
            for form in (GAPS, POSITIONS, BITS):
                some = postings.filter(pa.array(forms == form))
                counts = some.column("docs").to_numpy().astype(np.int64)
                at = positions(form, counts, some.column("bits"))
                plane = some.column("plane").to_numpy().astype(np.int64)
                weight = np.where(plane == 0, 1, 1 << np.maximum(plane - 1, 0))
                np.add.at(total, at, np.repeat(weight * some.column("n_docs").to_numpy(), counts))
                np.add.at(best, at, np.repeat(weight * some.column("best").to_numpy(zero_copy_only=False), counts))
        out = facts.append_column("n_best", pa.array(best[low])).append_column("count_sum", pa.array(total[low]))
        return out.select([f.split()[0] for f in _RESULT.split(", ")])

    return facts.groupBy("of_chunk").cogroup(postings.groupBy("chunk")).applyInArrow(of, _RESULT)


def aligned_documents(docs: DataFrame, **of) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    index = pair_index(docs, **of)
    return document_scores(index, staged(pair_scores(index), "pair-scores"))
