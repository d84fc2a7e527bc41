"""Line deduplication across documents: a segment-partition join under an edit distance.

Lines are split at \\n and stripped of surrounding white space. Equal lines fall together by their hash. For the others,
a line is cut into threshold + 1 segments of nearly equal length. Edits that keep two lines within the threshold leave
one segment of the shorter line whole in the longer one, at a place that the two lengths and the edits before and
behind it allow. So a line enters the bucket of each of its own segments and probes, for each length it may be
matched with, the few substrings that can hold such a segment. Lines that share a bucket are candidates; common ends
are cut off, and a bit-parallel edit distance over a band of 2 threshold + 1 diagonals confirms the rest.

The first line of a class, by doc_id and line number, is kept. Copies of a line are found at any length. Lines that
differ are compared under a threshold of one edit for each CHARS_AN_EDIT characters of the longer one, `edits` at most:
the segments are never empty, and words of a few letters are not linked because they are short.

Longer lines are also compared word by word: two lines are alike if one edit for each WORDS_AN_EDIT words of the longer
one turns one into the other, however long they are. Up to one edit, their words are cut into segments like characters.
Lines of at least LEVELS[0] words share a stretch of words instead, whichever of the two rules links them: an edit of a
character touches two words of a line at most. The rarest hash among the grams of each stretch of that length goes to a
bucket of its own, together with the level of the line's length and the part of the line it lies in; near the edge of a
level or part it goes to the next one as well. So only shorter lines need segments of characters.

Defined cases: a null text has no lines, an empty one a single empty line; lines without a word are left alone. Rows without a doc_id keep all their lines.
Rows that repeat a doc_id and its text count as one document. Extra columns are ignored by `line_classes` and kept by
`without_repeated_lines`. Lines are told apart by 64-bit hashes: among 10^9 lines, two different ones meet with a
chance of 3 in 100.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from encore.llm.links import grouped
from encore.llm.texts import MIX_1, MIX_2, RUN_BYTES, grams, mixed, prefix_sums, stretch_hashes
from encore.sources.stage import staged

EDITS = 2
CHARS_AN_EDIT = 20
WORDS_AN_EDIT = 20
#: Stretches of words are known by grams of so many words.
GRAM = 6
#: Lengths in words of the longer of two lines at which a level begins; below the first, lines are cut into segments.
LEVELS = 2 * WORDS_AN_EDIT * 1.5 ** np.arange(50)
#: Segments of words, apart from those of characters.
OF_WORDS = np.uint64(1 << 20)
#: Characters that part words, as `str.split` has them, and one place for all characters beyond.
BLANK = np.array([chr(c).isspace() for c in range(0x3002)])
#: Lines of a crowd are told apart by histograms of so many bins first.
BINS = 64
#: A task forgets which lines it has seen beyond so many, which only repeats some rows.
SEEN = 1 << 19


def lines_of(text: str | None) -> list[str]:
    return [] if text is None else [x.strip() for x in text.split("\n")]


def code_points(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all lines in a row, and the bounds of the lines."""
    bounds = np.zeros(len(lines) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in lines], out=bounds[1:])
    return np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), bounds


def hashed(lines: list[str]) -> np.ndarray:
    """64-bit hashes of whole lines."""
    points, bounds = code_points(lines)
    return stretch_hashes(prefix_sums(points), bounds[:-1], bounds[1:]).view(np.int64)


def segment(length, i: int, edits: int):
    """Start and end of segment i of a line of that length; the last segments take the odd characters."""
    parts = edits + 1
    short, long = length // parts, length % parts
    start = short * i + np.maximum(0, i - (parts - long))
    return start, start + short + (i >= parts - long)


def probes(length: np.ndarray, edits: int) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length of the indexed line, segment number, start, end, valid) of all substrings that lines of `length` probe."""
    for less in range(edits + 1):
        other = length - less
        for i in range(edits + 1):
            start, end = segment(other, i, edits)
            # edits before the segment are at most i, those behind it at most edits - i; they add up to `less` more
            low = max(-i, less - (edits - i))
            high = min(i, less + (edits - i))
            for shift in range(low, high + 1):
                a, b = start + shift, end + shift
                yield other, i, a, b, (a >= 0) & (b <= length) & (b > a) & (other > 0)


def runs_of_lines(rows: Iterator[tuple[int, str | None]]) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """(row, line number, line) as three lists, for runs of rows of about RUN_BYTES characters."""
    at, number, held, size = [], [], [], 0
    for row, text in rows:
        own = lines_of(text)
        at += [row] * len(own)
        number += range(len(own))
        held += own
        size += len(text or "")
        if size >= RUN_BYTES:
            yield at, number, held
            at, number, held, size = [], [], [], 0
    if held:
        yield at, number, held


def stretch(level: int) -> int:
    """How many words in a row two lines share at least if they are linked and the longer one's length is in the level.

    e edits of words leave n - e of n words in e + 1 stretches, at their shortest where e has just grown. EDITS edits of
    characters leave n - 2 EDITS in EDITS + 1.
    """
    least = int(np.ceil(LEVELS[level]))
    found = [-(-(least - 2 * EDITS) // (EDITS + 1))]
    for n in (least, -(-least // WORDS_AN_EDIT) * WORDS_AN_EDIT):
        edits = n // WORDS_AN_EDIT
        found.append(-(-(n - edits) // (edits + 1)))
    return min(found)


def lowest_places(values: np.ndarray, size: int) -> np.ndarray:
    """For each window of `size` values, the place of its smallest, the first of equal ones."""
    at, held = np.arange(len(values)), 1
    while held < size:
        step = min(held, size - held)
        left, right = at[:len(at) - step], at[step:]
        at = np.where(values[left] <= values[right], left, right)
        held += step
    return at


def words_of(points: np.ndarray, bounds: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all lines in order, and the bounds of the lines among them."""
    blank = BLANK[np.minimum(points, len(BLANK) - 1)]
    edge = np.zeros(len(points) + 1, dtype=bool)
    edge[bounds] = True
    starts = np.flatnonzero(~blank & (np.concatenate(([True], blank))[:-1] | edge[:-1]))
    ends = np.flatnonzero(~blank & (np.concatenate((blank, [True]))[1:] | edge[1:])) + 1
    return stretch_hashes(sums, starts, ends), np.searchsorted(starts, bounds)


def segment_keys(words: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(lines, bucket keys) for pairs of lines whose longer one has fewer than LEVELS[0] words: one edit at most."""
    n = np.diff(cuts)
    line = np.flatnonzero((n >= WORDS_AN_EDIT - 1) & (n < LEVELS[0]))
    sums, first, n = prefix_sums(words), cuts[line], n[line]
    for other, i, a, b, valid in probes(n, 1):
        to = np.flatnonzero(valid)
        key = stretch_hashes(sums, first[to] + a[to], first[to] + b[to])
        yield line[to], mixed(key + mixed(other[to].astype(np.uint64) * np.uint64(MIX_2) + OF_WORDS + np.uint64(i)))


def stretch_keys(words: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(lines, bucket keys) for pairs of lines whose longer one has LEVELS[0] words or more."""
    n = np.diff(cuts)
    own = np.searchsorted(LEVELS, n, side="right") - 1
    # the longest line that can be alike has one word more for each 19
    upper = np.searchsorted(LEVELS, n + n // (WORDS_AN_EDIT - 1), side="right") - 1
    for level in np.unique(np.concatenate((own, upper))).tolist():
        if level < 0:
            continue
        of = np.flatnonzero((own == level) | (upper == level))
        ends = np.cumsum(n[of])
        line, starts = np.repeat(np.arange(len(of)), n[of]), ends - n[of]
        every = grams(words[np.arange(ends[-1]) + (cuts[of] - starts)[line]], GRAM)
        size = stretch(level)
        lowest = lowest_places(every, size - GRAM + 1)
        at = np.unique(lowest[np.arange(len(lowest)) + size <= ends[line[:len(lowest)]]])
        place, most = at - starts[line[at]], int(LEVELS[level + 1]) // WORDS_AN_EDIT
        part, edge = place // (8 * most), (place + most) // (8 * most)
        for to, here in ((at, part), (at[edge != part], edge[edge != part])):
            where = here.astype(np.uint64) + mixed(np.array([level]))
            yield of[line[to]], mixed(every[to] + mixed(where * np.uint64(MIX_2)))


def word_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(positions of lines, bucket keys), each pair once: lines that are alike word by word share a key."""
    points, bounds = code_points(lines)
    return distinct_keys(*words_of(points, bounds, prefix_sums(points)))


def distinct_keys(words: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    line, key = (np.concatenate(x) for x in zip(*segment_keys(words, cuts), *stretch_keys(words, cuts)))
    order = np.lexsort((key, line))
    line, key = line[order], key[order]
    new = np.ones(len(line), dtype=bool)
    new[1:] = (line[1:] != line[:-1]) | (key[1:] != key[:-1])
    return line[new], key[new]


def buckets(docs: DataFrame, edits: int) -> DataFrame:
    """(bucket, node) of the lines of (doc_id, text), a task's repeated lines left out."""
    least = CHARS_AN_EDIT - 1

    def of(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, _, lines in runs_of_lines(enumerate(x.as_py() for x in batch.column(0))):
                made = list(keys([x for x in lines if len(x) >= least], seen))
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*made)], ["bucket", "node"])

    def keys(lines, seen):
        if not lines:
            return
        points, bounds = code_points(lines)
        sums = prefix_sums(points)
        every = stretch_hashes(sums, bounds[:-1], bounds[1:]).view(np.int64)
        node, at = np.unique(every, return_index=True)
        fresh = np.array([x not in seen for x in node.tolist()], dtype=bool)
        node, at = node[fresh], at[fresh]
        if len(seen) > SEEN:
            seen.clear()
        seen.update(node.tolist())
        first, length = bounds[at], bounds[at + 1] - bounds[at]
        words, cuts = words_of(points, bounds, sums)
        count_of = np.diff(cuts)[at]
        # linked lines of more words share a stretch of words
        segmented = (count_of < LEVELS[0]) | (edits > EDITS)
        for k in range(1, edits + 1):
            # the lines whose threshold is k, and those that are up to k characters shorter than one of them
            mine = segmented & (length >= CHARS_AN_EDIT * k - k)
            if k < edits:
                mine &= length < CHARS_AN_EDIT * (k + 1)
            for other, i, a, b, valid in probes(length, k):
                to = np.flatnonzero(valid & mine)
                if len(to):
                    key = stretch_hashes(sums, first[to] + a[to], first[to] + b[to])
                    place = np.uint64(i * (edits + 1) + k)
                    key = mixed(key + mixed(other[to].astype(np.uint64) * np.uint64(MIX_2) + place))
                    yield key.view(np.int64), node[to]
        ends = np.cumsum(count_of)
        own = np.arange(len(words) and ends[-1]) + np.repeat(cuts[at] - (ends - count_of), count_of)
        to, key = distinct_keys(words[own], np.concatenate(([0], ends)))
        if len(to):
            yield key.view(np.int64), node[to]

    return docs.select("text").mapInArrow(of, "bucket long, node long")


def shared_buckets(rows: DataFrame) -> DataFrame:
    """(bucket, node, mate, size) of buckets with several nodes: those of two as one row with both, others with a row a node.

    A node that has a row for itself is its own mate. All rows are made and shuffled once, by bucket.
    """
    each = W.partitionBy("bucket")
    several = rows.select("bucket", "node", F.min("node").over(each).alias("low"), F.max("node").over(each).alias("high")).filter(
        "low <> high").distinct().withColumn("size", F.count("*").over(each))
    return several.filter("size > 2 or node = low").select(
        "bucket", "node", F.expr("if(size > 2, node, high)").alias("mate"), "size")


def small_distance(p: Sequence[str], t: Sequence[str]) -> int:
    row = list(range(len(p) + 1))
    for j, c in enumerate(t, 1):
        before, row[0] = row[0], j
        for i, d in enumerate(p, 1):
            before, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, before + (c != d))
    return row[-1]


def same_start(p: Sequence[str], t: Sequence[str]) -> int:
    """How many places two sequences of one kind agree in from the start, by halving."""
    low, high = 0, min(len(p), len(t))
    if p[:high] == t[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if p[low:mid] == t[low:mid]:
            low = mid
        else:
            high = mid
    return low


def within(p: Sequence[str], t: Sequence[str], edits: int) -> bool:
    """Whether the edit distance is at most `edits`. Bits 0 to 2 edits of a word are rows j - edits to j + edits."""
    if len(p) > len(t):
        p, t = t, p
    if len(t) - len(p) > edits:
        return False
    start = same_start(p, t)
    p, t = p[start:], t[start:]
    end = same_start(p[::-1], t[::-1])
    p, t = p[:len(p) - end], t[:len(t) - end]
    m, n = len(p), len(t)
    if m <= edits:
        return n <= edits or (n <= 2 * edits and small_distance(p, t) <= edits)
    places: dict[str, int] = {}
    for i, c in enumerate(p):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << 2 * edits + 1) - 1
    up, down, last = full & ~((1 << edits) - 1), 0, 1 << 2 * edits
    distance = edits
    for j in range(1, n + 1):
        shift = j - edits - 1
        here = places.get(t[j - 1], 0)
        here = (here >> shift if shift >= 0 else here << -shift) & full
        zero = ((((here & up) + up) ^ up) | here | down) & full
        plus = (down | ~(zero | up)) & full
        minus = zero & up
        if j <= m - edits:
            distance += not zero & last
            if distance > 3 * edits:
                return False
        else:
            row = 1 << m - j + edits
            distance += bool(plus & row) - bool(minus & row)
        up = (minus | ~((zero >> 1) | plus)) & full
        down = (zero >> 1) & plus
    return distance <= edits


def close(p: str, t: str, edits: int) -> bool:
    """Whether two lines are within the threshold of the longer one, by characters or by words."""
    most = min(edits, max(len(p), len(t)) // CHARS_AN_EDIT)
    if most > 0 and within(p, t, most):
        return True
    a, b = p.split(), t.split()
    most = max(len(a), len(b)) // WORDS_AN_EDIT
    # an edit takes one word away, adds one, or does both
    if most == 0 or abs(len(a) - len(b)) > most or len(set(a) ^ set(b)) > 2 * most:
        return False
    if max(len(a), len(b)) - sum((Counter(a) & Counter(b)).values()) > most:
        return False
    return within(a, b, most)


def histograms(lines: list[str]) -> tuple[np.ndarray, ...]:
    """For each line, the numbers of characters and of words, and how many of each fall to each of BINS."""
    points, bounds = code_points(lines)
    words, cuts = words_of(points, bounds, prefix_sums(points))

    def spread(values, ends):
        row = np.repeat(np.arange(len(lines)), np.diff(ends))
        return np.bincount(row * BINS + (values % values.dtype.type(BINS)).astype(np.int64), minlength=len(lines) * BINS).reshape(-1, BINS)

    return np.diff(bounds), np.diff(cuts), spread(points, bounds), spread(words, cuts)


def close_ones(asking: list[str], others: list[str], edits: int, apart: Callable | None = None) -> Iterator[tuple[int, int]]:
    """Positions of lines that are close. An edit changes one or two counts of a histogram by one, so most need no look.

    apart(i, others) says which pairs are still asked for, and may change whenever a pair has been given.
    """
    if not asking or not others:
        return
    every = np.arange(len(others))
    length, words, letters, bags = histograms(others)
    for i, (x, n, m, own, bag) in enumerate(zip(asking, *histograms(asking))):
        by_char = np.minimum(edits, np.maximum(n, length) // CHARS_AN_EDIT)
        by_word = np.maximum(m, words) // WORDS_AN_EDIT
        asked = True if apart is None else apart(i, every)
        may = asked & (by_char > 0) & (np.abs(length - n) <= by_char)
        may[may] = np.abs(letters[may] - own).sum(axis=1) <= 2 * by_char[may]
        or_may = asked & ~may & (by_word > 0) & (np.abs(words - m) <= by_word)
        or_may[or_may] = np.abs(bags[or_may] - bag).sum(axis=1) <= 2 * by_word[or_may]
        for j in np.flatnonzero(may | or_may).tolist():
            if (apart is None or apart(i, j)) and close(x, others[j], edits):
                yield i, j


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, n_chars, node) of all lines; node is null for lines without a word."""

    def of(batches):
        for batch in batches:
            for at, number, lines in runs_of_lines(enumerate(x.as_py() for x in batch.column(1))):
                size = np.array([len(x) for x in lines], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(number, pa.int32()), pa.array(size),
                     pa.array(hashed(lines), mask=size == 0)], ["doc_id", "line_no", "n_chars", "node"])

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, line_no int, n_chars long, node long")


def _lines(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(node, line) at the given (node, first), stripped; where a doc_id has several texts, the node's own line."""
    own = places.groupBy(F.col("first.doc_id").alias("doc_id")).agg(
        F.collect_list("node").alias("nodes"), F.collect_set("first.line_no").alias("places"))

    def of(batches):
        for batch in batches:
            texts = []
            for at, text in zip(batch.column(1).to_pylist(), batch.column(2)):
                held = lines_of(text.as_py())
                texts += [held[i] for i in at if i < len(held)]
            if texts:
                node = hashed(texts)
                right = pa.array(np.isin(node, batch.column(0).flatten().to_numpy()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node).filter(right), pa.array(texts, pa.string()).filter(right)], ["node", "line"])

    # the texts need no sorting, as the places of a document are few
    every = docs.join(own.hint("shuffle_hash"), "doc_id").select("nodes", "places", "text")
    return every.mapInArrow(of, "node long, line string").dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, held: DataFrame, edits: int) -> DataFrame:
    """Pairs of lines within the distance."""
    both = (pairs.join(held.toDF("b", "line_b"), "b").join(held.toDF("a", "line_a"), "a")
            .select("a", "b", "line_a", "line_b"))

    def of(batches):
        for batch in batches:
            near = [close(x, y, edits) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            near = pa.array(near, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(near) for i in (0, 1)], ["a", "b"])

    return both.mapInArrow(of, "a long, b long")


def line_classes(docs: DataFrame, id_col="doc_id", text_col="text", edits=EDITS) -> DataFrame:
    """(doc_id, line_no, n_chars, first_doc_id, first_line_no, kept), one row for each line of each document.

    The first line is that of the smallest doc_id, then line number, in the line's class; kept says it is this line.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = staged(line_table(docs), "line-table")
    compared = rows.filter("node is not null and doc_id is not null")
    named = docs.filter("doc_id is not null")
    place = F.struct("doc_id", "line_no")
    nodes = staged(compared.groupBy("node").agg(
        F.min(place).alias("first"), F.max(place).alias("last")), "line-nodes")

    def compare(asking, others, apart):
        return close_ones(asking, others, edits, apart)

    found = staged(shared_buckets(buckets(named, edits)), "line-buckets")
    roots = grouped(
        found.filter("node = mate").select("bucket", "node", "size"),
        lambda shared: staged(_lines(named, nodes.join(shared, "node").select("node", "first")), "lines"),
        lambda pairs, held: _confirmed(pairs, held, edits), "line", compare, spared=True,
        pairs=found.filter("node <> mate").select(F.col("node").alias("a"), F.col("mate").alias("b")))
    first = roots.join(nodes, "node").groupBy("root").agg(F.min("first").alias("class_first"))
    alike = roots.join(first, "root").select("node", "class_first")
    repeated = nodes.filter("first <> last").join(alike, "node", "full").select(
        "node", F.coalesce("class_first", "first").alias("found"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", place)).otherwise(place)
    out = rows.join(repeated, "node", "left").withColumn("found", own)
    return out.select(
        "doc_id", "line_no", "n_chars", F.col("found.doc_id").alias("first_doc_id"),
        F.col("found.line_no").alias("first_line_no"),
        (F.col("found.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("found.line_no") == F.col("line_no"))).alias("kept"))


def without_repeated_lines(docs: DataFrame, id_col="doc_id", text_col="text", edits=EDITS) -> DataFrame:
    """`docs` without the lines that are not kept; other rows and columns as they were."""
    key, lines = (next(n for i in count() if (n := f"{name}_{i}") not in docs.columns) for name in ("key", "lines"))
    gone = line_classes(docs, id_col, text_col, edits).filter("not kept").groupBy(
        F.col("doc_id").alias(key)).agg(F.collect_set("line_no").alias(lines))
    left = F.filter(F.split(text_col, "\n", -1), lambda _, i: ~F.array_contains(lines, i))
    text = F.when(F.col(lines).isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    return docs.join(gone, docs[id_col] == gone[key], "left").withColumn(text_col, text).select(*docs.columns)
