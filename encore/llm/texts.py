"""Words, shingles and 64-bit hashes of whole texts, a batch of byte strings at a time.

Words are the runs of bytes other than space and \\t \\n \\v \\f \\r, after A-Z became a-z. A byte string's hash is a
polynomial modulo 2^64 over its bytes, passed through a finaliser; two texts are compared by these hashes, never by
samples of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: An odd base, its inverse modulo 2^64, and the multipliers of the SplitMix64 finaliser.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: As LOWER, with every ASCII character that is neither letter nor digit as a space.
BARE = LOWER.copy()
BARE[[c for c in range(128) if not chr(c).isalnum()]] = 32

#: Texts are worked on in runs of about so many bytes; a longer text is a run of its own.
RUN_BYTES = 1 << 20
_powers = {BASE: np.ones(1, dtype=np.uint64), INVERSE: np.ones(1, dtype=np.uint64)}


def mixed(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser: every bit of the input moves every bit of the output."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(MIX_1)
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX_2)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64."""
    known = _powers[base]
    if len(known) < n:
        grown = np.full(max(n, RUN_BYTES + 1), base, dtype=np.uint64)
        grown[0] = 1
        known = np.cumprod(grown, dtype=np.uint64)
        if n <= 8 * RUN_BYTES:
            _powers[base] = known
    return known[:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """s[i] = sum of (values[j] + 1) * BASE^j over j < i; the hash of a stretch follows from two of them."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(values)), out=out[1:])
    return out


def stretch_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end], the same wherever the stretch lies."""
    raw = (sums[ends] - sums[starts]) * powers(INVERSE, len(sums))[starts]
    return mixed(raw + (ends - starts).astype(np.uint64) * np.uint64(MIX_1))


def runs(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row bounds in the bytes) of consecutive rows; a null counts as empty."""
    if len(column) == 0:
        return
    column = column.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + RUN_BYTES, side="right")) - 1)
        yield row, data[bounds[row]:bounds[stop]], bounds[row:stop + 1] - bounds[row]
        row = stop


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows of a run, in order; no word crosses a row's bound."""
    blank = SPACE[data]
    if len(data) == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    before = np.concatenate(([True], blank[:-1])) | edge[:-1]
    after = np.concatenate((blank[1:], [True])) | edge[1:]
    return np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1


def run_words(column: pa.Array, letters: np.ndarray = LOWER) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes of all words, word bounds of the rows) for each run of rows; bytes are read as `letters` says."""
    for row, data, bounds in runs(column):
        data = letters[data]
        starts, ends = words(data, bounds)
        yield row, stretch_hashes(prefix_sums(data), starts, ends), np.searchsorted(starts, bounds)


def word_hashes(column: pa.Array, letters: np.ndarray = LOWER) -> Iterator[np.ndarray]:
    """For each row, the hashes of its words in order."""
    for _, hashes, cuts in run_words(column, letters):
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield hashes[a:b]


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of `size` words in a row, in order."""
    n = max(0, len(hashes) - size + 1)
    total = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        total = mixed(total * np.uint64(BASE) + hashes[i:i + n])
    return total


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of `size` words in a row; of fewer words, one for the whole sequence; of none, none."""
    if len(hashes) == 0:
        return hashes
    return np.unique(grams(hashes, min(size, len(hashes))))


def digest(values: np.ndarray) -> bytes:
    """128 bits that are the same for the same set of hashes."""
    if len(values) == 0:
        return bytes(16)
    return np.array([mixed(values).sum(), mixed(values ^ np.uint64(MIX_2)).sum()], dtype=np.uint64).tobytes()
