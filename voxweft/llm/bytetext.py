"""Words and shingles of many texts at once, by numpy over their UTF-8 bytes.

A word is a run of bytes other than space and ``\\x09``-``\\x0d``; letters A-Z count as a-z. Word and shingle
hashes are 64 bits wide, the same on every machine.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Of the GNU C library; other systems have none.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RANDOM = np.random.RandomState(20240611)
BYTE = _RANDOM.randint(1, 2**63 - 1, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 2**64)
STEP = (_RANDOM.randint(1, 2**62, 64, dtype=np.int64).astype(U64) << U64(1)) | U64(1)
_powers = [np.ones(1, U64), np.ones(1, U64)]
#: Bytes of text handled at a time.
SLICE = 1_000_000


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def sorted_set(x: np.ndarray) -> np.ndarray:
    """Different values in order, by a sort: of 64-bit hashes that is several times as fast as the hash table of ``np.unique``."""
    x = np.sort(x, axis=None)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, BASE_INVERSE)):
            out = np.full(n, base, U64)
            out[0] = 1
            _powers[k] = np.cumprod(out, dtype=U64)
    return _powers[0][:n], _powers[1][:n]


def release() -> None:
    """Gives memory that was freed back to the system: workers are used again by later stages."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes each, or of one row."""
    ends = np.concatenate([[0], np.cumsum(lengths(column))])
    at, n = 0, len(column)
    while at < n:
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, stop
        at = stop
    release()


def lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows, and where each row begins (one more than rows); null is an empty text."""
    sizes = lengths(column)
    off = np.concatenate([[0], np.cumsum(sizes)])
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    begins = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    if not len(column) or not off[-1]:
        return np.zeros(0, np.uint8), off
    data = np.frombuffer(column.buffers()[2], np.uint8)[begins[0] : begins[-1]]
    return data, off


def spans(keep: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of kept bytes that don't cross a row: starts, ends, and the rows they are of."""
    n = len(keep)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first = keep.copy()
    first[1:] &= ~keep[:-1] | edge[1:n]
    last = keep.copy()
    last[:-1] &= ~keep[1:] | edge[1:n]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(s, off)))


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of spans of bytes, taken as they are."""
    p, q = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE[data] * p[: len(data)], out=total[1:])
    return mix((total[e] - total[s]) * q[s] + (e - s).astype(U64))


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all rows: lower-cased bytes, row offsets, and by word its start, end, row and hash."""
    data, off = buffer(column)
    low = LOWER[data]
    s, e, row = spans(~SPACE[data], off)
    return low, off, s, e, row, span_hashes(low, s, e)


def shingles(hashes: np.ndarray, row: np.ndarray, k: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles in order, the row and the first word of each. A row with fewer words, but
    one at least, has its whole sequence as its only shingle."""
    n = len(hashes)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, U64), z, z
    m = max(0, n - k + 1)
    out = np.zeros(m, U64)
    for j in range(k):
        out += hashes[j : j + m] * STEP[j]
    first = np.flatnonzero(row[:m] == row[k - 1 : k - 1 + m]) if m else np.zeros(0, np.int64)
    out = mix(out[first])
    counts = np.bincount(row, minlength=rows)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if not len(short):
        return out, row[first], first
    begins = np.concatenate([[0], np.cumsum(counts)])
    more = np.zeros(len(short), U64)
    for j in range(k - 1):
        has = counts[short] > j
        more[has] += hashes[begins[short[has]] + j] * STEP[j]
    more = mix(more + counts[short].astype(U64))
    both, of = np.concatenate([out, more]), np.concatenate([row[first], short])
    order = np.argsort(of, kind="stable")
    return both[order], of[order], np.concatenate([first, begins[short]])[order]
