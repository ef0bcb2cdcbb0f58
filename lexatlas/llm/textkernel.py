"""Vectorised byte-level text kernels for Arrow string columns.

All functions work on one flat ``uint8`` buffer plus row offsets, so a batch
of documents costs a fixed number of numpy passes whatever the row count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 1 << 19

#: Byte classes of the word contract: a word is a run of bytes outside space and \t..\r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_GAMMA = 0x9E3779B97F4A7C15
TABLE = mix((np.arange(1, 257, dtype=np.uint64)) * U64(_GAMMA))
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown geometrically and kept while small."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        steps = np.full(size, U64(base))
        steps[0] = U64(1)
        have = np.cumprod(steps, dtype=np.uint64)
        if size <= 4 * CHUNK_BYTES:
            _POWERS[base] = have
    return have[:n]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets int64, bytes uint8) of a string or binary column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


def pieces(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each (one longer row stands alone)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def rolling(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash; see span_hash."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(TABLE[data] * powers(_BASE, len(data)), dtype=np.uint64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-independent 64-bit hash of data[start:end]."""
    inv = powers(_INVERSE, len(prefix))
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64) * U64(_GAMMA))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word; words never cross rows."""
    n = len(data)
    if n == 0:
        e = np.zeros(0, np.int64)
        return e, e, e
    inside = ~SPACE[data]
    cut = offsets[1:-1]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[cut[cut < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends_before = cut[(cut > 0)] - 1
    after[ends_before] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return start, end, row


def stretches(data: np.ndarray, limit: int = 2 * CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of about ``limit`` bytes that end after a white space (a longer word makes a longer one)."""
    lo = 0
    while lo < len(data):
        hi = min(lo + limit, len(data))
        if hi < len(data):
            gaps = np.flatnonzero(SPACE[data[lo:hi]])
            while not len(gaps) and hi < len(data):
                lo_, hi = hi, min(hi + limit, len(data))
                gaps = np.flatnonzero(SPACE[data[lo_:hi]]) + lo_ - lo
            hi = lo + int(gaps[-1]) + 1 if len(gaps) else hi
        yield lo, hi
        lo = hi


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word after ``fold`` (A-Z are lower-cased). A long text is taken a stretch at a time."""
    low = fold[data]
    if len(offsets) == 2 and len(data) > 2 * CHUNK_BYTES:
        h = np.concatenate([_hashed(low[lo:hi], np.array([0, hi - lo]))[0] for lo, hi in stretches(low)])
        return h, np.zeros(len(h), np.int64)
    return _hashed(low, offsets)


def _hashed(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, row = words(low, offsets)
    return span_hash(rolling(low), start, end), row


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every ``width``-word shingle, repeats included.

    A row with at least one but fewer than ``width`` words has its whole word
    sequence as the only shingle; a row without words has none.
    """
    h, row = word_hashes(data, offsets)
    n = len(h)
    rows = len(offsets) - 1
    count = np.bincount(row, minlength=rows)
    weights = mix(np.arange(11, 11 + width, dtype=np.uint64) * U64(_GAMMA)) | U64(1)
    parts_h, parts_r = [], []
    if n >= width:
        acc = h[: n - width + 1] * weights[0]
        for k in range(1, width):
            acc = acc + h[k : n - width + 1 + k] * weights[k]
        ok = row[: n - width + 1] == row[width - 1 :]
        parts_h.append(mix(acc[ok] + U64(width)))
        parts_r.append(row[: n - width + 1][ok])
    first = np.cumsum(count) - count
    for m in range(1, width):
        rs = np.flatnonzero(count == m)
        if len(rs):
            acc = np.zeros(len(rs), np.uint64)
            for k in range(m):
                acc = acc + h[first[rs] + k] * weights[k]
            parts_h.append(mix(acc + U64(m)))
            parts_r.append(rs)
    if not parts_h:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(parts_h), np.concatenate(parts_r)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(values, bounds): row r's sorted distinct shingles are values[bounds[r]:bounds[r+1]]."""
    h, row = shingles(data, offsets, width)
    order = np.argsort(row, kind="stable")
    h, row = h[order], row[order]
    rows = len(offsets) - 1
    edge = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=rows))))
    for r in np.flatnonzero(np.diff(edge) > 1):
        h[edge[r] : edge[r + 1]].sort()
    keep = np.ones(len(h), bool)
    if len(h) > 1:
        keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[keep], np.concatenate(([0], np.cumsum(np.bincount(row[keep], minlength=rows))))


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[r]:bounds[r+1]] for each r (uint64 wraps)."""
    c = np.empty(len(values) + 1, values.dtype)
    c[0] = 0
    np.cumsum(values, out=c[1:])
    return c[bounds[1:]] - c[bounds[:-1]]
