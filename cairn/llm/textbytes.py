"""Vectorised work on the UTF-8 bytes of Arrow string columns: slices, word spans, span hashes, shingles.

A slice holds whole rows and about SLICE_BYTES bytes, so memory stays bounded by the slice or by the longest
single text. Null texts count as empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words as runs of bytes that are neither blank nor control white space: [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Words as runs of ASCII letters, digits and all non-ASCII bytes.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1024)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective); works on a copy."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def column_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; offsets start at 0."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.type not in (pa.large_binary(), pa.large_string()):
        array = array.cast(pa.large_binary() if pa.types.is_binary(array.type) else pa.large_string())
    if array.null_count:
        array = pc.fill_null(array, b"" if pa.types.is_large_binary(array.type) else "")
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, dtype=np.int64, count=len(array) + 1, offset=8 * array.offset) if len(array) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches into runs of rows of about `limit` bytes of `column`; yields (rows, bytes, offsets)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, off = column_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


def spans(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes in `table`, never across rows, and each row's first run."""
    inside = table[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = off[:-1] < off[1:]
    edge = off[:-1][full]
    first[edge] = inside[edge]
    edge = off[1:][full] - 1
    last[edge] = inside[edge]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes that doesn't depend on where the span stands."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    v = BYTE_CODE[data]
    v *= up[: len(data)]
    np.cumsum(v, out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start])


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's `width`-word shingles (a shorter row of words is one shingle), and row offsets.

    `words` are word hashes, `first` the row offsets into them. Repeats are kept.
    """
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out_off = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    at = np.arange(out_off[-1]) - out_off[:-1][row] + first[:-1][row]
    size = np.minimum(n, width)[row]
    acc = np.full(len(at), 0x243F6A8885A308D3, dtype=np.uint64) + size.astype(np.uint64)
    step = np.uint64(0xD6E8FEB86659FD93)
    for k in range(width):
        use = size > k
        w = words[np.minimum(at + k, max(len(words) - 1, 0))] if len(words) else words
        acc = np.where(use, (acc * step) ^ w, acc) if not use.all() else (acc * step) ^ w
        acc ^= acc >> np.uint64(29)
    return mix(acc), out_off


def distinct_per_row(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and the new offsets."""
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    keep = np.ones(len(v), dtype=bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    v, r = v[keep], r[keep]
    return v, np.searchsorted(r, np.arange(len(off)))
