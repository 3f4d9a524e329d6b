"""Vectorised work on the UTF-8 bytes of Arrow string columns.

All functions take a whole run of documents at once: ``data`` holds their bytes end to end and ``off`` the
offsets (one more than there are documents), so the cost is a few numpy passes over the bytes and no Python
loop per word. Runs are cut at ``RUN_BYTES``; a longer document is a run of its own, never a prefix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 1 << 17

_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
MULTIPLIERS = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NOT_SPACE = ~SPACE
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 16, 1 << int(n).bit_length())
    if size > 4 * RUN_BYTES or size not in _powers:
        base = np.full(size, _BASE, np.uint64)
        inverse = np.full(size, _BASE_INVERSE, np.uint64)
        base[0] = inverse[0] = 1
        table = np.multiply.accumulate(base), np.multiply.accumulate(inverse)
        if size > 4 * RUN_BYTES:
            return table
        _powers[size] = table
    return _powers[size]


def runs(column: pa.Array, limit: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offsets, values = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1))
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def spans(data: np.ndarray, off: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of member bytes inside documents, and the first of them of each document."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    w = member[data]
    start, end = w.copy(), w.copy()
    start[1:] &= ~w[:-1]
    end[:-1] &= ~w[1:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    start[inner] = w[inner]
    end[inner - 1] = w[inner - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, off)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial of the bytes, from which ``span_hash`` takes the hash of any span."""
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * _power_table(len(data))[0][: len(data)], out=h[1:])
    return h


def span_hash(h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return mix((h[e] - h[s]) * _power_table(len(h))[1][s] + (e - s).astype(np.uint64))


def window_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values (len - k + 1 of them); the caller drops those across documents."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h += words[i : i + n] * MULTIPLIERS[i]
    return mix(h)


def per_document(first: np.ndarray) -> np.ndarray:
    """The document of each item, from the first item of each document."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of flags (a value for each byte or item) in each document."""
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
