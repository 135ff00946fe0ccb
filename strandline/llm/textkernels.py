"""Vectorised text kernels over Arrow string columns: chunks, words, hashes.

A chunk is the UTF-8 of consecutive rows, end to end, as one byte array. All
kernels work on a chunk at once, so no Python statement runs for a character
or a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a chunk has at most, unless a single row has more.
CHUNK_BYTES = 1 << 20

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit words that spreads every bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit words."""
    return mix((np.arange(1, n + 1, dtype=_U) + _U(seed) * _U(1_000_003)) * _U(0x9E3779B97F4A7C15))


def ascii_table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


#: Space, tab, newline, vertical tab, form feed, carriage return.
SPACES = ascii_table(b" \t\n\x0b\x0c\r")

_BYTE = seeds(256, 1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]  # A-Z count as a-z

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, base, dtype=_U)
            table[0] = 1
            np.multiply.accumulate(table, out=table)
            _powers[name] = table
    return _powers["up"], _powers["down"]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, end row, bytes and offsets of each chunk of a column."""
    if not len(column):
        return
    data, offsets = utf8(column)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, is_space: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word of a chunk."""
    inside = ~is_space[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span data[start:end]; A-Z count as a-z."""
    return value_span_hashes(_BYTE[data], start, end)


def value_span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of 64-bit values: a polynomial from prefix sums, mixed with the length."""
    up, down = _power_table(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=_U)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


def shingle_hashes(word_hashes: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each shingle of k words; a row of fewer words has one shingle of all its words."""
    n = len(word_hashes)
    parts = []
    if n >= k:
        h = np.zeros(n - k + 1, dtype=_U)
        for j in range(k):
            h = mix(h + word_hashes[j : n - k + 1 + j] * _U(0x9E3779B97F4A7C15))
        whole = row[: n - k + 1] == row[k - 1 :]
        parts.append((h[whole], row[: n - k + 1][whole]))
    count = np.bincount(row, minlength=n_rows) if n else np.zeros(n_rows, dtype=np.int64)
    at = np.concatenate(([0], np.cumsum(count)))
    for r in np.flatnonzero((count > 0) & (count < k)):
        h = np.zeros(1, dtype=_U)
        for j in range(at[r], at[r + 1]):
            h = mix(h + word_hashes[j : j + 1] * _U(0x9E3779B97F4A7C15))
        parts.append((mix(h + _U(count[r])), np.full(1, r)))
    if not parts:
        return np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row of a chunk, end to end, and their offsets."""
    start, end, row = words(data, offsets)
    n_rows = len(offsets) - 1
    h, r = shingle_hashes(span_hashes(data, start, end), row, n_rows, k)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    if len(h):
        fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])))
        h, r = h[fresh], r[fresh]
    return h, np.concatenate(([0], np.cumsum(np.bincount(r, minlength=n_rows)))) if n_rows else np.zeros(1, dtype=np.int64)
