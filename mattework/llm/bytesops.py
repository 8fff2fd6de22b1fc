"""Vectorised work on the UTF-8 bytes of whole Arrow batches: spans of words, hashes of spans."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_M1, _M2, _GOLD = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
BASE = 0xD1342543DE82EF95  # odd, so that it has an inverse modulo 2**64
_INV = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (splitmix finaliser)."""
    x = x + _GOLD
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


#: One random 64-bit value for each byte.
NAMES = mix(np.arange(256, dtype=U) + U(977))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n; the largest table for usual blocks is kept."""
    size = max(1 << 16, 1 << (n - 1).bit_length()) if n > 1 else 1 << 16
    for have, tables in _powers.items():
        if have >= n:
            return tables
    tables = []
    for base in (BASE, _INV):
        t = np.full(size, base, U)
        t[0] = 1
        tables.append(np.multiply.accumulate(t))
    if size <= 1 << 22:
        _powers.clear()
        _powers[size] = tuple(tables)
    return tuple(tables)


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] fixing symbols[i:j] but for its place; see span_hash."""
    out = np.zeros(len(symbols) + 1, U)
    np.cumsum(symbols * powers(len(symbols) + 1)[0][: len(symbols)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span [start, end); equal spans get equal hashes wherever they are."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(U) * _M2)


def gram_hash(sums: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n symbols from each place on."""
    m = len(sums) - n
    return mix((sums[n:] - sums[:-n]) * powers(len(sums))[1][:m]) if m > 0 else np.zeros(0, U)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n+1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary() if binary else pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, b"" if binary else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about limit bytes; a longer document is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on after its task, beside others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def text_blocks(batches, column: str = "text", limit: int = 1 << 19):
    """(batch rows of the block, its bytes, its offsets) for each block of each batch."""
    for batch in batches:
        data, offsets = column_bytes(batch.column(batch.schema.get_field_index(column)))
        for i, j in blocks(offsets, limit):
            yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
    _powers.clear()
    give_back()


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (bytes other than white space, never across documents), and the
    n+1 offsets of the documents into them."""
    if not len(data):
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = inside[heads]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[tails] = inside[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def sums_by(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values in each range of offsets (an empty range gives 0)."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
