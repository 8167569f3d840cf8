"""Vectorised tokenising and hashing over the raw UTF-8 buffers of Arrow string columns.

A column of texts is one byte buffer plus offsets, so words are found and hashed with a
handful of array passes instead of a Python loop over words. All hashes are fixed functions
of the bytes: they agree between workers, runs and machines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
BASE_INVERSE = pow(BASE, -1, 1 << 64)
STEP = 0xD6E8FEB86659FD93
#: Bytes that are hashed at a time; arrays of eight bytes for each are held meanwhile.
SLAB = 1 << 18


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_class(spans: list[tuple[int, int]]) -> np.ndarray:
    """A table of 256 flags, set for the byte ranges given (both ends included)."""
    flags = np.zeros(256, dtype=bool)
    for low, high in spans:
        flags[low : high + 1] = True
    return flags


#: Everything but space and the controls from tab to carriage return.
SPACED = ~byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: ASCII letters and digits, and every byte of a code point from U+0080 on.
ALNUM = byte_class([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])


def byte_values(fold_case: bool = True) -> np.ndarray:
    """A random 64-bit value for each byte; with fold_case A-Z count as a-z."""
    values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
    if fold_case:
        values[0x41:0x5B] = values[0x61:0x7B]
    return values


_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, SLAB + 1)
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            row = np.full(size, base, dtype=np.uint64)
            row[0] = 1
            _powers[name] = np.cumprod(row, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def words_of(data: np.ndarray, breaks: np.ndarray, is_word: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word in a byte buffer; no word crosses a position in breaks."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(0, dtype=np.uint64)
    inside = is_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    breaks = breaks[(breaks > 0) & (breaks < n)]
    first[breaks] = inside[breaks]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[breaks - 1] = inside[breaks - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power_table(n + 1)
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(values[data] * up[:n], out=total[1:])
    hashes = mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(STEP))
    return starts, ends, hashes


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def slabs(offsets: np.ndarray, most: int = SLAB) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes each, or of one row."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1)
        yield low, min(high, n)
        low = high


def _pieces(data: np.ndarray, is_word: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about a slab each that end between words."""
    low, n = 0, len(data)
    while low < n:
        high = min(n, low + SLAB)
        while high < n:
            gap = np.flatnonzero(~is_word[data[high : high + SLAB]])
            if len(gap):
                high += int(gap[0])
                break
            high = min(n, high + SLAB)
        yield low, high
        low = high


def tokenise(column: pa.Array | pa.ChunkedArray, is_word: np.ndarray, values: np.ndarray, spans: bool = False) -> Iterator[tuple]:
    """For row ranges of the column: low, high, bounds, hashes and, with spans, starts and ends.

    Row low + i has the words bounds[i] to bounds[i + 1]; starts and ends are byte offsets
    from the beginning of the row range's first text.
    """
    data, offsets = buffers(column)
    for low, high in slabs(offsets):
        begin, end = int(offsets[low]), int(offsets[high])
        if high - low == 1 and end - begin > SLAB:
            parts = [(a, *words_of(data[begin + a : begin + b], np.zeros(0, np.int64), is_word, values)) for a, b in _pieces(data[begin:end], is_word)]
            hashes = np.concatenate([p[3] for p in parts])
            starts, ends = (np.concatenate([p[0] + p[k] for p in parts]) for k in (1, 2)) if spans else (None, None)
            bounds = np.array([0, len(hashes)])
        else:
            cuts = offsets[low : high + 1] - begin
            starts, ends, hashes = words_of(data[begin:end], cuts, is_word, values)
            bounds = np.searchsorted(starts, cuts)
        yield (low, high, bounds, hashes, starts, ends) if spans else (low, high, bounds, hashes)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width consecutive words; of fewer words, the whole as one; of none, none."""
    if not len(words):
        return words
    short = len(words) < width
    k = len(words) if short else width
    total = np.zeros(len(words) - k + 1, dtype=np.uint64)
    factor = 1
    for j in range(k):
        total += words[j : len(words) - k + 1 + j] * np.uint64(factor)
        factor = factor * STEP & MASK
    return mix64(total + np.uint64(k * BASE & MASK))
