"""Texts of a batch as one array of code points, so that spans are found and checked without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points that are looked at together, about: four bytes each, and a few arrays of eight.
SLAB = 1 << 20

_BLANK = np.array([chr(c).isspace() for c in range(0x3001)])


def slabs(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about a slab each: first row, row after the last, offsets of their texts, and which code points are not blank."""
    lengths = pc.utf8_length(pc.fill_null(texts, "")).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    low = 0
    while low < len(lengths):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + SLAB, side="right")))
        codes = np.frombuffer("".join(x or "" for x in texts.slice(low, high - low).to_pylist()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        yield low, high, np.concatenate([[0], ends[low:high] - before]), ~_BLANK[np.minimum(codes, 0x3000)] | (codes > 0x3000)
        low = high


def words(offsets: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of code points that are not blank, within its text, and the number of runs of each text."""
    n = len(solid)
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = solid[cuts]
    last[cuts - 1] = solid[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, starts, side="right") - 1
    return starts - offsets[row], ends - offsets[row], np.bincount(row, minlength=len(offsets) - 1)


FAULTS = np.array([None, "out of range", "overlap", "uncovered"], dtype=object)


def first_faults(offsets: np.ndarray, solid: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each text the number in FAULTS of the first fault of its spans (given by row, in any order), 0 if they cover all that is not blank."""
    order = np.lexsort((end, start, row))
    row, start, end = row[order], start[order], end[order]
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    same = np.concatenate([[False], row[1:] == row[:-1]]) if len(row) else np.zeros(0, dtype=bool)
    at = np.where(same, np.concatenate([[0], end[:-1]]), 0) if len(row) else start
    filled = np.concatenate([[0], np.cumsum(solid)])
    # Up to a text's first fault every span is in range and begins where the one before it ended, or later.
    inside = lambda x: np.clip(x, 0, lengths[row]) + offsets[row]
    bare = filled[inside(start)] > filled[inside(at)]
    fault = np.select([(start < 0) | (end > lengths[row]) | (start >= end), start < at, bare], [1, 2, 3], 0)
    out = np.zeros(n, dtype=np.int64)
    wrong = np.flatnonzero(fault)
    rows, where = np.unique(row[wrong], return_index=True)
    out[rows] = fault[wrong[where]]
    tail = np.zeros(n, dtype=np.int64)
    lasts = np.flatnonzero(np.concatenate([row[1:] != row[:-1], [True]])) if len(row) else np.zeros(0, dtype=np.int64)
    tail[row[lasts]] = np.clip(end[lasts], 0, lengths[row[lasts]])
    rest = filled[offsets[1:]] > filled[offsets[:-1] + tail]
    return np.where((out == 0) & rest, 3, out)
