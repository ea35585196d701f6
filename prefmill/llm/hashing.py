"""Vectorised hashing of words and spans in Arrow string arrays.

A prefix sum of byte * P**i modulo 2**64 gives the hash of any span as a
difference times an inverse power, so spans of any number and length are hashed
with a few array operations and without copying text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

P, Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes of text handled at once; a longer text is a block of its own.
BLOCK = 1 << 20
_POWERS: dict[tuple[int, bool], np.ndarray] = {}
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def powers(base: np.uint64, n: int, inverse: bool = False) -> np.ndarray:
    known = _POWERS.get((int(base), inverse))
    if known is None or len(known) < n:
        b = pow(int(base), -1, 1 << 64) if inverse else int(base)
        known = np.ones(1, np.uint64)
        while len(known) < n:
            known = np.concatenate([known, known * np.uint64(pow(b, len(known), 1 << 64))])
        _POWERS[int(base), inverse] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Spans:
    """Hashes of [start, end) of an array of bytes or of 64-bit numbers. Beside the sums it holds tables of BLOCK powers, whatever the length."""

    def __init__(self, values: np.ndarray, base: np.uint64 = P):
        self.sums = np.zeros(len(values) + 1, np.uint64)
        inverse, wide = pow(int(base), -1, 1 << 64), min(BLOCK, len(values) + 1)
        self.near, self.far = powers(base, wide, True), []
        for low in range(0, len(values) + 1, BLOCK):
            self.far.append(pow(inverse, low, 1 << 64))
            part = values[low : low + BLOCK].astype(np.uint64)
            part += np.uint64(1)
            part *= powers(base, len(part))
            part *= np.uint64(pow(int(base), low, 1 << 64))
            np.cumsum(part, out=part)
            np.add(part, self.sums[low], out=self.sums[low + 1 : low + 1 + len(part)])
        self.far = np.array(self.far, np.uint64)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inverse = self.near[start % BLOCK] * self.far[start // BLOCK]
        return mix((self.sums[end] - self.sums[start]) * inverse + (end - start).astype(np.uint64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches with about ``most`` bytes of text, with bytes and offsets."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(column))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
            yield batch.slice(low, high - low), data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
            low = high


class Words:
    """Words of a block: starts, ends, row of each, hash of each, and the words of row i are first[i]:first[i + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        space = SPACES[data]
        start, end = ~space, ~space
        if len(data):
            start[1:] &= space[:-1]
            end[:-1] &= space[1:]
            at = offsets[(offsets > 0) & (offsets < len(data))]
            start[at] = ~space[at]
            end[at - 1] = ~space[at - 1]
        self.data, self.offsets = data, offsets
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.hash = Spans(data).of(self.starts, self.ends)
