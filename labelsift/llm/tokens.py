"""Words of whole Arrow batches as 64-bit hashes, without a Python object for each word.

Words are runs of bytes other than white space (``[^\\x20\\x09-\\x0D]+``), with A-Z in lower case. A word's hash is a polynomial
over mixed byte values modulo 2^64, taken from running sums and mixed with its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes looked at together; a word that is longer is taken whole.
WINDOW = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that spreads every bit."""
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By byte: its mixed value, and whether it is white space."""
    low = np.arange(256)
    low[65:91] += 32
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return mixed(low.astype(np.uint64) + np.uint64(1)), space


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def row(base):
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return row(_BASE), row(_INVERSE)


def _power_rows(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n <= WINDOW + 1:
        return _powers(WINDOW + 1)
    return _powers.__wrapped__(n)


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, words by row) of a column of texts; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(column) else np.empty(0, np.uint8)
    ends = ends - ends[0] if len(ends) else np.zeros(1, np.int64)
    values, white = _tables()
    n = len(data)
    starts, hashes = np.zeros(n + 1, bool), []
    inside = ~white[data]
    after = np.ones(n + 1, bool)  # whether a word can't go on from the byte before
    after[1:n] = ~inside[:-1]
    after[ends] = True
    starts[:n] = inside & after[:n]
    at = 0
    while at < n:
        end = min(at + WINDOW, n)
        if end < n and not after[end]:  # back to where a word can end, or forward to it
            back = np.flatnonzero(after[at + 1 : end])
            end = at + 1 + int(back[-1]) if len(back) else end + int(np.argmax(after[end:]))
        begin = np.flatnonzero(starts[at:end])
        if len(begin):
            stop = np.flatnonzero(inside[at:end] & (after[at + 1 : end + 1] | ~np.r_[inside[at + 1 : end], False])) + 1
            power, inverse = _power_rows(end - at + 1)
            sums = np.zeros(end - at + 1, np.uint64)
            np.cumsum(values[data[at:end]] * power[: end - at], out=sums[1:])
            hashes.append(mixed((sums[stop] - sums[begin]) * inverse[begin] + (stop - begin).astype(np.uint64)))
        at = end
    before = np.r_[0, np.cumsum(starts[:n])]
    return np.concatenate(hashes) if hashes else np.empty(0, np.uint64), np.diff(before[ends])


def parts(batch: pa.RecordBatch, text: int, size: int = WINDOW) -> Iterator[pa.RecordBatch]:
    """Runs of the batch's rows with about ``size`` bytes in column number ``text``; no run is empty."""
    column = batch.column(text).cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


class Index:
    """Sorted distinct 64-bit keys, found by their leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.starts = None

    def __len__(self) -> int:
        return len(self.keys)

    def __getstate__(self):
        return {"keys": self.keys, "starts": None}

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``wanted`` among the keys, and which of them are there."""
        hit = np.zeros(len(wanted), bool)
        if not len(self.keys):
            return np.zeros(len(wanted), np.int64), hit
        if self.starts is None:
            bits = min(24, max(1, len(self.keys).bit_length() + 1))
            self.shift = np.uint64(64 - bits)
            edges = np.arange(1 << bits, dtype=np.uint64) << self.shift
            self.starts = np.r_[np.searchsorted(self.keys, edges), len(self.keys)].astype(np.uint32)
        slot = (wanted >> self.shift).astype(np.int64)
        at, end = self.starts[slot].astype(np.int64), self.starts[slot + 1].astype(np.int64)
        live = np.flatnonzero(at < end)
        while len(live):
            same = self.keys[at[live]] == wanted[live]
            hit[live[same]] = True
            live = live[~same]
            at[live] += 1
            live = live[at[live] < end[live]]
        return np.minimum(at, len(self.keys) - 1), hit
