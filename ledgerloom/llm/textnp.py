"""Vectorised kernels over the bytes of many texts at once.

A block is a slice of an Arrow string column: its bytes and the offsets of the
texts. White space is the six ASCII characters (space and 0x09-0x0D); words
are the runs between them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WHITE = np.zeros(256, dtype=bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True

_rng = np.random.default_rng(20240607)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))

#: Bytes of text handled at once; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 20


def strings(column) -> pa.LargeStringArray:
    """The column as one large-string array, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def blocks(column, block_bytes: int = BLOCK_BYTES):
    """(first row, row after the last, bytes, offsets) of consecutive slices of a column."""
    arr = strings(column)
    n = len(arr)
    if n == 0:
        return
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset:arr.offset + n + 1]
    data = arr.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size \
        else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + block_bytes, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(inside: np.ndarray, offsets: np.ndarray):
    """Starts and ends of the runs of true values, cut at ``offsets``."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


class Powers:
    """Powers of the hash base and of its inverse, grown when a longer block comes."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int):
        if len(self.up) < n:
            n = max(n, 2 * BLOCK_BYTES)
            with np.errstate(over="ignore"):
                one = np.ones(1, dtype=np.uint64)
                self.up = np.cumprod(np.concatenate([one, np.full(n - 1, BASE)]))
                self.down = np.cumprod(np.concatenate([one, np.full(n - 1, BASE_INVERSE)]))
        return self.up, self.down


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers):
    """A 64-bit hash of the bytes of every span, equal for equal bytes."""
    up, down = powers.upto(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(BYTE_CODE[data] * up[:len(data)], out=total[1:])
        return mix64((total[ends] - total[starts]) * down[starts])


def words(data: np.ndarray, offsets: np.ndarray):
    """Starts and ends of the words, and the first word's number of each text (plus the total)."""
    starts, ends = spans(~WHITE[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


SHINGLE_CODE = (_rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1))


def shingles(word_hash: np.ndarray, first: np.ndarray, size: int = 5):
    """Hashes of the ``size``-word shingles and each text's first shingle number (plus the total).

    A text of fewer words (but one at least) has one shingle: all its words.
    """
    n_words = np.diff(first)
    count = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], count) + np.repeat(first[:-1], count)
    stop = np.repeat(first[1:], count)
    with np.errstate(over="ignore"):
        h = np.zeros(len(at), dtype=np.uint64)
        padded = np.concatenate([word_hash, np.zeros(size, np.uint64)])
        for k in range(size):
            part = padded[at + k] * SHINGLE_CODE[k]
            if k:
                part = np.where(at + k < stop, part, np.uint64(0))
            h += part
        return mix64(h), begin
