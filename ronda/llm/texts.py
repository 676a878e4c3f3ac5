"""Vectorised views of text columns inside a task: bytes, words, hashes.

Everything works on numpy arrays over the UTF-8 bytes of an Arrow string
column, in chunks of bounded size; one text longer than a chunk is a chunk of
its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_M1, _M2, _P = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(_M1)
    x ^= x >> np.uint64(27)
    x *= np.uint64(_M2)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        for k, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _pow[k] = np.multiply.accumulate(steps)
    return _pow[0], _pow[1]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(ends):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8), ends


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of some one megabyte."""
    data, ends = column_bytes(column)
    n, i = len(column), 0
    while i < n:
        j = int(np.searchsorted(ends, ends[i] + CHUNK_BYTES, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j, data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
        i = j


def spans(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes; a run never crosses rows."""
    if not len(is_word):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty_like(is_word)
    before[0] = False
    before[1:] = is_word[:-1]
    after = np.empty_like(is_word)
    after[-1] = False
    after[:-1] = is_word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(is_word))]
    before[inner] = False
    after[inner - 1] = False
    return np.flatnonzero(is_word & ~before), np.flatnonzero(is_word & ~after) + 1


class Hashes:
    """Hashes of any byte spans of a chunk, from one running sum."""

    def __init__(self, data: np.ndarray):
        power, self._inverse = _powers(len(data) + 1)
        self._sum = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[: len(data)], out=self._sum[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self._sum[ends] - self._sum[starts]) * self._inverse[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(_P))


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row of each span."""
    return np.searchsorted(offsets, starts, "right") - 1
