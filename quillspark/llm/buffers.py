"""Whole texts as flat byte arrays: words, word hashes and document borders in numpy.

Every function takes all bytes of all texts.  A null text counts as empty.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Fixed: the six white-space bytes of the word pattern [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Fixed: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0..n and base**-0..-n modulo 2**64."""
    if len(_POWERS[0]) <= n:
        for i, b in enumerate((_BASE, _BACK)):
            p = np.full(max(n + 1, 1 << 20), b, np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0][: n + 1], _POWERS[1][: n + 1]


_LIBC = ctypes.CDLL(None)


def tidy(f: Callable) -> Callable:
    """f over batches; after the last one the worker's free memory goes back to the system, as the worker lives on beside later stages."""

    @functools.wraps(f)
    def run(batches, *args, **kwargs):
        try:
            yield from f(batches, *args, **kwargs)
        finally:
            give_back()

    return run


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


#: Bytes of an Arrow batch where the session leaves Spark's own limit, which is 64 MB.
ARROW_BATCH = "4m"


def small_batches(df: DataFrame) -> DataFrame:
    """df; its session sends texts to Python a few MB at a time: a task holds a batch on either side, and an executor keeps the room for its largest ones."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, "64m") in ("64m", "67108864", "67108864b"):
        conf.set(key, ARROW_BATCH)
    return df


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    h = h + np.uint64((salt * 0xD1B54A32D192ED03 + 0x2545F4914F6CDD1D) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA3B195354A39B70D)
    return h ^ (h >> np.uint64(32))


def texts(column: pa.Array | pa.ChunkedArray, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, borders) of runs of rows of about `limit` bytes; a longer text comes alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word, in order."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    ink = ~SPACE[data]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    heads = at[:-1][at[:-1] < at[1:]]
    first[heads] = ink[heads]
    tails = at[1:][at[:-1] < at[1:]] - 1
    last[tails] = ink[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span, from one prefix sum over all bytes."""
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mixed((total[end] - total[start]) * down[start], salt)


def row_sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n)[:n]
