"""Vectorised text kernel: Arrow string columns to word, shingle and gram hashes.

A whole slice of a column is handled as one byte buffer with numpy, so no
Python code runs per word.  Texts are UTF-8; every byte of a character outside
ASCII counts as a word byte unless a class table says otherwise.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer single text is a slice of its own.
SLICE_BYTES = 1 << 18

Batches = Iterator[pa.RecordBatch]


def give_back() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, giving freed memory back when a task ends: workers are used again, and executors are small."""

    def wrapped(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


_SEED = 0x9E3779B97F4A7C15
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def _table(keep) -> np.ndarray:
    """Byte class table: 0 for separators, else the byte with A-Z lower-cased (255 for NUL)."""
    out = np.zeros(256, np.uint8)
    for b in range(256):
        if keep(b):
            out[b] = b + 32 if 65 <= b <= 90 else b or 255  # a NUL within a word; UTF-8 has no byte 255
    return out


#: Words of ASCII letters, digits and every character outside ASCII.
ALNUM_WORDS = _table(lambda b: b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)
#: Words between the ASCII white space characters 09-0D and 20.
SPACE_WORDS = _table(lambda b: not (b == 32 or 9 <= b <= 13))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; x is an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_RANDOM = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_SEED)) | np.uint64(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        for way, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[way] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, end row, bytes, offsets); a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        end = min(end, n)
        a, b = offsets[first], offsets[end]
        yield first, end, data[a:b], offsets[first : end + 1] - a
        first = end


def spans(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a slice: mapped bytes, starts, ends, and offsets of each text's words."""
    mapped = table[raw]
    inside = mapped > 0
    n = len(raw)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    edge = offsets[(offsets > 0) & (offsets < n)]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[edge - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return mapped, starts, ends, np.searchsorted(starts, offsets)


def hashes(mapped: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans."""
    n = len(mapped)
    up, down = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_RANDOM[mapped] * up[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(_SEED))


_ODD = mix(np.arange(1001, 1065, dtype=np.uint64)) | np.uint64(1)


def shingles(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words and each text's offsets into them.

    A text of fewer than k words, but not none, has its whole sequence as one.
    """
    n = len(words)
    counts = np.diff(at)
    out = np.zeros(n, np.uint64)
    if n >= k:
        m = n - k + 1
        for i in range(k):
            out[:m] += words[i : i + m] * _ODD[i]
    keep = np.zeros(n, bool)
    each = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(counts)), counts)
    keep = (np.arange(n) - at[:-1][text]) < each[text]
    out = mix(out)
    for t in np.flatnonzero((counts > 0) & (counts < k)):
        own = words[at[t] : at[t + 1]]
        out[at[t]] = mix(np.array([(own * _ODD[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))], np.uint64))[0]
    return out[keep], np.concatenate([[0], np.cumsum(each)])


def grams(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words by the index of their first word, and which of them lie in one text."""
    n = len(words)
    out, keep = np.zeros(n, np.uint64), np.zeros(n, bool)
    if n >= k:
        m = n - k + 1
        for i in range(k):
            out[:m] += words[i : i + m] * _ODD[i]
        counts = np.diff(at)
        keep = np.arange(n) + k <= np.repeat(at[1:], counts)
    return mix(out + np.uint64(k)), keep


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType = pa.int64()) -> pa.ListArray:
    """A list column from flat values; uint64 hashes become longs of the same bits."""
    if values.dtype == np.uint64:
        values = values.view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
