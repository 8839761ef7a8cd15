"""Numpy kernels over UTF-8 buffers shared by the text operators.

Every kernel works on whole Arrow batches: no Python loop runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a kernel expands at once; one longer text is one slice.
SLICE_BYTES = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array without nulls (null reads as the empty text)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return pc.fill_null(column, "")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and len+1 offsets (from 0) of a large_string or large_binary array."""
    n = len(column)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, budget: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Zero-copy runs of whole rows of about ``budget`` bytes each."""
    _, offsets = utf8(column)
    start, n = 0, len(column)
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + budget, side="right")) - 1
        stop = min(n, max(stop, start + 1))
        yield column.slice(start, stop - start)
        start = stop


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@lru_cache(maxsize=2)
def _powers_upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    forward = np.empty(n, np.uint64)
    backward = np.empty(n, np.uint64)
    forward[0] = backward[0] = 1
    forward[1:] = _BASE
    backward[1:] = _INVERSE
    return np.multiply.accumulate(forward), np.multiply.accumulate(backward)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers_upto(1 << max(20, int(n).bit_length()))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; equal bytes give equal hashes wherever they lie."""
    forward, backward = _powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * forward[: len(data)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * backward[starts] ^ (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and owning row of every word: a run of ASCII letters, digits and non-ASCII bytes, or of ``table``'s bytes."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = table[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every lower-cased word of a slice."""
    data, offsets = utf8(pc.utf8_lower(column))
    starts, ends, rows = words(data, offsets)
    return span_hashes(data, starts, ends), rows
