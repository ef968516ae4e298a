"""Vectorised text kernels shared by the operators that hash words.

They work on the UTF-8 buffer of an Arrow string column, so that no Python
object is made per word. Texts are taken in runs of about ``CHUNK_BYTES``; a
longer single text is a run of its own, whole.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_RNG = np.random.default_rng(20240521)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_ODD = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Everything but ASCII letters and digits and the bytes of other letters.
NON_WORD = np.ones(256, bool)
NON_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, cache: list = []) -> np.ndarray:  # noqa: B006  grows to the longest word seen
    if not cache or len(cache[0]) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        out = np.full(size, _BASE, np.uint64)
        out[0] = 1
        cache[:] = [np.multiply.accumulate(out)]
    return cache[0]


def runs(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``first, last, bytes, bounds`` for runs of rows; nulls count as empty texts.

    ``bounds`` has one more entry than there are rows and starts at 0.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    if len(texts) == 0:
        return
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64, len(texts) + 1, texts.offset * 8)
    buffer = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, len(texts))
        yield first, last, buffer[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def ascii_lower(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def words(data: np.ndarray, bounds: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``starts, ends, per_text``: byte ranges of words and where each text's words begin in that list."""
    inside = ~apart[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; ranges must be in order and apart."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    at = np.cumsum(size) - size
    rel = np.arange(int(size.sum())) - np.repeat(at, size)
    values = _BYTE[data[np.repeat(starts, size) + rel]] * _powers(int(size.max()))[rel]
    return mix(np.add.reduceat(values, at) + size.astype(np.uint64) * _STEP)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` successive word hashes."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for j in range(n):
        total += hashes[j : len(hashes) - n + 1 + j] * _ODD[j]
    return mix(total)


def shingle_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct ``n``-word shingles of one text; a shorter text is one shingle, an empty one has none."""
    if len(hashes) == 0:
        return np.zeros(0, np.uint64)
    if len(hashes) >= n:
        return np.unique(windows(hashes, n))
    return mix(windows(hashes, len(hashes)) + np.full(1, len(hashes), np.uint64) * _STEP)


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The shingle set of each text: A-Z lower-cased, words between ASCII white space."""
    for first, last, data, bounds in runs(texts):
        data = ascii_lower(data)
        starts, ends, per_text = words(data, bounds, WHITE)
        hashes = word_hashes(data, starts, ends)
        for i in range(last - first):
            yield shingle_set(hashes[per_text[i] : per_text[i + 1]], n)


def give_back() -> None:
    """Hand freed memory back to the system, where the C library can; workers outlive their tasks."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
