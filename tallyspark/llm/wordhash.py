"""Vectorised word hashing over Arrow text columns (numpy inside Spark tasks).

Words are cut on the bytes of the Arrow buffers, a few MB of whole documents at a time, and hashed by
a polynomial over random byte values. Hashes depend on the bytes alone, not on process or batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of whole documents handled at once; a longer document is a batch of its own.
BATCH_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64), 7)


def fold_bytes(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    return _FOLD[data]


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.full(n, base & 0xFFFFFFFFFFFFFFFF, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Polynomial hashes of ranges of a sequence, by prefix sums modulo 2 ** 64 (the base is odd, so it has an inverse)."""

    def __init__(self, base: int = _BASE) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = powers(base, 1), powers(self.inverse, 1)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        n = len(values)
        if len(self.up) < n + 1:
            size = 1 << (n + 1).bit_length()
            self.up, self.down = powers(self.base, size), powers(self.inverse, size)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.up[:n], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.down[start]


_BYTES, _WORDS = Rolling(), Rolling(0xD6E8FEB86659FD93)


def batches(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of consecutive whole texts; null counts as empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2] if len(column) else None
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BATCH_BYTES, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


#: Anything but ASCII letters, digits and non-ASCII bytes: word gaps where punctuation does not count.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = False, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of every word, and per text the index of its first word (one more entry at the end)."""
    n = len(data)
    gap = np.ones(n + 1, bool)
    np.take(space, data, out=gap[:n])
    first = ~gap[:n]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(first & (np.concatenate(([True], gap[: n - 1])) | cut[:n])) if n else np.zeros(0, np.int64)
    ends = np.flatnonzero(first & (gap[1:] | cut[1:])) + 1 if n else starts
    hashes = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + BATCH_BYTES, "right")))
        a, b = starts[lo], ends[hi - 1]
        part = data[a:b]
        prefix = _BYTES.prefix(_BYTE[_FOLD[part] if fold else part])
        hashes[lo:hi] = _BYTES.ranges(prefix, starts[lo:hi] - a, ends[lo:hi] - a)
        lo = hi
    hashes = mix(hashes ^ (ends - starts).astype(np.uint64))
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each word on; the last n - 1 entries are not meant to be used."""
    if len(hashes) < n:
        return np.zeros(len(hashes), np.uint64)
    prefix = _WORDS.prefix(hashes)
    at = np.arange(len(hashes) - n + 1)
    return np.concatenate([mix(_WORDS.ranges(prefix, at, at + n), n), np.zeros(n - 1, np.uint64)])
