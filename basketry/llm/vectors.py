"""Words and shingles of many texts at once: numpy over the bytes of an Arrow string column.

Hashes are prefix sums of a polynomial modulo 2**64, so the hash of any byte range is one subtraction; a final mix makes
all bits usable. They stand for words and shingles in candidate searches; where a result depends on equality it is
checked on the texts themselves or on 128-bit digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 21
U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
STEP = U(0xC2B2AE3D27D4EB4F)
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
SOLID = ~BLANK


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


CODES = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    known = _powers.get(str(base))
    if known is None or len(known) < n:
        size = max(n, CHUNK_BYTES + 1)
        known = np.full(size, base, np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if size <= 4 * CHUNK_BYTES:  # tables for one very long text are not kept
            _powers[str(base)] = known
    return known[:n]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its values; nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of values with at most ``limit`` bytes together, or one value that is longer."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """n + 1 prefix sums of codes times powers of the base."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * _power(BASE, len(codes)), out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [start, end); equal contents give equal hashes wherever they stand."""
    return mix((prefix[end] - prefix[start]) * _power(INVERSE, len(prefix))[start])


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all runs of non-blank bytes, and the n + 1 word numbers at which the values begin."""
    n = len(data)
    solid = SOLID[data]
    begin, end = solid.copy(), np.zeros(n + 1, bool)
    begin[1:] &= ~solid[:-1]
    end[1:] = solid
    end[1:n] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    begin[inner] = solid[inner]
    end[inner] |= solid[inner - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end), np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and the word numbers at which the values begin."""
    starts, ends, first = word_spans(data, offsets)
    return range_hashes(prefix_hashes(CODES[data]), starts, ends), first


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a value, and where the values' runs begin.

    A value of fewer than k words, but one at least, has one run of all its words.
    """
    counts = np.diff(first)
    runs = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate(([0], np.cumsum(runs)))
    owner = np.repeat(np.arange(len(counts)), runs)
    at = np.arange(bounds[-1]) - bounds[owner] + first[owner]
    out = np.zeros(len(at), np.uint64)
    padded = np.concatenate((words, np.zeros(k, np.uint64)))
    for j in range(k):
        out = out * STEP + np.where(at + j < first[owner + 1], padded[at + j], U(0))
    return mix(out), bounds
