"""Vectorised scans over the UTF-8 buffers of Arrow string columns.

Word hashes are polynomials modulo 2**64 over random byte values, finished by a mixing step; they depend on a word's
bytes alone, so they agree between batches, tasks and tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text hashed at a time; bounds the 64-bit work arrays.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTES = _rng.integers(0, 2**64, 256, dtype=U64)
_LOWERED = _BYTES.copy()
_LOWERED[65:91] = _BYTES[97:123]
_GRAM = _rng.integers(0, 2**64, 64, dtype=U64) | U64(1)

#: Space and the five controls from tab to carriage return.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n-1 and their inverses modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK + 4096)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finisher of 64 bits."""
    x = x + U64((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its n + 1 offsets; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the n + 1 places of the texts' first words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~separators[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    at = offsets[:-1][offsets[:-1] < n]
    first[at] |= word[at]
    last = word.copy()
    last[:-1] &= ~word[1:]
    at = offsets[1:][offsets[1:] > 0] - 1
    last[at] |= word[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each span; lower takes A-Z as a-z."""
    values = _LOWERED if lower else _BYTES
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
        a, b = starts[i], ends[j - 1]
        up, down = powers(int(b - a) + 1)
        sums = np.empty(b - a + 1, U64)
        sums[0] = 0
        np.cumsum(values[data[a:b]] * up[:-1], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64))
        i = j
    return out


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k word hashes, over text boundaries too: the caller takes those within a text."""
    n = max(0, len(words) - k + 1)
    out = np.full(n, k, U64)
    for j in range(k):
        out += words[j : j + n] * _GRAM[j % 64] if k <= 64 else mix(words[j : j + n], j)
    return mix(out)


def pieces(column: pa.Array, most: int = 4 * CHUNK):
    """Slices of a column with at most so many bytes each, or one text: (first row, slice)."""
    _, offsets = buffers(column)
    i, n = 0, len(column)
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1))
        yield i, column.slice(i, j - i)
        i = j
