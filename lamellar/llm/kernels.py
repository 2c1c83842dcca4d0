"""Vectorised text kernels shared by the language-data operators.

They work on Arrow string buffers inside Spark tasks: one NumPy pass over a
block of whole documents, a few megabytes at a time, so that memory is bounded
by the block (or by the longest single document).  Every function treats a null
text as an empty one.
"""

from __future__ import annotations

import random
import secrets
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Text bytes handled at once inside a task.
BLOCK_BYTES = 4 << 20

#: Words are maximal runs of bytes other than these.
WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_IS_WHITE = np.zeros(256, dtype=bool)
_IS_WHITE[list(WHITE)] = True


def mix(z: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


#: Fixed value: the Mersenne prime of all polynomial hashes.
PRIME = (1 << 61) - 1
_P, _31, _30, _61 = np.uint64(PRIME), np.uint64(31), np.uint64(30), np.uint64(61)
_LOW31, _LOW30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
#: Bytes of a slice whose exponents are kept in tables; longer slices are hashed piece by piece.
SEGMENT = 1 << 20
#: Bytes hashed together.
CACHED_BYTES = 1 << 15


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _61)
    return x - _P * (x >= _P)


def times(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """a * b modulo PRIME, for numbers below it."""
    a1, a0, b1, b0 = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    mid = a1 * b0 + a0 * b1
    return _reduced(((a1 * b1) << np.uint64(1)) + (mid >> _30) + ((mid & _LOW30) << _31) + a0 * b0)


class Rabin:
    """Rabin-Karp hashes: polynomials modulo the prime 2**61 - 1 at a base that the seed draws.

    Two given sequences of n items collide for at most n of the 2**61 bases.
    """

    def __init__(self, seed: int):
        self.base = random.Random(seed).randrange(1 << 32, PRIME)
        self._high = self._low = np.zeros(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self._low) < n:
            n, out = max(n, 4096), np.ones(1, np.uint64)
            while len(out) < n:
                out = np.concatenate([out, times(out, np.uint64(pow(self.base, len(out), PRIME)))])
            self._high, self._low = out >> _31, out & _LOW31

    def slices(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each slice of bytes."""
        size = end - start
        longest = int(size.max(initial=0))
        if longest > SEGMENT:
            out = np.zeros(len(start), np.uint64)
            short = size <= SEGMENT
            out[short] = self.slices(raw, start[short], end[short])
            for i in np.flatnonzero(~short).tolist():
                cut = np.arange(start[i], end[i], SEGMENT)
                parts = self.slices(raw, cut, np.minimum(cut + SEGMENT, end[i])).tolist()
                out[i] = sum(x * pow(self.base, SEGMENT * k, PRIME) for k, x in enumerate(parts)) % PRIME
            return out
        self._grow(longest)
        out, upto, low = np.zeros(len(start), np.uint64), np.concatenate([[0], np.cumsum(size)]), 0
        while low < len(start):  # as many slices at once as a core's cache holds
            high = max(low + 1, int(np.searchsorted(upto, upto[low] + CACHED_BYTES, side="right")) - 1)
            out[low:high] = self._sums(raw, start[low:high], size[low:high], upto[low : high + 1] - upto[low])
            low = high
        return out

    def _sums(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray, upto: np.ndarray) -> np.ndarray:
        inner = np.arange(upto[-1])
        place = inner - np.repeat(upto[:-1], size)  # in its slice
        value = raw[place + np.repeat(start, size)].astype(np.uint64) + np.uint64(1)
        total = lambda table: np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * table[place])])  # noqa: E731  differences of up to 2**60 are exact
        high, low = total(self._high), total(self._low)
        high, low = high[upto[1:]] - high[upto[:-1]], low[upto[1:]] - low[upto[:-1]]
        return _reduced(times(_reduced(high), np.uint64(1 << 31)) + _reduced(low))

    def windows(self, values: np.ndarray, size: int) -> np.ndarray:
        """Hash of every window of so many consecutive values (below PRIME)."""
        step = CACHED_BYTES // 8
        return np.concatenate([self._doubled(values[i : i + step + size - 1], size) for i in range(0, len(values) - size + 1, step)])

    def _doubled(self, values: np.ndarray, size: int) -> np.ndarray:
        """By doubling: the hash of 2k values is that of k and of k."""
        out, done, power, span = None, 0, values, 1
        n = len(values) - size + 1
        while True:
            if size & span:
                own = power[done : done + n]
                out = own if out is None else _reduced(out + times(own, np.uint64(pow(self.base, done, PRIME))))
                done += span
            if done == size:
                return out
            power = _reduced(power[:-span] + times(power[span:], np.uint64(pow(self.base, span, PRIME))))
            span *= 2


@lru_cache(maxsize=16)
def rabin(seed: int) -> Rabin:
    return Rabin(seed)


def seed() -> int:
    """A new seed: an operator draws one on the driver and its tasks share it."""
    return secrets.randbits(63)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and where each row starts in them (n + 1 offsets)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows with about limit bytes."""
    raw, at = buffers(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        yield row, end, raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start, byte end and row of each word."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_IS_WHITE[raw]
    cut = np.zeros(len(raw) + 1, dtype=bool)
    cut[at[:-1]] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(at, start, side="right") - 1


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes stay."""
    return np.where((raw >= 65) & (raw <= 90), raw | 32, raw).astype(np.uint8)


def slice_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """Hashes, below PRIME, of byte slices."""
    return rabin(seed).slices(raw, start, end)


def window_hashes(word_hash: np.ndarray, row: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Start word and hash, below PRIME, of every window of so many consecutive words of one row."""
    n = len(word_hash)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(row[: n - size + 1] == row[size - 1 :])
    return first, rabin(seed).windows(word_hash, size)[first]


def counts_by_row(row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, minlength=n).astype(np.int64)
