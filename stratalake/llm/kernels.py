"""Vectorised text kernels over Arrow string buffers.

Words are runs of bytes other than ``[\x20\x09-\x0D]``; this needs no decoding, so every kernel works on the UTF-8 bytes.
Batches are cut into pieces of about 256 KB, so memory doesn't depend on the batch size.  A single longer text is one piece.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 18

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _random_words(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, n, dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (xor-shift and multiply rounds)."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


CACHED = 1 << 14  # numbers handled at once, so that what lies between steps stays in the cache
_P61, _LOW31, _LOW30 = U64((1 << 61) - 1), U64((1 << 31) - 1), U64((1 << 30) - 1)


def _reduce61(x: np.ndarray) -> np.ndarray:
    x = (x & _P61) + (x >> U64(61))
    return np.minimum(x, x - _P61)  # the difference wraps where x is smaller


def minus61(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differences modulo 2^61 - 1 of residues."""
    x = a + (_P61 - b)
    return np.minimum(x, x - _P61)


def times61(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """Products modulo 2^61 - 1 of residues, from halves of 31 bits."""
    out = np.empty(len(a), U64)
    for i in range(0, len(a), CACHED):
        x, y = a[i : i + CACHED], b[i : i + CACHED] if isinstance(b, np.ndarray) else b
        x1, x0, y1, y0 = x >> U64(31), x & _LOW31, y >> U64(31), y & _LOW31
        mid = x0 * y1 + x1 * y0
        out[i : i + CACHED] = _reduce61(((x1 * y1) << U64(1)) + (mid >> U64(30)) + ((mid & _LOW30) << U64(31)) + x0 * y0)
    return out


class Rolling:
    """Polynomial hashes of byte ranges modulo the prime 2^61 - 1 over random byte codes, from prefix sums.

    The field makes two different ranges of n bytes agree for at most n of the 2^61 bases, whatever the texts; modulo a
    power of two there are texts that agree for every base.
    """

    prime = (1 << 61) - 1

    def __init__(self, seed: int, fold_case: bool = False):
        self.code = U64(1) + _random_words(seed, 256) % U64(self.prime - 1)
        if fold_case:
            self.code = self.code[LOWER]
        self.base = int(_random_words(seed + 1, 1)[0]) % (self.prime - 2) + 2
        self.back = pow(self.base, -1, self.prime)
        self._up = self._down = np.ones(1, U64)

    def _powers(self, n: int) -> None:
        while len(self._up) < n:
            k = len(self._up)
            self._up = np.concatenate([self._up, times61(self._up, U64(pow(self.base, k, self.prime)))])
            self._down = np.concatenate([self._down, times61(self._down, U64(pow(self.back, k, self.prime)))])

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        out = np.zeros(len(data) + 1, U64)
        for i in range(0, len(data), CACHED):
            x = times61(self.code[data[i : i + CACHED]], self._up[i : i + CACHED][: len(data) - i])
            low = np.cumsum(x & _LOW31)  # both sums are exact
            high = np.cumsum(x >> U64(31))
            low += (high >> U64(30)) + ((high & _LOW30) << U64(31)) + out[i]
            out[i + 1 : i + 1 + len(x)] = _reduce61(low)
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of ``data[start:end]``, the length mixed in."""
        x = times61(minus61(prefix[end], prefix[start]), self._down[start])
        return mix(x + (end - start).astype(U64) * U64(0x9E3779B97F4A7C15))

    def grams(self, prefix: np.ndarray, n: int) -> np.ndarray:
        """Hashes of all stretches of ``n`` bytes."""
        many = len(prefix) - n
        return mix(times61(minus61(prefix[n:], prefix[:many]), self._down[:many]))


class PrimeRolling:
    """Polynomial hashes of byte ranges modulo the prime 2^31 - 1; shares neither codes nor field with ``Rolling``."""

    prime = (1 << 31) - 1

    def __init__(self, seed: int):
        self.code = U64(1) + _random_words(seed, 256) % U64(self.prime - 1)
        self.base = int(_random_words(seed + 1, 1)[0]) % (self.prime - 2) + 2
        self.back = pow(self.base, -1, self.prime)
        self._up = self._down = np.ones(1, U64)

    def _powers(self, n: int) -> None:
        m = U64(self.prime)
        while len(self._up) < n:
            k = len(self._up)
            self._up = np.concatenate([self._up, self._up * U64(pow(self.base, k, self.prime)) % m])
            self._down = np.concatenate([self._down, self._down * U64(pow(self.back, k, self.prime)) % m])

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Sums of residues below 2^31, so they are exact up to 2^33 bytes."""
        self._powers(len(data) + 1)
        out = np.zeros(len(data) + 1, U64)
        np.cumsum(self.code[data] * self._up[: len(data)] % U64(self.prime), out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of ``data[start:end]``."""
        m = U64(self.prime)
        return (prefix[end] - prefix[start]) % m * self._down[start] % m


class Words:
    """The words of a piece of a batch: byte bounds, and bounds of each document's words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        space = SPACE[data]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        word = ~space
        begin = word.copy()
        begin[1:] &= space[:-1] | first[1:n]
        stop = word
        stop[:-1] &= space[1:] | first[1:n]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.bounds = np.searchsorted(self.start, offsets)  # of each document's words

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def windows(hashes: np.ndarray, bounds: np.ndarray, n: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of every run of ``n`` words within a document."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    factor = _random_words(7_001 + salt, n) | U64(1)
    x = np.zeros(m, U64)
    for k in range(n):
        x += hashes[k : k + m] * factor[k]
    at = window_starts(len(hashes), bounds, n)
    return mix(x[at]), at


def window_starts(words: int, bounds: np.ndarray, n: int) -> np.ndarray:
    """Indices of the first words of every run of ``n`` words within a document."""
    m = max(0, words - n + 1)
    last = np.repeat(bounds[1:], np.diff(bounds))[:m]  # end of the document of each word
    return np.flatnonzero(np.arange(m) + n <= last)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, text: str, most: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) in pieces of about ``most`` bytes of text."""
    tokens = sys.modules.get(f"{__package__}.tokens")
    if tokens is not None and tokens._OPEN:  # this worker process has tokenised before
        tokens.forget()
    at = batch.schema.get_field_index(text)
    data, offsets = text_buffers(batch.column(at))
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def binaries(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
