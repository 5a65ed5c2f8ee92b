"""Whole Arrow batches of texts to words and 64-bit hashes, in NumPy.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Word hashes are
polynomial hashes modulo 2**64 over UTF-8 bytes, taken from prefix sums of the
whole batch, then mixed; there is no loop over words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_MASK = (1 << 64) - 1
SLICE_BYTES = 1 << 20
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse for i < n, grown by doubling and kept."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            out = np.ones(size, np.uint64)
            done = 1
            while done < size:
                step = np.uint64(pow(b, done, 1 << 64))
                out[done : 2 * done] = out[:done] * step
                done *= 2
            _powers[k] = out
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@dataclass
class Texts:
    """``data``: the UTF-8 bytes of all texts; text i is data[offsets[i]:offsets[i+1]]."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        return counts_between(flags, self.offsets)


@dataclass
class Words:
    """Words of the texts in order; ``text`` is the index of each word's text and
    word j of text i is at first[i] + j."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray


def counts_between(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    """Null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return Texts(data, offsets - offsets[0])


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Parts of a batch whose texts have about ``limit`` bytes; a longer text comes alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = np.cumsum(sizes) // limit
    cuts = np.flatnonzero(np.diff(block)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        if b > a:
            yield batch.slice(a, b - a)


def lowered(texts: Texts) -> Texts:
    """With the capitals of ASCII and of Latin-1 (two UTF-8 bytes, the first 0xC3) made small."""
    data = texts.data.copy()
    data[(data >= 0x41) & (data <= 0x5A)] += 0x20
    second = np.zeros(len(data), bool)
    second[1:] = data[:-1] == 0xC3
    data[second & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 0x20
    return Texts(data, texts.offsets)


def words_of(texts: Texts) -> Words:
    data, offsets = texts.data, texts.offsets
    n = len(texts)
    if not len(data):
        empty = np.zeros(0, np.int64)
        return Words(empty, empty, empty, np.zeros(n + 1, np.int64))
    inside = ~IS_SPACE[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    lows, highs = offsets[:-1], offsets[1:]
    full = highs > lows
    opens[lows[full]] = inside[lows[full]]
    closes[highs[full] - 1] = inside[highs[full] - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.searchsorted(start, offsets)
    text = np.repeat(np.arange(n), np.diff(first))
    return Words(start, end, text, first)


class Hasher:
    """Hashes of any byte ranges of one batch."""

    def __init__(self, data: np.ndarray):
        power, self._inverse = _tables(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=self._sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._inverse[start])


def hash_strings(values: list[str]) -> np.ndarray:
    """The hashes that :class:`Hasher` gives these strings as words."""
    texts = texts_of(pa.array(values, pa.large_string()))
    return Hasher(texts.data).ranges(texts.offsets[:-1], texts.offsets[1:])


def grams(hashes: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words within a text, and the first word of each."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    factor = 1
    for k in range(size):
        factor = factor * 0xD6E8FEB86659FD93 & _MASK
        out += hashes[k : k + n] * np.uint64(factor)
    at = np.flatnonzero(text[:n] == text[size - 1 : size - 1 + n])
    return mix(out[at]), at
