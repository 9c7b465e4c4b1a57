"""Words and word-sequence hashes of Arrow string columns, computed with numpy.

A word is ``[^\\x20\\x09-\\x0D]+`` over the whole text.  The six separators are
ASCII, so words can be cut on the UTF-8 bytes that Arrow already holds: no
Python string is made.  Work is done on slices of a few megabytes, whatever the
size of a batch; only a single text longer than that makes a larger slice.

Hashes are 64-bit.  Every use that removes or links rows compares at least two
whole sequences by them, so a wrong decision needs a collision between two
given sequences (about 1 in 10**19).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE = np.random.default_rng(0xC0FFEE).integers(0, 2**64, 256, dtype=U)
_STEP = 0x9E3779B97F4A7C15
SLICE_BYTES = 2_000_000

_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base modulo 2**64, and of its inverse."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_STEP, pow(_STEP, -1, 2**64))):
            out = np.full(n + n // 4, base, U)
            out[0] = 1
            _powers[i] = np.multiply.accumulate(out)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def running(values: np.ndarray) -> np.ndarray:
    """Prefix sums of ``values[i] * base**i``, from which any range's hash follows."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges ``[start, end)``, alike wherever a range lies."""
    raw = (sums[end] - sums[start]) * powers(len(sums))[1][start]
    return mix(raw + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


@dataclass
class Words:
    """The words of some texts: byte ranges in ``buf``, and each text's first word in ``at``."""

    buf: np.ndarray  # bytes, lower-cased when asked for
    off: np.ndarray  # text i has the bytes off[i] to off[i + 1]
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def text_of(self) -> np.ndarray:
        """The text to which each word belongs."""
        return np.repeat(np.arange(len(self.at) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return between(running(_BYTE[self.buf]), self.start, self.end)

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def cut(texts: pa.Array, fold: bool = False) -> Words:
    """The words of an Arrow string column; null counts as empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    n = len(texts)
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint8), np.zeros(1, np.int64), none, none, np.zeros(1, np.int64))
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, width)[texts.offset : texts.offset + n + 1].astype(np.int64)
    low, high = int(off[0]), int(off[-1])
    buf = np.frombuffer(data, np.uint8)[low:high] if data is not None and high > low else np.zeros(0, np.uint8)
    off -= low
    inside = ~_SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    first = inside & edge[:-1]
    first[1:] |= inside[1:] & ~inside[:-1]
    last = inside & edge[1:]
    last[:-1] |= inside[:-1] & ~inside[1:]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return Words(_FOLD[buf] if fold else buf, off, start, end, np.searchsorted(start, off))


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each, together all rows."""
    n = len(texts)
    if n == 0:
        return
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    off = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + n + 1].astype(np.int64)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def as_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def gram_hashes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words that lie in one text, and the first word of each."""
    n = len(words.start)
    if n < k:
        return np.zeros(0, U), np.zeros(0, np.int64)
    last = np.repeat(words.at[1:], words.counts)  # the end of each word's text
    first = np.flatnonzero(np.arange(n) + k <= last)
    return between(running(words.hashes()), first, first + k), first


def shingle_sets(words: Words, k: int = 5) -> Iterator[np.ndarray]:
    """For each text its sorted distinct k-word shingles.

    A text of fewer words has one, its whole sequence; one without words has none.
    """
    sums = running(words.hashes())
    for a, b in zip(words.at[:-1], words.at[1:], strict=True):
        n = b - a
        if n == 0:
            yield np.zeros(0, U)
        elif n <= k:
            yield between(sums, np.array([a]), np.array([b]))
        else:
            first = np.arange(a, b - k + 1)
            yield np.unique(between(sums, first, first + k))
