"""Vectorised text kernels shared by the operators that run in Arrow batches.

Every kernel works on the raw UTF-8 bytes of a slice of rows: one ``uint8``
array and the rows' byte offsets.  Nulls and empty texts are rows of no bytes.
A slice ends once it holds ``limit`` bytes, so memory is bounded by that limit
or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are processed at once.
SLICE_BYTES = 1 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_GRAM_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """The powers of an odd number and of its inverse; those of a slice are kept, more are made for a long text alone."""

    def __init__(self, base: np.uint64, inverse: np.uint64):
        self.base, self.inverse = base, inverse
        self.up = self.down = np.ones(1, np.uint64)

    @staticmethod
    def _of(base: np.uint64, n: int) -> np.ndarray:
        out = np.full(n, base)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64, out=out)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > SLICE_BYTES + 1:
            return self._of(self.base, n), self._of(self.inverse, n)
        if len(self.up) < n:
            size = min(SLICE_BYTES + 1, max(n, 1 << 16, 2 * len(self.up)))
            self.up, self.down = self._of(self.base, size), self._of(self.inverse, size)
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _GRAM_POWERS = _Powers(_MULTIPLIER, _INVERSE), _Powers(_GRAM, _GRAM_INVERSE)


@dataclass
class TextSlice:
    """Rows ``first`` to ``first + rows`` of a batch."""

    first: int
    rows: int
    data: np.ndarray
    offsets: np.ndarray


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[TextSlice]:
    """Cut a string column into slices of about ``limit`` bytes; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, raw, body = column.buffers()
    offsets = np.frombuffer(raw, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(max(end, first + 1), n)
        yield TextSlice(first, end - first, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first])
        first = end


def table(members: bytes) -> np.ndarray:
    """A truth table over byte values."""
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


#: What separates words: the bytes 0x20 and 0x09 to 0x0D, which no longer UTF-8 sequence contains.
WHITE = table(b" \t\n\x0b\x0c\r")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def row_of(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The row that each byte position belongs to."""
    return np.searchsorted(offsets, at, "right") - 1


def segments(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside`` within each row."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = np.empty(len(inside), bool), np.empty(len(inside), bool)
    first[0] = last[-1] = True
    np.logical_not(inside[:-1], out=first[1:])
    np.logical_not(inside[1:], out=last[:-1])
    filled = offsets[1:] > offsets[:-1]
    first[offsets[:-1][filled]] = True
    last[offsets[1:][filled] - 1] = True
    return np.flatnonzero(inside & first), np.flatnonzero(inside & last) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from one prefix sum."""
    up, down = _BYTE_POWERS.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """Words of a slice: byte spans, the row of each, hashes, and each row's first word (one more at the end)."""

    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows of ``n`` words that lie within one row, and the index of each one's first word."""
        count = len(self.hashes) - n + 1
        if count <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        up, down = _GRAM_POWERS.upto(len(self.hashes) + 1)
        total = np.zeros(len(self.hashes) + 1, np.uint64)
        np.cumsum(self.hashes * up[: len(self.hashes)], out=total[1:])
        at = np.flatnonzero(self.row[:count] == self.row[n - 1 :])
        return mix((total[at + n] - total[at]) * down[at] + np.uint64(n)), at


def words(part: TextSlice, separators: np.ndarray = WHITE, mapping: np.ndarray | None = None) -> Words:
    """Split the rows of a slice at separator bytes; ``mapping`` replaces bytes before they are hashed."""
    starts, ends = segments(~separators[part.data], part.offsets)
    row = row_of(part.offsets, starts)
    data = part.data if mapping is None else mapping[part.data]
    return Words(starts, ends, row, span_hashes(data, starts, ends), np.searchsorted(row, np.arange(part.rows + 1)))


def per_row(counts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum ``counts`` between consecutive bounds."""
    total = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of many spans, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)
