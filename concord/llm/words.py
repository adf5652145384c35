"""Words of many texts at once, as numpy arrays over Arrow's own buffers.

A word is a longest run of bytes outside 0x20 and 0x09-0x0D.  Those bytes never occur inside a multi-byte UTF-8
character, so working on bytes and on characters gives the same words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once, so that temporary arrays stay near the processor.  A longer text is handled alone.
SLICE_BYTES = 500_000
#: Rows handled at once: a row number fits into 16 bits.
SLICE_ROWS = 60_000

_STEP, _LENGTH_STEP = 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15
#: Keeps the lowest k bytes of 8.
_low = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(step: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """step**i and its inverse modulo 2**64, for i below n at least."""
    known = _powers.get(step)
    if known is None or len(known[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for base in (step, pow(step, -1, 1 << 64)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            out.append(np.cumprod(a))
        known = _powers[step] = (out[0], out[1])
    return known[0][:n], known[1][:n]


def mixed(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spreads every bit over all 64 (two rounds of multiply and shift)."""
    h = h ^ np.uint64((seed * 0xA24BAED4963EE407 + 0x51ED270B) % 2**64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each span; equal spans have equal hashes wherever they stand."""
    up, down = powers(_STEP, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """Words of some rows: byte places in ``data``, the row of each, and each row's first word (one more at the end)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64 bits for each word, taken eight bytes at a time."""
        n = len(self.data)
        padded = np.zeros(n + 8, np.uint8)
        padded[:n] = self.data
        eight = np.ndarray((n + 1,), "<u8", padded.data, 0, (1,))  # the eight bytes from each place on
        size = self.ends - self.starts
        h = mixed(size.astype(np.uint64) * np.uint64(_LENGTH_STEP) ^ (eight[self.starts] & _low[np.minimum(size, 8)]))
        done, longer = 8, np.flatnonzero(size > 8)
        while len(longer):
            more = eight[self.starts[longer] + done] & _low[np.minimum(size[longer] - done, 8)]
            h[longer] = mixed(h[longer] * np.uint64(_STEP) ^ more)
            done += 8
            longer = longer[size[longer] > done]
        return h

    def window_starts(self, size: int) -> np.ndarray:
        """Numbers of the words at which a window of ``size`` words of one row begins."""
        n = len(self.starts)
        if n < size:
            return np.zeros(0, np.int64)
        at = np.arange(n - size + 1)
        return at[self.row[at] == self.row[at + size - 1]]

    def window_hashes(self, hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        return span_hashes(hashes, starts, starts + size)

    def kept_text(self, row: int, drop: np.ndarray | None = None) -> bytes:
        """The row's words (without the dropped ones) joined by one space."""
        a, b = self.first[row], self.first[row + 1]
        raw = self.data.tobytes() if drop is None else self.data
        places = zip(self.starts[a:b].tolist(), self.ends[a:b].tolist(), strict=True)
        if drop is None:
            return b" ".join(raw[s:e] for s, e in places)
        return b" ".join(raw[s:e].tobytes() for (s, e), gone in zip(places, drop.tolist(), strict=True) if not gone)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and where each row begins (one more at the end); null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str = "text", rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about SLICE_BYTES bytes of text and at most ``rows`` rows."""
    n = batch.num_rows
    if not n:
        return
    _, at = text_bytes(batch.column(column))
    begin = 0
    while begin < n:
        end = int(np.searchsorted(at, at[begin] + SLICE_BYTES, "right")) - 1
        end = min(max(end, begin + 1), begin + rows, n)
        yield batch.slice(begin, end - begin)
        begin = end


def words_of(column: pa.Array, lower: bool = False) -> Words:
    data, at = text_bytes(column)
    if lower:
        data = _lower[data]
    ink = ~_space[data]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    filled = at[1:] > at[:-1]
    edges = at[:-1][filled]
    first[edges] = ink[edges]
    edges = at[1:][filled] - 1
    last[edges] = ink[edges]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    bounds = np.searchsorted(starts, at)
    return Words(data, starts, ends, np.repeat(np.arange(len(at) - 1), np.diff(bounds)), bounds)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, a place of each, and for every place the number of its value."""
    order = np.argsort(values)
    ranked = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    number = np.empty(len(values), np.int64)
    number[order] = np.cumsum(new) - 1
    return ranked[new], order[new], number


def long_ints(values: np.ndarray) -> np.ndarray:
    """64 bits as Spark's signed long."""
    return values.astype(np.uint64).view(np.int64)
