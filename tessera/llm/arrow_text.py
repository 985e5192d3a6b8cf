"""Word-level numpy views of Arrow text columns.

A batch of texts is one UTF-8 buffer with offsets, so words, lines and n-grams
of all its rows are found with a few array passes instead of a loop over rows.
Words are maximal runs of bytes other than space and 0x09-0x0D; those bytes
never occur inside a multi-byte UTF-8 sequence.

Words and n-grams are identified by 64-bit hashes. They depend on the bytes
alone (fixed constants), so every executor and every rerun agrees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are expanded into 64-bit arrays at a time; a longer row stands alone.
CHUNK_BYTES = 1 << 18
#: Rows whose results are held as one batch.
ROWS = 1024

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_GAPS = np.zeros(256, dtype=bool)
_GAPS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_TABLE = mix(np.arange(256, dtype=np.uint64) + np.uint64(1))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        steps = [np.full(size, b, dtype=np.uint64) for b in (_BASE, _INV)]
        for s in steps:
            s[0] = 1
            np.cumprod(s, out=s)
        if size > CHUNK_BYTES * 4:  # a single very long row: not kept
            return steps[0], steps[1]
        _POWERS[:] = steps
    return _POWERS[0], _POWERS[1]


@dataclass
class Words:
    """Words of consecutive texts; positions are bytes in ``data``."""

    data: np.ndarray
    bounds: np.ndarray  # text i is data[bounds[i]:bounds[i + 1]]
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # words of text i are first[i]:first[i + 1]

    @property
    def texts(self) -> int:
        return len(self.bounds) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts), self.counts())

    def prefix(self) -> np.ndarray:
        """Prefix sums of the polynomial hash, with a leading zero."""
        power, _ = _powers(len(self.data) + 1)
        out = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(_TABLE[self.data] * power[: len(self.data)], out=out[1:])
        return out

    def span_hash(self, start: np.ndarray, end: np.ndarray, prefix: np.ndarray | None = None) -> np.ndarray:
        prefix = self.prefix() if prefix is None else prefix
        _, inverse = _powers(len(self.data) + 1)
        return mix(((prefix[end] - prefix[start]) * inverse[start]) ^ mix((end - start).astype(np.uint64)))


def words_of(data: np.ndarray, bounds: np.ndarray) -> Words:
    n = len(data)
    flags = np.zeros(n + 2, dtype=bool)
    np.logical_not(_GAPS[data], out=flags[1 : n + 1])
    inside = flags[1 : n + 1]
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    start = np.flatnonzero(inside & (~flags[:n] | edge[:n]))
    end = np.flatnonzero(inside & (~flags[2:] | edge[1 : n + 1])) + 1
    return Words(data, bounds, start, end, np.searchsorted(start, bounds))


def ngram_hash(word_hash: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, by the index of its first word (runs may cross texts)."""
    m = len(word_hash) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += word_hash[k : k + m]
    return mix(out)


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that what is made of a batch stays small."""
    for batch in batches:
        for k in range(0, len(batch), rows):
            yield batch.slice(k, rows)


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column as string, null as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array."""
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]] if n else data[:0], offsets - offsets[0] if n else np.zeros(1, dtype=np.int64)


def parts(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of row ranges of about ``limit`` bytes; a long row stands alone."""
    data, offsets = raw(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def code_points(data: np.ndarray) -> np.ndarray:
    """True at the first byte of each code point."""
    return (data & 0xC0) != 0x80


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]]."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
