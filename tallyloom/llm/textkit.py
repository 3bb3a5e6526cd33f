"""Vectorised text primitives on Arrow string buffers.

A batch of texts is one run of UTF-8 bytes. Words, lines and their 64-bit
hashes come from array operations over that run, a few megabytes at a time, so
no Python object is made per word and memory does not follow the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
SALT = tuple(U64(x | 1) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every output bit depends on every input bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_powers: list[np.ndarray] = []


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, kept between chunks."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 4096)
        with np.errstate(over="ignore"):
            _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size - 1, x, np.uint64))]) for x in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the rows' offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), off.astype(np.int64)


def runs(data: np.ndarray, off: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets): whole texts, about `limit` bytes at a time."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def text_chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """runs() of a string or binary column."""
    return runs(*buffers(column), limit)


class Hasher:
    """Hashes of any spans of one run of bytes; equal spans have equal hashes."""

    def __init__(self, data: np.ndarray):
        power, self.back = _powers_to(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE[data] * power[: len(data)], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64) * SALT[0])


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the texts in one run of bytes.

    starts, ends: byte positions; first: position of each text's first word, one
    more entry at the end. Another table of separators gives other words.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, separators: np.ndarray = SPACE):
        self.data, self.off = data, off
        inside = ~separators[data]
        self.inside = inside
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        full = off[:-1] < off[1:]
        at = off[:-1][full]
        begin[at] = inside[at]
        at = off[1:][full] - 1
        end[at] = inside[at]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, off)
        self.counts = np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Order-dependent hashes of n hashed words from each position on; the last n - 1 are undefined."""
    out = np.zeros(len(words), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            part = words[k:] * U64(pow(int(SALT[1]), k + 1, 1 << 64))
            out[: len(part)] += part
        return mix(out)


def per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of a flag over each text's positions."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def keyed(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes that differ between texts, to sort several texts at once."""
    with np.errstate(over="ignore"):
        return mix(h + (owner.astype(np.uint64) + U64(1)) * SALT[2])


def lower(data: np.ndarray) -> np.ndarray:
    return LOWER[data]


def to_signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def rows_and_texts(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of about CHUNK bytes of text each."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        for lo, hi, data, off in text_chunks(column):
            yield batch.slice(lo, hi - lo), data, off
