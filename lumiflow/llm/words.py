"""Words of whole texts, found and hashed with numpy over Arrow buffers.

A batch of texts is one byte array; words are pairs of offsets into it.  All work is
per batch and bounded by ``SLICE_BYTES`` (a single longer text makes a slice alone), so
memory follows the longest text and not the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _word_bytes(separators) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: [^\x20\x09-\x0D]+
SPACED = _word_bytes([0x20, *range(0x09, 0x0E)])
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ on lower-cased text (A-Z are folded before)
ALNUM = _word_bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


mix = _mix
_BASE = 0xD6E8FEB86659FD93
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_powers: list[np.ndarray] = []


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 4096)
        out = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(size, b, dtype=np.uint64)
            x[0] = 1
            out.append(np.cumprod(x, dtype=np.uint64))
        if size > 4 * SLICE_BYTES:  # a very long text: don't keep its tables
            return out[0], out[1]
        _powers[:] = out
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of some texts. Word i spans ``data[start[i]:end[i]]``; text k has words ``first[k]`` to ``first[k + 1]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word: a polynomial in the bytes, then mixed with the length."""
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        up, down = _powers_of(len(self.data))
        total = np.empty(len(self.data) + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[self.data] * up[: len(self.data)], out=total[1:])
        h = (total[self.end] - total[self.start]) * down[self.start]
        return _mix(h + (self.end - self.start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of a string array; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(texts) else np.zeros(0, dtype=np.uint8)
    return offsets - offsets[0], raw


def words_of(texts: pa.Array, table: np.ndarray, lower: bool = True) -> Words:
    offsets, raw = buffers(texts)
    n = len(raw)
    data = _LOWER[raw] if lower else raw
    inside = table[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    if n:
        ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begins[edges] = inside[edges]  # a text begins here, whatever the one before ended with
    ends[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(begins)
    return Words(data, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of at most ``limit`` text bytes (one row at least)."""
    i = batch.schema.get_field_index(column)
    offsets, _ = buffers(batch.column(i))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def shingle_hashes(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of every run of ``k`` words; a text of fewer words (not none) has its whole sequence as one."""
    h, n = w.hashes(), w.counts()
    place = np.arange(len(h)) - np.repeat(w.first[:-1], n)
    text = w.text_of_word()
    size = np.repeat(np.minimum(n, k), n)
    keep = place + size <= np.repeat(n, n)
    at = np.flatnonzero(keep)
    size = size[at]
    out = _mix(size.astype(np.uint64))
    for j in range(k):
        more = size > j
        out[more] = _mix(out[more] * np.uint64(0x9E3779B97F4A7C15) + h[at[more] + j])
    return out, text[at]


def texts_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
