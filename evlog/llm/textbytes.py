"""Vectorised work on UTF-8 text columns: slices of Arrow batches, word spans, hashes.

Everything here runs inside Arrow-fed Python workers and holds one slice of a
batch at a time. A slice is a run of whole documents of about ``SLICE_BYTES``;
one longer document is a slice of its own.
"""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_LIBC = ctypes.util.find_library("c")
_TRIM = getattr(ctypes.CDLL(_LIBC), "malloc_trim", None) if _LIBC else None

U = np.uint64
_P = U(0x9E3779B97F4A7C15)
_PINV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def release() -> None:
    """Give free memory back to the system: idle workers live on, beside the JVM and the next stage's workers."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, with the task's memory released at its end."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return tidied


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every input bit."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


BYTE64 = mix64(np.arange(1, 257, dtype=np.uint64) * U(0xA0761D6478BD642F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE64_LOWER = BYTE64[LOWER]

#: Words of letters, digits and every non-ASCII character.
ALNUM = np.ones(256, dtype=bool)
ALNUM[:128] = False
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
#: Words between ASCII white space.
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[[32, 9, 10, 11, 12, 13]] = False

_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n (kept for the worker's life up to a slice's size)."""
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        for key, base in (("p", _P), ("q", _PINV)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            np.multiply.accumulate(a, out=a)
            if size <= SLICE_BYTES + 1:
                _POWERS[key] = a
            elif key == "p":
                big = a
            else:
                return big, a
    return _POWERS["p"], _POWERS["q"]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if wide else np.int32
    offs = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of whole rows."""
    raw, offs = utf8(column)
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, j, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def word_spans(raw: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each document the index of its first word (n + 1 of them)."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    w = is_word[raw]
    cut = np.ones(len(raw) + 1, dtype=bool)  # a word can't reach over cut[i]: i - 1 and i are apart
    cut[1:-1] = ~(w[1:] & w[:-1])
    cut[offs] = True
    starts = np.flatnonzero(w & cut[:-1])
    ends = np.flatnonzero(w & cut[1:]) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE64_LOWER) -> np.ndarray:
    """A 64-bit hash, never 0, of the bytes of each span; with the default table A-Z counts as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, q = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(table[raw] * p[: len(raw)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * q[starts]
    return np.maximum(mix64(h + (ends - starts).astype(np.uint64) * U(0xE7037ED1A0B428DB)), U(1))


def fold(*hashes: np.ndarray) -> np.ndarray:
    """One hash, never 0, for a sequence of hashes; the order counts."""
    out = hashes[0].copy()
    for h in hashes[1:]:
        out = mix64(out * U(0x9FB21C651E98DF25) + h)
    return np.maximum(mix64(out), U(1))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the runs (start, length), one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(total)
