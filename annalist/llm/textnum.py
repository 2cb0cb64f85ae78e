"""Vectorised word segmentation and rolling hashes over Arrow text batches.

All Python-side operators share these kernels.  They work on the UTF-8 bytes of
many documents at once, so the per-row cost is numpy's and memory is bounded by
``CHUNK_BYTES`` (one document longer than that is a chunk of its own).

Hashes are 64-bit polynomials modulo 2**64 over random byte images, finished
with an avalanche step; two different words or windows share one with a chance
of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE_IMAGE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_P = int(_rng.integers(1, 2**62)) * 2 + 1
_Q = int(_rng.integers(1, 2**62)) * 2 + 1
_MASK = (1 << 64) - 1

# A-Z to a-z, everything else unchanged
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IDENTITY = np.arange(256, dtype=np.uint8)

# words are runs of bytes that are no ASCII white space
SPACE_SEP = np.zeros(256, dtype=bool)
SPACE_SEP[[0x20, *range(0x09, 0x0E)]] = True
# words are runs of digits, lower-case letters and non-ASCII bytes
ALNUM_SEP = np.zeros(256, dtype=bool)
ALNUM_SEP[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    filled = 1
    while filled < n:
        step = U(pow(base, filled, 1 << 64))
        take = min(filled, n - filled)
        out[filled : filled + take] = out[:take] * step
        filled += take
    return out


class _PowerTable:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << int(n - 1).bit_length()
            self.up, self.down = _powers(self.base, size), _powers(self.inverse, size)
        return self.up, self.down


_WORD_POWERS, _WINDOW_POWERS = _PowerTable(_P), _PowerTable(_Q)


def mix64(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit integers (a bijection)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


class Words:
    """Words of a chunk of documents.

    ``start``/``end`` are byte positions in ``data``, ``first`` gives each
    document's range of words (length: documents + 1), ``doc`` the document of
    each word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = np.empty(n + 1, dtype=bool)
        np.logical_not(separators[data], out=inside[:n])
        inside[n] = False
        before = np.empty(n + 1, dtype=bool)
        before[0] = False
        before[1:] = inside[:n]
        cuts = offsets[1:-1]
        before_start = before.copy()
        before_start[cuts] = False  # a word never spans two documents
        after_end = inside.copy()
        after_end[cuts] = False
        self.start = np.flatnonzero(inside & ~before_start)
        self.end = np.flatnonzero(before & ~after_end)
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        n = len(self.data)
        up, down = _WORD_POWERS.get(n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE_IMAGE[self.data] * up[:n], out=total[1:])
        h = (total[self.end] - total[self.start]) * down[self.start]
        return mix64(h + (self.end - self.start).astype(np.uint64))


def window_hashes(word_hash: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hash of each k consecutive entries (also across documents: see ``inside``)."""
    n = len(word_hash)
    if n < k:
        return np.empty(0, dtype=np.uint64)
    up, down = _WINDOW_POWERS.get(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(word_hash * up[:n], out=total[1:])
    return mix64((total[k:] - total[:-k]) * down[: n - k + 1])


def inside(first: np.ndarray, k: int) -> np.ndarray:
    """Which windows of k words (by first word) lie in one document."""
    n = int(first[-1])
    if n < k:
        return np.empty(0, dtype=bool)
    room = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    return room[: n - k + 1] >= k


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if not n:
        return
    _, where, values = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.empty(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(n, max(row + 1, end))
        lo, hi = int(offsets[row]), int(offsets[end])
        yield row, end, data[lo:hi], offsets[row : end + 1] - lo
        row = end
