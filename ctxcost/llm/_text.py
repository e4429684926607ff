"""Whole Arrow batches of text at once: words, their hashes and lookups as numpy arrays.

A word is a run of ASCII letters and digits and of all non-ASCII characters; callers lower-case
the text in Spark first. Hashes are 64-bit and the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)
_EXACT = _TABLE.copy()
_TABLE[65:91] = _TABLE[97:123]
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse; they are made anew for a text beyond the usual block and not kept."""
    global _POW, _INV
    if len(_POW) >= n:
        return _POW, _INV

    def up(base: int) -> np.ndarray:
        p = np.full(n, base, np.uint64)
        p[0] = 1
        return np.multiply.accumulate(p)

    pair = up(_R), up(_RINV)
    if n <= 2 * BLOCK:
        _POW, _INV = pair
    return pair


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows with about ``limit`` bytes; a longer text is a block alone. Nulls are empty."""
    row = 0
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if part.null_count:
            part = part.fill_null("")
        wide = pa.types.is_large_string(part.type)
        _, offs, data = part.buffers()
        n = len(part)
        if not n:
            continue
        o = np.frombuffer(offs, np.int64 if wide else np.int32)[part.offset : part.offset + n + 1].astype(np.int64)
        b = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(o, o[i] + limit, "right")) - 1)
            yield row + i, b[o[i] : o[j]], o[i : j + 1] - o[i]
            i = j
        row += n


def spans(data: np.ndarray, offs: np.ndarray, table: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row of each) of the runs of bytes in ``table``; a run ends with its text."""
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = table[data]
    cut = np.zeros(n + 1, bool)
    cut[offs[:-1]] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | cut))
    ends = np.flatnonzero(before & (~inside | cut))
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """Hash of each span of bytes; ``fold``: ASCII letters of either case are the same."""
    p, inv = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_TABLE if fold else _EXACT)[data] * p[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def shingles(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of its first word) of each ``k`` consecutive words of one text."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = h[:n].copy()
    for i in range(1, k):
        g = mix(g * np.uint64(_R) + h[i : n + i])
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return g[at], at


def runs(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``shingles``, at a cost that doesn't grow with ``k``."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    p, inv = _powers(len(h))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * p[: len(h)], out=total[1:])
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return mix((total[at + k] - total[at]) * inv[at]), at


class Lookup:
    """Index of each key in a table of distinct unsigned keys, -1 where absent; open addressing, a quarter full at most."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(4 * max(1, len(keys)) - 1).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.concatenate((keys.astype(np.uint64), np.zeros(1, np.uint64)))
        self.slot = np.full(1 << self.bits, -1, np.int64)
        left, at = np.arange(len(keys)), self._at(self.keys[:-1])
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]
            lost = self.slot[at] != left
            left, at = left[lost], (at[lost] + 1) & self.mask
        self.known = self.keys[self.slot]

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(_R)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64, copy=False)
        at = self._at(keys)
        out = self.slot[at]
        miss = np.flatnonzero((self.known[at] != keys) & (out >= 0))
        while len(miss):
            at[miss] = (at[miss] + 1) & self.mask
            out[miss] = self.slot[at[miss]]
            miss = miss[(self.known[at[miss]] != keys[miss]) & (out[miss] >= 0)]
        return out


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def column(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    """A column of numbers without nulls."""
    return batch.column(name).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(name).to_numpy()
