"""Vectorised word splitting and hashing of Arrow string columns (numpy).

A word is a maximal run of bytes of one class inside one row; rows never share
a word. The classes used here are unions of whole UTF-8 byte values, so byte
runs and character runs are the same words.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ALL = np.arange(256)
#: words `[^\x20\x09-\x0D]+`
NON_SPACE = ~((_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D)))
#: words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (after A-Z became a-z)
ALNUM = ~((_ALL <= 0x2F) | ((_ALL >= 0x3A) & (_ALL <= 0x60)) | ((_ALL >= 0x7B) & (_ALL <= 0x7F)))
_UPPER = (_ALL >= 0x41) & (_ALL <= 0x5A)
LOWER = np.where(_UPPER, _ALL + 32, _ALL).astype(np.uint8)
SAME = _ALL.astype(np.uint8)

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_SEGMENT = 1 << 20  # bytes hashed at once


def worker_cache(key, make: Callable):
    """Value kept for the life of a Python worker. The package's functions are
    shipped by value, so a module global would be rebuilt in every task."""
    store = sys.modules.setdefault("_qalake_worker_cache", types.ModuleType("_qalake_worker_cache")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (public-domain murmur3 constants)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE)) | _U(1)


def _powers(n: int) -> np.ndarray:
    """BASE**0 .. BASE**(n-1) modulo 2**64."""
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    """Words of consecutive rows: ``counts`` per row, ``first`` word of each
    row (len rows + 1), and per word its byte ``start``, ``length``, ``hash``."""

    counts: np.ndarray
    first: np.ndarray
    start: np.ndarray
    length: np.ndarray
    hash: np.ndarray
    row_start: np.ndarray

    def row_end(self) -> np.ndarray:
        """For each word, the index just past its row's last word."""
        return np.repeat(self.first[1:], self.counts)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def text_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1]
    off = off.astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


def split_words(col, cls: np.ndarray, fold: np.ndarray = SAME) -> Words:
    """Words of every row of ``col``: class ``cls`` after byte map ``fold``."""
    raw, off = text_bytes(col)
    n = len(raw)
    inside = cls[fold[raw]]
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    heads = off[:-1][off[:-1] < n]
    before[heads] = False
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[heads[heads > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    length = np.flatnonzero(inside & ~after) + 1 - start
    first = np.searchsorted(start, off)
    return Words(np.diff(first), first, start, length, _hash(raw, inside, fold, start, length), off)


def _hash(raw, inside, fold, start, length) -> np.ndarray:
    if not len(start):
        return np.empty(0, np.uint64)
    values = worker_cache("byte_values", _byte_values)
    powers = worker_cache("powers", lambda: _powers(1 << 12))
    if length.max() > len(powers):
        powers = _powers(int(length.max()))
    out = np.empty(len(start), np.uint64)
    total = np.cumsum(length)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + _SEGMENT)))
        lo, hi = start[a], start[b - 1] + length[b - 1]
        part = raw[lo:hi][inside[lo:hi]]
        lens = length[a:b]
        at = np.cumsum(lens) - lens
        k = np.arange(len(part)) - np.repeat(at, lens)
        out[a:b] = np.add.reduceat(values[fold[part]] * powers[k], at)
        a = b
    return mix(out ^ (length.astype(np.uint64) * _U(0x2545F4914F6CDD1D)))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words that start at each position (len(h) - k + 1 values);
    doubling: a run of 2m words is made of two runs of m words."""
    n = len(h) - k + 1
    if n <= 0 or not k:
        return np.empty(0, np.uint64)
    out, have, level, width = None, 0, h, 1
    rest = k
    while rest:
        if rest & 1:
            part = level[have:have + n]
            out = part.copy() if out is None else out * _U(pow(_BASE, width, 1 << 64)) + part
            have += width
        rest >>= 1
        if rest:
            level = level[:-width] * _U(pow(_BASE, width, 1 << 64)) + level[width:]
            width *= 2
    return mix(out + _U(k))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum over every ``width`` consecutive values, by doubling."""
    if len(x) < width:
        return np.empty(0, x.dtype)
    w = 1
    while w * 2 <= width:
        x = np.minimum(x[:-w], x[w:])
        w *= 2
    if w < width:
        x = np.minimum(x[:len(x) - (width - w)], x[width - w:])
    return x


def small_batches(batches: Iterable[pa.RecordBatch], text: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``max_bytes`` of text (one row at
    least), so that the work arrays stay small whatever the batch size."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False))
        a, done = 0, 0
        while a < b.num_rows:
            z = max(a + 1, int(np.searchsorted(size, done + max_bytes, side="right")))
            yield b.slice(a, z - a)
            a, done = z, int(size[z - 1])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint64)
