"""Numpy helpers over the raw UTF-8 buffers of Arrow string columns.

Everything works on bounded slices of a batch (`slices`), so peak memory follows
the slice size or one single text, never the batch or the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_ODD_INV = pow(_ODD, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE_CODE = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64)
_pow = {_ODD: np.ones(1, _U), _ODD_INV: np.ones(1, _U)}


class Texts(NamedTuple):
    """`buf[offs[i]:offs[i + 1]]` is the i-th text; rows are `lo..hi` of the batch."""

    lo: int
    hi: int
    buf: np.ndarray
    offs: np.ndarray


class Words(NamedTuple):
    """Word i covers bytes starts[i]..ends[i]; text t owns words first[t]..first[t + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Cut a string column into runs of rows of about `limit` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo, n = 0, len(column)
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1))
        yield Texts(lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi
    pa.default_memory_pool().release_unused()


def powers(base: int, n: int) -> np.ndarray:
    if len(_pow[base]) < n:
        full = np.full(max(n, 1), base, _U)
        full[0] = 1
        table = np.cumprod(full, dtype=_U)
        if n > 4 * SLICE_BYTES:
            return table
        _pow[base] = table
    return _pow[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(31))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    return h ^ (h >> _U(32))


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-free 64-bit polynomial hash of every span of `codes`."""
    pre = np.zeros(len(codes) + 1, _U)
    np.cumsum(codes * powers(_ODD, len(codes)), dtype=_U, out=pre[1:])
    return mix((pre[ends] - pre[starts]) * powers(_ODD_INV, len(codes) + 1)[starts] + (ends - starts).astype(_U))


def byte_codes(buf: np.ndarray) -> np.ndarray:
    return _BYTE_CODE[buf]


def split(texts: Texts, gap: np.ndarray = _SPACE) -> Words:
    """Maximal runs of bytes outside `gap`; a text's end also ends its word."""
    buf, offs = texts.buf, texts.offs
    solid = ~gap[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    before = np.empty_like(solid)
    before[1:] = solid[:-1]
    before[:1] = False
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty_like(solid)
    after[:-1] = solid[1:]
    after[-1:] = False
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return Words(starts, ends, np.searchsorted(starts, offs))


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    """Copy of `buf` with A-Z lowered."""
    upper = (buf >= 65) & (buf <= 90)
    return buf + (upper * np.uint8(32))


def shingle_hashes(h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `n` consecutive word hashes inside one owner, and their first positions."""
    if len(h) < n:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    m = len(h) - n + 1
    g = np.zeros(m, _U)
    for j in range(n):
        g *= _U(0xD6E8FEB86659FD93)
        g += h[j : j + m]
    inside = np.flatnonzero(owner[:m] == owner[n - 1 :])
    return mix(g[inside]), inside


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks: key occurs twice or more; key occurred at an earlier position."""
    many, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    if len(keys) < 2:
        return many, later
    slots = 1 << int(4 * len(keys)).bit_length()
    slot = (keys & _U(slots - 1)).astype(np.int64)
    sub = np.flatnonzero(np.bincount(slot, minlength=slots)[slot] > 1)  # the rest is surely unique
    order = np.argsort(keys[sub], kind="stable")
    ordered = keys[sub][order]
    same = ordered[1:] == ordered[:-1]
    hit = np.zeros(len(sub), bool)
    hit[1:] |= same
    later[sub[order]] = hit
    hit[:-1] |= same
    many[sub[order]] = hit
    return many, later


def covered(first: np.ndarray, length: int, size: int) -> np.ndarray:
    """Mask of the positions inside any window first..first + length."""
    steps = np.zeros(size + 1, np.int32)
    np.add.at(steps, first, 1) if len(first) < 64 else np.add(steps, np.bincount(first, minlength=size + 1), out=steps, casting="unsafe")
    np.subtract(steps, np.bincount(first + length, minlength=size + 1)[: size + 1], out=steps, casting="unsafe")
    return np.cumsum(steps)[:size] > 0


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of `values` over each text's run first[t]..first[t + 1]."""
    pre = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=pre[1:])
    return pre[first[1:]] - pre[first[:-1]]
