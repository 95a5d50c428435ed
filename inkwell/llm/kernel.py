"""Vectorised helpers on Arrow text columns, used inside tasks.

A batch of texts is one byte buffer with offsets, so words, hashes and runs of whole batches come
from a few numpy passes. Batches are cut into pieces of bounded size along document borders."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
BASE = 0x9E3779B97F4A7C15 | 1
BASE2 = 0xC2B2AE3D27D4EB4F | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def column_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def pieces(raw: np.ndarray, off: np.ndarray, most: int = 1 << 21):
    """Runs of rows of about ``most`` bytes: (first row, end row, bytes, offsets). A longer row is
    a piece of its own."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, hi, raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (murmur's)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i up to n."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 21)
        up, down = np.full(size, base, U), np.full(size, pow(base, -1, 1 << 64), U)
        up[0] = down[0] = 1
        have = np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)
        if size <= 1 << 23:
            _powers[base] = have
    return have


def prefix(raw: np.ndarray, base: int = BASE) -> np.ndarray:
    """S[i]: sum of mix(byte j) * base^j over j < i, so that any substring has a hash."""
    table = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
    out = np.zeros(len(raw) + 1, U)
    np.cumsum(table[raw] * powers(base, len(raw))[0][:len(raw)], out=out[1:])
    return out


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """64-bit hashes of the substrings [start, end)."""
    return mix((pre[end] - pre[start]) * powers(base, len(pre))[1][start] + (end - start).astype(U))


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): spans of all words, and for each row the index of its first word
    (one more entry than rows)."""
    w = ~SPACE[raw]
    begin = w.copy()
    begin[1:] &= ~w[:-1]
    stop = w.copy()
    stop[:-1] &= ~w[1:]
    some = off[:-1][off[:-1] < off[1:]]
    begin[some] = w[some]
    last = off[1:][off[:-1] < off[1:]] - 1
    stop[last] = w[last]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return start, end, np.searchsorted(start, off)


def per_row(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over [off[i], off[i + 1])."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]
