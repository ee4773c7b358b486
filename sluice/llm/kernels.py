"""Vectorised byte kernels used inside Arrow tasks.

Texts arrive as one UTF-8 buffer with offsets, so nothing here makes a Python
string per word. Every function is exact on whole texts; hashes are 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; the power tables have this many entries.
SLICE = 1 << 19
#: Bytes of whole documents handled together.
CHUNK = 1 << 21

BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)

#: Word bytes after lower-casing A-Z: digits, letters, and everything past ASCII.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n at least."""
    size = SLICE + 1 if n <= SLICE else n + 1
    if size not in _powers:
        with np.errstate(over="ignore"):
            up = np.full(size, BASE, dtype=np.uint64)
            down = np.full(size, BASE_INV, dtype=np.uint64)
            up[0] = down[0] = 1
            got = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if size > SLICE + 1:
            return got
        _powers[size] = got
    return _powers[size]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes in place (a bijection)."""
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if large else np.int32, count=col.offset + len(col) + 1)[col.offset :].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of up to limit bytes together, or a longer one alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each document the index of its first word (one more at the end)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    m = IS_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = m.copy()
    first[1:] &= ~m[:-1] | edge[1:-1]
    last = m
    last = last & np.concatenate([~m[1:] | edge[1:-1], [True]])
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's lower-cased bytes."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            a = starts[i]
            j = max(i + 1, int(np.searchsorted(ends, a + SLICE, side="right")))
            b = ends[j - 1]
            up, down = powers(int(b - a))
            p = np.zeros(b - a + 1, np.uint64)
            np.cumsum((LOWER[data[a:b]].astype(np.uint64) + np.uint64(1)) * up[: b - a], out=p[1:])
            out[i:j] = (p[ends[i:j] - a] - p[starts[i:j] - a]) * down[starts[i:j] - a]
            i = j
    return mix(out)


def window_hashes(wh: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words (across documents too; callers mask those)."""
    if len(wh) < n:
        return np.zeros(0, np.uint64)
    c, out = np.uint64(0xC2B2AE3D27D4EB4F), None
    with np.errstate(over="ignore"):
        for k in range(n):
            part = wh[k : len(wh) - n + 1 + k]
            out = part.copy() if out is None else out * c + part
    return mix(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Each document's sorted distinct n-word shingle hashes; of fewer words, but not none, one shingle of all."""
    starts, ends, first = words(data, offsets)
    wh = word_hashes(data, starts, ends)
    full = window_hashes(wh, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(full[a : b - n + 1]))
        elif b > a:
            out.append(window_hashes(wh[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
