"""Vectorised text kernels on Arrow buffers: words, shingles and 64-bit polynomial hashes.

A word is a maximal run of bytes above 0x20 of the UTF-8 text.  Hashes are sums of random byte values times powers of
an odd number modulo 2**64, passed through a finaliser; any substring's hash comes from two prefix sums.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def lean(run: Callable) -> Callable:
    """A function over Arrow batches whose worker gives memory back when a task ends: workers are used again, and their pools grow otherwise."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library: its pools stay as they are
            pass

    return wrapped


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        n = max(n, 1 << 20)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for k, base in (("up", BASE), ("down", inverse)):
            full = np.full(n, base, np.uint64)
            full[0] = 1
            _powers[k] = np.cumprod(full, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def buffers(texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string array; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.fill_null("").cast(pa.large_string()) if texts.type != pa.large_binary() else texts
    raw = texts.buffers()
    offsets = np.frombuffer(raw[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit bytes each; a longer text has a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(BYTE[data] * up[: len(data)], out=out[1:])
    return out


def spans_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word."""
    solid = data > 32
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edge = np.unique(offsets)
    inner = edge[edge < len(data)]
    first[inner] |= solid[inner]
    inner = edge[edge > 0] - 1
    last[inner] |= solid[inner]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def shingles(h: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each run of size words; a text of fewer words has one shingle of all of them."""
    n = len(h)
    if not n:
        return h, text
    factor = [np.uint64(pow(int(BASE), 2 * j + 3, 1 << 64)) for j in range(size)]
    full = np.zeros(max(0, n - size + 1), np.uint64)
    for j in range(size):
        full += h[j : j + len(full)] * factor[j]
    whole = text[: len(full)] == text[size - 1 :] if len(full) else np.zeros(0, bool)
    out, of = [mix(full[whole])], [text[: len(full)][whole]]
    begin = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    count = np.diff(np.r_[begin, n])
    few = count < size
    if few.any():
        b, c = begin[few], count[few]
        short = np.zeros(len(b), np.uint64)
        for j in range(size - 1):
            has = c > j
            short[has] += h[b[has] + j] * factor[j]
        out.append(mix(short + c.astype(np.uint64)))
        of.append(text[b])
    return np.concatenate(out), np.concatenate(of)


def text_shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    start, end, text = words(data, offsets)
    return shingles(spans_hash(prefix_sums(data), start, end), text, size)


def counted(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) in that order, with how often each occurs."""
    if not len(h):
        return text, h, np.zeros(0, np.int64)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])])
    return text[new], h[new], np.diff(np.r_[new, len(h)])


def as_long(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))
