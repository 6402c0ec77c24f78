"""Vectorised word and shingle hashing over Arrow string columns (no per-word Python)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POW: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]
CHUNK = 1 << 20

#: Fixed classes of bytes: the contract's white space, and letters or digits with all of non-ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        m = max(n, 2 * CHUNK)
        for k, b in enumerate((_BASE, _BASE_INV)):
            p = np.full(m, b, U)
            p[0] = 1
            _POW[k] = np.cumprod(p, dtype=U)
    return _POW[0][:n], _POW[1][:n]


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def chunks(off: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes each, so that working memory doesn't follow the batch."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, off: np.ndarray, word_bytes: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the rows that ``off`` bounds, and each row's first word (one more at the end). A-Z count as a-z."""
    raw = data[off[0] : off[-1]]
    at = off - off[0]
    n = len(raw)
    if not n:
        return np.zeros(0, U), np.zeros(len(off), np.int64)
    is_word = word_bytes[raw]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = is_word[:-1]
    start = np.flatnonzero(is_word & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = is_word[1:]
    end = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    p, q = _powers(n)
    total = np.zeros(n + 1, U)
    np.cumsum((LOWER[raw].astype(U) + U(1)) * p, out=total[1:])
    h = mix((total[end] - total[start]) * q[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))
    return h, np.searchsorted(start, at, "left")


_STEP = mix(np.arange(1, 65, dtype=U) * U(0xA0761D6478BD642F)) | U(1)


def row_shingles(h: np.ndarray, first: np.ndarray, size: int, every: bool = False) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its runs of ``size`` words; fewer words are one run; no word, none.

    every: in order and with repeats instead.
    """
    run = np.zeros(max(0, len(h) - size + 1), U)
    for j in range(size if len(run) else 0):
        run += h[j : j + len(run)] * _STEP[j]
    run = mix(run + U(size))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            x = run[a : b - size + 1]
        elif b > a:
            x = mix((h[a:b] * _STEP[: b - a]).sum(dtype=U, keepdims=True) + U(b - a))
        else:
            x = h[:0]
        yield x if every else np.unique(x)


def runs(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of ``size`` words inside one row."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    run = np.zeros(n, U)
    for j in range(size):
        run += h[j : j + n] * _STEP[j]
    row = np.searchsorted(first, np.arange(n), "right") - 1
    ok = np.arange(n) + size <= first[row + 1]
    return mix(run[ok] + U(size)), row[ok]


def shingle_sets(col: pa.Array, size: int, word_bytes: np.ndarray = NOT_SPACE) -> Iterator[np.ndarray]:
    data, off = string_buffers(col)
    for i, j in chunks(off):
        h, first = words(data, off[i : j + 1], word_bytes)
        yield from row_shingles(h, first, size)
