"""Words, lines and hashes of many texts at once, as numpy operations on their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text worked on at once; only a longer single text makes a larger step.
STEP = 2 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]

BYTES = np.arange(256)
#: White space is \x20 and \x09-\x0D.
SPACE = np.isin(BYTES, [0x20, *range(0x09, 0x0E)])
NOT_SPACE = ~SPACE
NOT_NEWLINE = BYTES != 0x0A


def steps(texts: pa.Array, step: int = STEP) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, row offsets) of consecutive rows of about ``step`` bytes. Nulls count as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + step, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def spans(buf: np.ndarray, off: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes for which ``keep`` holds, cut at row ends: (row, start, end)."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    mask = keep[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[off] = True
    before = np.concatenate(([False], mask[:-1]))
    after = np.concatenate((mask[1:], [False]))
    start = np.flatnonzero(mask & (~before | cut[:-1]))
    end = np.flatnonzero(mask & (~after | cut[1:])) + 1
    return np.searchsorted(off, start, "right") - 1, start, end


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(21, int(n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        for k, base in enumerate((_BASE, inverse)):
            p = np.full(size, base, U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans: equal bytes give equal hashes wherever they stand."""
    if not len(start):
        return np.zeros(0, U)
    up, down = _power(len(buf) + 1)
    total = np.zeros(len(buf) + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * up[: len(buf)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def grams(row: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of one row: (index of the first word, row, hash)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    first = np.flatnonzero(row[:n] == row[k - 1 :])
    g = np.zeros(len(first), U)
    for j in range(k):
        g = g * U(0xFF51AFD7ED558CCD) + h[first + j]
    return first, row[first], mix(g)


def count(row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, minlength=n).astype(np.int64)


def tally(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Bytes of each row for which ``mask`` holds."""
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return total[off[1:]] - total[off[:-1]]
