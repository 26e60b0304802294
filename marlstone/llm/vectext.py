"""Words of many texts at once: numpy over Arrow string buffers, in windows of bounded size.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which is the same as [^\\x20\\x09-\\x0D]+ over code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WINDOW = 1 << 16
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20260229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POW = np.ones(1 << 12, np.uint64)
np.multiply.accumulate(np.concatenate([_POW[:1], np.full(len(_POW) - 1, _BASE)]), out=_POW)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    global _POW
    while n > len(_POW):
        _POW = np.concatenate([_POW, _POW * (_POW[-1] * _BASE)])
    return _POW


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of an Arrow string column; null is an empty text."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = column.fill_null("").cast(pa.large_string())
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    raw = a.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, off


def slices(off: np.ndarray, most: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most so many bytes, or of one row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _cuts(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about WINDOW that end between words."""
    a, end = int(off[0]), int(off[-1])
    while a < end:
        b = min(a + WINDOW, end)
        if b < end:
            last = np.flatnonzero(SPACE[data[a:b]])
            at = a + int(last[-1]) + 1 if len(last) else a
            at = max(at, int(off[np.searchsorted(off, b, "right") - 1]))
            while at <= a:  # one word fills the window
                more = np.flatnonzero(SPACE[data[b : b + WINDOW]])
                stop = int(off[np.searchsorted(off, a, "right")])
                at = min(b + int(more[0]) + 1 if len(more) else b + WINDOW, stop)
                if not len(more) and at < stop:
                    b, at = b + WINDOW, a
            b = at
        yield a, b
        a = b


def word_hashes(data: np.ndarray, off: np.ndarray, lower: bool = False, kinds: np.ndarray | None = None, shapes: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all rows in order, and each row's first place (one more than rows).

    kinds, a table by byte, also ends a word where the kind of byte changes. shapes gets, for each window of bytes, an
    array of small numbers: kind of the first byte, capitals (none, the first only, others too) and length up to 7.
    """
    hashes, places = [], []
    with np.errstate(over="ignore"):
        for a, b in _cuts(data, off):
            seg = data[a:b]
            solid = ~SPACE[seg]
            first = solid.copy()
            if kinds is None:
                first[1:] &= ~solid[:-1]
            else:
                k = kinds[seg]
                first[1:] &= ~solid[:-1] | (k[1:] != k[:-1])
            rows = off[np.searchsorted(off, a, "left") : np.searchsorted(off, b, "left")] - a
            first[rows] |= solid[rows]
            at = np.flatnonzero(solid)
            if not len(at):
                continue
            k = np.flatnonzero(first[at])
            start = at[k]
            size = np.diff(np.append(k, len(at)))
            pos = at - np.repeat(start, size)
            nb = seg[at]
            if shapes is not None:
                upper = (nb >= 65) & (nb <= 90)
                more = np.add.reduceat(upper.astype(np.int32), k)
                case = np.where(more == 0, 0, np.where(upper[k] & (more == 1), 1, 2))
                shapes.append((kinds[nb[k]].astype(np.int64) * 3 + case) * 8 + np.minimum(size, 7))
            if lower:
                nb = _LOWER[nb]
            hashes.append(mix(np.add.reduceat(_BYTE[nb] * _powers(int(size.max()))[pos], k)))
            places.append(start + a)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), off, "left")


def windows(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all n-word windows that lie within a row, and the place of each one's first word."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        s = np.zeros(len(h) - n + 1, np.uint64)
        for i in range(n):
            s = s * _BASE + h[i : len(h) - n + 1 + i]
        s = mix(s)
    ok = np.ones(len(s), bool)
    for i in range(1, n):
        bad = first[1:-1] - i
        bad = bad[(bad >= 0) & (bad < len(s))]
        ok[bad] = False
    places = np.flatnonzero(ok)
    return s[places], places
