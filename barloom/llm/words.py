"""Hashes of words, word windows and their minima over whole batches of texts, in numpy."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C13 | 3
_ODD = np.uint64(BASE)
PIECE = 1 << 18  # bytes hashed at once


def _inverse(x: int) -> int:
    return pow(x, -1, 2**64)


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.n = base, 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            size = max(n, 1 << 16)
            out = []
            for b in (self.base, _inverse(self.base)):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                out.append(np.multiply.accumulate(p))
            self.up, self.down = out
            self.n = size
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(BASE), _Powers(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def byte_table(is_word, lower: bool = False) -> np.ndarray:
    """A random nonzero value for each byte of a word, 0 for the others."""
    t = mix(np.arange(1, 257, dtype=np.uint64) * _ODD) | np.uint64(1)
    if lower:
        t[65:91] = t[97:123]
    return np.where([bool(is_word(i)) for i in range(256)], t, np.uint64(0))


#: Words parted by ASCII white space, unchanged.
PLAIN = byte_table(lambda i: i not in (9, 10, 11, 12, 13, 32))
#: Runs of ASCII letters and digits and of anything beyond ASCII, A-Z read as a-z.
FOLDED = byte_table(lambda i: 48 <= i <= 57 or 65 <= i <= 90 or 97 <= i <= 122 or i > 127, lower=True)


def hashes(data: np.ndarray, bounds: np.ndarray, table: np.ndarray):
    """Words of texts that lie one after the other in ``data``.

    Returns their 64-bit hashes, first bytes, ends, and the bounds of each text's words.
    """
    n = len(data)
    found = []
    at = 0
    while at < n:
        to = min(n, at + PIECE)
        if to < n:  # cut between words: at a row's end, or after a byte outside words
            row = int(bounds[np.searchsorted(bounds, to, side="right") - 1])
            gaps = np.flatnonzero(table[data[at:to]] == 0)
            gap = at + int(gaps[-1]) + 1 if len(gaps) else at
            to = max(row, gap)
            if to <= at:  # one word longer than a piece
                row = int(bounds[np.searchsorted(bounds, at, side="right")])
                to = row
                for k in range(at, row, PIECE):
                    gaps = np.flatnonzero(table[data[k : min(row, k + PIECE)]] == 0)
                    if len(gaps):
                        to = k + int(gaps[0]) + 1
                        break
        found.append(_piece(data[at:to], bounds[np.searchsorted(bounds, at) : np.searchsorted(bounds, to, side="right")] - at, table, at))
        at = to
    if not found:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, np.zeros(len(bounds), np.int64)
    h, starts, ends = (np.concatenate(x) for x in zip(*found, strict=True))
    return h, starts, ends, np.searchsorted(starts, bounds)


def _piece(data, bounds, table, shift):
    n = len(data)
    t = table[data]
    inside = t != 0
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _BYTES.upto(n)
    t *= up
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(t, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts]), starts + shift, ends + shift


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hash of every ``k`` consecutive values, modulo 2**64."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _WORDS.upto(len(h))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up, out=total[1:])
    return mix((total[k:] - total[:-k]) * down[:n])


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of every ``k`` consecutive values, by doubling."""
    width = 1
    while 2 * width <= k:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (k - width)], x[k - width :]) if k > width else x


def whole_windows(word_bounds: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of ``n`` window starts have all their ``k`` words in one text."""
    ok = np.ones(n + k, bool)
    for d in range(1, k):
        ends = word_bounds[1:] - d
        ok[ends[ends >= 0]] = False
    return ok[:n]


def runs(mask: np.ndarray, change: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First positions and lengths of stretches of True, cut also where ``change`` is True."""
    first = mask.copy()
    first[1:] &= ~mask[:-1] if change is None else (~mask[:-1] | change[1:])
    starts = np.flatnonzero(first)
    at = np.flatnonzero(mask)
    return starts, np.diff(np.append(np.searchsorted(at, starts), len(at)))


def cut(text: str, spans: list[tuple[int, int]], table: np.ndarray) -> str:
    """``text`` without the words of ``spans``; what lies between the other words stays as it is."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    _, starts, ends, _ = hashes(data, np.array([0, len(data)]), table)
    out, at = [], 0
    for lo, hi in spans:
        out.append(raw[at : starts[lo]])
        at = int(starts[hi]) if hi < len(starts) else int(ends[-1])
    out.append(raw[at:])
    return b"".join(out).decode()
