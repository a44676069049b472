"""Recursions whose steps compose: block maps and their products, in numpy.

Two kinds. The level and trend filter: a step is affine in the state and linear-fractional in
its covariance, so a segment of steps is the element (A, b, C, eta, J) of parallel filtering: the
state behind it is ``A (1 + P J)^-1 (x + P eta) + b`` and the covariance
``A (1 + P J)^-1 P A' + C``. Dollar bars: what is open at a block's start fixes the first tick
that closes a bar in it, and that tick fixes the rest; the map from the open amount to the one at
the block's end is a step function with a step for each tick of the first bar.
"""

from __future__ import annotations

import numpy as np

# --- level and trend filter ----------------------------------------------------------------

#: A (4), b (2), C (3), eta (2), J (3), then: any usable tick (1), state and covariance of a
#: filter that starts at the first usable tick of the segment (5)
WIDTH = 20


def _guarded(a, b, d):
    """The covariance kept positive definite, as in the one-step kernel."""
    a, d = np.maximum(a, 1e-8), np.maximum(d, 1e-8)
    tight = a * d - b * b <= 1e-16
    if tight.any():
        floor = np.sqrt(b * b + 1e-6) + 1e-4
        a, d = np.where(tight, np.maximum(a, floor), a), np.where(tight, np.maximum(d, floor), d)
    return a, b, d


def lockstep(at: np.ndarray):
    """Segments ``at[i]:at[i + 1]``, longest first: their order and, step by step, the rows of
    those that are long enough."""
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    first, size = at[:-1][order], size[order]
    active = np.searchsorted(-size, -np.arange(1, int(size.max(initial=0)) + 1), side="right")
    return order, ((int(n), first[:n] + t) for t, n in enumerate(active))


def filter_segments(at, price, skip, state, q, r):
    """Filter every segment from its row of ``state`` (x, v, a, b, d; NaN: not started).

    Returns per row: price or prediction, level, trend and covariance; and the last states.
    """
    n = len(price)
    out = np.full((n, 6), np.nan)
    order, steps = lockstep(at)
    x, v, a, b, d = (c.copy() for c in state[order].T)
    for k, rows in steps:
        z, miss = price[rows], skip[rows]
        fresh = np.isnan(x[:k])
        px, pv = x[:k] + v[:k], v[:k]
        pa, pb, pd = _guarded(a[:k] + 2 * b[:k] + d[:k] + q[0], b[:k] + d[:k], d[:k] + q[1])
        gap = pa + r
        k0, k1, e = pa / gap, pb / gap, z - px
        ua, ub, ud = _guarded((1 - k0) * pa, (1 - k0) * pb, pd - k1 * pb)
        begin = fresh & ~miss
        for s, started, kept, new in ((x, z, px, px + k0 * e), (v, 0.0, pv, pv + k1 * e), (a, 1.0, pa, ua), (b, 0.0, pb, ub), (d, 1.0, pd, ud)):
            s[:k] = np.where(begin, started, np.where(miss, kept, new))
        out[rows, 0] = np.where(miss, px, z)
        none = np.isnan(x[:k])
        out[rows, 1], out[rows, 2] = np.where(none, 0.0, x[:k]), np.where(none, 0.0, v[:k])
        for j, c in ((3, a), (4, b), (5, d)):
            out[rows, j] = np.where(none, np.nan, c[:k])
    last = np.empty_like(state)
    last[order] = np.stack([x, v, a, b, d], 1)
    return out, last


def filter_elements(at, price, skip, q, r) -> np.ndarray:
    """The element of every segment: a filter without initial doubt, and how it bends one with."""
    order, steps = lockstep(at)
    m = len(order)
    e = np.zeros((WIDTH, m))
    e[0] = e[3] = 1.0
    a00, a01, a10, a11, b0, b1, c00, c01, c11, h0, h1, j00, j01, j11 = e[:14]
    for k, rows in steps:
        a00[:k] += a10[:k]
        a01[:k] += a11[:k]
        b0[:k] += b1[:k]
        c00[:k] += 2 * c01[:k] + c11[:k] + q[0]
        c01[:k] += c11[:k]
        c11[:k] += q[1]
        s = 1 / (r + c00[:k])
        s[skip[rows]] = 0.0  # nothing is learnt
        with np.errstate(invalid="ignore"):
            miss = np.where(skip[rows], 0.0, price[rows] - b0[:k])
        k0, k1 = c00[:k] * s, c01[:k] * s
        h0[:k] += a00[:k] * miss * s
        h1[:k] += a01[:k] * miss * s
        j00[:k] += a00[:k] * a00[:k] * s
        j01[:k] += a00[:k] * a01[:k] * s
        j11[:k] += a01[:k] * a01[:k] * s
        a10[:k] -= k1 * a00[:k]
        a11[:k] -= k1 * a01[:k]
        a00[:k] *= 1 - k0
        a01[:k] *= 1 - k0
        b0[:k] += k0 * miss
        b1[:k] += k1 * miss
        c11[:k] -= k1 * c01[:k]
        c01[:k] *= 1 - k0
        c00[:k] *= 1 - k0
    out = np.empty((m, WIDTH))
    out[order] = e.T
    blank = np.full((m, 5), np.nan)
    blank[:, 2:] = (1.0, 0.0, 1.0)
    last = filter_segments(at, price, skip, blank, q, r)[1]
    out[:, 14] = ~np.isnan(last[:, 0])
    out[:, 15:] = np.where(out[:, 14:15] > 0, last, 0.0)
    return out


def _parts(e):
    e = np.asarray(e, float)
    sym = lambda v: np.array([[v[0], v[1]], [v[1], v[2]]])
    return e[:4].reshape(2, 2), e[4:6], sym(e[6:9]), e[9:11], sym(e[11:14])


def filter_after(element, state):
    """State and covariance (x, v, a, b, d) behind a segment that is entered with ``state``."""
    a, b, c, h, j = _parts(element)
    x, p = np.array(state[:2]), np.array([[state[2], state[3]], [state[3], state[4]]])
    w = a @ np.linalg.inv(np.eye(2) + p @ j)
    x = w @ (x + p @ h) + b
    p = w @ p @ a.T + c
    return [float(x[0]), float(x[1]), float(p[0, 0]), float((p[0, 1] + p[1, 0]) / 2), float(p[1, 1])]


def filter_product(first, then) -> list[float]:
    a1, b1, c1, h1, j1 = _parts(first)
    a2, b2, c2, h2, j2 = _parts(then)
    w = np.linalg.inv(np.eye(2) + c1 @ j2)
    a = a2 @ w @ a1
    b = a2 @ w @ (b1 + c1 @ h2) + b2
    c = a2 @ w @ c1 @ a2.T + c2
    h = a1.T @ w.T @ (h2 - j2 @ b1) + h1
    j = a1.T @ w.T @ j2 @ a1 + j1
    if first[14]:
        begun = [1.0, *filter_after(then, first[15:20])]
    else:
        begun = [float(x) for x in then[14:20]]
    half = lambda s: [float(s[0, 0]), float((s[0, 1] + s[1, 0]) / 2), float(s[1, 1])]
    return [*a.ravel().tolist(), *b.tolist(), *half(c), *h.tolist(), *half(j), *begun]


# --- tick rule -------------------------------------------------------------------------------


def last_moves(at: np.ndarray, price: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Sign of the last non-zero move at each row of the stretches ``at[i]:at[i + 1]``.

    ``before``: for each stretch the price and the sign ahead of it (NaN: no price).
    """
    size = np.diff(at)
    ahead = np.append(np.nan, price[:-1])
    ahead[at[:-1]] = before[:, 0]
    with np.errstate(invalid="ignore"):
        move = np.nan_to_num(np.sign(price - ahead))
    last = np.maximum.accumulate(np.where(move != 0, np.arange(len(price)), -1))
    return np.where(last >= np.repeat(at[:-1], size), move[last], np.repeat(before[:, 1], size))


def move_elements(at: np.ndarray, price: np.ndarray) -> np.ndarray:
    """First and last price of every stretch, and the sign of its last move (0 if none)."""
    none = np.tile([np.nan, 0.0], (len(at) - 1, 1))
    return np.stack([price[at[:-1]], price[at[1:] - 1], last_moves(at, price, none)[at[1:] - 1]], 1)


def moves_product(first, then) -> list[float]:
    between = float(np.nan_to_num(np.sign(then[0] - first[1])))
    return [float(first[0]), float(then[1]), float(then[2] or between or first[2])]


# --- dollar bars -----------------------------------------------------------------------------

#: dollars are counted in these parts, so that sums do not depend on their order
UNITS = 10_000
_NEVER = 2**52


def amounts(price, volume, theta, low: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Dollars and thresholds in fixed decimals.

    ``low`` bounds what may be open from below. If nothing is ever negative, a tick whose
    threshold is not positive always closes, and counts so.
    """
    with np.errstate(invalid="ignore"):
        d = np.nan_to_num(np.rint(price * volume * UNITS), nan=0.0, posinf=0.0, neginf=0.0).astype(np.int64)
        t = np.minimum(np.nan_to_num(np.rint(theta * UNITS), nan=_NEVER, posinf=_NEVER, neginf=-_NEVER), _NEVER).astype(np.int64)
    if low < 0:
        return d, t
    always = t <= 0
    return np.where(always, np.maximum(d, 1), d), np.where(always, 1, t)


def _first_at_least(w: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For every s the first i >= s with ``w[i] >= value[s]``; the length if none. By doubled maxima."""
    n = len(w)
    most = [w]
    while 2 ** len(most) <= n:
        m, k = most[-1], 2 ** (len(most) - 1)
        most.append(np.maximum(m[:-k], m[k:]))
    at = np.arange(n)
    for k in range(len(most) - 1, -1, -1):
        fits = at + 2**k <= n
        go = fits & (most[k][np.minimum(at, n - 2**k)] < value)
        at = at + np.where(go, 2**k, 0)
    return at


class Closes:
    """Where bars close in a block: ``after[s]`` is the first tick of the bar behind the one that
    starts at tick ``s`` (the block's length plus one, if that stays open)."""

    def __init__(self, d: np.ndarray, t: np.ndarray, low: int = 0):
        self.n, self.low = len(d), low
        n = self.n
        self.total = np.append(0, np.cumsum(d))
        over = self.total[1:] - t
        #: running maximum of sums minus thresholds: the first bar closes where it reaches what is missing
        self.reach = np.maximum.accumulate(over) if n else over
        if low < 0 and n:
            found = _first_at_least(over, self.total[:-1])
        else:  # sums grow, so no earlier tick reaches the sum before s
            found = np.searchsorted(self.reach, self.total[:-1], side="left")
        self.after = np.append(found + 1, [n + 1, n + 1])

    def first(self, carry) -> np.ndarray:
        """The tick that closes the first bar when ``carry`` is open at the start; the length if none."""
        return np.searchsorted(self.reach, -np.asarray(carry), side="left")

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """For a bar that starts at each tick: the last bar's start, and the closes up to the end."""
        n = self.n
        to = np.where(self.after <= n, self.after, np.arange(n + 2))
        count = (to != np.arange(n + 2)).astype(np.int64)
        while True:  # pointers double until none moves
            further = to[to]
            if (further == to).all():
                return to, count
            count = count + count[to]
            to = further

    def element(self) -> np.ndarray:
        """Sum and lower bound, and by falling amounts that must be open: what is open at the end, and the closes."""
        steps = np.flatnonzero(self.reach > np.append(-(2**62), self.reach[:-1]))
        need = np.maximum(-self.reach[steps], self.low)
        keep = np.append(True, need[1:] < need[:-1]) if len(need) else np.zeros(0, bool)
        steps, need = steps[keep], need[keep]
        last, count = self.ends()
        open_ = self.total[-1] - self.total[np.minimum(last[steps + 1], self.n)]
        return np.concatenate([[self.total[-1], self.low], need, open_, count[steps + 1] + 1]).astype(float)

    def marks(self, carry: int) -> np.ndarray:
        """1 at ticks that close a bar."""
        out = np.zeros(self.n, np.int32)
        i = int(self.first(carry))
        while i < self.n:  # one step a bar
            out[i] = 1
            i = int(self.after[i + 1]) - 1
        return out


def _closes(e):
    m = (len(e) - 2) // 3
    return e[0], e[2 : m + 2], e[m + 2 : 2 * m + 2], e[2 * m + 2 :]


def _applied(element, carry):
    """Open amount and closes behind a block, for open amounts before it."""
    total, need, open_, count = _closes(element)
    carry = np.asarray(carry, float)
    if not len(need):
        return carry + total, np.zeros_like(carry)
    at = np.searchsorted(-need, -carry, side="left")  # the first step that is low enough
    has = at < len(need)
    at = np.minimum(at, len(need) - 1)
    return np.where(has, open_[at], carry + total), np.where(has, count[at], 0.0)


def bars_product(first, then) -> list[float]:
    first, then = np.asarray(first, float), np.asarray(then, float)
    total, need, open_, count = _closes(first)
    open1, more = _applied(then, open_)
    # amounts that close nothing in the first block may do so in the second
    total2, need2, open2, count2 = _closes(then)
    later = np.maximum(need2 - total, first[1])
    keep = later < (need[-1] if len(need) else np.inf)
    keep[1:] &= later[1:] < later[:-1]
    cols = [np.append(need, later[keep]), np.append(open1, open2[keep]), np.append(count + more, count2[keep])]
    return np.concatenate([[total + total2, first[1]], *cols]).tolist()


def bars_after(element) -> tuple[float, float]:
    """Open amount and closes behind a product of blocks that nothing was open before."""
    open_, count = _applied(np.asarray(element, float), [0.0])
    return float(open_[0]), float(count[0])
