"""One-step state updates shared by the batch scans and the streaming operators.

Each step takes plain floats and returns (new state, outputs); a state is a list of
floats (or None before the first usable value), so it travels as text or as a row.
"""

from __future__ import annotations

import math


def usable(x) -> bool:
    return x is not None and math.isfinite(x)


def keep_pd(a: float, b: float, d: float, least: float, tight: float, bump: tuple[float, float]):
    """Floor the diagonal of [[a, b], [b, d]] and widen it when singular."""
    a, d = max(a, least), max(d, least)
    if a * d - b * b <= tight:
        floor = bump[0] * abs(b) + bump[1] if bump[0] else math.sqrt(b * b + 1e-6) + bump[1]
        a, d = max(a, floor), max(d, floor)
    return a, b, d


def _tick_pd(a, b, d):
    return keep_pd(a, b, d, 1e-8, 1e-16, (0.0, 1e-4))


def _trend_pd(a, b, d):
    return keep_pd(a, b, d, 1e-12, 1e-24, (1.0, 2e-9))


def _predict(s, q0, q1):
    x, v, a, b, d = s
    return x + v, v, a + 2 * b + d + q0, b + d, d + q1


def _update(x, v, a, b, d, z, r):
    gap = a + r
    k0, k1 = a / gap, b / gap
    e = z - x
    return x + k0 * e, v + k1 * e, (1 - k0) * a, (1 - k0) * b, d - k1 * b


def replace_tick(state, price, bad, q=(1e-4, 1e-5), r=1e-2):
    """Level and trend filter; a bad tick is replaced by its prediction."""
    skip = bool(bad) or not usable(price) or price <= 0
    if state is None:
        if skip:
            return None, (None, 0.0, 0.0)
        return [price, 0.0, 1.0, 0.0, 1.0], (price, price, 0.0)
    x, v, a, b, d = _predict(state, *q)
    a, b, d = _tick_pd(a, b, d)
    clean = x if skip else price
    if not skip:
        x, v, a, b, d = _update(x, v, a, b, d, price, max(r, 1e-12))
        a, b, d = _tick_pd(a, b, d)
    return [x, v, a, b, d], (clean, x, v)


def trend_step(state, z, q=(1e-4, 1e-5), r=1e-2):
    """Local linear trend; a missing value only predicts."""
    if state is None:
        return (None, (0.0, 0.0)) if not usable(z) else ([z, 0.0, 1.0, 0.0, 1.0], (z, 0.0))
    x, v, a, b, d = _predict(state, *q)
    if usable(z):
        x, v, a, b, d = _update(x, v, a, b, d, z, r)
        a, b, d = _trend_pd(a, b, d)
    return [x, v, a, b, d], (x, v)


#: two-state return model: transition rows, means, deviations
HMM_A = ((0.95, 0.05), (0.05, 0.95))


def hmm_step(state, obs, trans=HMM_A, means=(0.0, 0.0), stds=(0.01, 0.03)):
    """Forward recursion of a two-state Gaussian chain from an even prior."""
    p = state or [0.5, 0.5]
    q = [p[0] * trans[0][j] + p[1] * trans[1][j] for j in (0, 1)]
    if not usable(obs):
        return q, tuple(q)
    like = [
        max(math.exp(-0.5 * ((obs - m) / s) ** 2) / (s * math.sqrt(2 * math.pi)), 1e-15)
        for m, s in zip(means, stds)
    ]
    w = [like[0] * q[0], like[1] * q[1]]
    total = w[0] + w[1]
    out = [w[0] / total, w[1] / total] if total > 0 else q
    return out, tuple(out)


def _floor_eigen(a, b, d, least=1e-10):
    """Clamp the eigenvalues of [[a, b], [b, d]] from below."""
    mid, half = 0.5 * (a + d), 0.5 * (a - d)
    rad = math.hypot(half, b)
    lo, hi = mid - rad, mid + rad
    if lo >= least:
        return a, b, d
    if rad == 0.0:
        return max(a, least), 0.0, max(d, least)
    lo, hi = max(lo, least), max(hi, least)
    c, s = half / rad, b / rad
    mid, rad = 0.5 * (hi + lo), 0.5 * (hi - lo)
    return mid + rad * c, rad * s, mid - rad * c


#: process noise of the trending and the choppy model, measurement noise, transitions
IMM_Q = ((1e-4, 1e-2), (1e-6, 1e-7))
IMM_R = 1e-3
IMM_A = ((0.95, 0.05), (0.05, 0.95))


def imm_step(state, obs, p_trend, p_chop, atr):
    """Two interacting filters mixed by the previous regime weights.

    state: [x, v, a, b, d] of both models and the two weights.
    """
    if state is None:
        state = [obs, 0.0, 1.0, 0.0, 1.0] * 2 + [0.5, 0.5]
    models, w = (state[0:5], state[5:10]), state[10:12]
    out = []
    for j in (0, 1):
        c = max(w[0] * IMM_A[0][j] + w[1] * IMM_A[1][j], 1e-12)
        mu = [IMM_A[i][j] * w[i] / c for i in (0, 1)]
        x = mu[0] * models[0][0] + mu[1] * models[1][0]
        v = mu[0] * models[0][1] + mu[1] * models[1][1]
        a = b = d = 0.0
        for m, u in zip(models, mu):
            dx, dv = m[0] - x, m[1] - v
            a, b, d = a + u * (m[2] + dx * dx), b + u * (m[3] + dx * dv), d + u * (m[4] + dv * dv)
        a, b, d = _floor_eigen(a, b, d)
        x, v, a, b, d = _predict((x, v, a, b, d), *IMM_Q[j])
        x, v, a, b, d = _update(x, v, a, b, d, obs, IMM_R)
        out += [x, v, *_floor_eigen(a, b, d)]
    t, k = max(0.0, p_trend), max(0.0, p_chop)
    t, k = (t / (t + k), k / (t + k)) if t + k > 1e-12 else (0.5, 0.5)
    level, trend = t * out[0] + k * out[5], t * out[1] + k * out[6]
    scale = max(atr if usable(atr) else 1.0, 1e-8)
    return out + [t, k], (level, trend, trend / scale)


def efficiency_step(state, price, window=20, smoothing=0.30):
    """Smoothed efficiency ratio. state: [p or None, recent prices...]."""
    p, recent = (state[0], state[1:]) if state else (None, [])
    if not usable(price):
        cur = 0.5 if p is None else p
        return [p] + recent, (cur, 1.0 - cur)
    recent = (recent + [price])[-(window + 1):]
    if len(recent) < 3:
        return [p] + recent, (0.5, 0.5)
    path = sum(abs(b - a) for a, b in zip(recent, recent[1:]))
    er = min(max(abs(recent[-1] - recent[0]) / path, 0.0), 1.0) if path > 1e-12 else 0.0
    p = er if p is None else smoothing * er + (1.0 - smoothing) * p
    out = min(max(p, 0.0), 1.0)
    return [p] + recent, (out, 1.0 - out)


def cusum_step(state, i, price, threshold, atr, cooldown=10, spatial=1.0, inclusive=False):
    """Two-sided log-return CUSUM with a time and distance gate.

    state: [s+, s-, previous price, last accepted index, last accepted price]. Both sides
    reset on every trigger, accepted or not. ``inclusive`` is the streaming gate.
    """
    if state is None:
        return [0.0, 0.0, price, None, None], 0
    up, dn, prev, last_i, last_p = state
    r = math.log(price / prev)
    up, dn = max(0.0, up + r), min(0.0, dn + r)
    side = 1 if up > threshold else -1 if dn < -threshold else 0
    if side:
        up = dn = 0.0
        if last_i is not None:
            move, need = abs(price - last_p), spatial * atr
            far = move >= need if inclusive else move > need
            if i - last_i < cooldown or not far:
                return [up, dn, price, last_i, last_p], 0
        last_i, last_p = i, price
    return [up, dn, price, last_i, last_p], side


def drift_step(state, score, baseline, threshold, reset=True):
    """One-sided CUSUM of excess error. state: [s]."""
    s = max(0.0, (state[0] if state else 0.0) + score - baseline)
    alarm = s > threshold
    return [0.0 if alarm and reset else s], (s, alarm)


def ewma_step(state, x, alpha, reset=False):
    v = x if state is None or reset else alpha * x + (1.0 - alpha) * state[0]
    return [v], v
