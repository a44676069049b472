"""Kernel steps against matrix forms, solvers against direct computations."""

import numpy as np
import pytest

from barloom.functions import kernels as kn
from barloom.operators import portfolio as pf
from barloom.streaming import stateful as sf

F2 = np.array([[1.0, 1.0], [0.0, 1.0]])
H = np.array([[1.0, 0.0]])


def kalman(x, p, z, q, r):
    x, p = F2 @ x, F2 @ p @ F2.T + q
    s = (H @ p @ H.T)[0, 0] + r
    k = p @ H.T / s
    return x + k * (z - x[0, 0]), (np.eye(2) - k @ H) @ p


def test_trend_step_is_the_matrix_filter():
    z = 100 + np.cumsum(np.random.default_rng(0).normal(0, 1, 80))
    x, p, s = np.array([[z[0]], [0.0]]), np.eye(2), None
    for i, v in enumerate(z):
        if i:
            x, p = kalman(x, p, v, np.diag([1e-4, 1e-5]), 1e-2)
        s, o = kn.trend_step(s, float(v))
        assert np.allclose(o, x.ravel(), rtol=1e-9)


def test_missing_value_only_predicts():
    s, _ = kn.trend_step(None, 10.0)
    s, _ = kn.trend_step(s, 11.0)
    before = list(s)
    s, o = kn.trend_step(s, None)
    assert o == (before[0] + before[1], before[1])


def clean(m):
    v, e = np.linalg.eigh((m + m.T) / 2)
    return (e * np.maximum(v, 1e-10)) @ e.T


def test_imm_step_is_the_mixed_matrix_filter():
    rng = np.random.default_rng(1)
    z = 50 + np.cumsum(rng.normal(0, 0.5, 40))
    a = np.array(kn.IMM_A)
    xs, ps, w = [np.array([[z[0]], [0.0]])] * 2, [np.eye(2)] * 2, np.array([0.5, 0.5])
    state = None
    for v in z:
        pt = float(rng.random())
        c = w @ a
        mu = a * w[:, None] / c
        nx, np_ = [], []
        for j in (0, 1):
            x0 = sum(mu[i, j] * xs[i] for i in (0, 1))
            p0 = clean(sum(mu[i, j] * (ps[i] + (xs[i] - x0) @ (xs[i] - x0).T) for i in (0, 1)))
            x, p = kalman(x0, p0, v, np.diag(kn.IMM_Q[j]), kn.IMM_R)
            nx.append(x)
            np_.append(clean(p))
        xs, ps, w = nx, np_, np.array([pt, 1 - pt])
        want = w[0] * xs[0] + w[1] * xs[1]
        state, (lvl, tr, score) = kn.imm_step(state, float(v), pt, 1 - pt, 2.0)
        assert np.allclose([lvl, tr, score], [want[0, 0], want[1, 0], want[1, 0] / 2.0], rtol=1e-8, atol=1e-10)


def test_trigger_that_fails_the_gate_still_resets():
    s, _ = kn.cusum_step(None, 0, 100.0, 0.01, 1.0, cooldown=5)
    s, a = kn.cusum_step(s, 1, 103.0, 0.01, 1.0, cooldown=5)
    s, b = kn.cusum_step(s, 2, 106.0, 0.01, 1.0, cooldown=5)
    assert (a, b) == (1, 0) and s[0] == 0.0 and s[3] == 1


def test_spatial_gate_is_inclusive_only_online():
    for inclusive, want in ((False, 0), (True, 1)):
        s = [0.0, 0.0, 100.0, 0, 100.0]
        _, side = kn.cusum_step(s, 9, 102.0, 0.01, 2.0, cooldown=5, spatial=1.0, inclusive=inclusive)
        assert side == want


def test_finished_weights_are_neutral_and_scaled():
    rng = np.random.default_rng(3)
    w, beta = rng.normal(0, 1, 14), rng.normal(1, 0.3, 14)
    out = pf.np_finish(w, beta, 1.0, 0.2)
    assert abs(out.sum()) < 1e-9 and abs(out @ beta) < 1e-9 and np.isclose(np.abs(out).sum(), 1.0)


def test_cap_respects_the_limit_when_feasible():
    out = pf.np_cap(np.array([5.0, 1, 1, 1, -1, -1, -1]), 1.0, 0.2)
    assert np.abs(out).max() <= 0.2 + 1e-9 and np.isclose(np.abs(out).sum(), 1.0)


def test_two_names_are_not_a_neutral_book():
    assert (pf.np_project(np.array([0.5, -0.4, 0.0])) == 0).all()


def test_complete_linkage_merges_below_the_cut():
    from barloom.operators.learn import complete_linkage

    d = np.array([[0, 0.1, 0.9], [0.1, 0, 0.8], [0.9, 0.8, 0]])
    lab = complete_linkage(d, 0.3)
    assert lab[0] == lab[1] != lab[2]


def test_stationarity_test_separates_noise_from_a_walk():
    from barloom.operators.features import adf_p_value

    e = np.random.default_rng(4).normal(0, 1, 400)
    assert adf_p_value(e) < 0.01 and adf_p_value(np.cumsum(e)) > 0.05


def test_exit_state_labels_a_position_once():
    rules = sf.ExitRules(t_max=5)
    s, a = sf.exit_step(None, 0, 100, 101, 99, 100, 1.0, 0.9, 0.0, 1, False, rules)
    assert a[0] == "ENTRY"
    s, a = sf.exit_step(s, 1, 100, 101, 99.5, 100, 1.0, 0.9, 0.0, 0, False, rules)
    assert a[0] == "HOLD"
    s, a = sf.exit_step(s, 2, 100, 100, 80, 82, 1.0, 0.9, 0.0, 0, False, rules)
    assert a[0] == "TRAIL" and s is None  # the second bar has moved the stop from 97.96 to 99
    assert a[2] == 99.0


def test_last_drawdown_tier_latches():
    s, _ = sf.tier_step(None, 100.0, 0)
    s, o = sf.tier_step(s, 80.0, 1)
    s, p = sf.tier_step(s, 100.0, 2)
    assert o[0] == p[0] == "KILL"


def test_cap_equals_plain_fillings():
    rng = np.random.default_rng(6)
    for _ in range(400):
        w = rng.normal(0, 1, rng.integers(1, 25)) * rng.choice([0.0, 1.0, 5.0])
        want = w / max(np.abs(w).sum(), 1e-300)
        for _ in range(8):
            big = np.abs(want) > 0.2 + 1e-12
            if big.any():
                want = np.where(big, np.sign(want) * 0.2, want)
                room, small = 1 - 0.2 * big.sum(), np.abs(want[~big]).sum()
                if room <= 0 or small <= 1e-12:
                    break
                want = np.where(big, want, want * room / small)
        assert np.allclose(pf.np_cap(w, 1.0, 0.2), want, atol=1e-9)


@pytest.mark.parametrize("rule", ["v1", "v2"])
def test_hysteresis_holds_a_name_until_it_leaves_its_zone(rule):
    h = pf.Hysteresis(rule)
    held = lambda k, order: {x: s for x, s, *_ in h.step(8, k, order[::-1][:3], order[:3])}
    assert held(1, list("abcdefgh")) == {"a": 1.0, "h": -1.0}
    assert held(1, list("bcadefhg")) == {"a": 1.0, "h": -1.0}  # third on either side: both stay
    assert held(1, list("bcdaefhg")) == {"b": 1.0, "h": -1.0}  # a left its zone
    assert held(2, list("bcdaefhg")) == {"b": 1.0, "c": 1.0, "h": -1.0, "g": -1.0}
    assert h.step(3, 1, ["a"], ["b"]) == [] and held(1, list("hgfedcba")) == {"h": 1.0, "a": -1.0}
