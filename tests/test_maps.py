"""Composed block maps against plain loops."""

import functools

import numpy as np
import pytest

from barloom.operators import maps as mp


def loop(d, t):
    acc, out = 0, []
    for a, b in zip(d.tolist(), t.tolist()):
        acc += a
        out.append(int(acc >= b))
        acc = 0 if acc >= b else acc
    return np.array(out)


@pytest.mark.parametrize("negative", [False, True])
@pytest.mark.parametrize("theta", ["50", "40000", "steps"])
def test_bars_compose_in_any_grouping(negative, theta):
    rng = np.random.default_rng(4)
    n = 3000
    price = np.round(100 + np.cumsum(rng.normal(0, 1, n)), 2)
    if negative:
        price = np.where(rng.random(n) < 0.1, -3 * price, price)
    volume = rng.integers(0, 20, n).astype(float)
    limit = np.repeat(rng.choice([0, -5, 1000.0, 50_000, 1e5, np.nan], n // 50), 50) if theta == "steps" else np.full(n, float(theta))
    low = int(np.minimum(price * volume, 0).sum() * mp.UNITS * 1.01)
    assert (low < 0) == negative
    d, t = mp.amounts(price, volume, limit, low)
    want = loop(np.rint(price * volume * mp.UNITS), np.nan_to_num(np.rint(limit * mp.UNITS), nan=2.0**52))
    assert (mp.Closes(d, t, low).marks(0) == want).all() and want.any()
    for size in (37, 250, 1000):
        blocks = [mp.Closes(d[k : k + size], t[k : k + size], low) for k in range(0, n, size)]
        elements = [b.element() for b in blocks]
        got, product = [], None
        for b, e in zip(blocks, elements):
            carry, done = (0, 0) if product is None else mp.bars_after(product)
            assert done == want[: sum(map(len, got))].sum()
            got.append(b.marks(int(carry)))
            product = e if product is None else mp.bars_product(product, e)
        assert (np.concatenate(got) == want).all()
        while len(elements) > 1:
            elements = [mp.bars_product(*elements[i : i + 2]) if i + 1 < len(elements) else elements[i] for i in range(0, len(elements), 2)]
        assert mp.bars_after(elements[0]) == mp.bars_after(product)


def test_filter_elements_are_associative():
    rng = np.random.default_rng(2)
    price, skip = 50 + np.cumsum(rng.normal(0, 1, 900)), rng.random(900) < 0.2
    at = np.array([0, 1, 4, 100, 300, 650, 899, 900])
    e = [x.tolist() for x in mp.filter_elements(at, price, skip, (1e-4, 1e-5), 1e-2)]
    left = functools.reduce(mp.filter_product, e)
    right = functools.reduce(lambda b, a: mp.filter_product(a, b), e[::-1])
    whole = mp.filter_elements(np.array([0, 900]), price, skip, (1e-4, 1e-5), 1e-2)[0]
    assert np.allclose(left, whole, rtol=1e-11, atol=1e-12) and np.allclose(right, whole, rtol=1e-11, atol=1e-12)


def test_last_moves_carry_over_any_cut():
    rng = np.random.default_rng(5)
    price = np.round(rng.normal(0, 1, 300))
    price[rng.integers(0, 300, 30)] = np.nan
    whole = mp.last_moves(np.array([0, 300]), price, np.array([[np.nan, 1.0]]))
    want, sign = [], 1.0
    for a, b in zip(np.append(np.nan, price[:-1]), price):
        sign = np.sign(b - a) if abs(b - a) > 0 else sign
        want.append(sign)
    assert (whole == want).all()
    at = np.array([0, 1, 2, 90, 91, 200, 300])
    carried, got = None, []
    for (a, b), e in zip(zip(at[:-1], at[1:]), mp.move_elements(at, price)):
        held = (np.nan, 1.0) if carried is None else (carried[1], carried[2] or 1.0)
        got += mp.last_moves(np.array([0, b - a]), price[a:b], np.array([held])).tolist()
        carried = e if carried is None else mp.moves_product(carried, e)
    assert got == want
