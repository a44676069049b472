"""Kelly fractions, their bootstrap and overfitting against direct computations."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import sizing as sz


def root(r, top, w=None):
    w = np.ones(len(r)) if w is None else w
    if w.sum() < 5 or (w * r).sum() <= 0:
        return 0.0
    low = r[w > 0].min()
    top = min(top, 0.999 / abs(low)) if low < 0 else top
    a, b = 0.0, top
    if (w * r / (1 + top * r)).sum() > 0:
        return top
    for _ in range(80):
        m = (a + b) / 2
        a, b = (m, b) if (w * r / (1 + m * r)).sum() > 0 else (a, m)
    return (a + b) / 2


@pytest.fixture(scope="module")
def trades():
    rng = np.random.default_rng(3)
    parts = {"many": rng.normal(0.002, 0.05, 4000), "tiny": rng.normal(3e-8, 4e-7, 500), "loss": rng.normal(-0.01, 0.05, 300), "few": np.array([0.1, 0.2]), "gain": np.abs(rng.normal(0.01, 0.01, 50))}
    return {k: v for k, v in parts.items()}, pd.concat([pd.DataFrame({"k": k, "ret": v}) for k, v in parts.items()])


def test_kelly_fraction_of_all_groups_at_once(spark, trades):
    parts, pdf = trades
    got = {r.k: (r.n, r.f_point) for r in sz.kelly_fraction(spark.createDataFrame(pdf), ["k"], F.lit(20.0)).collect()}
    assert got.keys() == parts.keys()
    for k, r in parts.items():
        assert got[k][0] == len(r) and got[k][1] == pytest.approx(root(r, 20.0), abs=2e-9)
    with pytest.raises(Exception, match="below -100%"):
        sz.kelly_fraction(spark.createDataFrame(pd.DataFrame({"k": "a", "ret": [-1.5, 9.0] * 5})), ["k"], F.lit(20.0)).collect()


def test_bootstrap_kelly_sums_over_rows(spark, trades, monkeypatch):
    parts, pdf = trades
    df = spark.createDataFrame(pdf).repartition(3)
    got = {r.k: r for r in sz.bootstrap_kelly(df, ["k"], F.lit(20.0), 60, 25.0).collect()}
    again = {r.k: r for r in sz.bootstrap_kelly(df, ["k"], F.lit(20.0), 60, 25.0).collect()}
    assert got == again
    r = parts["many"]
    rng = np.random.default_rng(0)
    want = np.array([root(r, 20.0, rng.poisson(1, len(r))) for _ in range(400)])
    assert abs(got["many"].f_low - np.quantile(want, 0.25)) < 4 * want.std() / np.sqrt(60) and got["many"].f_std == pytest.approx(want.std(), rel=0.4)
    assert got["few"].f_low == 0.0 and got["loss"].f_point == 0.0 and got["gain"].f_low == 20.0


def test_draws_are_poisson_counts():
    w = sz._draws(np.arange(3000), np.arange(50), 42)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.08 and (w[10] == sz._draws(np.array([10]), np.arange(50), 42)[0]).all()


def test_draws_of_equal_rows_are_those_of_their_sum():
    for c in (2, 7, 300, 2_000_000):
        w = sz._draws(np.arange(400) * 7919, np.arange(100), 42, np.full(400, c))
        assert w.mean() == pytest.approx(c, abs=6 * np.sqrt(c / w.size)) and w.var() == pytest.approx(c, rel=0.05)
    least, table = sz._poisson(2)
    assert least == 0 and np.diff(table[:4]) == pytest.approx([2 * np.exp(-2), 2 * np.exp(-2), 4 / 3 * np.exp(-2)], rel=1e-12)


def test_bootstrap_sees_distinct_returns_only(spark, monkeypatch):
    r = np.array([-0.05, -0.02, 0.01, 0.03, 0.06])
    df = spark.range(40_000).select((F.col("id") % 2).alias("k"), F.element_at(F.array(*map(F.lit, r.tolist())), (F.col("id") % 5 + 1).cast("int")).alias("ret"))
    seen = []
    run = sz._resampled
    monkeypatch.setattr(sz, "_resampled", lambda rows, *a: seen.append(rows.count()) or run(rows, *a))
    got = {x.k: x for x in sz.bootstrap_kelly(df, ["k"], F.lit(20.0), 300).collect()}
    assert set(seen) == {10}
    other = {x.k: x for x in sz.bootstrap_kelly(df.repartition(5), ["k"], F.lit(20.0), 300).collect()}
    assert got == other
    rng = np.random.default_rng(0)
    want = np.array([root(r, 20.0, rng.poisson(4000, 5)) for _ in range(400)])
    for x in got.values():
        assert x.n == 20_000 and x.f_point == pytest.approx(root(r, 20.0), abs=2e-9)
        assert x.f_low == pytest.approx(np.quantile(want, 0.25), abs=5 * want.std() / np.sqrt(300)) and x.f_std == pytest.approx(want.std(), rel=0.2)


def test_pbo_over_all_halves(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(0, 1, (40, 5)), 1)
    df = spark.createDataFrame([(f"c{j}", i, float(x[i, j])) for i in range(40) for j in range(5)], "config string, ti int, ret double")
    blocks = [b.sum(0) for b in np.array_split(x, 8)]
    under = []
    for pick in itertools.combinations(range(8), 4):
        inside = np.round(sum(blocks[i] for i in pick), 9)
        outside = np.round(sum(blocks[i] for i in range(8) if i not in pick), 9)
        best = int(inside.argmax())
        place = (outside < outside[best]).sum() + (outside[:best] == outside[best]).sum()
        under.append(place / 4 < 0.5)
    got = sz.pbo(df, 8, part=16).first()
    assert got.n_combinations == len(under) == 70 and got.pbo == pytest.approx(np.mean(under), abs=0.03)
    assert sz._halves(16).shape == (12870, 16)
