"""Blocked windows, carried values, exact quantiles and scans against one-pass results."""

import glob

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import kernels as kn
from barloom.operators import ordered as od
from barloom.operators import sizing as sz
from barloom.operators import ticks as tk


@pytest.fixture(scope="module")
def ticks(spark):
    """Three symbols, one of them holding most rows; repeated prices and timestamps."""
    rng = np.random.default_rng(5)
    rows = []
    for sym, n in ((1, 900), (2, 60), (3, 7)):
        price = np.round(100 + np.cumsum(rng.normal(0, 1, n)), 1)
        spike = rng.random(n) < 0.02
        price = np.where(spike, price * 1.5, price)
        for i in range(n):
            rows.append((sym, int(i // 3) * 3_600_000, i, float(price[i]), float(rng.integers(1, 20))))
    pdf = pd.DataFrame(rows, columns=["symbol", "ts_ms", "seq", "price", "volume"])
    return pdf, spark.createDataFrame(pdf.sample(frac=1, random_state=1))


def by_key(df):
    return df.toPandas().sort_values(["symbol", "pos"]).reset_index(drop=True)


def test_positions_count_every_row_once(ticks):
    pdf, df = ticks
    got = by_key(tk.numbered(df))
    want = pdf.sort_values(["symbol", "ts_ms", "seq"]).groupby("symbol").cumcount()
    assert got.pos.tolist() == want.tolist()
    assert got.seq.tolist() == pdf.sort_values(["symbol", "seq"]).seq.tolist()


def test_blocked_windows_equal_whole_windows(ticks):
    _, df = ticks
    n = tk.numbered(df)
    small, whole = (by_key(tk.flag_ticks(n, 20, b)) for b in (64, 1 << 20))
    pd.testing.assert_frame_equal(small[whole.columns], whole)
    assert whole.is_bad.sum() > 0


def test_fill_forward_crosses_blocks(ticks):
    pdf, df = ticks
    n = tk.numbered(df).withColumn("v", F.when(F.col("pos") % 97 == 5, F.col("price")))
    got = by_key(od.fill_forward(n, ["symbol"], "v", "f", 16))
    want = got.groupby("symbol").v.ffill()
    pd.testing.assert_series_equal(got.f, want, check_names=False)


def test_tick_sign_in_blocks(ticks):
    _, df = ticks
    n = tk.numbered(df)
    a, b = by_key(tk.tick_sign(n, block_rows=32)), by_key(tk.tick_sign(n))
    assert a.sign.tolist() == b.sign.tolist()


@pytest.mark.parametrize("scale", [0.1, 1.0, 1e6])
def test_kalman_by_composed_maps(ticks, scale):
    """The same bits for any block size, and one sequential pass up to rounding."""
    _, df = ticks
    f = tk.flag_ticks(tk.numbered(df.withColumn("price", F.when(F.col("seq") > 3, F.col("price") * scale))), 20)
    a, b, c = (by_key(tk.replace_bad_ticks(f, rows, segment=64)) for rows in (64, 1000, 1 << 20))
    pd.testing.assert_frame_equal(a, b, check_exact=True)
    pd.testing.assert_frame_equal(a, c, check_exact=True)
    state, want = None, []
    for r in a.itertuples():
        if r.pos == 0:
            state = None
        state, o = kn.replace_tick(state, r.price, r.is_bad)
        want.append([*o, *(state or [np.nan] * 5)[2:]])
    want = np.array(want, float)
    got = a[["clean_price", "level", "trend", "p00", "p01", "p11"]].to_numpy(float)
    size = np.maximum(np.abs(want), [scale, scale, scale, 1, 1, 1])
    assert (np.isnan(got) == np.isnan(want)).all() and np.nanmax(np.abs(got - want) / size) < 1e-13
    whole = by_key(tk.replace_bad_ticks(f, segment=1 << 20))[["clean_price", "level", "trend"]].to_numpy(float)
    assert np.array_equal(whole, want[:, :3], equal_nan=True)


def test_carried_in_levels(spark):
    """Products over three levels of groups equal one running product, in order."""
    rows = [(k, i * 3 + k, [float(i + 1), float(i % 3)]) for k in (1, 2) for i in range(40 if k == 1 else 1)]
    df = spark.createDataFrame(rows, "k long, i long, e array<double>")
    then = lambda a, b: [float(a[0] * b[0] % 1009), float((a[1] * b[0] + b[1]) % 1009)]
    got = {(r.k, r.i): r.before for r in od.carried(df, ["k"], "i", "e", then, fan=4).collect()}
    for k in (1, 2):
        before = None
        for kk, i, e in rows:
            if kk == k:
                assert got[(k, i)] == before
                before = e if before is None else then(before, e)
    assert len(got) == 41


def test_positions_of_one_hot_symbol_with_unique_times(spark):
    """One tick a millisecond: no window or group holds the symbol's ticks."""
    df = spark.range(20_000).select(F.lit(1).alias("symbol"), (20_000 - F.col("id")).alias("ts_ms"), F.lit(0).alias("seq"))
    n = tk.numbered(df)
    plan = n._jdf.queryExecution().executedPlan().toString()
    got = n.agg(F.min("pos"), F.max("pos"), F.count_distinct("pos"), F.sum(F.abs(F.col("pos") - F.col("ts_ms") + 1))).first()
    assert tuple(got) == (0, 19_999, 20_000, 0)
    assert "_at" in plan and plan.count("Window") == 1 and "row_number" not in plan


def test_dollar_bars_by_composed_maps(ticks):
    _, df = ticks
    n = tk.numbered(df).withColumn("theta", F.lit(5_000.0))
    cols = ["symbol", "bar_idx"]
    a, b = (tk.dollar_bars(n, "price", 5, r).toPandas().sort_values(cols).reset_index(drop=True) for r in (50, 1 << 20))
    pd.testing.assert_frame_equal(a, b)
    assert (b.tick_count > 0).all() and len(b) > 20


@pytest.mark.parametrize("block", [700, 10_000])
def test_dollar_bars_of_two_thousand_ticks(spark, block):
    """Bars of about 2000 ticks over many blocks, with steps of the threshold, against a plain loop."""
    rng = np.random.default_rng(9)
    n = 80_000 if block > 2000 else 15_000
    price, volume = np.round(100 + np.cumsum(rng.normal(0, 0.05, n)), 2), rng.integers(0, 20, n).astype(float)
    theta = np.repeat(rng.choice([1.9e6, 2.1e6, 0.0, 1.0], n // 500, p=[0.5, 0.46, 0.02, 0.02]), 500)
    pdf = pd.DataFrame({"symbol": 1, "pos": range(n), "ts_ms": range(n), "price": price, "volume": volume, "theta": theta})
    got = by_key(tk.cut_bars(spark.createDataFrame(pdf), "price", block))
    acc, closes, bar, want = 0, 0, 0, []
    for p, v, t in zip(price, volume, theta):
        acc += round(p * v * 10_000)
        closes = int(acc >= round(t * 10_000))
        want.append((closes, bar))
        acc, bar = (0, bar + 1) if closes else (acc, bar)
    assert list(zip(got.closes, got.bar)) == want
    move = np.sign(np.diff(price, prepend=price[0]))
    assert got.sign.tolist() == pd.Series(np.where(move == 0, np.nan, move)).ffill().fillna(1.0).tolist()


def test_scan_settles_when_nothing_is_forgotten(spark):
    """A plain running sum never coalesces; the scan must still be the one-pass result."""
    from pyspark.sql import types as T

    pdf = pd.DataFrame({"k": ["a"] * 50 + ["b"] * 3, "pos": list(range(50)) + list(range(3)), "x": np.arange(53.0)})
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("s", T.DoubleType())])

    def kernel(state, p):
        s = np.cumsum(p["x"].to_numpy()) + state[0]
        return [float(s[-1])], p[["k", "pos"]].assign(s=s)

    df = spark.createDataFrame(pdf)
    got = od.scan(df, ["k"], kernel, schema, [0.0], ["x"], block_rows=10).toPandas().sort_values(["k", "pos"])
    assert got.s.tolist() == pdf.groupby("k").x.cumsum().tolist()


def test_cross_venue_against_brute_force(spark):
    rng = np.random.default_rng(2)
    t = np.sort(rng.integers(0, 50_000, 300))
    r = np.sort(rng.integers(0, 50_000, 200))
    tick = pd.DataFrame({"symbol": 1, "ts_ms": t, "seq": range(300), "price": 100 + rng.normal(0, 1, 300), "volume": 1.0})
    ref = pd.DataFrame({"symbol": 1, "ts_ms": r, "seq": range(200), "price": 100 + rng.normal(0, 1, 200)})
    ref["sigma"] = np.where(np.arange(200) < 20, np.nan, 1.0)
    n = tk.numbered(spark.createDataFrame(tick))
    rs = spark.createDataFrame(ref).withColumn("sigma", F.when(~F.isnan("sigma"), F.col("sigma")))
    got = tk.cross_venue(n, rs, 500, 2.0, block_ms=1000).orderBy("pos").toPandas().confirmed.tolist()
    want = []
    for x in t:
        near, past = ref[(ref.ts_ms >= x - 500) & (ref.ts_ms <= x + 500)], ref[ref.ts_ms <= x]
        if near.empty or past.empty or not past.sigma.iloc[-1] > 0:
            want.append(False)
        else:
            want.append(bool((near.price - past.price.iloc[-1]).abs().max() < 2.0 * past.sigma.iloc[-1]))
    assert got == want and any(want) and not all(want)


def test_exact_quantiles_with_heavy_ties(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([np.full(400, 0.5), rng.random(333)])
    df = spark.createDataFrame(pd.DataFrame({"k": ["a"] * len(x), "x": x}))
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = sz.exact_quantiles(df, ["k"], "x", qs, sz.unit_bucket()).orderBy("q").toPandas()
    assert np.allclose(got.value, np.quantile(x, qs))
    one = sz.exact_quantiles(df.drop("k"), [], "x", qs, sz.unit_bucket()).orderBy("q").toPandas()
    assert np.allclose(one.value, np.quantile(x, qs))


def test_positions_of_keys_that_straddle_ranges_and_of_missing_keys(spark):
    df = spark.range(6000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("symbol"), F.xxhash64("id").alias("t"), F.lit("x").alias("more"))
    got = od.positions(df, ["symbol"], ["t"]).toPandas()
    assert list(got.columns) == ["symbol", "t", "more", "pos"] and len(got) == 6000
    for _, g in got.groupby("symbol", dropna=False):
        assert g.sort_values("t")["pos"].tolist() == list(range(2000))


def test_rows_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    d = od.kept(spark.range(1000).mapInArrow(run, "id long"))
    assert d.count() == 1000 and seen.value == 1000


def test_dollar_bars_keep_one_table_of_ticks(ticks):
    """Tables of ticks go when the next is written, and products of segments are not joined to ticks."""
    _, df = ticks
    kept = lambda: set(glob.glob(od.checkpoint_dir(df.sparkSession).removeprefix("file:") + "/rows-*"))
    had = kept()
    bars = tk.build_dollar_bars(df, None, 5, 0.2, 5)
    assert len(kept() - had) == 1
    assert bars.count() > 0
    plain = tk.clean_ticks(df, None, 20)
    assert len(kept() - had) == 2 and plain.count() == df.count()
    states = tk.replace_bad_ticks(tk.flag_ticks(tk.numbered(df), 20), segment=64)
    assert "LeftOuter" not in states._jdf.queryExecution().executedPlan().toString()
    assert states.count() == df.count()
