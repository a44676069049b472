"""No look-ahead, planted effects, hand values and source round trips."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import attribution as at
from barloom.operators import evaluate as ev
from barloom.operators import events as et
from barloom.operators import ledger as lg
from barloom.operators import portfolio as pf
from barloom.operators import signals as sg
from barloom.sources import tables as tb


def frame(spark, seed=42, n=80, names=12, change_from=None):
    rng = np.random.default_rng(seed)
    r = rng.normal(0, 0.02, (n, names))
    if change_from is not None:
        r[change_from:] = rng.normal(0, 0.05, (n - change_from, names))
    close = 100 * np.exp(np.cumsum(r, axis=0))
    rows = [
        (f"S{j:02d}", i, i * 14_400_000, float(close[i, j]), float(close[i, j] * 1.01), float(close[i, j] * 0.99), 10.0 + j, 5.0, float(np.sin(i + j)), float(np.cos(i * j) * 1e-4))
        for i in range(n) for j in range(names)
    ]
    cols = ["symbol", "ti", "ts_ms", "close", "high", "low", "volume", "tick_count", "ofi", "funding"]
    return spark.createDataFrame(pd.DataFrame(rows, columns=cols)).withColumn("ti", F.col("ti").cast("int"))


def test_signals_do_not_see_the_future(spark):
    names = ["mom_fast", "carry_level", "ofi_fast", "low_idio_vol", "close_location"]
    params = {"low_idio_vol": {"window": 20}}
    a, b = (
        sg.build_signals(frame(spark, change_from=c), names, params).filter("ti < 50").orderBy("symbol", "ti").toPandas() for c in (None, 50)
    )
    pd.testing.assert_frame_equal(a, b)


def test_weights_do_not_see_the_future(spark):
    spec = pf.PortfolioSpec(n_positions=6, vol_window=15, beta_window=20)
    out = []
    for c in (None, 50):
        p = sg.build_signals(pf.with_risk(frame(spark, change_from=c), spec), ["mom_fast"], keep=("close", "vol", "beta", "r1"))
        w = pf.build_weights(p, "mom_fast", spec, risk=False)
        out.append(w.filter("ti < 50").orderBy("symbol", "ti").toPandas())
    pd.testing.assert_frame_equal(*out)
    s = out[0].groupby("ti").w.agg(["sum", lambda v: v.abs().sum()])
    live = s.iloc[:, 1] > 0
    assert live.any() and np.allclose(s[live]["sum"], 0, atol=1e-9) and np.allclose(s[live].iloc[:, 1], 1.0)


def test_perfect_foresight_has_unit_correlation(spark):
    from barloom.functions import frames as fr

    p = ev.with_forward(frame(spark), (1,)).withColumn("s", F.col("fwd_1"))
    ic = ev.information_coefficient(p, "s", (1,)).toPandas().ic
    assert len(ic) == 79 and np.allclose(ic, 1.0)


def test_drift_lowers_turnover_to_the_traded_amount(spark):
    rows = [("A", 0, 100.0, 0.5), ("B", 0, 100.0, -0.5), ("A", 1, 110.0, 0.5), ("B", 1, 100.0, -0.5), ("A", 2, 110.0, 0.5), ("B", 2, 100.0, -0.5)]
    p = spark.createDataFrame(rows, "symbol string, ti int, close double, w double").withColumn("ts_ms", F.col("ti").cast("long"))
    a = at.simulate(p, at.CostModel()).orderBy("ti").toPandas()
    assert np.isclose(a.gross[0], 0.05) and np.isclose(a.turnover[0], 1.0)
    drift = abs(0.5 - 0.5 * 1.1 / 1.05) + abs(-0.5 + 0.5 / 1.05)
    assert np.isclose(a.turnover[1], drift) and pd.isna(a.ret[2])


def test_mark_to_market_compounds_to_the_coarse_return(spark):
    p = frame(spark, n=21).withColumn("w", F.when(F.col("ti") % 5 == 0, F.when(F.col("symbol") < "S06", 1 / 12).otherwise(-1 / 12)))
    fine = at.mark_to_market(p.drop("funding"), 5).orderBy("ti").toPandas()
    coarse = at.simulate(pf.sample_marks(p.drop("funding"), 5)).orderBy("ti").toPandas()
    for k in range(4):
        seg = fine[(fine.ti > 5 * k) & (fine.ti <= 5 * k + 5)]
        assert np.isclose(np.prod(1 + seg.gross) - 1, coarse.gross[k])


def test_resample_keeps_hand_values(spark):
    h = 3_600_000
    rows = [("A", i * h, 1.0 + i, 2.0 + i, 0.0 + i, 1.5 + i - 0.5, 10.0, 3, 1.0 if i % 2 else -1.0) for i in range(10)]
    b = spark.createDataFrame(rows, "symbol string, ts_ms long, open double, high double, low double, close double, volume double, tick_count long, ofi double")
    r = lg.resample_bars(b, h, 4 * h).orderBy("bucket_ms").toPandas()
    assert len(r) == 2  # the third bucket has two of four hours
    assert r.open[0] == 1.0 and r.high[0] == 5.0 and r.low[0] == 0.0 and r.close[0] == 4.0 and r.volume[0] == 40.0 and r.tick_count[0] == 12 and r.ofi[0] == 0.0


def test_uniqueness_of_overlapping_labels(spark):
    l = spark.createDataFrame([("A", 0, 2, 0.1), ("A", 1, 3, -0.2), ("A", 5, 6, 0.0)], "symbol string, t0 int, t1 int, realized_return double")
    b = spark.createDataFrame([("A", i) for i in range(8)], "symbol string, bar_idx int")
    u = et.average_uniqueness(l, et.concurrency(l, b)).orderBy("t0").toPandas().uniqueness
    assert np.allclose(u, [(1 + 0.5 + 0.5) / 3, (0.5 + 0.5 + 1) / 3, 1.0])


def test_purged_folds_leave_no_violation(spark):
    e = spark.createDataFrame([("A", i, i + 7) for i in range(0, 400, 3)], "symbol string, t0 int, t1 int")
    s = et.purged_kfold(e, 5, 24)
    assert et.purge_violations(s, 24).agg(F.sum("violations")).first()[0] == 0
    both = s.filter("role = 'train'").join(s.filter("role = 'test'"), ["fold", "t0"]).count()
    assert both == 0


def test_path_risk_against_a_loop(spark):
    r = np.random.default_rng(8).normal(0.001, 0.03, 66)
    df = spark.createDataFrame(pd.DataFrame({"ti": range(66), "ret": r}))
    got = at.path_risk(df, [1.0, 8.0], 6, 0.01).orderBy("leverage").toPandas()
    for lev, row in zip((1.0, 8.0), got.itertuples()):
        eq = peak = 1.0
        dd, ruined = 0.0, 0
        for p in range(11):
            c = np.cumsum(r[p * 6:(p + 1) * 6])
            if (1 + lev * c <= 0.01 * lev).any():
                ruined, dd, eq = ruined + 1, 1.0, eq * max(1e-12, 1 + lev * c[0])
                continue
            path = eq * (1 + lev * c)
            peak = max(peak, path.max())
            dd, eq = max(dd, 1 - path.min() / peak), path[-1]
        assert np.isclose(row.max_dd, dd) and np.isclose(row.ruin_share, ruined / 11)


def test_sources_round_trip(spark, tmp_path):
    bars = spark.createDataFrame([("A", 1, 1.0, 2.0, 0.5, 1.5, 9.0, 3, 0.1), ("A", 2, 1.5, 2.0, 1.0, 1.2, 8.0, 2, -0.1)], tb.BAR_SCHEMA)
    p = str(tmp_path / "bars.csv")
    bars.write.option("header", "true").csv(p)
    assert sorted(tb.read_bars(spark, p).collect()) == sorted(bars.collect())
    new = bars.limit(1).withColumn("close", F.lit(7.0))
    up = tb.upsert_bars(bars, new)
    assert up.count() == 2 and up.filter("close = 7.0").count() == 1
    log = tmp_path / "log.jsonl"
    log.write_text('{"timestamp_ms": 1, "equity": 2.0, "other": 3}\n\nnot json\n{"timestamp_ms": 2}\n')
    assert tb.read_jsonl(spark, str(log)).count() == 2
    assert tb.count_trials(spark, str(log)).first()[0] == 3
    sp = tmp_path / "spreads.json"
    sp.write_text(json.dumps({"A": 1.5, "B": 2.0}))
    assert {(r.symbol, r.spread_bps) for r in tb.read_spreads(spark, str(sp)).collect()} == {("A", 1.5), ("B", 2.0)}
    out = str(tmp_path / "seg")
    tb.export_segments({"train": bars, "holdout": bars}, out)
    assert spark.read.option("header", "true").csv(out).groupBy("segment").count().count() == 2
    part = str(tmp_path / "part")
    tb.write_partitioned(bars, part, "symbol")
    tb.write_partitioned(bars, part, "symbol")
    assert spark.read.parquet(part).count() == 2


def test_stream_and_batch_features_agree(spark, tmp_path):
    from barloom.operators import features as ft
    from barloom.streaming import stateful as sf

    b = frame(spark, n=40, names=3).withColumn("open", F.col("close"))
    src = str(tmp_path / "src")
    b.drop("ti").write.parquet(src)
    s = spark.readStream.schema(b.drop("ti").schema).parquet(src)
    got = sf.drain(sf.bar_features(s), str(tmp_path / "out")).drop("late").orderBy("symbol", "ts_ms").toPandas()
    want = ft.batch_features(ft.indexed(b)).select("symbol", "ts_ms", *ft.DERIVED).orderBy("symbol", "ts_ms").toPandas()
    pd.testing.assert_frame_equal(got, want, rtol=1e-9, atol=1e-12)


def test_late_rows_are_marked(spark, tmp_path):
    from barloom.streaming import stateful as sf

    src = str(tmp_path / "src")
    mk = lambda t: spark.createDataFrame([("A", t, 100.0 + t)], "symbol string, ts_ms long, close double").coalesce(1)
    mk(10).write.parquet(src)
    s = lambda: spark.readStream.schema("symbol string, ts_ms long, close double").parquet(src)
    out = str(tmp_path / "out")
    sf.drain(sf.trend(s()), out)
    mk(5).write.mode("append").parquet(src)
    r = sf.drain(sf.trend(s()), out).orderBy("ts_ms").toPandas()
    assert r.late.tolist() == [True, False]
