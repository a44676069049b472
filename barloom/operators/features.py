"""Per-bar features. Bars are bounded by the calendar, so windows run per symbol."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions import frames as fr
from barloom.functions import kernels as kn
from barloom.operators.ordered import per_series

BAR = dict(order="bar_idx")


def _o():
    """Bars of a symbol in order (built on use: workers import this module too)."""
    return Window.partitionBy("symbol").orderBy("bar_idx")


def indexed(bars: DataFrame) -> DataFrame:
    """Bars with ``bar_idx`` counted per symbol."""
    return bars.withColumn("bar_idx", F.row_number().over(Window.partitionBy("symbol").orderBy("ts_ms")) - 1)


def with_gap_mask(bars: DataFrame, gap_ms: int, window: int) -> DataFrame:
    """True in the first ``window`` rows and in ``window`` rows from each gap start."""
    gap = F.col("ts_ms") - F.lag("ts_ms").over(_o()) > gap_ms
    b = bars.withColumn("_i", F.row_number().over(_o()) - 1)
    b = b.withColumn("_g", F.when(gap, F.col("_i")))
    last = F.last("_g", ignorenulls=True).over(_o().rowsBetween(Window.unboundedPreceding, 0))
    hit = (F.col("_i") < window) | F.coalesce(F.col("_i") - last < window, F.lit(False))
    return b.withColumn("insufficient_history", hit).drop("_i", "_g")


def true_range() -> Column:
    pc = F.lag("close").over(_o())
    span = F.col("high") - F.col("low")
    return F.when(pc.isNull(), span).otherwise(
        F.greatest(span, F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))
    )


def with_atr(bars: DataFrame, window: int = 14) -> DataFrame:
    b = bars.withColumn("tr", true_range())
    return b.withColumn("atr_14", F.avg("tr").over(_o().rowsBetween(-(window - 1), 0)))


DERIVED = ("hl_spread", "ret_1", "ret_5", "vol_ratio", "range_position", "ofi_ma5", "volume_z", "ret_zscore")


def _change(n: int) -> Column:
    p = F.lag("close", n).over(_o())
    return F.coalesce(fr.div(F.col("close") - p, p), F.lit(0.0))


def feature_columns(names=DERIVED) -> dict[str, Column]:
    """The derived bar features by name; neutral values before their warm-up."""
    f20 = _o().rowsBetween(-19, 0)
    span = F.col("high") - F.col("low")
    floor = lambda c: F.greatest(c, F.lit(1e-6))
    vol_sd = F.stddev_pop("volume").over(f20)
    n_ret = F.count("_r").over(f20)
    ret_sd = F.stddev_pop("_r").over(f20)
    all_cols = {
        "hl_spread": span / floor(F.col("close")),
        "ret_1": _change(1),
        "ret_5": _change(5),
        "vol_ratio": F.col("volume") / floor(F.avg("volume").over(f20)),
        "range_position": F.when(span <= 1e-12, 0.5).otherwise((F.col("close") - F.col("low")) / F.nullif(span, F.lit(0.0))),
        "ofi_ma5": F.avg("ofi").over(_o().rowsBetween(-4, 0)),
        "volume_z": F.when((F.count("volume").over(f20) < 5) | (vol_sd <= 1e-12), 0.0).otherwise(
            (F.col("volume") - F.avg("volume").over(f20)) / F.nullif(vol_sd, F.lit(0.0))
        ),
        "ret_zscore": F.when((n_ret < 5) | (ret_sd <= 1e-12), 0.0).otherwise(F.col("_r") / F.nullif(ret_sd, F.lit(0.0))),
    }
    return {n: all_cols[n] for n in names}


def batch_features(bars: DataFrame, names=DERIVED) -> DataFrame:
    p = F.lag("close").over(_o())
    b = bars.withColumn("_r", (F.col("close") - p) / F.greatest(p, F.lit(1e-12)))
    return b.withColumns(feature_columns(names)).drop("_r")


def with_hurst(bars: DataFrame, window: int = 50, max_lag: int = 10, q: int = 1) -> DataFrame:
    """Generalised Hurst exponent over ``window + 1`` closes: the slope of the log mean
    absolute difference on the log lag, 0.5 before the window fills."""
    b = bars
    ok = F.row_number().over(_o()) > window
    gap = lambda t: F.abs(F.col("close") - F.lag("close", t).over(_o()))
    b = b.withColumns({f"_d{t}": gap(t) if q == 1 else F.pow(gap(t), q) for t in range(1, max_lag + 1)})
    m = {f"_m{t}": F.avg(f"_d{t}").over(_o().rowsBetween(-(window - t), 0)) for t in range(1, max_lag + 1)}
    b = b.withColumns(m)
    b = b.withColumns({f"_y{t}": F.when(F.col(f"_m{t}") > 0, F.log(f"_m{t}")) for t in range(1, max_lag + 1)})
    lags = range(1, max_lag + 1)
    xs = {t: math.log(t) for t in lags}
    y = {t: F.coalesce(F.col(f"_y{t}"), F.lit(0.0)) for t in lags}
    on = {t: F.col(f"_y{t}").isNotNull().cast("double") for t in lags}
    b = b.withColumns(
        {
            "_n": sum(on[t] for t in lags),
            "_sx": sum(on[t] * xs[t] for t in lags),
            "_sxx": sum(on[t] * (xs[t] ** 2) for t in lags),
            "_sy": sum(y[t] for t in lags),
            "_sxy": sum(y[t] * xs[t] for t in lags),
            "_ok": ok,
        }
    )
    n, sx, sy = F.col("_n"), F.col("_sx"), F.col("_sy")
    b = b.withColumn("_s", fr.div(n * F.col("_sxy") - sx * sy, n * F.col("_sxx") - sx * sx) / q)
    h = F.when(F.col("_ok") & (n >= 2), fr.clip("_s", 0.0, 1.0)).otherwise(0.5)
    drop = [f"_{k}{t}" for k in "dmy" for t in lags] + ["_n", "_sx", "_sxx", "_sy", "_sxy", "_ok", "_s"]
    return b.withColumn("hurst_value", h).drop(*drop)


# --- fractional differencing -----------------------------------------------------------


def ffd_weights(d: float, tau: float = 1e-5) -> list[float]:
    w = [1.0]
    while True:
        k = len(w)
        nxt = -w[-1] * (d - k + 1) / k
        if abs(nxt) < tau:
            return w
        w.append(nxt)


def fractional_diff(bars: DataFrame, d: float, tau: float = 1e-5, x: str = "close") -> DataFrame:
    """Adds ``ffd``: the weighted sum of the last len(w) values, null until they exist."""
    w = ffd_weights(d, tau)[::-1]
    lit = "array(" + ",".join(f"{v!r}D" for v in w) + ")"
    b = bars.withColumn("_f", F.collect_list(x).over(_o().rowsBetween(-(len(w) - 1), 0)))
    dot = F.expr(f"aggregate(zip_with(_f, {lit}, (a, b) -> a * b), 0D, (s, v) -> s + v)")
    return b.withColumn("ffd", F.when(F.size("_f") == len(w), dot)).drop("_f")


def adf_p_value(x: np.ndarray) -> float:
    """Augmented Dickey-Fuller test with a constant; lag by AIC on the common sample.

    The p value uses the published response surface for one regressor with a constant.
    """
    n = len(x)
    dx = np.diff(x)
    top = min(int(math.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - 2)

    def fit(lag, start):
        rows = np.arange(start, len(dx))
        cols = [x[rows]] + [dx[rows - j] for j in range(1, lag + 1)] + [np.ones(len(rows))]
        a, y = np.column_stack(cols), dx[rows]
        b, *_ = np.linalg.lstsq(a, y, rcond=None)
        e = y - a @ b
        return a, b, e, len(rows)

    best = None
    for lag in range(0, max(top, 0) + 1):
        a, b, e, m = fit(lag, top)
        aic = m * math.log(max(e @ e / m, 1e-300)) + 2 * a.shape[1]
        if best is None or aic < best[0]:
            best = (aic, lag)
    a, b, e, m = fit(best[1], best[1])
    s2 = e @ e / (m - a.shape[1])
    tau = b[0] / math.sqrt(s2 * np.linalg.inv(a.T @ a)[0, 0])
    if tau > 2.74:
        return 1.0
    if tau < -18.83:
        return 0.0
    c = (2.1659, 1.4412, 0.038269) if tau <= -1.61 else (1.7339, 0.93202, -0.12745, -0.010368)
    z = sum(k * tau**i for i, k in enumerate(c))
    return 0.5 * (1.0 + math.erf(z / math.sqrt(2.0)))


def stationary_order(bars: DataFrame, grid, tau: float = 1e-5, p_max: float = 0.05) -> DataFrame:
    """(symbol, d_star): first d whose differenced series rejects a unit root.

    Every (symbol, d) is its own group, so the grid runs in parallel.
    """
    q = bars.withColumn("d", F.explode(F.array(*[F.lit(float(v)) for v in sorted(grid)])))
    out = T.StructType([bars.schema["symbol"], T.StructField("d", T.DoubleType()), T.StructField("p_value", T.DoubleType())])

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        x, d = pdf["close"].to_numpy(float), pdf["d"].iloc[0]
        w = ffd_weights(d, tau)
        y = np.convolve(x, w, mode="valid") if len(x) >= len(w) else np.array([])
        p = adf_p_value(y) if len(y) >= 10 and np.ptp(y) > 0 else None
        return pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]], "d": [d], "p_value": [p]})

    tests = per_series(q, ["symbol", "d"], test, out, ["close"], order="bar_idx")
    top = float(max(grid))
    return tests.groupBy("symbol").agg(
        F.coalesce(F.min(F.when(F.col("p_value") < p_max, F.col("d"))), F.lit(top)).alias("d_star")
    )


# --- recursive filters over bars ------------------------------------------------------------


def _walk(bars, step, outputs, inputs, initial=None):
    """Apply a kernel step along each symbol's bars."""
    schema = T.StructType(
        [bars.schema["symbol"], T.StructField("bar_idx", T.IntegerType())]
        + [T.StructField(o, T.DoubleType()) for o in outputs]
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, rows = initial, []
        args = [[None if v != v else v for v in pdf[c].astype(float).tolist()] for c in inputs]
        for vals in zip(*args):
            state, o = step(state, *vals)
            rows.append(o)
        res = pdf[["symbol", "bar_idx"]].copy()
        res[list(outputs)] = np.array(rows, dtype=float).reshape(len(pdf), len(outputs))
        return res

    return per_series(bars, ["symbol"], run, schema, list(inputs), order="bar_idx")


def local_trend(bars: DataFrame) -> DataFrame:
    return _walk(bars, kn.trend_step, ("level", "trend"), ("close",))


def efficiency_regime(bars: DataFrame, window: int = 20, smoothing: float = 0.30) -> DataFrame:
    return _walk(bars, lambda s, p: kn.efficiency_step(s, p, window, smoothing), ("p_trend", "p_chop"), ("close",))


def hmm_posteriors(bars: DataFrame, x: str = "lr", **kw) -> DataFrame:
    return _walk(bars, lambda s, o: kn.hmm_step(s, o, **kw), ("p_0", "p_1"), (x,))


def imm_scores(bars: DataFrame) -> DataFrame:
    """Needs close, p_trend, p_chop, atr_14; missing weights count as even."""
    even = lambda v: 0.5 if v is None else v

    def step(s, price, pt, pc, atr):
        return kn.imm_step(s, price, even(pt), even(pc), atr)

    return _walk(bars, step, ("p_hat", "nu_hat", "trend_score"), ("close", "p_trend", "p_chop", "atr_14"))


def signal_bars(bars: DataFrame, warmup: int = 20) -> DataFrame:
    """The 19-column bar contract: native windows plus one recursive pass."""
    b = with_hurst(with_atr(bars))

    def both(state, price, atr):
        er, imm = state if state else (None, None)
        er, (pt, pc) = kn.efficiency_step(er, price)
        imm, (_, _, score) = kn.imm_step(imm, price, pt, pc, atr)
        return (er, imm), (pt, pc, score)

    r = _walk(b, both, ("p_trend", "p_chop", "trend_score"), ("close", "atr_14"))
    j = b.join(r, ["symbol", "bar_idx"])
    cold = F.col("bar_idx") < max(warmup, 5)
    hide = lambda c: F.when(~cold, c)
    return j.select(
        "bar_idx", "symbol", "ts_ms", "open", "high", "low", "close", "volume",
        fr.clip(F.col("ofi"), -1.0, 1.0).alias("ofi"), "tick_count",
        F.lit(False).alias("is_toxic_flag"), F.lit(False).alias("is_tail_event"),
        cold.alias("insufficient_history"),
        hide(F.col("trend_score")).alias("trend_score"), hide(F.col("p_trend")).alias("p_trend"),
        hide(F.col("p_chop")).alias("p_chop"), hide(F.col("atr_14")).alias("atr_14"),
        hide(F.col("hurst_value")).alias("hurst_value"), hide(F.lit(0.35)).alias("d_star_used"),
    )


# --- regime test -------------------------------------------------------------------------------


def two_regime_test(bars: DataFrame, x: str = "lr", p_max: float = 0.01) -> DataFrame:
    """One regime against several, from moments: (symbol, n, statistic, p_value, two_regimes).

    Returns of one Gaussian regime have no excess kurtosis, and their squares do not follow
    each other; a mixture of regimes that last has both. The sum of the two squared scores is
    compared with the chi-squared law of two degrees of freedom. Sums combine on the map side;
    only the lag looks along a symbol.
    """
    obs = bars.filter(F.col(x).isNotNull()).withColumn("_x", F.col(x))
    m = obs.groupBy("symbol").agg(F.avg("_x").alias("_m"), F.stddev_pop("_x").alias("_s"))
    z = obs.join(m, "symbol").filter("_s > 0").withColumn("_q", ((F.col("_x") - F.col("_m")) / F.col("_s")) ** 2)
    z = z.withColumn("_p", F.lag("_q").over(_o()))
    g = z.groupBy("symbol").agg(
        F.count("*").alias("n"), F.avg(F.col("_q") ** 2).alias("_4"), F.sum((F.col("_q") - 1) * (F.col("_p") - 1)).alias("_c"), F.sum((F.col("_q") - 1) ** 2).alias("_v"),
    )
    stat = F.col("n") * ((F.col("_4") - 3) ** 2 / 24 + F.coalesce(fr.div(F.col("_c"), F.col("_v")), F.lit(0.0)) ** 2)
    g = g.withColumn("statistic", stat).withColumn("p_value", F.exp(-F.col("statistic") / 2))
    return g.select("symbol", "n", "statistic", "p_value", (F.col("p_value") < p_max).alias("two_regimes"))
