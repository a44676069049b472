"""Statistics of return series, folds, logs, cost estimates and trial tables."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import frames as fr

# --- normal distribution -------------------------------------------------------------

_N = NormalDist()


def norm_cdf(x: Column) -> Column:
    @F.pandas_udf("double")
    def cdf(v: pd.Series) -> pd.Series:
        return v.map(_N.cdf, na_action="ignore").astype(float)

    return cdf(x)


def norm_ppf(x: Column) -> Column:
    @F.pandas_udf("double")
    def ppf(v: pd.Series) -> pd.Series:
        return v.map(lambda p: _N.inv_cdf(p) if 0 < p < 1 else np.nan, na_action="ignore").astype(float)

    return ppf(x)


# --- return series -------------------------------------------------------------------


def with_equity(s: DataFrame, keys, x="ret", order="ti") -> DataFrame:
    """Adds ``equity`` and ``dd`` along each series (one row per period)."""
    o = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("equity", F.product(1.0 + F.col(x)).over(o))
    return s.withColumn("dd", 1.0 - F.col("equity") / F.max("equity").over(o))


def ratio(mean: Column, std: Column, scale) -> Column:
    return F.when(std > 1e-15, mean / std * scale).otherwise(0.0)


def period_stats(series: DataFrame, keys, ppy: float, least: int = 20, extras=()) -> DataFrame:
    """Performance of each series; only ``n`` is filled below ``least`` periods.

    ``extras`` maps output names to (column, annualise) means, taken over all rows of
    the series, as the attribution of the last period is known while its return is not.
    """
    keys = list(keys)
    q = with_equity(series.filter(F.col("ret").isNotNull()), keys)
    r = F.col("ret")
    neg = F.when(r < 0, r)
    a = q.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(r).alias("_m"),
        F.stddev_samp(r).alias("_s"),
        F.max("dd").alias("_dd"),
        F.avg((r > 0).cast("double")).alias("_hit"),
        F.max_by("equity", "ti").alias("_eq"),
        F.count(neg).alias("_nn"),
        F.stddev_samp(neg).alias("_ns"),
        F.skewness(r).alias("_sk"),
        F.kurtosis(r).alias("_ku"),
    )
    if extras:
        b = series.groupBy(*keys).agg(
            *[(F.avg(c) * (ppy if ann else 1.0)).alias(name) for name, (c, ann) in dict(extras).items()]
        )
        a = a.join(b, keys)
    n = F.col("n").cast("double")
    year = float(np.sqrt(ppy))
    ann = F.col("_m") * ppy
    vals = {
        "ann_return": ann,
        "ann_vol": F.col("_s") * year,
        "sharpe": ratio(F.col("_m"), F.col("_s"), year),
        "sortino": F.when((F.col("_nn") > 2) & (F.col("_ns") > 1e-15), F.col("_m") / F.col("_ns") * year).otherwise(0.0),
        "t_stat": ratio(F.col("_m"), F.col("_s"), F.sqrt(n)),
        "max_dd": F.col("_dd"),
        "calmar": F.when(F.col("_dd") > 1e-9, ann / F.nullif("_dd", F.lit(0.0))).otherwise(0.0),
        "hit_rate": F.col("_hit"),
        "total_return": F.col("_eq") - 1.0,
        "cagr": F.when(F.col("_eq") > 0, F.pow("_eq", ppy / n) - 1.0).otherwise(-1.0),
        "skew": fr.skew_unbiased(F.col("_sk"), n),
        "kurtosis": fr.kurt_unbiased(F.col("_ku"), n),
    }
    ok = F.col("n") >= least
    return a.select(
        *keys, "n", ok.alias("viable"),
        *[F.when(ok, v).alias(k) for k, v in vals.items()],
        *[F.when(ok, F.col(k)).alias(k) for k in dict(extras)],
    )


def sharpe_ci(series: DataFrame, keys, ppy: float) -> DataFrame:
    """Annual Sharpe and its 95% band from se = sqrt((1 + sr^2/2) / n)."""
    a = series.filter(F.col("ret").isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("ret").alias("_m"), F.stddev_samp("ret").alias("_s")
    )
    sr = F.col("_m") / F.nullif("_s", F.lit(0.0))
    se = F.sqrt((1.0 + 0.5 * sr * sr) / F.col("n"))
    year = float(np.sqrt(ppy))
    return a.select(
        *keys, "n", (sr * year).alias("sharpe"),
        ((sr - 1.96 * se) * year).alias("low"), ((sr + 1.96 * se) * year).alias("high"),
    )


def fold_sharpes(series: DataFrame, keys, k: int, ppy: float) -> DataFrame:
    """Contiguous folds (the first n mod k are one longer) and the Sharpe of each."""
    keys = list(keys)
    o = Window.partitionBy(*keys).orderBy("ti")
    q = series.filter(F.col("ret").isNotNull()).withColumn("fold", F.ntile(k).over(o))
    a = q.groupBy(*keys, "fold").agg(F.avg("ret").alias("_m"), F.stddev_samp("ret").alias("_s"), F.count("*").alias("n"))
    return a.select(*keys, "fold", "n", ratio(F.col("_m"), F.col("_s"), float(np.sqrt(ppy))).alias("sharpe"))


def fold_summary(folds: DataFrame, keys) -> DataFrame:
    a = folds.groupBy(*keys).agg(
        F.percentile("sharpe", F.lit(0.5)).alias("fold_median"),
        F.min("sharpe").alias("fold_min"),
        F.avg((F.col("sharpe") > 0).cast("double")).alias("share_positive"),
    )
    return a.withColumn("score", F.col("fold_median") * F.col("share_positive"))


def growth_and_drawdown(series: DataFrame, keys) -> DataFrame:
    q = with_equity(series.filter(F.col("ret").isNotNull()), keys)
    return q.groupBy(*keys).agg(F.avg(F.log1p("ret")).alias("log_growth"), F.max("dd").alias("max_dd"))


# --- cost estimates --------------------------------------------------------------------


def corwin_schultz(p: DataFrame, bars_per_day: int = 6) -> DataFrame:
    """(symbol, spread_bps) from non-overlapping day highs and lows."""
    n = max(1, int(bars_per_day))
    full = lambda agg, c: fr.rolling(agg, c, n)
    q = p.withColumns({"hi": full(F.max, "high"), "lo": full(F.min, "low")}).filter(F.col("ti") % n == 0)
    two = fr.frame(2)
    pair = lambda agg, c: F.when(F.count(c).over(two) == 2, agg(c).over(two))
    q = q.withColumn("_b", F.pow(F.log(F.col("hi") / F.col("lo")), 2))
    q = q.withColumns({"h2": pair(F.max, "hi"), "l2": pair(F.min, "lo"), "beta": pair(F.sum, "_b")})
    k = 3.0 - 2.0 * float(np.sqrt(2.0))
    gamma = F.pow(F.log(F.col("h2") / F.col("l2")), 2)
    alpha = fr.clip((F.sqrt(2.0 * F.col("beta")) - F.sqrt("beta")) / k - F.sqrt(gamma / k), 0.0)
    q = q.withColumn("s", 2.0 * (F.exp(alpha) - 1.0) / (1.0 + F.exp(alpha)))
    return q.groupBy("symbol").agg(F.percentile("s", F.lit(0.5)).alias("_m")).select(
        "symbol", fr.clip(F.col("_m") * 1e4, 0.2, 60.0).alias("spread_bps")
    )


def estimate_cost(p: DataFrame, spreads: DataFrame | None = None, notional: float = 20.0, lookback: int = 720, bars_per_day: int = 6, impact: float = 1.0) -> DataFrame:
    """(symbol, cost_bps): half spread plus square-root impact over the last rows."""
    cs = corwin_schultz(p, bars_per_day)
    if spreads is not None:
        cs = cs.join(spreads.withColumnRenamed("spread_bps", "_live"), "symbol", "left").select(
            "symbol", F.coalesce("_live", "spread_bps").alias("spread_bps")
        )
    last = p.agg(F.max("ti")).scalar()
    q = p.withColumns({"_dv": F.col("volume") * F.col("close"), "_lr": fr.log_ret("close")})
    a = q.filter(F.col("ti") > last - lookback).groupBy("symbol").agg(
        (F.percentile("_dv", F.lit(0.5)) * bars_per_day).alias("adv"),
        (F.stddev_samp("_lr") * float(np.sqrt(bars_per_day))).alias("sigma_day"),
    )
    j = a.join(cs, "symbol", "left")
    imp = fr.clip(impact * F.col("sigma_day") * F.sqrt(fr.div(F.lit(notional), "adv")) * 1e4, 0.0, 20.0)
    # one row per symbol: medians over the universe
    u = Window.partitionBy(F.lit(0))
    half = F.col("spread_bps") * 0.5
    j = j.withColumn("_t", F.coalesce(half, F.percentile(half, F.lit(0.5)).over(u)) + F.coalesce(imp, F.lit(0.0)))
    return j.select(
        "symbol", F.greatest(F.coalesce("_t", F.percentile("_t", F.lit(0.5)).over(u)), F.lit(0.1)).alias("cost_bps")
    )


def capacity_table(adv: DataFrame, aums, per_order: Column, impact: Column, cap_bps: float = 20.0) -> DataFrame:
    """Per AUM level: order size, slippage and participation over the symbols."""
    q = adv.withColumn("aum", F.explode(F.array(*[F.lit(float(a)) for a in aums])))
    q = q.withColumns({"order": per_order, "slip": F.least(impact, F.lit(cap_bps))})
    q = q.withColumn("part", F.col("order") / F.col("adv"))
    return q.groupBy("aum").agg(
        F.max("order").alias("notional_per_order"),
        F.percentile("slip", F.lit(0.5)).alias("median_bps"),
        F.avg((F.col("slip") >= cap_bps).cast("double")).alias("share_at_cap"),
        F.percentile("part", F.lit(0.5)).alias("participation_median"),
        F.percentile("part", F.lit(0.9)).alias("participation_p90"),
    )


# --- deflated statistics ------------------------------------------------------------------

EULER_GAMMA = 0.5772156649015329


def psr(sr: Column, bench: Column, n: Column, skew: Column, kurt: Column) -> Column:
    """Probability that the true Sharpe exceeds ``bench`` (kurtosis not in excess)."""
    var = F.greatest(1.0 - skew * sr + (kurt - 1.0) / 4.0 * sr * sr, F.lit(1e-12))
    return norm_cdf((sr - bench) * F.sqrt(n - 1.0) / F.sqrt(var))


def dispersion(df: DataFrame, x: str, keys=()) -> DataFrame:
    q = lambda f: F.percentile(x, F.lit(f))
    return df.groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.var_samp(x).alias("var"), F.min(x).alias("min"), q(0.25).alias("p25"), q(0.5).alias("p50"),
        q(0.75).alias("p75"), F.max(x).alias("max"),
    )
