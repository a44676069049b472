"""Combining signals: adaptive evidence weights, cross-sectional regression, mixes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import frames as fr
from barloom.operators import evaluate as ev


@dataclass(frozen=True)
class AdaptiveSpec:
    lookback: int = 250
    min_periods: int = 90
    t_threshold: float = 1.0
    max_abs_weight: float = 0.45
    max_step: float = 0.10
    allow_sign_flip: bool = True
    shrink: float = 1.0
    warm_equal: bool = True
    collapse_equal: bool = True


def factor_table(wide: DataFrame, sigs, top_frac: float = 0.1, min_names: int = 10) -> DataFrame:
    """(signal, ti, spread) for several signals from one forward-return pass."""
    q = ev.with_forward(wide, (1,))
    rows = ev.by_config(q, {s: (s, "fwd_1") for s in sigs}, "signal")
    keys = ("signal", "ti")
    rows = rows.withColumn("n", F.count("*").over(fr.xs(keys))).filter(F.col("n") >= min_names)
    rows = rows.withColumns({"pos": fr.first_rank("a", keys), "k": fr.side_count(F.col("n"), top_frac)})
    top, low = F.col("pos") > F.col("n") - F.col("k"), F.col("pos") <= F.col("k")
    return rows.groupBy("signal", "ti").agg(
        (0.5 * (F.avg(F.when(top, F.col("b"))) - F.avg(F.when(low, F.col("b"))))).alias("spread")
    )


def evidence(fac: DataFrame, sigs, spec: AdaptiveSpec) -> DataFrame:
    """(ti, i, e_<signal>): evidence from rows i-lookback..i-1 of the factor table."""
    wide = fac.groupBy("ti").agg(
        *[F.max(F.when(F.col("signal") == s, F.col("spread"))).alias(s) for s in sigs]
    )
    # one row per timestamp: the only global ordering is over the calendar
    order = Window.partitionBy(F.lit(0)).orderBy("ti")
    back = order.rowsBetween(-spec.lookback, -1)
    cols = {"i": F.row_number().over(order) - 1}
    for s in sigs:
        n = F.count(s).over(back).cast("double")
        mu, sd = F.avg(s).over(back), F.stddev_samp(s).over(back)
        t = fr.div(mu, sd / F.sqrt(n))
        excess = F.abs(t) - spec.t_threshold
        factor = F.pow(fr.div(excess, F.abs(t)), spec.shrink) if spec.shrink > 0 else F.lit(1.0)
        live = (n >= 20) & (sd > 1e-15) & (excess > 0)
        if not spec.allow_sign_flip:
            live = live & (t >= 0)
        cols[f"e_{s}"] = F.when(live, F.signum(t) * F.abs(mu / sd) * factor).otherwise(0.0)
    return wide.withColumns(cols).select("ti", "i", *[f"e_{s}" for s in sigs])


def adaptive_weights(fac: DataFrame, sigs, spec: AdaptiveSpec = AdaptiveSpec()) -> DataFrame:
    """(ti, branch, w_<signal>): a fold over the evidence, which has one row per timestamp.

    The target is the evidence at unit gross, no part beyond the largest weight; the weights
    move to it by at most a step each and are then brought to the target's gross.
    """
    sigs = list(sigs)
    k = len(sigs)
    e = evidence(fac, sigs, spec).select("ti", F.struct(F.col("i"), F.col("ti"), F.array(*[F.coalesce(F.col(f"e_{s}"), F.lit(0.0)) for s in sigs]).alias("e")).alias("row"))
    size = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + F.abs(y))
    scaled = lambda a, f: F.transform(a, lambda x: x * f)
    even = lambda on: F.array(*[F.lit(1.0 / k if on else 0.0)] * k)

    def branch(row):
        cold = F.least(row["i"], F.lit(spec.lookback)) < spec.min_periods
        return F.when(cold, "warmup").when(size(row["e"]) <= 1e-12, "collapse").otherwise("ok")

    def target(row):
        unit = scaled(row["e"], 1 / size(row["e"]))
        cut = F.transform(unit, lambda x: fr.clip(x, -spec.max_abs_weight, spec.max_abs_weight))
        b = branch(row)
        bounded = F.when(F.exists(unit, lambda x: F.abs(x) > spec.max_abs_weight), scaled(cut, 1 / size(cut))).otherwise(unit)
        return F.when(b == "warmup", even(spec.warm_equal)).when(b == "collapse", even(spec.collapse_equal)).otherwise(bounded)

    def step(seen, row):
        last = F.when(F.size(seen) > 0, F.element_at(seen, -1)["w"]).otherwise(even(False))
        moved = F.zip_with(last, row["t"], lambda x, y: x + fr.clip(y - x, -spec.max_step, spec.max_step))
        both = (size(moved) > 1e-12) & (size(row["t"]) > 1e-12)
        w = F.when(both, scaled(moved, size(row["t"]) / size(moved))).otherwise(moved)
        return F.concat(seen, F.array(F.struct(row["ti"].alias("ti"), row["b"].alias("branch"), w.alias("w"))))

    ready = e.select(F.struct("row.i", "row.ti", branch(F.col("row")).alias("b"), target(F.col("row")).alias("t")).alias("r"))
    start = F.array().cast("array<struct<ti:int,branch:string,w:array<double>>>")
    path = ready.groupBy().agg(F.aggregate(F.array_sort(F.collect_list("r")), start, step).alias("path"))
    rows = path.select(F.explode("path").alias("p")).select("p.*")
    return rows.select("ti", "branch", *[F.col("w")[i].alias(f"w_{s}") for i, s in enumerate(sigs)])


def on_grid(weights: DataFrame, wide: DataFrame, cols) -> DataFrame:
    """Weights on every grid timestamp, the last known ones carried forward."""
    axis = wide.select("ti").distinct()
    w = Window.partitionBy(F.lit(0)).orderBy("ti").rowsBetween(Window.unboundedPreceding, 0)
    return axis.join(weights, "ti", "left").select(
        "ti", *[F.last(c, ignorenulls=True).over(w).alias(c) for c in cols]
    )


def combine_adaptive(wide: DataFrame, sigs, spec: AdaptiveSpec = AdaptiveSpec(), top_frac: float = 0.1) -> DataFrame:
    """Wide panel plus ``combined``."""
    sigs = list(sigs)
    cols = [f"w_{s}" for s in sigs]
    weights = on_grid(adaptive_weights(factor_table(wide, sigs, top_frac), sigs, spec), wide, cols)
    q = wide.join(weights, "ti", "left")
    w = {s: F.coalesce(F.col(f"w_{s}"), F.lit(0.0)) for s in sigs}
    total = sum(F.coalesce(F.col(s) * w[s], F.lit(0.0)) for s in sigs)
    cover = sum(F.col(s).isNotNull().cast("double") * F.abs(w[s]) for s in sigs)
    q = q.withColumn("combined", F.when(cover > 1e-9, total))
    return q.withColumn("combined", fr.xs_z("combined")).drop(*cols)


# --- cross-sectional regression ------------------------------------------------------


@dataclass(frozen=True)
class RegressionSpec:
    beta_window: int = 60
    min_periods: int = 20
    min_names: int = 15
    method: str = "ols"
    alpha: float = 1e-3
    l1_ratio: float = 0.5
    winsorize: float = 0.02
    standardize: bool = True


def _elastic_net(x, y, alpha, l1_ratio, sweeps=2000, tol=1e-5):
    """Coordinate descent without intercept on the (k x k) normal equations."""
    n, k = x.shape
    gram, xy = x.T @ x / n, x.T @ y / n
    b = np.zeros(k)
    for _ in range(sweeps):
        shift = 0.0
        for j in range(k):
            part = xy[j] - gram[j] @ b + gram[j, j] * b[j]
            new = np.sign(part) * max(abs(part) - alpha * l1_ratio, 0.0)
            new /= gram[j, j] + alpha * (1.0 - l1_ratio)
            shift, b[j] = max(shift, abs(new - b[j])), new
        if shift <= tol * max(np.abs(b).max(), 1e-300):
            break
    return b


def _one_period(x, y, spec: RegressionSpec):
    if spec.standardize:
        sd = x.std(axis=0)
        x = (x - x.mean(axis=0)) / np.where(sd < 1e-12, 1.0, sd)
    if spec.winsorize > 0 and len(y) >= 10:
        y = np.clip(y, *np.quantile(y, [spec.winsorize, 1.0 - spec.winsorize]))
    y = y - y.mean()
    if spec.method == "ols":
        return np.linalg.lstsq(x, y, rcond=None)[0]
    if spec.method == "ridge":
        k = x.shape[1]
        return np.linalg.solve(x.T @ x + spec.alpha * len(y) * np.eye(k), x.T @ y)
    if spec.method == "elastic_net":
        return _elastic_net(x, y, spec.alpha, spec.l1_ratio)
    raise ValueError(f"unknown method: {spec.method}")


def cross_sectional_betas(wide: DataFrame, sigs, spec: RegressionSpec = RegressionSpec()) -> DataFrame:
    """(ti, b_<signal>): one small regression per timestamp.

    A timestamp travels as one row of arrays (as long as the universe), so a batch of
    them is solved per Arrow batch instead of one pandas frame per timestamp.
    """
    sigs = list(sigs)
    q = ev.with_forward(wide, (1,))
    ok = F.col("fwd_1").isNotNull()
    for s in sigs:
        ok = ok & F.col(s).isNotNull()
    rows = (
        q.filter(ok)
        .groupBy("ti")
        .agg(F.collect_list(F.array("fwd_1", *sigs)).alias("m"))
        .filter(F.size("m") >= spec.min_names)
    )

    @F.pandas_udf("array<double>")
    def solve(ms: pd.Series) -> pd.Series:
        res = []
        for m in ms:
            a = np.array([np.asarray(r, dtype=float) for r in m])
            a = a[np.lexsort(a.T[::-1])]
            try:
                res.append(_one_period(a[:, 1:], a[:, 0], spec))
            except np.linalg.LinAlgError:
                res.append(None)
        return pd.Series(res)

    b = rows.select("ti", solve("m").alias("b")).filter(F.col("b").isNotNull())
    return b.select("ti", *[F.col("b")[i].alias(f"b_{s}") for i, s in enumerate(sigs)])


def combine_regression(wide: DataFrame, sigs, spec: RegressionSpec = RegressionSpec()) -> DataFrame:
    """Signals times lagged mean betas; the betas of t use returns up to t only."""
    sigs = list(sigs)
    betas = cross_sectional_betas(wide, sigs, spec)
    order = Window.partitionBy(F.lit(0)).orderBy("ti")
    lagged = betas.select("ti", *[F.lag(f"b_{s}", 1).over(order).alias(f"b_{s}") for s in sigs])
    f = order.rowsBetween(-(spec.beta_window - 1), 0)
    mean = lagged.select(
        "ti",
        *[
            F.when(F.count(f"b_{s}").over(f) >= spec.min_periods, F.avg(f"b_{s}").over(f)).alias(f"b_{s}")
            for s in sigs
        ],
    )
    cols = [f"b_{s}" for s in sigs]
    q = wide.join(on_grid(mean, wide, cols), "ti", "left")
    total = sum(F.coalesce(F.col(s) * F.col(f"b_{s}"), F.lit(0.0)) for s in sigs)
    cover = sum(F.col(s).isNotNull().cast("int") for s in sigs)
    known = F.coalesce(*cols).isNotNull()
    least = max(1, len(sigs) // 3)
    q = q.withColumn("combined", F.when((cover >= least) & known, total))
    return q.withColumn("combined", fr.xs_z("combined")).drop(*cols)


# --- return series ----------------------------------------------------------------


def combine_inverse_vol(returns: DataFrame, lookback: int = 90, min_periods: int = 30) -> DataFrame:
    """(name, ti, ret) -> (ti, ret): strategies weighted by the inverse of lagged vol."""
    k = dict(keys=("name",))
    vol = fr.roll_std("ret", lookback, min_periods, **k)
    r = returns.withColumn("_v", vol).withColumn("_inv", fr.div(F.lit(1.0), fr.lag("_v", 1, **k)))
    w = fr.div("_inv", F.sum("_inv").over(fr.xs()))
    return (
        r.withColumn("_x", F.col("ret") * w)
        .groupBy("ti").agg(F.sum("_x").alias("ret"))
        .filter(F.col("ret").isNotNull())
    )


def equal_mix(returns: DataFrame, names) -> DataFrame:
    """Mean of several strategies on timestamps where all of them are present."""
    return (
        returns.groupBy("ti").agg(F.avg("ret").alias("ret"), F.count("ret").alias("n"))
        .filter(F.col("n") == len(names)).drop("n")
    )
