"""Scores to weights: selection, risk scaling, neutral projections, covariances."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from barloom.functions import frames as fr


@dataclass(frozen=True)
class PortfolioSpec:
    mode: str = "zscore_riskparity"
    top_frac: float = 0.10
    n_positions: int | None = None
    exit_frac: float | None = None
    gross: float = 1.0
    max_weight: float = 0.20
    vol_window: int = 60
    vol_floor_pct: float = 0.10
    beta_neutral: bool = False
    beta_window: int = 120
    z_clip: float = 2.5
    min_names: int = 6
    cov_method: str = "constant_correlation"
    cov_window: int = 250
    risk_aversion: float = 5.0

    def least_names(self) -> int:
        return self.min_names if self.n_positions is None else min(self.min_names, self.n_positions)

    def side(self, n: Column) -> Column:
        if self.n_positions is None:
            return fr.side_count(n, self.top_frac)
        return F.greatest(F.lit(1), F.least(F.lit(self.n_positions // 2), F.floor(n / 2)))


def sample_marks(p: DataFrame, every: int) -> DataFrame:
    """Every k-th grid timestamp, counted from the first; renumbers ``ti``."""
    return p.filter(F.col("ti") % every == 0).withColumn("ti", (F.col("ti") / every).cast("int"))


# --- risk estimates -------------------------------------------------------------------


def realized_vol(window: int = 60, close="close", least: int | None = None) -> Column:
    """Std of log returns, known one step later. Needs column ``lr``."""
    return fr.roll_std("lr", window, least or max(5, window // 3))


def rolling_beta_parts(window: int, least: int | None = None) -> Column:
    """Covariance with the equal-weight market over its variance. Needs r1, mkt."""
    m = least or max(20, window // 3)
    f = fr.frame(window)
    both = F.col("r1").isNotNull() & F.col("mkt").isNotNull()
    cov = F.when(F.count_if(both).over(f) >= m, F.covar_samp("r1", "mkt").over(f))
    var = F.when(F.count("mkt").over(f) >= m, F.var_samp("mkt").over(f))
    return fr.div(cov, var)


def with_risk(p: DataFrame, spec: PortfolioSpec) -> DataFrame:
    """Panel with lagged ``vol`` and ``beta``; the lag comes after the window."""
    p = p.withColumns({"r1": fr.ret("close"), "lr": fr.log_ret("close")})
    p = p.withColumn("mkt", F.avg("r1").over(fr.xs()))
    p = p.withColumns({"_v": realized_vol(spec.vol_window), "_b": rolling_beta_parts(spec.beta_window)})
    return p.withColumns({"vol": fr.lag("_v"), "beta": fr.lag("_b")}).drop("_v", "_b")


# --- selection --------------------------------------------------------------------------


def rank_weights(p: DataFrame, sig: str, top_frac: float = 0.25, neutral: bool = True, keys=fr.BY_TS) -> DataFrame:
    """Equal weights on the top and bottom fraction; nothing below four names."""
    n = F.count(sig).over(fr.xs(keys))
    q = p.withColumns({"_n": n, "_pos": fr.first_rank(sig, keys)})
    q = q.withColumn("_k", fr.side_count(F.col("_n"), top_frac))
    live = F.col(sig).isNotNull() & (F.col("_n") >= 4)
    low, top = F.col("_pos") <= F.col("_k"), F.col("_pos") > F.col("_n") - F.col("_k")
    if neutral:
        w = F.when(live & low, -0.5 / F.col("_k")).when(live & top, 0.5 / F.col("_k"))
    else:
        w = F.when(live & top, 1.0 / F.col("_k"))
    return q.withColumn("w", w.otherwise(0.0)).drop("_n", "_pos", "_k")


def selection(p: DataFrame, sig: str, spec: PortfolioSpec) -> DataFrame:
    """Adds ``sel``: +1, -1 or 0."""
    if spec.exit_frac is not None:
        held = buffered_selection(
            p, sig, spec.top_frac, spec.exit_frac, spec.n_positions,
            spec.exit_frac / spec.top_frac, rule="v2",
        )
        return p.join(held, ["ti", "symbol"], "left").withColumn("sel", F.coalesce("side", F.lit(0.0))).drop("side")
    n = F.count(sig).over(fr.xs())
    q = p.withColumns({"_n": n, "_pos": fr.first_rank(sig)})
    q = q.withColumn("_k", spec.side(F.col("_n")))
    live = F.col(sig).isNotNull() & (F.col("_n") >= 4)
    top, low = F.col("_pos") > F.col("_n") - F.col("_k"), F.col("_pos") <= F.col("_k")
    return q.withColumn("sel", F.when(live & top, 1.0).when(live & low, -1.0).otherwise(0.0)).drop("_n", "_pos", "_k")


def _chosen(rank: dict, staying: set, taken: set, k: int) -> set:
    """Names that stay, best first, then names within the first ``k`` ranks; ``k`` in all."""
    order = sorted(rank, key=rank.get)
    stay = [x for x in order if x in staying]
    enter = [x for x in order if rank[x] < k and x not in taken]
    return {*(stay + enter)[:k]}


class Hysteresis:
    """Which names are held at a timestamp, from its keep zones and what was held before.

    A name enters within the first ``k_in`` ranks of its side and leaves when it drops out of
    the keep zone. Rule v1 lets a staying short displace a long, v2 any held short.
    """

    def __init__(self, rule: str):
        self.rule, self.long, self.short = rule, set(), set()

    def step(self, n: int, k_in: int, low: list, high: list) -> list[tuple]:
        """(symbol, side, longs, shorts) held now; ``low`` weakest first, ``high`` strongest first."""
        if n < 4:
            self.long, self.short = set(), set()
            return []
        up, down = ({x: i for i, x in enumerate(zone)} for zone in (high, low))
        short = self.short & down.keys()
        long = (self.long & up.keys()) - (short if self.rule == "v1" else self.short)
        taken = long | short
        self.long, self.short = _chosen(up, long, taken, k_in), _chosen(down, short, taken, k_in)
        if self.rule == "v1" and not (self.long and self.short):
            return []
        size = (len(self.long), len(self.short))
        # a name on both sides counts as short
        return [(x, 1.0, *size) for x in self.long - self.short] + [(x, -1.0, *size) for x in self.short]


def buffered_selection(p, sig, entry_frac, exit_frac, n_positions=None, exit_ratio=1.5, rule="v2", config=None) -> DataFrame:
    """(config?, ti, symbol, side): enter inside k_in, stay inside k_out.

    Ranks and keep zones are native; a timestamp reaches Python as one row with its two keep
    zones. What is held depends on all timestamps before, so a strategy's rows are streamed in
    order of time; only the held names are kept between them.
    """
    keys = (config, "ti") if config else ("ti",)
    n = F.count(sig).over(fr.xs(keys))
    q = p.withColumns({"n": n, "_pos": fr.first_rank(sig, keys)})
    if n_positions is None:
        k_in = fr.side_count(F.col("n"), entry_frac)
        k_out = F.greatest(k_in, fr.half_even(F.col("n") * F.lit(exit_frac)))
    else:
        half = F.floor(F.col("n") / 2)
        k_in = F.greatest(F.lit(1), F.least(F.lit(n_positions // 2), half)).cast("int")
        k_out = F.greatest(k_in, F.least(fr.half_even(k_in * F.lit(float(exit_ratio))), half)).cast("int")
    q = q.withColumns({"k_in": k_in, "k_out": k_out})
    here = F.struct("_pos", "symbol")
    ok = F.col(sig).isNotNull()
    low = F.collect_list(F.when(ok & (F.col("_pos") <= F.col("k_out")), here))
    high = F.collect_list(F.when(ok & (F.col("_pos") > F.col("n") - F.col("k_out")), here))
    names = lambda a: F.transform(a, lambda s: s["symbol"])
    zones = q.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("k_in").alias("k_in"), low.alias("_l"), high.alias("_h")
    ).withColumns(
        {"low": names(F.sort_array("_l")), "high": names(F.sort_array("_h", asc=False))}
    )
    zones = zones.withColumn("strategy", F.col(config) if config else F.lit("0"))
    out = T.StructType(
        [
            T.StructField("strategy", T.StringType()),
            T.StructField("ti", T.IntegerType()),
            T.StructField("symbol", p.schema["symbol"].dataType),
            T.StructField("side", T.DoubleType()),
            T.StructField("n_long", T.LongType()),
            T.StructField("n_short", T.LongType()),
        ]
    )

    def walk(batches):
        now, state = None, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if state is None or r["strategy"] != now:
                    now, state = r["strategy"], Hysteresis(rule)
                rows += [(now, r["ti"], *x) for x in state.step(r["n"], r["k_in"], r["low"], r["high"])]
            if rows:
                columns = zip(out.names, zip(*rows, strict=True), strict=True)
                yield pa.RecordBatch.from_pydict({c: pa.array(v, kinds[c]) for c, v in columns})

    kinds = {f.name: to_arrow_type(f.dataType) for f in out}
    zones = zones.select(F.col("strategy").cast("string").alias("strategy"), "ti", "n", "k_in", "low", "high")
    held = zones.repartition("strategy").sortWithinPartitions("strategy", "ti").mapInArrow(walk, out)
    return held.withColumnRenamed("strategy", config) if config else held.select("ti", "symbol", "side", "n_long", "n_short")


def buffered_weights(p, sig, entry_frac=0.10, exit_frac=0.25, neutral=True) -> DataFrame:
    if not 0 < entry_frac <= exit_frac < 0.5:
        raise ValueError("need 0 < entry_frac <= exit_frac < 0.5")
    h = buffered_selection(p, sig, entry_frac, exit_frac, rule="v1")
    long, short = F.col("side") > 0, F.col("side") < 0
    if neutral:
        w = F.when(long, 0.5 / F.col("n_long")).when(short, -0.5 / F.col("n_short"))
    else:
        w = F.when(long, 1.0 / F.col("n_long")).otherwise(0.0)
    held = h.select("ti", "symbol", w.alias("w"))
    return p.join(held, ["ti", "symbol"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))


# --- weight transforms (all per timestamp) -------------------------------------------------


def vol_floor(pct: float, vol="vol") -> Column:
    w = fr.xs()
    low = F.percentile(vol, F.lit(pct)).over(w)
    mid = F.percentile(vol, F.lit(0.5)).over(w)
    return F.when(low > 0, low).when(mid > 0, mid)


def inverse_vol(w: Column, vol: Column, floor: Column) -> Column:
    return fr.div(w, F.when(vol > floor, vol).otherwise(floor))


def beta_neutralize(w: str, beta: str) -> Column:
    """Remove the projection on beta among active names with a known beta."""
    x, b = F.col(w), F.col(beta)
    active = (x != 0) & b.isNotNull()
    s = fr.xs()
    n = F.count_if(active).over(s)
    bb = F.sum(F.when(active, b * b)).over(s)
    lam = F.sum(F.when(active, x * b)).over(s) / F.nullif(bb, F.lit(0.0))
    return F.when(active & (n >= 2) & (bb > 1e-12), x - lam * b).otherwise(x)


def project_neutral(w: str, beta: str | None = None) -> dict[str, Column]:
    """Orthogonal projection on sum(w)=0 (and sum(w*beta)=0), active names only.

    Closed form of the 1x1 or 2x2 normal equations from per-timestamp sums; a beta
    without spread makes them singular, where the plain projection already holds.
    """
    x = F.col(w)
    act = x != 0
    s = fr.xs()
    n = F.count_if(act).over(s).cast("double")
    sx = F.sum(F.when(act, x)).over(s)
    if beta is None:
        return {w: F.when(act & (n >= 3), x - sx / n).otherwise(0.0)}
    known = F.when(act, F.col(beta))
    med = F.coalesce(F.percentile(known, F.lit(0.5)).over(s), F.lit(1.0))
    b = F.coalesce(F.col(beta), med)
    sb, sbb, sxb = (F.sum(F.when(act, e)).over(s) for e in (b, b * b, x * b))
    det = n * sbb - sb * sb
    l0, l1 = fr.div(sbb * sx - sb * sxb, det), fr.div(n * sxb - sb * sx, det)
    full = x - l0 - l1 * b
    flat = x - sx / n
    return {
        w: F.when(act & (n >= 3), F.when(F.abs(det) > 1e-12 * n * sbb, full).otherwise(flat)).otherwise(0.0)
    }


def dollar_neutralize(w: str, sidewise: bool = True) -> Column:
    x, s = F.col(w), fr.xs()
    n = F.count_if(x != 0).over(s)
    if not sidewise:
        mean = F.avg(F.when(x != 0, x)).over(s)
        return F.when(n < 2, 0.0).when(x != 0, x - mean).otherwise(0.0)
    up = F.sum(F.when(x > 0, x).otherwise(0.0)).over(s)
    dn = F.sum(F.when(x < 0, -x).otherwise(0.0)).over(s)
    both = (n >= 2) & (up > 1e-12) & (dn > 1e-12)
    return F.when(both & (x > 0), x / F.nullif(up, F.lit(0.0)) * 0.5).when(
        both & (x < 0), x / F.nullif(dn, F.lit(0.0)) * 0.5
    ).otherwise(0.0)


# --- small per-timestamp solvers, run on arrays in Arrow batches ---------------------------


def np_project(w: np.ndarray, beta: np.ndarray | None = None) -> np.ndarray:
    act = w != 0
    out = np.zeros_like(w)
    if act.sum() < 3:
        return out
    x = w[act]
    a = np.ones((1, len(x)))
    if beta is not None:
        b = beta[act]
        good = np.isfinite(b)
        b = np.where(good, b, np.median(b[good]) if good.any() else 1.0)
        a = np.vstack([a, b])
    out[act] = x - a.T @ np.linalg.lstsq(a @ a.T, a @ x, rcond=None)[0]
    return out


def np_cap(w: np.ndarray, gross: float, cap_frac: float, rounds: int = 8) -> np.ndarray:
    """Weights of the given gross with none above the cap, by a fixed number of fillings.

    Scaling keeps the order of magnitudes, so names above the cap are always the largest
    ones: a filling only moves a border in the sorted weights, whose sums are known. A later
    filling may lift names that were capped before above the cap again.
    """
    size = np.abs(w)
    total = size.sum()
    if total <= 1e-12:
        return np.zeros_like(w)
    order = np.argsort(-size, kind="stable")
    ranked = size[order]
    left = total - np.append(0.0, np.cumsum(ranked))  # sum of what follows each border
    cap, scale = cap_frac * gross, gross / total
    height = np.zeros(0)  # of the names capped so far, the largest ones
    for _ in range(rounds):
        more = int((ranked[len(height) :] * scale > cap + 1e-12).sum())
        full = np.append(height > cap + 1e-12, np.ones(more, bool))
        if not full.any():
            break
        height = np.where(full, cap, np.append(height, np.zeros(more)))
        spare = gross - cap * full.sum()
        rest = left[len(height)] * scale + height[~full].sum()
        if rest <= 1e-12 or spare <= 0:
            break
        scale *= spare / rest
        height = np.where(full, cap, height * (spare / rest))
    out = np.empty_like(size)
    out[order] = np.append(height, ranked[len(height) :] * scale)
    return np.sign(w) * out


def np_finish(w, beta, gross, cap_frac):
    """Three rounds of cap and projection, ending on the projection; then gross."""
    for _ in range(3):
        w = np_project(np_cap(w, gross, cap_frac), beta)
    total = np.abs(w).sum()
    w = w / max(total, 1e-12) * gross
    return w if np.abs(w).sum() > 1e-12 else np.zeros_like(w)


def per_timestamp(df: DataFrame, cols, solve, out: str = "w", keys=("ti",)) -> DataFrame:
    """Apply ``solve(dict of arrays) -> array`` per timestamp.

    One timestamp is one row of arrays sorted by symbol (bounded by the universe); the
    pandas UDF sees many timestamps per batch.
    """
    cols = list(cols)
    packed = df.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("symbol", *cols))).alias("a")
    )

    @F.pandas_udf("array<double>")
    def run(rows: pd.Series) -> pd.Series:
        res = []
        for a in rows:
            arr = {c: np.array([np.nan if r[c] is None else r[c] for r in a], dtype=float) for c in cols}
            res.append(solve(arr))
        return pd.Series(res)

    solved = packed.select(*keys, "a", run("a").alias("v"))
    z = solved.select(*keys, F.explode(F.arrays_zip("a", "v")).alias("z"))
    return z.select(*keys, F.col("z.a.symbol").alias("symbol"), F.col("z.v").alias(out))


def cap_and_scale(df: DataFrame, w: str, gross: float = 1.0, max_weight: float = 0.2) -> DataFrame:
    return per_timestamp(df, [w], lambda a: np_cap(a[w], gross, max_weight), w)


def raw_weights(p: DataFrame, sig: str, spec: PortfolioSpec) -> DataFrame:
    """Selected, sized and side-neutral weights before the cap/projection rounds.

    Needs ``vol`` and ``beta`` on the panel. Rows of closed timestamps carry w = 0.
    """
    q = selection(p, sig, spec).withColumn("_floor", vol_floor(spec.vol_floor_pct))
    s = fr.xs()
    chosen = F.col("sel") != 0
    q = q.withColumn("_m", F.count_if(chosen).over(s))
    live = chosen & F.col("_floor").isNotNull() & (F.col("_m") >= spec.least_names())
    if spec.mode.startswith("rank"):
        size = F.col("sel")
    else:
        sd = F.stddev_samp(sig).over(s)
        z = fr.clip((F.col(sig) - F.avg(sig).over(s)) / F.nullif(sd, F.lit(0.0)), -spec.z_clip, spec.z_clip)
        size = F.when(sd > 1e-12, F.abs(z) * F.col("sel"))
    if spec.mode.endswith("riskparity"):
        size = inverse_vol(size, F.col("vol"), F.col("_floor"))
    q = q.withColumn("w", F.coalesce(F.when(live, size), F.lit(0.0)))
    return q.withColumn("w", dollar_neutralize("w")).drop("_m", "_floor")


def build_weights(p: DataFrame, sig: str, spec: PortfolioSpec = PortfolioSpec(), risk: bool = True) -> DataFrame:
    """(ti, symbol, w) on every (timestamp, symbol) of the panel, gross = spec.gross."""
    if risk:
        p = with_risk(p, spec)
    if spec.mode == "mvo":
        return mean_variance_weights(p, sig, spec)
    q = raw_weights(p, sig, spec)
    cols = ["w"] + (["beta"] if spec.beta_neutral else [])
    return per_timestamp(
        q, cols, lambda a: np_finish(a["w"], a.get("beta"), spec.gross, spec.max_weight)
    )


def mean_variance_weights(p: DataFrame, sig: str, spec: PortfolioSpec) -> DataFrame:
    """Shrunk covariance of the prior rows, mean = z * sigma, then cap/projection."""
    q = selection(p, sig, spec)
    back = fr.series().rowsBetween(-spec.cov_window, -1)
    nan = F.lit(float("nan"))
    q = q.withColumn("_hist", F.collect_list(F.coalesce("r1", nan)).over(back))
    rows = q.filter("sel != 0").groupBy("ti").agg(
        F.sort_array(
            F.collect_list(F.struct("symbol", F.coalesce(sig, F.lit(0.0)).alias("s"), F.coalesce("beta", nan).alias("beta"), F.col("_hist").alias("h")))
        ).alias("a")
    )
    least = spec.least_names()

    @F.pandas_udf("array<double>")
    def solve(batch: pd.Series) -> pd.Series:
        res = []
        for a in batch:
            s = np.array([r["s"] for r in a], dtype=float)
            beta = np.array([r["beta"] for r in a], dtype=float) if spec.beta_neutral else None
            hist = [np.asarray(r["h"], dtype=float) for r in a]
            w = np.zeros(len(a))
            keep = np.array([len(h) > 0 and np.isfinite(h).any() for h in hist])
            if keep.sum() >= least:
                m = np.column_stack([h for h, k in zip(hist, keep) if k])
                m = m[np.isfinite(m).all(axis=1)]
                if len(m) >= max(30, 3 * keep.sum()):
                    sigma = shrink_covariance(m, spec.cov_method)
                    mu = np.clip(s[keep], -spec.z_clip, spec.z_clip) * np.sqrt(np.diag(sigma))
                    raw = np.linalg.solve(spec.risk_aversion * sigma, mu)
                    w[keep] = np_finish(raw, None if beta is None else beta[keep], spec.gross, spec.max_weight)
            res.append(w)
        return pd.Series(res)

    z = rows.select("ti", "a", solve("a").alias("v")).select("ti", F.explode(F.arrays_zip("a", "v")).alias("z"))
    w = z.select("ti", F.col("z.a.symbol").alias("symbol"), F.col("z.v").alias("w"))
    return p.select("ti", "symbol").join(w, ["ti", "symbol"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))


# --- covariance ------------------------------------------------------------------------


def nearest_pd(sigma: np.ndarray, least: float = 1e-12) -> np.ndarray:
    sigma = 0.5 * (sigma + sigma.T)
    val, vec = np.linalg.eigh(sigma)
    if val.min() >= least:
        return sigma
    return (vec * np.maximum(val, max(least, val.max() * 1e-10))) @ vec.T


def shrink_from_moments(s2, s22, s31, t):
    """Constant-correlation shrinkage from second, (2,2) and (3,1) central moments."""
    n = len(s2)
    var = np.where(np.diag(s2) > 0, np.diag(s2), 1e-18)
    sd = np.sqrt(var)
    scale = np.outer(sd, sd)
    off = ~np.eye(n, dtype=bool)
    rbar = (s2 / scale)[off].mean()
    target = np.where(off, rbar * scale, np.diag(var))
    pi = s22 - s2**2
    left = s31 - var[:, None] * s2
    right = s31.T - var[None, :] * s2
    ratio = sd[None, :] / sd[:, None]
    cross = rbar * (ratio * left + right / ratio) / 2.0
    rho = np.trace(pi) + cross[off].sum()
    gamma = ((target - s2) ** 2).sum()
    delta = 0.0 if gamma <= 1e-18 else float(np.clip((pi.sum() - rho) / gamma / t, 0.0, 1.0))
    return nearest_pd((delta * target + (1 - delta) * s2) * (t / max(t - 1, 1))), delta


def shrink_covariance(x: np.ndarray, method: str = "constant_correlation", halflife: float = 60.0):
    t = len(x)
    if method == "sample":
        return nearest_pd(np.cov(x, rowvar=False))
    if method == "constant_correlation":
        c = x - x.mean(axis=0)
        return shrink_from_moments(c.T @ c / t, (c**2).T @ (c**2) / t, (c**3).T @ c / t, t)[0]
    if method == "single_index":
        m = x.mean(axis=1)
        c, mc = x - x.mean(axis=0), m - m.mean()
        beta = c.T @ mc / (mc @ mc)
        eps = ((c - np.outer(mc, beta)) ** 2).sum(axis=0) / max(t - 2, 1)
        return nearest_pd(np.outer(beta, beta) * (mc @ mc) / max(t - 1, 1) + np.diag(eps))
    if method == "ewma":
        w = 0.5 ** (np.arange(t - 1, -1, -1) / halflife)
        w /= w.sum()
        c = x - w @ x
        return nearest_pd((c * w[:, None]).T @ c / max(1 - (w**2).sum(), 1e-12))
    raise ValueError(f"unknown method: {method}")


def complete_rows(p: DataFrame, value: str = "r1") -> DataFrame:
    """(ti, names, x): timestamps where every symbol has a value, as vectors."""
    width = p.select("symbol").distinct().agg(F.count("*")).scalar()
    packed = p.filter(F.col(value).isNotNull()).groupBy("ti").agg(
        F.sort_array(F.collect_list(F.struct("symbol", F.col(value).alias("v")))).alias("a")
    )
    return packed.filter(F.size("a") == width).select(
        "ti", F.transform("a", lambda s: s["symbol"]).alias("names"), F.transform("a", lambda s: s["v"]).alias("x")
    )


def covariance(p: DataFrame, method: str = "constant_correlation", value: str = "r1", halflife: float = 60.0) -> DataFrame:
    """(symbol_a, symbol_b, cov) from complete timestamps.

    Every partition folds its vectors into (n x n) moment matrices; only those partial
    sums (one row per symbol and partition) are shuffled, and no pair of rows is ever
    emitted. The matrices are as large as the universe squared.
    """
    x = complete_rows(p, value)
    if method == "ewma":
        # halved every ``halflife`` complete rows back in time; ranks over timestamps only
        newest = Window.partitionBy(F.lit(0)).orderBy(F.col("ti").desc())
        w = F.pow(F.lit(0.5), (F.row_number().over(newest) - 1) / F.lit(halflife))
        x = x.join(x.select("ti").select("ti", w.alias("wt")), "ti")
    else:
        x = x.withColumn("wt", F.lit(1.0))
    wide = T.ArrayType(T.DoubleType())
    first = T.StructType([T.StructField("n", T.DoubleType()), T.StructField("w2", T.DoubleType()), T.StructField("s", wide)])

    def add_first(batches):
        n = w2 = 0.0
        s = None
        for b in batches:
            m, wt = np.array(b["x"].tolist(), dtype=float), b["wt"].to_numpy()
            if len(m):
                s = wt @ m if s is None else s + wt @ m
                n, w2 = n + wt.sum(), w2 + (wt**2).sum()
        if s is not None:
            yield pd.DataFrame({"n": [n], "w2": [w2], "s": [s]})

    sums = x.select("x", "wt").mapInPandas(add_first, first)
    total = sums.agg(
        F.struct(
            F.sum("n").alias("n"), F.sum("w2").alias("w2"),
            F.aggregate(
                F.collect_list("s"), F.array().cast("array<double>"),
                lambda a, b: F.when(F.size(a) == 0, b).otherwise(F.zip_with(a, b, lambda u, v: u + v)),
            ).alias("s"),
        ).alias("t")
    ).scalar()
    c = x.withColumn("_t", total)
    c = c.withColumn("d", F.zip_with("x", "_t.s", lambda v, s: v - s / F.col("_t.n")))
    part = T.StructType(
        [T.StructField("i", T.IntegerType()), T.StructField("t", T.DoubleType()), T.StructField("w2", T.DoubleType()), T.StructField("rows", T.DoubleType())]
        + [T.StructField(k, wide) for k in ("m11", "m22", "m31")]
        + [T.StructField("m1", T.DoubleType())]
        + [T.StructField("names", T.ArrayType(p.schema["symbol"].dataType))]
    )

    def add_second(batches):
        acc = names = None
        t = w2 = 0.0
        rows = 0
        for b in batches:
            d, wt = np.array(b["d"].tolist(), dtype=float), b["wt"].to_numpy()
            if not len(d):
                continue
            names = list(b["names"].iloc[0])
            t, w2 = b["n"].iloc[0], b["w2"].iloc[0]
            rows += len(d)
            mk = d.mean(axis=1)
            new = [(d * wt[:, None]).T @ d, (d**2).T @ d**2, (d**3).T @ d, d.T @ mk]
            acc = new if acc is None else [u + v for u, v in zip(acc, new)]
        if acc is not None:
            yield pd.DataFrame(
                {
                    "i": range(len(names)), "t": t, "w2": w2, "rows": float(rows),
                    "m11": list(acc[0]), "m22": list(acc[1]), "m31": list(acc[2]), "m1": acc[3],
                    "names": [names] * len(names),
                }
            )

    parts = c.select("names", "d", "wt", F.col("_t.n").alias("n"), F.col("_t.w2").alias("w2")).mapInPandas(add_second, part)
    plus = lambda k: F.aggregate(
        F.collect_list(k), F.array().cast("array<double>"),
        lambda a, b: F.when(F.size(a) == 0, b).otherwise(F.zip_with(a, b, lambda u, v: u + v)),
    ).alias(k)
    rows = parts.groupBy("i").agg(
        F.max("t").alias("t"), F.max("w2").alias("w2"), F.sum("rows").alias("rows"),
        plus("m11"), plus("m22"), plus("m31"), F.sum("m1").alias("m1"), F.first("names").alias("names"),
    )
    sym = p.schema["symbol"].dataType
    out = T.StructType([T.StructField("symbol_a", sym), T.StructField("symbol_b", sym), T.StructField("cov", T.DoubleType()), T.StructField("delta", T.DoubleType())])

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        m11, m22, m31 = (np.array(pdf[k].tolist()) for k in ("m11", "m22", "m31"))
        t, rows_n, delta = pdf["t"].iloc[0], pdf["rows"].iloc[0], 0.0
        if method == "constant_correlation":
            sigma, delta = shrink_from_moments(m11 / t, m22 / t, m31 / t, t)
        elif method == "ewma":
            sigma = nearest_pd(m11 / t / max(1 - pdf["w2"].iloc[0] / t**2, 1e-12))
        elif method == "sample":
            sigma = nearest_pd(m11 / (t - 1))
        else:
            mm = pdf["m1"].mean()
            beta = pdf["m1"].to_numpy() / mm
            eps = (np.diag(m11) - beta**2 * mm) / max(rows_n - 2, 1)
            sigma = nearest_pd(np.outer(beta, beta) * mm / max(rows_n - 1, 1) + np.diag(eps))
        names = list(pdf["names"].iloc[0])
        n = len(names)
        return pd.DataFrame({"symbol_a": np.repeat(names, n), "symbol_b": names * n, "cov": sigma.ravel(), "delta": delta})

    return rows.groupBy(F.lit(0).alias("one")).applyInPandas(finish, out)


# --- ensembles ------------------------------------------------------------------------


def _capped_projection(q: DataFrame, gross: float, cap: float, rounds: int) -> DataFrame:
    """Gross weights with the overflow above the cap spread over the rest and projected again.

    Sums per timestamp only, so all rounds run on one exchange; ``_fin`` marks timestamps that
    are settled.
    """
    s = fr.xs()
    for _ in range(rounds):
        w = F.col("w")
        over = F.abs(w) > cap + 1e-12
        q = q.withColumns({"_m": F.count_if(over).over(s), "_rest": F.sum(F.when(over, 0.0).otherwise(F.abs(w))).over(s)})
        spare = gross - cap * F.col("_m")
        done = F.col("_fin") | (F.col("_m") == 0)
        stuck = (F.col("_rest") <= 1e-12) | (spare <= 0)
        q = q.withColumn("_c", F.when(over, F.signum(w) * cap).when(stuck, w).otherwise(fr.div(w * spare, F.col("_rest"))))
        q = q.withColumns(project_neutral("_c") | {"_was": F.col("_c")})
        total = F.greatest(F.sum(F.abs("_c")).over(s), F.lit(1e-12))
        q = q.withColumn("w", F.when(done, w).when(stuck, F.col("_was")).otherwise(F.col("_c") / total * gross))
        q = q.withColumn("_fin", done | stuck)
    return q.drop("_m", "_rest", "_c", "_was")


def ensemble(member_weights: DataFrame, risk: DataFrame, max_weight=0.2, gross=1.0, max_positions=None, risk_parity=True) -> DataFrame:
    """Weighted mean of member weights (already on the common grid), re-projected.

    ``member_weights``: (ti, symbol, w, share); ``risk``: (ti, symbol, vol).
    """
    s = fr.xs()
    total = member_weights.groupBy("ti", "symbol").agg(F.sum(F.col("w") * F.col("share")).alias("w"))
    q = total.join(risk.select("ti", "symbol", "vol"), ["ti", "symbol"], "left")
    if max_positions is not None:
        place = F.row_number().over(s.orderBy(F.desc(F.abs("w")), "symbol"))
        q = q.withColumn("w", F.when(place <= max_positions, F.col("w")).otherwise(0.0))
    if risk_parity:
        floor = F.percentile("vol", F.lit(0.10)).over(s)
        q = q.withColumn("w", F.when(floor > 0, inverse_vol(F.col("w"), F.col("vol"), floor)).otherwise(F.col("w")))
    q = q.withColumns(project_neutral("w")).withColumn("_t", F.sum(F.abs("w")).over(s))
    q = q.withColumns({"w": F.when(F.col("_t") > 1e-12, F.col("w") / F.col("_t") * gross).otherwise(0.0), "_fin": F.col("_t") <= 1e-12})
    return _capped_projection(q, gross, max_weight * gross, 4).select("ti", "symbol", "w")
