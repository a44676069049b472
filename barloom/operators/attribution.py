"""Return attribution of target weights, leverage, and resampled outcomes."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions import frames as fr
from barloom.operators.ordered import per_series


@dataclass(frozen=True)
class CostModel:
    taker_fee_bps: float = 5.0
    maker_fee_bps: float = 2.0
    maker_ratio: float = 0.5
    half_spread_bps: float = 1.0
    min_bps: float = 0.5

    def base_bps(self) -> float:
        taker = 1 - self.maker_ratio
        fee = self.maker_ratio * self.maker_fee_bps + taker * self.taker_fee_bps
        return max(self.min_bps, fee + taker * self.half_spread_bps)

    def bps(self, extra: Column | None = None) -> Column:
        """One-way cost per symbol; ``extra`` is the symbol's own slippage."""
        c = F.lit(self.base_bps())
        if extra is not None:
            c = c + F.coalesce(extra, F.lit(0.0))
        return F.greatest(c, F.lit(self.min_bps))


def simulate(
    p: DataFrame, cost: CostModel = CostModel(), bar_hours: float = 4.0, every: int = 1,
    drift: bool = True, extra_bps: str | None = None, config=(),
) -> DataFrame:
    """Attribution per period from (config.., symbol, ti, close, w, funding).

    The traded amount is measured against the previous target after price drift:
    w' = w(1+r)/(1+sum w r). That needs only the previous row of the symbol and one
    sum per timestamp, so two exchanges (symbol, timestamp) do the whole attribution.
    """
    config = list(config)
    sym, ts = config + ["symbol"], config + ["ti"]
    q = p.filter(F.col("ti") % every == 0) if every > 1 else p
    q = q.withColumn("w", F.coalesce("w", F.lit(0.0)))
    o = Window.partitionBy(*sym).orderBy("ti")
    q = q.withColumn("r", fr.div(F.lead("close").over(o), "close") - 1.0)
    q = q.withColumns({"pw": F.lag("w").over(o), "pr": F.lag("r").over(o), "_last": F.lead("ti").over(o).isNull()})
    s = Window.partitionBy(*ts)
    any_prev = F.count("pr").over(s) > 0
    denom = 1.0 + F.coalesce(F.sum(F.col("pw") * F.coalesce("pr", F.lit(0.0))).over(s), F.lit(0.0))
    moved = F.when(F.abs(denom) < 1e-9, 0.0).otherwise(
        F.col("pw") * (1.0 + F.coalesce("pr", F.lit(0.0))) / F.when(F.abs(denom) >= 1e-9, denom)
    )
    held = F.when(any_prev, moved).otherwise(F.col("pw")) if drift else F.col("pw")
    q = q.withColumn("_tr", F.abs(F.col("w") - F.coalesce(held, F.lit(0.0))))
    bps = cost.bps(F.col(extra_bps) if extra_bps else None)
    fund = F.coalesce("funding", F.lit(0.0)) if "funding" in p.columns else F.lit(0.0)
    g = q.groupBy(*ts, "ts_ms").agg(
        F.when(F.count("r") > 0, F.sum(F.col("w") * F.coalesce("r", F.lit(0.0)))).alias("gross"),
        F.sum(F.col("_tr") * bps / 1e4).alias("cost"),
        (-F.sum(F.col("w") * fund) * (bar_hours * every / 8.0)).alias("funding_pnl"),
        F.sum("_tr").alias("turnover"),
        F.count_if(F.col("w") != 0).alias("n_positions"),
        F.sum("w").alias("net_exposure"),
        F.sum(F.abs("w")).alias("gross_exposure"),
        F.max("_last").alias("_last"),
    )
    net = F.col("gross") - F.col("cost") + F.col("funding_pnl")
    return g.withColumn("ret", F.when(~F.col("_last"), net)).drop("_last")


def mark_to_market(p: DataFrame, marks_every: int, cost: CostModel = CostModel(), bar_hours: float = 4.0) -> DataFrame:
    """Attribution on the fine grid; ``w`` is the target on rebalance rows only.

    Between rebalances weights drift in closed form, w0 G / (1 + sum w0 (G - 1)) with
    G the growth of the symbol since the rebalance, so no bar depends on the bar before
    through anything but a running product inside its own segment.
    """
    o = Window.partitionBy("symbol").orderBy("ti")
    q = p.withColumn("is_mark", F.col("ti") % marks_every == 0)
    q = q.withColumns(
        {
            "r": F.when(F.col("ti") > 0, fr.ret("close")),
            "w0": F.when(F.col("is_mark"), F.coalesce("w", F.lit(0.0))),
        }
    )
    # the bar of a rebalance still belongs to the segment that ends there
    prior = o.rowsBetween(Window.unboundedPreceding, -1)
    q = q.withColumns(
        {
            "seg": F.floor((F.col("ti") - 1) / marks_every),
            "h0": F.coalesce(F.last("w0", ignorenulls=True).over(prior), F.lit(0.0)),
        }
    )
    run = Window.partitionBy("symbol", "seg").orderBy("ti").rowsBetween(Window.unboundedPreceding, 0)
    q = q.withColumn("g", F.product(1.0 + F.coalesce("r", F.lit(0.0))).over(run))
    q = q.withColumn("g0", F.coalesce(F.lag("g").over(Window.partitionBy("symbol", "seg").orderBy("ti")), F.lit(1.0)))
    s = Window.partitionBy("ti")
    v1 = 1.0 + F.sum(F.col("h0") * (F.col("g") - 1.0)).over(s)
    v0 = 1.0 + F.sum(F.col("h0") * (F.col("g0") - 1.0)).over(s)
    q = q.withColumns({"v1": v1, "v0": v0})
    before = F.col("h0") * F.col("g0") / F.col("v0")
    after = F.col("h0") * F.col("g") / F.col("v1")
    q = q.withColumns({"_before": before, "_after": after})
    held = F.when(F.col("is_mark"), F.col("w0")).otherwise(F.col("_after"))
    traded = F.when(F.col("is_mark"), F.abs(F.col("w0") - F.col("_after"))).otherwise(0.0)
    fund = F.coalesce("funding", F.lit(0.0)) if "funding" in p.columns else F.lit(0.0)
    q = q.withColumns({"_held": held, "_tr": traded, "_bps": cost.bps() / 1e4})
    live = (F.count("r") > 0) & (F.sum(F.abs("_before")) > 0)
    g = q.groupBy("ti", "ts_ms").agg(
        F.when(live, F.max(F.col("v1") / F.col("v0")) - 1.0).otherwise(0.0).alias("gross"),
        F.sum(F.col("_tr") * F.col("_bps")).alias("cost"),
        F.when(live, -F.sum(F.col("_before") * fund) * (bar_hours / 8.0)).otherwise(0.0).alias("funding_pnl"),
        F.sum("_tr").alias("turnover"),
        F.count_if(F.col("_held") != 0).alias("n_positions"),
        F.sum("_held").alias("net_exposure"),
        F.sum(F.abs("_held")).alias("gross_exposure"),
    )
    return g.withColumn("ret", F.col("gross") - F.col("cost") + F.col("funding_pnl"))


def simple_attribution(p: DataFrame, every: int = 6, bar_hours: float = 4.0, cost_rate: float = 0.0004, config=(), rate: str | None = None) -> DataFrame:
    """No drift, flat cost rate. Rows (config.., symbol, ti, ts_ms, close, w, funding).

    ``rate`` names a per-row cost rate column when the rate is part of the config.
    """
    config = list(config)
    o = Window.partitionBy(*config, "symbol").orderBy("ti")
    q = p.withColumns(
        {
            "r": fr.div(F.lead("close").over(o), "close") - 1.0,
            "_tr": F.abs(F.col("w") - F.coalesce(F.lag("w").over(o), F.lit(0.0))),
            "_last": F.lead("ti").over(o).isNull(),
        }
    )
    c = F.max(rate) if rate else F.lit(cost_rate)
    g = q.groupBy(*config, "ti", "ts_ms").agg(
        F.sum(F.col("w") * F.col("r")).alias("gross"),
        F.sum("_tr").alias("turnover"),
        (F.sum("_tr") * c).alias("cost"),
        (-F.sum(F.col("w") * F.col("funding")) * (every * bar_hours / 8.0)).alias("funding_pnl"),
        F.max("_last").alias("_last"),
    )
    net = F.coalesce("gross", F.lit(0.0)) - F.col("cost") + F.coalesce("funding_pnl", F.lit(0.0))
    return g.withColumn("ret", F.when(~F.col("_last"), net)).drop("_last")


# --- basis carry ------------------------------------------------------------------------


@dataclass(frozen=True)
class BasisSpec:
    n_positions: int = 8
    rebalance_bars: int = 1008
    funding_window: int = 12
    exit_multiple: int = 3
    round_trip_bps: float = 24.0
    min_universe: int = 8


def basis(perp: Column, spot: Column) -> Column:
    return fr.div(perp, spot) - 1.0


def basis_carry(p: DataFrame, spec: BasisSpec = BasisSpec()) -> DataFrame:
    """Short perp, long spot on the names with the highest lagged funding.

    Rows (symbol, ti, close, spot, funding). Only rebalance timestamps, with the few
    names inside the keep zone, reach the selection walk; profit and loss is a join of
    the held names per segment with their bars.
    """
    m = max(2, spec.funding_window // 3)
    # the mean of row i-1 shifted once more: a rebalance at i reads the score of i-1
    q = p.withColumn("_s", fr.roll_mean("funding", spec.funding_window, m))
    q = q.withColumn("_score", fr.lag("_s", 2))
    marks = q.filter((F.col("ti") > 0) & (F.col("ti") % spec.rebalance_bars == 0) & F.col("_score").isNotNull())
    keep = spec.n_positions * spec.exit_multiple
    marks = marks.withColumns({"_n": F.count("*").over(fr.xs()), "_p": fr.first_rank("_score", desc=True)})
    zones = (
        marks.filter((F.col("_n") >= spec.min_universe) & (F.col("_p") <= keep))
        .groupBy("ti").agg(F.sort_array(F.collect_list(F.struct("_p", "symbol"))).alias("a"))
        .select(F.lit(0).alias("book"), "ti", F.transform("a", lambda s: s["symbol"]).alias("names"))
    )
    out = T.StructType(
        [
            T.StructField("ti", T.IntegerType()),
            T.StructField("symbol", p.schema["symbol"].dataType),
            T.StructField("n_held", T.IntegerType()),
            T.StructField("fee", T.DoubleType()),
        ]
    )

    def walk(pdf):
        held, rows = set(), []
        for ti, names in zip(pdf.ti, pdf.names):
            names = list(names)
            stay = held & set(names)
            room = max(0, spec.n_positions - len(stay))
            new = stay | set([x for x in names[: spec.n_positions] if x not in stay][:room])
            if new:
                fee = len(new ^ held) / len(new) * spec.round_trip_bps / 1e4
                held = new
                rows += [(ti, x, len(new), fee) for x in sorted(new)]
        return pd.DataFrame(rows, columns=["ti", "symbol", "n_held", "fee"])

    book = per_series(zones, ["book"], walk, out, ["names"])
    # bars of segment k run from its rebalance to the bar before the next one; a closed
    # universe keeps the previous book, which the walk expresses by emitting nothing
    starts = book.select("ti").distinct()
    axis = p.select("ti").distinct()
    w = Window.partitionBy(F.lit(0)).orderBy("ti")
    seg = axis.join(starts.withColumn("_m", F.col("ti")), "ti", "left").select(
        "ti", F.last("_m", ignorenulls=True).over(w).alias("seg")
    )
    fees = book.groupBy("ti").agg(F.max("fee").alias("fee"))
    bars = q.select(
        "symbol", "ti",
        (F.col("close") / fr.lag("close") - 1.0).alias("dp"),
        (F.col("spot") / fr.lag("spot") - 1.0).alias("ds"),
        fr.lag("funding").alias("pf"),
    ).join(seg, "ti")
    held = book.select(F.col("ti").alias("seg"), "symbol", "n_held")
    pnl = (
        bars.join(held, ["seg", "symbol"])
        .filter(F.col("dp").isNotNull() & F.col("ds").isNotNull())
        .groupBy("ti").agg(
            F.sum(-(F.col("dp") - F.col("ds")) / F.col("n_held")).alias("basis"),
            F.sum(F.coalesce("pf", F.lit(0.0)) * 0.5 / F.col("n_held")).alias("funding"),
        )
    )
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return (
        axis.filter("ti > 0").join(pnl, "ti", "left").join(fees, "ti", "left")
        .select("ti", z("basis").alias("basis"), z("funding").alias("funding"), (-z("fee")).alias("fee"))
        .withColumn("total", F.col("basis") + F.col("funding") + F.col("fee"))
    )


# --- leverage ----------------------------------------------------------------------------


@dataclass(frozen=True)
class LeverageSpec:
    target_ann_vol: float = 0.30
    max_leverage: float = 3.0
    vol_window: int = 60
    vol_min_periods: int = 20
    dd_start: float = 0.10
    dd_stop: float = 0.25
    periods_per_year: float = 365.0


def vol_target(returns: DataFrame, spec: LeverageSpec = LeverageSpec(), keys=("name",), x="ret") -> DataFrame:
    """Adds ``lev``: target over lagged realised vol, capped, 0 while unknown."""
    k = dict(keys=tuple(keys))
    q = returns.withColumn("_v", fr.roll_std(x, spec.vol_window, spec.vol_min_periods, **k))
    ann = fr.lag("_v", 1, **k) * np.sqrt(spec.periods_per_year)
    lev = F.least(fr.div(F.lit(spec.target_ann_vol), ann), F.lit(spec.max_leverage))
    return q.withColumn("lev", F.coalesce(F.when(ann.isNotNull() & (ann != 0), lev), F.lit(0.0))).drop("_v")


def drawdown_throttle(curve: DataFrame, spec: LeverageSpec = LeverageSpec(), keys=("name",), x="equity") -> DataFrame:
    o = Window.partitionBy(*keys).orderBy("ti")
    peak = F.max(x).over(o.rowsBetween(Window.unboundedPreceding, 0))
    dd = 1.0 - fr.div(x, peak)
    f = fr.clip(1.0 - (dd - spec.dd_start) / max(spec.dd_stop - spec.dd_start, 1e-9), 0.0, 1.0)
    q = curve.withColumn("_f", f)
    return q.withColumn("throttle", F.coalesce(F.lag("_f").over(o), F.lit(1.0))).drop("_f")


def apply_leverage(returns: DataFrame, spec: LeverageSpec = LeverageSpec(), use_vol=True, use_dd=True, keys=("name",)) -> DataFrame:
    """Levered path; the throttle feeds back on equity, one walk per strategy."""
    r = returns.filter(F.col("ret").isNotNull())
    q = vol_target(r, spec, keys) if use_vol else r.withColumn("lev", F.lit(1.0))
    fields = [returns.schema[k] for k in keys] + [T.StructField("ti", T.IntegerType())]
    out = T.StructType(fields + [T.StructField(c, T.DoubleType()) for c in ("ret", "leverage", "equity")])
    span = max(spec.dd_stop - spec.dd_start, 1e-9)

    def walk(pdf):
        equity = peak = 1.0
        rows = []
        for r, lev in zip(pdf["ret"].to_numpy(), pdf["lev"].to_numpy()):
            lev = min(lev, spec.max_leverage)
            dd = 1.0 - equity / peak
            if use_dd and dd > spec.dd_start:
                lev *= min(max(1.0 - (dd - spec.dd_start) / span, 0.0), 1.0)
            step = max(lev * r, -0.999)
            equity *= 1.0 + step
            peak = max(peak, equity)
            rows.append((step, lev, equity))
        res = pdf[list(keys) + ["ti"]].copy()
        res[["ret", "leverage", "equity"]] = np.array(rows).reshape(-1, 3)
        return res

    return per_series(q, list(keys), walk, out, ["ret", "lev"])


def kelly_leverage(mu: Column, sigma: Column, fraction: float = 0.5, cap: float = 5.0) -> Column:
    return F.when(sigma <= 1e-15, 0.0).otherwise(fr.clip(fraction * mu / (sigma * sigma), 0.0, cap))


def explode_grid(df: DataFrame, name: str, values) -> DataFrame:
    """One copy of every row per grid value (a literal array, not a join)."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def growth_grid(returns: DataFrame, levers, ppy: float, keys=()) -> DataFrame:
    """Exact annual log growth and drawdown for each leverage."""
    q = explode_grid(returns.filter(F.col("ret").isNotNull()), "leverage", levers)
    step = 1.0 + F.col("leverage") * F.col("ret")
    o = Window.partitionBy(*keys, "leverage").orderBy("ti").rowsBetween(Window.unboundedPreceding, 0)
    q = q.withColumn("_g", F.greatest(step, F.lit(1e-12))).withColumn("_e", F.product("_g").over(o))
    q = q.withColumn("_dd", 1.0 - F.col("_e") / F.greatest(F.max("_e").over(o), F.lit(1.0)))
    return q.groupBy(*keys, "leverage").agg(
        (F.avg(F.log("_g")) * ppy).alias("log_growth"),
        F.max("_dd").alias("max_dd"),
        F.avg((step <= 0).cast("double")).alias("ruin_share"),
    )


def bootstrap_table(
    returns: DataFrame, n_periods: int, levers, target: float, n_paths: int = 20000, block: int = 5,
    ruin: float = 0.30, ppy: float = 365.0, seed: int = 7,
) -> DataFrame:
    """Outcome distribution per leverage over block-resampled paths.

    Paths are rows of ``range``; each draws its block starts from a hash of (path,
    block, seed), so a lost task draws the same path again. The returns travel as one
    array (one value per period of one strategy), and each path folds its own steps.
    """
    spark = returns.sparkSession
    one = returns.filter(F.col("ret").isNotNull()).agg(
        F.struct(
            F.transform(F.sort_array(F.collect_list(F.struct("ti", "ret"))), lambda s: s["ret"]).alias("x"),
            F.avg("ret").alias("mu"), F.stddev_samp("ret").alias("sd"), F.count("*").alias("n"),
        ).alias("t")
    ).scalar()
    n_blocks = -(-n_periods // block)
    paths = spark.range(0, n_paths, numPartitions=spark.sparkContext.defaultParallelism).withColumn("t", one)
    paths = paths.withColumn(
        "s",
        F.expr(
            f"""slice(flatten(transform(sequence(0, {n_blocks - 1}), b ->
              transform(sequence(0, {block - 1}), j ->
                element_at(t.x, cast(pmod(xxhash64(id, b, {seed}L), t.n - {block}) as int) + j + 1)))), 1, {n_periods})"""
        ),
    )
    q = explode_grid(paths.select("id", "s", "t.mu", "t.sd"), "leverage", [float(v) for v in levers])
    q = q.withColumn(
        "f",
        F.expr(
            """aggregate(s, named_struct('e', 1D, 'm', cast('Infinity' as double)),
              (a, r) -> named_struct('e', a.e * (1 + greatest(r * leverage, -0.999D)),
                                     'm', least(a.m, a.e * (1 + greatest(r * leverage, -0.999D)))))"""
        ),
    )
    q = q.withColumn("ruined", F.col("f.m") <= ruin)
    q = q.withColumn("final", F.when(F.col("ruined"), F.lit(ruin)).otherwise(F.col("f.e")))
    kelly = F.max("mu") / (F.max("sd") * F.max("sd"))
    return q.groupBy("leverage").agg(
        F.when(kelly > 1e-9, F.first("leverage") / kelly).alias("kelly_multiple"),
        F.avg((F.col("final") >= 1.0 + target).cast("double")).alias("p_target"),
        F.avg(F.col("ruined").cast("double")).alias("p_ruin"),
        F.avg((F.col("final") < 1.0).cast("double")).alias("p_loss"),
        (F.percentile("final", F.lit(0.5)) - 1.0).alias("median"),
        (F.avg("final") - 1.0).alias("mean"),
        (F.percentile("final", F.lit(0.05)) - 1.0).alias("p05"),
        (F.percentile("final", F.lit(0.95)) - 1.0).alias("p95"),
        (F.first("leverage") * F.max("sd") * np.sqrt(ppy)).alias("ann_vol_implied"),
    )


def path_risk(fine: DataFrame, levers, bars_per_period: int = 18, maintenance: float = 0.01, keys=()) -> DataFrame:
    """(*keys, leverage, max_dd, ruin_share) with sizes held fixed inside each period.

    Inside a period equity is e0 (1 + L c) with c the summed return so far; a period
    that touches the maintenance level is a ruin and keeps its first bar only. Periods
    are chained by a running product, one row per period; ``keys`` name the strategy.
    """
    o = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("ti")  # one row per bar of a strategy
    r = fine.filter(F.col("ret").isNotNull()).withColumn("_i", F.row_number().over(o) - 1)
    r = r.withColumn("p", F.floor(F.col("_i") / bars_per_period))
    run = Window.partitionBy(*keys, "p").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("c", F.sum("ret").over(run))
    per = r.groupBy(*keys, "p").agg(
        F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.min_by("c", "_i").alias("c0"), F.max_by("c", "_i").alias("c1")
    ).filter(F.col("n") == bars_per_period)
    q = explode_grid(per, "leverage", [float(v) for v in levers])
    lev = F.col("leverage")
    q = q.withColumn("ruin", 1.0 + lev * F.col("lo") <= maintenance * lev)
    f = F.when(F.col("ruin"), F.greatest(F.lit(1e-12), 1.0 + lev * F.col("c0"))).otherwise(1.0 + lev * F.col("c1"))
    w = Window.partitionBy(*keys, "leverage").orderBy("p")
    q = q.withColumn("_f", f)
    q = q.withColumn("e0", F.coalesce(F.product("_f").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0)))
    top = F.when(~F.col("ruin"), F.col("e0") * (1.0 + lev * F.col("hi")))
    q = q.withColumn("peak", F.greatest(F.lit(1.0), F.coalesce(F.max(top).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))))
    dd = F.when(F.col("ruin"), 1.0).otherwise(1.0 - F.col("e0") * (1.0 + lev * F.col("lo")) / F.col("peak"))
    return q.groupBy(*keys, "leverage").agg(
        F.greatest(F.lit(0.0), F.max(dd)).alias("max_dd"), F.avg(F.col("ruin").cast("double")).alias("ruin_share")
    )


def executable_leverage(returns: DataFrame, target: float, window: int, ppy: float, floor: float, cap: float, dd_start=0.0, dd_stop=0.0, peak_window: int = 60, keys=("name",)) -> DataFrame:
    """Leverage limited to {0} or [floor, cap]; drawdown measured from a sliding peak."""
    k = dict(keys=tuple(keys))
    r = returns.filter(F.col("ret").isNotNull()).withColumn("_v", fr.roll_std("ret", window, max(5, window // 3), **k))
    r = r.withColumn("raw", fr.div(F.lit(target), fr.lag("_v", 1, **k) * float(np.sqrt(ppy))))
    span = max(dd_stop - dd_start, 1e-9)
    raw = F.coalesce(F.when(~F.isnan("raw"), F.col("raw")), F.lit(floor))
    out = T.StructType([r.schema[n] for n in (*keys, "ti")] + [T.StructField(n, T.DoubleType()) for n in ("ret", "leverage", "equity")])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        """One pass along a strategy, holding the equity and its last ``peak_window`` values."""
        recent, now, rows = deque([1.0], peak_window), 1.0, []
        for want, ret in zip(pdf["raw"], pdf["ret"], strict=True):
            fall = min(max((1 - now / max(recent) - dd_start) / span, 0.0), 1.0) if dd_stop > dd_start else 0.0
            lev = want * (1 - fall)
            lev = 0.0 if lev < floor else min(lev, cap)
            made = max(lev * ret, -0.999)
            now *= 1 + made
            recent.append(now)
            rows.append((made, lev, now))
        return pdf[[*keys, "ti"]].assign(**dict(zip(("ret", "leverage", "equity"), np.array(rows, float).reshape(-1, 3).T, strict=True)))

    return per_series(r.withColumn("raw", raw), keys, walk, out, ["raw", "ret"])
