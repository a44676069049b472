"""Events, barriers, labels, exits, and the sample weights and folds built on them."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions import frames as fr
from barloom.functions import kernels as kn
from barloom.operators.ordered import BLOCK_ROWS, per_series, scan

HOUR_MS = 3_600_000


# --- thresholds and CUSUM -------------------------------------------------------------------


def cusum_threshold(multiplier=2.5, least=1e-4, most=0.05, bars_per_atr=1.0, rel: Column | None = None) -> Column:
    """Clipped relative volatility; ``rel`` replaces atr/price when smoothed."""
    r = rel if rel is not None else F.col("atr_14") / F.col("close") / float(np.sqrt(bars_per_atr))
    return fr.clip(multiplier * r, least, most)


def smoothed_threshold(bars: DataFrame, span: int = 50, multiplier=2.5, least=1e-4, most=0.05, bars_per_atr=1.0, reset: str | None = None) -> DataFrame:
    """Threshold from an exponential mean re-seeded at reset rows."""
    q = bars.withColumn("_rel", F.col("atr_14") / F.col("close") / float(np.sqrt(bars_per_atr)))
    q = q.withColumn("_reset", F.col(reset).cast("boolean") if reset else F.lit(False))
    alpha = 2.0 / (span + 1.0)
    out = T.StructType([bars.schema["symbol"], T.StructField("bar_idx", T.IntegerType()), T.StructField("_ew", T.DoubleType())])

    def run(pdf):
        state, vals = None, []
        for x, r in zip(pdf["_rel"].tolist(), pdf["_reset"].tolist()):
            state, v = kn.ewma_step(state, x, alpha, r)
            vals.append(v)
        return pdf[["symbol", "bar_idx"]].assign(_ew=vals)

    e = per_series(q, ["symbol"], run, out, ["_rel", "_reset"], order="bar_idx")
    j = bars.join(e, ["symbol", "bar_idx"])
    return j.withColumn("threshold", cusum_threshold(multiplier, least, most, rel=F.col("_ew"))).drop("_ew")


EVENT_FIELDS = [T.StructField("bar_idx", T.IntegerType()), T.StructField("raw_dir", T.IntegerType())]


def cusum_events(bars: DataFrame, cooldown: int = 10, spatial: float = 1.0, block_rows: int = BLOCK_ROWS, rows_per_key: int | None = None) -> DataFrame:
    """(symbol, bar_idx, raw_dir) of accepted triggers; needs close, threshold, atr_14.

    Only events leave Python. Both sums restart at every trigger and the gate looks at
    the last accepted event, so blocks of a long series agree soon after a seam.
    """
    schema = T.StructType([bars.schema["symbol"]] + EVENT_FIELDS)

    def kernel(state, pdf):
        hits = []
        cols = (pdf["bar_idx"].tolist(), pdf["close"].tolist(), pdf["threshold"].tolist(), pdf["atr_14"].tolist())
        for i, p, h, a in zip(*cols):
            state, side = kn.cusum_step(state, i, p, h, a, cooldown, spatial)
            if side:
                hits.append((i, side))
        out = pd.DataFrame(hits, columns=["bar_idx", "raw_dir"])
        out.insert(0, "symbol", pdf["symbol"].iloc[0])
        return state, out

    return scan(bars, ["symbol"], kernel, schema, None, ["close", "threshold", "atr_14"], pos="bar_idx", block_rows=block_rows, rows_per_key=rows_per_key)


def event_sides(events: DataFrame, bars: DataFrame, fade: bool = False, gate: float = 0.6) -> DataFrame:
    """Events with their bar's fields, trade mode and side."""
    from barloom.operators.sizing import trade_mode

    j = events.join(bars, ["symbol", "bar_idx"])
    mode = trade_mode(F.coalesce("p_trend", F.lit(0.5)), F.coalesce("p_chop", F.lit(0.5)), fade, gate)
    follow = F.when(F.coalesce("trend_score", F.lit(0.0)) >= 0, 1).otherwise(-1)
    side = F.when(F.col("trade_mode") == "none", F.col("raw_dir")).when(F.col("trade_mode") == "follow", follow).otherwise(-follow)
    return j.withColumn("trade_mode", mode).withColumn("side", side.cast("int"))


def drift_alarms(scores: DataFrame, keys, x: str, baseline: float, threshold: float = 0.05, reset: bool = True, pos: str = "pos", block_rows: int = BLOCK_ROWS, rows_per_key: int | None = None) -> DataFrame:
    """Adds s_plus and alarm along each key's scores."""
    schema = T.StructType(
        [scores.schema[k] for k in keys]
        + [T.StructField(pos, T.LongType()), T.StructField("s_plus", T.DoubleType()), T.StructField("alarm", T.BooleanType())]
    )

    def kernel(state, pdf):
        rows = []
        for v in pdf[x].tolist():
            state, o = kn.drift_step(state, v, baseline, threshold, reset)
            rows.append(o)
        return state, pdf[list(keys) + [pos]].assign(s_plus=[r[0] for r in rows], alarm=[r[1] for r in rows])

    return scan(scores, list(keys), kernel, schema, [0.0], [x], pos=pos, block_rows=block_rows, rows_per_key=rows_per_key)


def exit_threshold(p_trend: DataFrame, keys, quantile: float = 0.10, mode: str = "follow") -> DataFrame:
    """Quantile of the training p_trend, with a fixed value below 20 observations."""
    q = quantile if mode == "follow" else 1.0 - quantile
    fixed = 0.35 if mode == "follow" else 0.65
    return p_trend.groupBy(*keys).agg(
        F.when(F.count("p_trend") >= 20, fr.clip(F.percentile("p_trend", F.lit(q)), 0.0, 1.0)).otherwise(fixed).alias("threshold")
    )


# --- barriers -------------------------------------------------------------------------------


def barriers(entry: Column, side: Column, pt: Column, pc: Column, sigma: Column, toxic: Column, cost: float = 0.0004):
    s = F.greatest(sigma, F.lit(1e-6))
    pt, pc = fr.clip(pt, 0.0, 1.0), fr.clip(pc, 0.0, 1.0)
    c = cost * F.when(toxic, 1.5).otherwise(1.0)
    tp = entry * (1.0 + side * (pc * 1.5 + pt * 3.0) * s)
    sl = entry * (1.0 - side * ((pc * 1.5 + pt * 2.0) * s + c))
    return tp, sl


def event_paths(events: DataFrame, bars: DataFrame, length, cols, until: Column | None = None) -> DataFrame:
    """Each event next to its following bars: an equi-join on (symbol, bar index).

    An event fans out to at most ``length`` rows, fixed by a parameter.
    """
    n = F.lit(length) if isinstance(length, int) else length
    steps = events.withColumn("k", F.explode(F.sequence(F.lit(1), n)))
    path = bars.select("symbol", F.col("bar_idx").alias("_i"), *[F.col(c).alias(f"f_{c}") for c in cols])
    steps = steps.withColumn("_i", F.col("t0") + F.col("k"))
    if until is not None:
        steps = steps.filter(F.col("_i") < until)
    return steps.join(path, ["symbol", "_i"]).drop("_i")


def triple_barrier(events: DataFrame, bars: DataFrame, window: int = 20) -> DataFrame:
    """(symbol, t0, t1, side, label, realized_return, hit_barrier, exit_price).

    ``events``: symbol, t0, side, entry, tp, sl. First bar touching a barrier wins, the
    stop when both are touched; else the last close of the window.
    """
    p = event_paths(events, bars, window, ("high", "low", "close"))
    long = F.col("side") > 0
    hit_sl = F.when(long, F.col("f_low") <= F.col("sl")).otherwise(F.col("f_high") >= F.col("sl"))
    hit_tp = F.when(long, F.col("f_high") >= F.col("tp")).otherwise(F.col("f_low") <= F.col("tp"))
    g = p.groupBy("symbol", "t0").agg(
        F.first("side").alias("side"), F.first("entry").alias("entry"), F.first("tp").alias("tp"), F.first("sl").alias("sl"),
        F.min(F.when(hit_sl, F.col("k"))).alias("k_sl"), F.min(F.when(hit_tp, F.col("k"))).alias("k_tp"),
        F.max("k").alias("k_end"), F.max_by("f_close", "k").alias("last"),
    )
    stop = F.col("k_sl").isNotNull() & (F.col("k_tp").isNull() | (F.col("k_sl") <= F.col("k_tp")))
    take = F.col("k_tp").isNotNull() & ~stop
    price = F.when(stop, F.col("sl")).when(take, F.col("tp")).otherwise(F.col("last"))
    ret = F.col("side") * (price - F.col("entry")) / F.col("entry")
    k = F.when(stop, F.col("k_sl")).when(take, F.col("k_tp")).otherwise(F.col("k_end"))
    return g.select(
        "symbol", "t0", (F.col("t0") + k).alias("t1"), "side",
        F.when(stop, 0).when(take, 1).otherwise((ret > 0).cast("int")).alias("label"),
        ret.alias("realized_return"),
        F.when(stop, "SL").when(take, "TP").otherwise("TIME").alias("hit_barrier"),
        price.alias("exit_price"),
    )


def trailing_exit(events: DataFrame, bars: DataFrame, t_max: int = 120, fold_end: str | None = None, m_trail=2.0, gamma=0.75, flips: int = 2, min_tick=1e-4, min_ticks=10, min_atr_pct=0.001) -> DataFrame:
    """Regime-aware trailing exit of each event.

    ``events``: symbol, t0, side, mode, entry, sl, liq (nullable), thr (flip threshold),
    optionally t_max and a fold end that cuts the path. Per bar the order is
    liquidation, stop, trail, regime flip; the trail reads extremes of earlier bars.
    """
    live = F.col("t_max") if "t_max" in events.columns else F.lit(t_max)
    e = events.withColumn("_live", live)
    cut = F.col(fold_end) if fold_end else None
    p = event_paths(e, bars, F.col("_live"), ("high", "low", "atr_14", "p_trend"), cut)
    o = Window.partitionBy("symbol", "t0", *(["fold"] if "fold" in events.columns else [])).orderBy("k")
    prior = o.rowsBetween(Window.unboundedPreceding, -1)
    long = F.col("side") > 0
    best = F.when(long, F.greatest("entry", F.max("f_high").over(prior))).otherwise(F.least("entry", F.min("f_low").over(prior)))
    floor = F.greatest(F.lit(min_tick * min_ticks), F.col("entry") * min_atr_pct)
    p = p.withColumn("_x", best).withColumn(
        "_c", m_trail * (1 + gamma * F.col("f_p_trend")) * F.greatest("f_atr_14", floor) / F.col("_x")
    )
    trail = F.when(long, F.greatest(F.col("_x") * F.exp(-F.col("_c")), F.col("sl"))).otherwise(F.least(F.col("_x") * F.exp(F.col("_c")), F.col("sl")))
    weak = F.when(F.col("mode") == "follow", F.col("f_p_trend") < F.col("thr")).otherwise(F.col("f_p_trend") > F.col("thr"))
    adverse = F.when(long, F.col("f_low")).otherwise(-F.col("f_high"))
    beyond = lambda level: adverse <= F.when(long, level).otherwise(-level)
    p = p.withColumns({"_w": weak.cast("int"), "_t": trail})
    run = F.sum("_w").over(o.rowsBetween(-(flips - 1), 0))
    reason = (
        F.when((F.col("liq") > 0) & beyond(F.col("liq")), "LIQUIDATION")
        .when(beyond(F.col("sl")), "SL")
        .when(beyond(F.col("_t")), "TRAIL")
        .when(run == flips, "REGIME_FLIP")
    )
    p = p.withColumn("_r", reason)
    key = ["symbol", "t0"] + (["fold"] if "fold" in events.columns else [])
    hit = F.when(F.col("_r").isNotNull(), F.col("k"))
    g = p.groupBy(*key).agg(F.min(hit).alias("_k"), F.min_by("_r", hit).alias("_reason"), F.max("k").alias("_n"))
    j = e.join(g, key, "left")
    n = F.coalesce("_n", F.lit(0))
    ahead = F.greatest(F.col(fold_end) - (F.col("t0") + 1), F.lit(0)) if fold_end else None
    eff = F.least(F.col("_live"), ahead) if fold_end else F.col("_live")
    short = (n < F.col("_live")) | (n <= 1)
    if fold_end:
        short = short | (eff < F.col("_live"))
    rel = F.coalesce(F.col("_k") - 1, F.greatest(F.least(eff, n) - 1, F.lit(0)))
    return j.withColumns(
        {
            "exit_rel": rel.cast("int"),
            "exit_idx": (F.col("t0") + 1 + rel).cast("int"),
            "exit_reason": F.coalesce("_reason", F.lit("TIME_STOP")),
            "boundary_truncated": F.col("_reason").isNull() & short,
        }
    ).drop("_live", "_k", "_reason", "_n")


def limit_fill(orders: DataFrame, bars: DataFrame, timeout: int = 5) -> DataFrame:
    """Passive orders filled once enough volume traded through their price.

    ``orders``: symbol, t0, side, limit_price, queue, size.
    """
    p = event_paths(orders, bars, timeout, ("high", "low", "volume"))
    touched = F.when(F.col("side") > 0, F.col("f_low") <= F.col("limit_price")).otherwise(F.col("f_high") >= F.col("limit_price"))
    o = Window.partitionBy("symbol", "t0").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("_v", F.sum(F.when(touched, F.col("f_volume")).otherwise(0.0)).over(o))
    p = p.withColumn("_need", F.col("queue") + F.col("size"))
    full = F.when(touched & (F.col("_v") >= F.col("_need")), F.col("k"))
    g = p.groupBy("symbol", "t0").agg(
        F.min(full).alias("fill_bar"), F.max("_need").alias("required_volume"), F.count("*").alias("_n"),
        F.min(F.when(full.isNotNull(), F.col("_v"))).alias("_vf"), F.max("_v").alias("_va"),
    )
    return g.select(
        "symbol", "t0", F.col("fill_bar").isNotNull().alias("filled"), F.coalesce("fill_bar", F.lit(-1)).alias("fill_bar"),
        F.coalesce("_vf", "_va").alias("processed_volume"), "required_volume",
        (F.col("fill_bar").isNull() & (F.col("_n") >= timeout)).alias("timeout_reached"),
    )


# --- concurrency and weights ------------------------------------------------------------------


def concurrency(labels: DataFrame, bars: DataFrame) -> DataFrame:
    """(symbol, bar_idx, c): running sum of +1 at t0 and -1 after t1."""
    d = labels.select("symbol", F.explode(F.array(
        F.struct(F.col("t0").alias("bar_idx"), F.lit(1).alias("d")),
        F.struct((F.col("t1") + 1).alias("bar_idx"), F.lit(-1).alias("d")),
    )).alias("x")).select("symbol", "x.*")
    d = d.groupBy("symbol", "bar_idx").agg(F.sum("d").alias("d"))
    b = bars.select("symbol", "bar_idx").join(d, ["symbol", "bar_idx"], "left")
    o = Window.partitionBy("symbol").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    return b.select("symbol", "bar_idx", F.coalesce(F.sum("d").over(o), F.lit(0)).alias("c"))


def average_uniqueness(labels: DataFrame, conc: DataFrame) -> DataFrame:
    """Labels plus ``uniqueness``: mean of 1/c over [t0, t1] from prefix sums."""
    o = Window.partitionBy("symbol").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    inv = F.when(F.col("c") > 0, 1.0 / F.col("c")).otherwise(0.0)
    pre = conc.withColumn("_p", F.sum(inv).over(o)).withColumn("_own", inv)
    a = pre.select("symbol", F.col("bar_idx").alias("t0"), (F.col("_p") - F.col("_own")).alias("_a"))
    b = pre.select("symbol", F.col("bar_idx").alias("t1"), F.col("_p").alias("_b"))
    j = labels.join(a, ["symbol", "t0"]).join(b, ["symbol", "t1"])
    return j.withColumn("uniqueness", (F.col("_b") - F.col("_a")) / (F.col("t1") - F.col("t0") + 1)).drop("_a", "_b")


def sample_weights(unique: DataFrame) -> DataFrame:
    """|return| x uniqueness scaled to the event count of the symbol; 1 if all zero."""
    raw = F.abs("realized_return") * F.col("uniqueness")
    w = Window.partitionBy("symbol")
    total = F.sum(raw).over(w)
    return unique.withColumn(
        "weight", F.when(total > 0, raw * F.count("*").over(w) / F.nullif(total, F.lit(0.0))).otherwise(1.0)
    )


# --- folds --------------------------------------------------------------------------------------


def purged_kfold(events: DataFrame, k: int = 5, embargo_bars: int | None = 24, lag: int = 0, pct: float = 0.0) -> DataFrame:
    """(symbol, t0, t1, fold, role): contiguous folds, purge before, embargo after.

    Folds follow the event order; an event is copied to its k folds, and the fold bounds
    are k small rows per symbol.
    """
    o = Window.partitionBy("symbol").orderBy("t0")
    e = events.withColumns({"_own": F.ntile(k).over(o) - 1, "_n": F.count("*").over(Window.partitionBy("symbol"))})
    if embargo_bars is not None:
        step = F.lit(embargo_bars)
    elif lag > 0:
        step = F.lit(lag)
    else:
        step = F.floor(F.col("_n") * pct)
    bounds = e.groupBy("symbol", F.col("_own").alias("fold")).agg(F.min("t0").alias("_s"), F.max("t1").alias("_e"))
    c = e.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).join(bounds, ["symbol", "fold"])
    role = (
        F.when(F.col("_own") == F.col("fold"), "test")
        .when((F.col("_own") < F.col("fold")) & (F.col("t1") <= F.col("_s")), "train")
        .when((F.col("_own") > F.col("fold")) & (F.col("t0") > F.col("_e") + step), "train")
        .otherwise("dropped")
    )
    return c.withColumn("role", role).drop("_n", "_s", "_e").withColumnRenamed("_own", "own_fold")


def purge_violations(splits: DataFrame, embargo: int) -> DataFrame:
    """(symbol, fold, violations) of the purge and embargo rules."""
    t = splits.filter("role = 'test'").groupBy("symbol", "fold").agg(F.min("t0").alias("_s"), F.max("t1").alias("_e"))
    tr = splits.filter("role = 'train'").join(t, ["symbol", "fold"])
    bad = ((F.col("own_fold") < F.col("fold")) & (F.col("t1") > F.col("_s"))) | (
        (F.col("own_fold") > F.col("fold")) & (F.col("t0") < F.col("_e") + embargo)
    )
    return tr.groupBy("symbol", "fold").agg(F.count_if(bad).alias("violations"))


def combinatorial_purged(events: DataFrame, groups: int = 6, tests: int = 2, embargo: int = 24) -> DataFrame:
    """(symbol, t0, t1, fold, role) for every choice of test groups."""
    o = Window.partitionBy("symbol").orderBy("t0")
    e = events.withColumn("_g", F.ntile(groups).over(o) - 1)
    b = e.groupBy("symbol", "_g").agg(F.min("t0").alias("s"), F.max_by("t1", "t0").alias("e"))
    b = b.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("_g", F.struct("s", "e")))).alias("_b"))
    sets = [F.struct(F.lit(i).alias("fold"), F.array(*[F.lit(g) for g in c]).alias("gs")) for i, c in enumerate(combinations(range(groups), tests))]
    c = e.join(b, "symbol").withColumn("x", F.explode(F.array(*sets))).select("*", "x.*").drop("x")
    blocked = F.exists(
        F.transform("gs", lambda g: F.element_at("_b", g)),
        lambda r: ~((F.col("t1") <= r["s"]) | (F.col("t0") >= r["e"]))
        | ((F.col("t0") >= r["e"]) & (F.col("t0") < r["e"] + embargo)),
    )
    role = F.when(F.array_contains("gs", F.col("_g")), "test").when(blocked, "dropped").otherwise("train")
    return c.withColumn("role", role).drop("gs", "_b").withColumnRenamed("_g", "own_group")


# --- funding ---------------------------------------------------------------------------------------


def settlements(start: Column, end: Column, hours: int = 8) -> Column:
    """Epoch multiples of the interval in (start, end]."""
    step = hours * HOUR_MS
    first = (F.floor(start / step) + 1) * step
    return F.when(end >= first, F.sequence(first, end, F.lit(step))).otherwise(F.array().cast("array<bigint>"))


def funding_accrued(trades: DataFrame, rates: DataFrame | None = None, rate: float = 0.0001, hours: int = 8, cap: float = 0.0075) -> DataFrame:
    """Trades plus ``funding_usd``. With a schedule, a missing settlement pays nothing."""
    s = settlements(F.col("entry_ts"), F.col("exit_ts"), hours)
    if rates is None:
        r = max(-cap, min(cap, rate))
        step = hours * HOUR_MS  # settlements in (entry, exit], counted without listing them
        n = F.greatest(F.floor(F.col("exit_ts") / step) - F.floor(F.col("entry_ts") / step), F.lit(0))
        return trades.withColumn("funding_usd", n * F.col("size_notional") * r * F.col("side"))
    on = ["symbol", "ts_ms"]
    x = trades.select("symbol", "entry_ts", "exit_ts", F.explode(s).alias("ts_ms")).distinct()
    per = x.join(rates.select(*on, fr.clip(F.col("rate"), -cap, cap).alias("r")), on).groupBy(
        "symbol", "entry_ts", "exit_ts"
    ).agg(F.sum("r").alias("_r"))
    j = trades.join(per, ["symbol", "entry_ts", "exit_ts"], "left")
    return j.withColumn("funding_usd", F.coalesce("_r", F.lit(0.0)) * F.col("size_notional") * F.col("side")).drop("_r")
