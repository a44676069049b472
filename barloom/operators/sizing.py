"""Trade modes, stops, liquidation, sizes, profit and loss, and Kelly tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions import frames as fr
from barloom.session import checkpoint_dir

F_MAX = 20.0
LAMBDA = 0.5


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# --- row expressions -----------------------------------------------------------------------


def trade_mode(p: Column, chop: Column, fade: bool, gate: float = 0.6, states: int = 2) -> Column:
    m = F.when(p >= 0.5, "follow")
    if fade:
        m = m.when(chop > max(0.8, gate), "fade") if states == 2 else m.when((p < 0.2) & (chop > gate), "fade")
    return m.otherwise("none")


def round_stop(sl: Column, side: Column, tick: float) -> Column:
    """Away from the entry: down for a long, up for a short."""
    steps = F.when(side > 0, F.floor((sl + 1e-12) / tick)).otherwise(F.ceil((sl - 1e-12) / tick))
    return F.greatest(F.lit(1e-4), steps * tick)


def initial_stop(entry: Column, side: Column, m_sl, sigma: Column, cost, tick: float | None = None, most: float = 0.5):
    """(stop, reject reason): exponential cushion; an unreasonable cushion is rejected."""
    cushion = lit(m_sl) * sigma + lit(cost)
    bad = F.when(~(entry > 0), "entry").when(~(sigma >= 0), "sigma").when(cushion > most, "cushion")
    sl = F.when(side > 0, F.greatest(entry * F.exp(-cushion), F.lit(1e-4))).otherwise(entry * F.exp(cushion))
    if tick:
        sl = round_stop(sl, side, tick)
    return F.when(bad.isNull(), sl), bad


def liquidation_price(entry, side, leverage, mmr=0.005, fee=0.0004, liq_fee=0.005, funding=0.0) -> Column:
    room = 1.0 / lit(leverage) - lit(mmr) - lit(fee) - lit(liq_fee) - lit(funding)
    moved = F.when(side > 0, F.greatest(entry * (1.0 - room), F.lit(1e-4))).otherwise(entry * (1.0 + room))
    return F.when(room <= 0, entry).otherwise(moved)


def leverage_check(entry, side, stop, leverage, mmr=0.005, buffer=0.15, **kw) -> Column:
    """Struct (is_safe, liq_price, dist_liq, dist_sl, reason)."""
    liq = liquidation_price(entry, side, leverage, mmr, **kw)
    d_liq, d_sl = side * (entry - liq), side * (entry - stop)
    safe = (d_liq > 0) & (d_sl <= d_liq * (1.0 - buffer))
    reason = F.when(d_sl <= 0, "STOP_ON_WRONG_SIDE").when(d_liq <= 0, "LIQ_PRICE_CROSSED_ENTRY").when(safe, "SAFE").otherwise("SL_TOO_CLOSE_TO_LIQ")
    return F.struct(safe.alias("is_safe"), liq.alias("liq_price"), d_liq.alias("dist_liq"), d_sl.alias("dist_sl"), reason.alias("reason"))


def max_safe_leverage(entry, side, stop, mmr=0.005, buffer=0.15, cap=20.0, fee=0.0004, liq_fee=0.005, funding=0.0) -> Column:
    d = side * (entry - stop) / entry
    need = d / (1.0 - buffer) + lit(mmr) + fee + liq_fee + funding
    return F.when(d > 0, F.least(1.0 / F.greatest(need, F.lit(1e-6)), F.lit(float(cap))))


def margin_rate(notional: Column, tiers: list[tuple[float, float]] | None) -> Column:
    """First tier whose bound covers the notional, the last one beyond all bounds.

    A tier table is a short parameter list, so it is an expression rather than a join.
    """
    if not tiers:
        return F.lit(0.005)
    fit = F.filter(F.array(*[F.struct(F.lit(float(m)).alias("m"), F.lit(float(r)).alias("r")) for m, r in tiers]), lambda t: notional <= t["m"])
    return F.when(F.size(fit) > 0, F.element_at(fit, 1)["r"]).otherwise(F.lit(float(tiers[-1][1])))


def resolve_trades(t: DataFrame, fade: bool, gate=0.6, m_sl=2.0, cost=0.0004, requested=10.0, mmr=0.005, fee=0.0004, liq_fee=0.001, t_follow=120, t_fade=40) -> DataFrame:
    """Mode, side, stop, leverage and liquidation price; untradeable rows are dropped.

    Rows: p_i, p_chop_i, entry, side (primary), sigma.
    """
    t = t.withColumn("mode", trade_mode(F.col("p_i"), F.col("p_chop_i"), fade, gate)).filter("mode <> 'none'")
    t = t.withColumn("side", F.when(F.col("mode") == "follow", F.col("side")).otherwise(-F.col("side")))
    sl, bad = initial_stop(F.col("entry"), F.col("side"), m_sl, F.col("sigma"), cost)
    t = t.withColumns({"sl": sl, "reject": bad}).filter("reject is null").drop("reject")
    safe = max_safe_leverage(F.col("entry"), F.col("side"), F.col("sl"), mmr, fee=fee, liq_fee=liq_fee)
    t = t.withColumn("leverage", F.least(F.lit(float(requested)), safe)).filter("leverage >= 1")
    return t.withColumns(
        {
            "liq": liquidation_price(F.col("entry"), F.col("side"), F.col("leverage"), mmr, fee, liq_fee),
            "t_max": F.when(F.col("mode") == "follow", t_follow).otherwise(t_fade),
        }
    )


def position_size(f_star, equity, max_leverage, lam=LAMBDA, cap=None, atr_hist=None, atr_now=None, lot=None, lo=0.2, hi=2.5) -> Column:
    mult = F.lit(1.0) if atr_hist is None else fr.clip(fr.div(atr_hist, atr_now), lo, hi)
    size = F.least(f_star * lam * equity * mult, max_leverage * equity)
    if cap is not None:
        size = F.least(size, lit(cap))
    if lot:
        size = F.greatest(F.lit(0.0), F.floor((size + 1e-12) / lot) * lot)
    return F.when(f_star == 0, 0.0).otherwise(size)


def realized_pnl(entry, exit_, side, notional, leverage, reason, entry_fill="taker", exit_fill="taker", maker=0.0001, taker=0.0004, funding=0.0) -> dict[str, Column]:
    """A liquidation loses the margin, pays the entry fee only and reports the bare move."""
    rate = lambda kind: F.when(lit(kind) == "maker", maker).otherwise(taker) if isinstance(kind, Column) else F.lit(maker if kind == "maker" else taker)
    liq = reason == "LIQUIDATION"
    move = side * (exit_ - entry) / entry
    fee_in = notional * rate(entry_fill)
    fee_out = notional * (exit_ / entry) * rate(exit_fill)
    gross = F.when(liq, -(notional / leverage)).otherwise(move * notional)
    net = F.when(liq, gross - fee_in).otherwise(move * notional - fee_in - fee_out - lit(funding))
    return {
        "gross_pnl": gross,
        "net_pnl": net,
        "realized_return": F.when(liq, move).otherwise(net / notional),
        "fee_paid": F.when(liq, fee_in).otherwise(fee_in + fee_out),
    }


def finalize_trades(trades: DataFrame, bars: DataFrame, size: float = 10_000.0, fee_entry: float = 0.0004, spread: float = 0.0002, impact: float = 0.1, depth: float = 1e6) -> DataFrame:
    """Exit fill, fees and return of each trade; joins the close of the exit bar.

    Trades: symbol, exit_idx, entry, side, leverage, liq, exit_reason, funding_usd.
    """
    px = bars.select("symbol", F.col("bar_idx").alias("exit_idx"), F.col("close").alias("_c"))
    t = trades.join(px, ["symbol", "exit_idx"], "left")
    slip = F.col("_c") * (spread / 2 + impact * (size / depth))
    fill = F.when(F.col("exit_reason") == "LIQUIDATION", F.col("liq")).otherwise(F.col("_c") - F.col("side") * slip)
    t = t.withColumn("fill_price_exit", fill).drop("_c")
    funding = F.col("funding_usd") if "funding_usd" in trades.columns else F.lit(0.0)
    p = realized_pnl(F.col("entry"), F.col("fill_price_exit"), F.col("side"), F.lit(size), F.col("leverage"), F.col("exit_reason"), funding=funding)
    t = t.withColumns(p).withColumn("size_notional", F.lit(size)).withColumn("fee_entry", F.lit(size * fee_entry))
    return t.withColumn("fee_exit", F.greatest(F.col("fee_paid") - F.col("fee_entry"), F.lit(0.0))).drop("fee_paid")


# --- exact quantiles of large columns -------------------------------------------------------


def exact_quantiles(df: DataFrame, keys, x: str, qs, bucket: Column) -> DataFrame:
    """(keys.., q, value): linear quantiles without sorting a key in one task.

    Values are counted first (map-side combined, so repeated values cost nothing), the
    bucket counts locate the one or two buckets a quantile falls in, and only those are
    ordered. ``bucket`` must not decrease in ``x``.
    """
    keys = list(keys)
    vc = df.filter(F.col(x).isNotNull()).groupBy(*keys, F.col(x).alias("_x")).agg(F.count("*").alias("_c"))
    vc = vc.withColumn("_b", bucket)
    sums = vc.groupBy(*keys, "_b").agg(F.sum("_c").alias("_n"))
    o = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    run = o.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumns({"_hi": F.sum("_n").over(run), "_tot": F.sum("_n").over(o)})
    sums = sums.withColumn("_lo", F.col("_hi") - F.col("_n"))
    sums = sums.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
    h = (F.col("_tot") - 1) * F.col("q")
    want = sums.withColumns({"_h": h, "_p": F.explode(F.array(F.floor(h), F.ceil(h)))})
    want = want.filter((F.col("_p") >= F.col("_lo")) & (F.col("_p") < F.col("_hi"))).select(
        *keys, "_b", "q", "_h", (F.col("_p") - F.col("_lo")).alias("_k")
    ).distinct()
    wide = Window.partitionBy(*keys, "_b").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    vals = vc.join(want.select(*keys, "_b").distinct(), keys + ["_b"], "left_semi").withColumn("_up", F.sum("_c").over(wide))
    hit = want.join(vals, keys + ["_b"]).filter((F.col("_k") < F.col("_up")) & (F.col("_k") >= F.col("_up") - F.col("_c")))
    w = F.col("_h") - F.floor("_h")
    return hit.groupBy(*keys, "q").agg(
        (F.min("_x") + (F.max("_x") - F.min("_x")) * F.max(w)).alias("value")
    )


# --- Kelly -----------------------------------------------------------------------------------------


SECTIONS = 32


def _ceiling(low: Column, f_max: Column) -> Column:
    """The largest fraction that the worst return allows."""
    return F.when(low < 0, F.least(f_max, 0.999 / F.abs(low))).otherwise(f_max)


def _counted(trades: DataFrame, keys, ret: str) -> DataFrame:
    """(keys.., _r, _c): every distinct return of a group and how often it occurs, kept."""
    checkpoint_dir(trades.sparkSession)
    r = trades.filter(F.col(ret).isNotNull()).groupBy(*keys, F.col(ret).cast("double").alias("_r"))
    return r.agg(F.count("*").alias("_c")).checkpoint()


def _roots(rows: DataFrame, keys, f_max: Column) -> DataFrame:
    g = rows.groupBy(*keys).agg(F.sum("_c").alias("n"), F.sum(F.col("_c") * F.col("_r")).alias("_s"), F.min("_r").alias("_low"))
    ok = (F.col("n") >= 5) & (F.col("_s") > 0)
    top = F.when(F.col("_low") < -1.0, F.raise_error(F.lit("return below -100%")).cast("double")).otherwise(_ceiling(F.col("_low"), f_max))
    g = g.select(*keys, "n", F.lit(0.0).alias("_a"), F.when(ok, top).otherwise(0.0).alias("_b")).checkpoint()
    for _ in range(7):  # 32 ** 7 sections of at most 20
        at = [F.col("_a") + (F.col("_b") - F.col("_a")) * (i / SECTIONS) for i in range(1, SECTIONS + 1)]
        sums = rows.join(g, keys).groupBy(*keys).agg(*[F.sum(F.col("_c") * F.col("_r") / (1.0 + f * F.col("_r"))).alias(f"_g{i}") for i, f in enumerate(at)])
        above = sum((F.col(f"_g{i}") > 0).cast("int") for i in range(SECTIONS))
        width = (F.col("_b") - F.col("_a")) / SECTIONS
        low = F.col("_a") + width * F.col("_k")
        g = g.join(sums.select(*keys, above.alias("_k")), keys).select(
            *keys, "n", F.when(F.col("_k") == SECTIONS, F.col("_b")).otherwise(low).alias("_a"),
            F.when(F.col("_k") == SECTIONS, F.col("_b")).otherwise(low + width).alias("_b"),
        ).checkpoint()
    return g.select(*keys, "n", ((F.col("_a") + F.col("_b")) / 2).alias("f_point"))


def kelly_fraction(trades: DataFrame, keys, f_max: Column, ret: str = "ret") -> DataFrame:
    """(keys.., n, f_point): the root of E[r / (1 + f r)] for every group at once.

    Equal returns of a group are counted first. The mean falls with f, so each pass evaluates it
    at the borders of ``SECTIONS`` sections of a group's interval, as plain sums that combine on
    the map side, and keeps the section where the sign turns: a fixed number of passes to 1e-9,
    for groups of any size. ``f_max`` may use ``n``.
    """
    keys = list(keys)
    return _roots(_counted(trades, keys, ret), keys, f_max)


def _poisson(mean: int) -> tuple[int, np.ndarray]:
    """The least count and the cumulative probabilities from there; what they leave out is below 2**-60."""
    wide = 10 * math.sqrt(mean) + 40
    k = np.arange(max(0, int(mean - wide)), int(mean + wide) + 1)
    log = np.append(0.0, np.cumsum(np.log(mean / k[1:])))
    p = np.exp(log - log.max())
    return int(k[0]), np.cumsum(p) / p.sum()


def _draws(ids: np.ndarray, replicates: np.ndarray, seed: int, counts: np.ndarray | None = None) -> np.ndarray:
    """Poisson counts of rows in replicates, from a hash of (row, replicate, seed).

    A row that stands for ``counts`` equal ones is drawn with that mean, as the sum of theirs is.
    """
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (replicates.astype(np.uint64) + np.uint64(seed << 32))[None] * np.uint64(0xD1B54A32D192ED03)
        for shift, odd in ((32, 0xD6E8FEB86659FD93), (29, 0xA0761D6478BD642F), (32, 0xE7037ED1A0B428DB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    u = (x >> np.uint64(11)).astype(np.float64) * 2.0**-53
    counts = np.ones(len(ids), np.int64) if counts is None else counts
    out = np.empty(u.shape, np.int64)
    for c in np.unique(counts).tolist():
        mine = counts == c
        least, table = _poisson(c)
        out[mine] = least + np.searchsorted(table, u[mine], side="right")
    return out


def _resampled(rows: DataFrame, state, replicates: int, seed: int, least: bool) -> DataFrame:
    """(cell, rep, sums): sums over resampled rows at the fraction of every (cell, replicate).

    With ``least``: the number of trades, the sum and the least return instead. A worker holds
    some thousand rows times the replicates, and the sums of its cells.
    """
    reps = np.arange(replicates)

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            cell, r, c, i = (batch.column(x).to_numpy() for x in ("_cell", "_r", "_c", "_id"))
            for k in np.unique(cell).tolist():
                mine = np.flatnonzero(cell == k)
                for part in np.array_split(mine, -(-len(mine) // 2048)):
                    w, x = _draws(i[part], reps, seed, c[part]), r[part][:, None]
                    if least:
                        got = np.stack([w.sum(0), (w * x).sum(0), np.where(w > 0, x, np.inf).min(0)])
                        held[k] = got if k not in held else np.stack([held[k][0] + got[0], held[k][1] + got[1], np.minimum(held[k][2], got[2])])
                    else:
                        q = x / (1.0 + state.value[k] * x)
                        got = np.stack([(w * q).sum(0), (w * q * q).sum(0)])
                        held[k] = held.get(k, 0.0) + got
        for k, s in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(replicates, k)), pa.array(reps), *(pa.array(v.astype(float)) for v in s)], names=["cell", "rep", "u", "v", "low"][: 2 + len(s)])

    kind = "cell long, rep long, u double, v double" + (", low double" if least else "")
    found = rows.mapInArrow(run, kind)
    more = [F.min("low").alias("low")] if least else []
    return found.groupBy("cell", "rep").agg(F.sum("u").alias("u"), F.sum("v").alias("v"), *more)


def bootstrap_kelly(trades: DataFrame, keys, f_max: Column, replicates: int = 1000, lower: float = 25.0, seed: int = 42, ret: str = "ret") -> DataFrame:
    """(keys.., n, f_point, f_low, f_std, uncertainty) for a bounded number of groups (bins, regimes).

    A replicate weighs every trade by a Poisson count of mean 1. Equal returns of a group are
    counted and drawn as one, with their number as the mean, which is the distribution of their
    sum; a hash of (group, return, replicate) gives the draw, so no group is collected and draws do
    not depend on how rows are dealt out. All roots are searched at once by Newton steps inside
    shrinking intervals; a pass sums over the distinct returns at the current fractions, and the
    driver keeps groups x replicates numbers.
    """
    keys = list(keys)
    spark = trades.sparkSession
    counted = _counted(trades, keys, ret)
    point = _roots(counted, keys, f_max).withColumn("_top", f_max)
    cells = point.collect()  # one row for each bin or regime
    code = spark.createDataFrame([(*[c[k] for k in keys], i) for i, c in enumerate(cells)], T.StructType([*(point.schema[k] for k in keys), T.StructField("_cell", T.LongType())]))
    rows = counted.join(code, keys).select("_cell", "_r", "_c", F.xxhash64(*keys, "_r").alias("_id"))
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).checkpoint()

    def summed(state, width, least=False):
        out = np.full((len(cells), replicates, width), np.inf if least else 0.0)
        for r in _resampled(rows, state, replicates, seed, least).collect():
            out[r[0], r[1]] = r[2:]
        return np.moveaxis(out, 2, 0)

    n, total, low = summed(None, 3, True)
    limit = np.array([c["_top"] for c in cells], float)[:, None]
    with np.errstate(divide="ignore"):
        top = np.where(low < 0, np.minimum(limit, 0.999 / np.abs(low)), limit)
    good = np.isfinite(n) & (n >= 5) & (total > 0)
    a, b = np.zeros_like(top), np.where(good, top, 0.0)
    f = b.copy()  # the first pass asks whether the ceiling is the answer; the next starts at the group's root
    near = np.array([c["f_point"] for c in cells], float)[:, None]
    for turn in range(60):
        u, v = summed(spark.sparkContext.broadcast(f), 2)
        ahead = u > 0
        a, b = np.where(ahead, f, a), np.where(ahead, b, f)
        with np.errstate(divide="ignore", invalid="ignore"):
            step = f + u / v if turn else near
        new = np.where((step >= a) & (step <= b), step, (a + b) / 2)
        done = np.abs(new - f) < 1e-10
        f = new
        if (done | (b - a < 1e-9)).all():
            break
    f = np.where(good, f, 0.0)
    out = []
    for c, x in zip(cells, f):
        few = c["n"] < 5
        p, q, s = (0.0, 0.0, 0.0) if few else (c["f_point"], float(np.quantile(x, lower / 100.0)), float(x.std()))
        out.append((*[c[k] for k in keys], c["n"], p, q, s, 0.0 if few else s / max(p, 1e-6)))
    kind = T.StructType([*(point.schema[k] for k in keys), T.StructField("n", T.LongType()), *(T.StructField(k, T.DoubleType()) for k in ("f_point", "f_low", "f_std", "uncertainty"))])
    return spark.createDataFrame(out, kind)


def unit_bucket(c: str = "_x", n: int = 4096) -> Column:
    return F.floor(F.col(c) * n)


def edges_array(q: DataFrame, keys, bins: int) -> DataFrame:
    """Inner edges per key as a strictly increasing array (at most bins - 1 values)."""
    e = q.filter((F.col("q") > 0) & (F.col("q") < 1)).groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("q", "value"))), lambda s: s["value"]).alias("_e")
    )
    step = lambda acc, v: F.concat(
        acc, F.array(F.when((F.size(acc) > 0) & (v <= F.element_at(acc, -1)), F.element_at(acc, -1) + 1e-12).otherwise(v))
    )
    return e.select(*keys, F.aggregate("_e", F.array().cast("array<double>"), step).alias("edges"))


def bin_of(x: Column, edges: Column, bins: int) -> Column:
    """Right-sided search: the number of the bins - 1 inner edges at or below x."""
    return sum(F.coalesce((F.get(edges, F.lit(i)) <= x).cast("int"), F.lit(0)) for i in range(bins - 1))


def valid_trades(trades: DataFrame) -> DataFrame:
    unit = lambda c: fr.clip(F.col(c), 0.0, 1.0)
    t = trades.filter("ret is not null and p_i is not null and p_chop_i is not null")
    if "boundary_truncated" in trades.columns:
        t = t.filter("not boundary_truncated")
    return t.withColumns({"p_i": unit("p_i"), "p_chop_i": unit("p_chop_i")})


def kelly_bins(trades: DataFrame, bins: int = 10):
    """(binned trades, p edges, chop edges per p bin)."""
    qs = [i / bins for i in range(bins + 1)]
    t = valid_trades(trades)
    p_edges = edges_array(exact_quantiles(t, [], "p_i", qs, unit_bucket()), [], bins)
    t = t.withColumn("_e", p_edges.scalar()).withColumn("p_bin", bin_of(F.col("p_i"), F.col("_e"), bins)).drop("_e")
    c_edges = edges_array(exact_quantiles(t, ["p_bin"], "p_chop_i", qs, unit_bucket()), ["p_bin"], bins)
    # ten rows: small whatever the trades weigh
    t = t.join(c_edges, "p_bin").withColumn("chop_bin", bin_of(F.col("p_chop_i"), F.col("edges"), bins)).drop("edges")
    return t, p_edges, c_edges


def kelly_table(binned: DataFrame, f_max: float = F_MAX, prior: float = 0.0, shrink: float = 20.0, replicates: int = 500, lower: float = 25.0) -> DataFrame:
    """(p_bin, chop_bin, n, f): shrunk lower bootstrap fraction per cell."""
    keys = ["p_bin", "chop_bin"]
    top = F.least(F.lit(float(f_max)), F.greatest(F.lit(1.0), F.sqrt("n")))
    b = bootstrap_kelly(binned, keys, top, replicates, lower)
    w = F.col("n") / (F.col("n") + shrink)
    f = F.when(F.col("n") < 5, prior).otherwise(w * F.col("f_low") + (1.0 - w) * prior)
    return b.select(*keys, "n", F.greatest(f, F.lit(0.0)).alias("f"))


def kelly_lookup(trades: DataFrame, table: DataFrame, p_edges: DataFrame, c_edges: DataFrame, bins: int, fade: bool, gate: float = 0.6) -> DataFrame:
    """Trades plus mode and f_target from a Kelly table and its edges."""
    t = trades.withColumn("mode", trade_mode(F.col("p_i"), F.col("p_chop_i"), fade, gate))
    t = t.withColumn("_e", p_edges.scalar()).withColumn("p_bin", bin_of(F.col("p_i"), F.col("_e"), bins)).drop("_e").join(c_edges, "p_bin", "left")
    t = t.withColumn("chop_bin", bin_of(F.col("p_chop_i"), F.col("edges"), bins)).drop("edges")
    j = t.join(table.select("p_bin", "chop_bin", "f"), ["p_bin", "chop_bin"], "left")
    return j.withColumn("f_target", F.when(F.col("mode") == "none", 0.0).otherwise(F.coalesce("f", F.lit(0.0)))).drop("f")


def regime_kelly(trades: DataFrame, probs: dict[str, float], f_max: float = F_MAX, prior: float = 0.1, shrink: float = 20.0, hard: bool = False, threshold: float = 0.5, replicates: int = 500) -> DataFrame:
    """One row: regime fractions shrunk to the prior, blended or taken from the likelier."""
    cut = threshold if hard else 0.5
    t = valid_trades(trades).withColumn("regime", F.when(F.col("p_i") >= cut, "trending").otherwise("choppy"))
    top = F.least(F.lit(float(f_max)), F.greatest(F.lit(1.0), F.sqrt("n")))
    b = bootstrap_kelly(t, ["regime"], top, replicates)
    w = F.col("n") / (F.col("n") + shrink)
    f = F.when(F.col("n") < 5, prior).otherwise(w * F.col("f_low") + (1.0 - w) * prior)
    per = {r: F.coalesce(F.max(F.when(F.col("regime") == r, f)), F.lit(prior)) for r in probs}
    best = max(probs, key=probs.get)
    blend = per[best] if hard else sum(p * per[r] for r, p in probs.items())
    return b.agg(*[per[r].alias(f"f_{r}") for r in probs], blend.alias("f_blend"))


# --- overfitting --------------------------------------------------------------------------------------


def _halves(splits: int) -> np.ndarray:
    """0/1 rows: every choice of half the blocks."""
    masks = np.arange(2**splits, dtype=np.int64)
    bits = (masks[:, None] >> np.arange(splits)) & 1
    return bits[bits.sum(1) == splits // 2].astype(float)


def pbo(returns: DataFrame, splits: int = 16, part: int = 1 << 11) -> DataFrame:
    """(n_combinations, pbo): combinatorially symmetric cross-validation.

    ``returns``: (config, ti, ret) on common timestamps. Sums per block and configuration make
    a matrix of ``splits`` columns; in-sample sums of all combinations are its product with the
    0/1 matrix of the halves, taken in parts of ``part`` combinations spread over tasks. The matrix of
    block sums travels as one array (configurations x ``splits`` numbers, whatever the returns).
    """
    o = Window.partitionBy("config").orderBy("ti")
    b = returns.withColumn("_b", F.ntile(splits).over(o) - 1).groupBy("config", "_b").agg(F.sum("ret").alias("_s"))
    a = b.groupBy("config").agg(F.transform(F.sort_array(F.collect_list(F.struct("_b", "_s"))), lambda s: s["_s"]).alias("_a"))
    sums = a.agg(F.sort_array(F.collect_list(F.struct("config", "_a"))).alias("m")).select(F.flatten(F.transform("m", lambda s: s["_a"])).alias("m"))
    parts = -(-math.comb(splits, splits // 2) // part)

    @F.pandas_udf("struct<n long, under long>")
    def score(m: pd.Series, k: pd.Series) -> pd.DataFrame:
        rows = []
        for x, i in zip(m, k):
            block = np.asarray(x, float).reshape(-1, splits)
            halves = _halves(splits)[i * part : (i + 1) * part]
            inside = halves @ block.T
            outside = (1 - halves) @ block.T
            best = inside.argmax(1)  # the first configuration among equals
            row = np.arange(len(halves))
            own = outside[row, best]
            place = (outside < own[:, None]).sum(1)
            place += ((outside == own[:, None]) & (np.arange(len(block)) < best[:, None])).sum(1)
            rows.append((len(halves), int((place / (len(block) - 1) < 0.5).sum())))
        return pd.DataFrame(rows, columns=["n", "under"])

    c = sums.select("m", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("k")).repartition(parts, "k")
    c = c.select(score("m", "k").alias("s"))
    return c.agg(F.sum("s.n").alias("n_combinations"), (F.sum("s.under") / F.sum("s.n")).alias("pbo"))
