"""Contracts, reconciliation, rebalance plans, logs and reports over row tables."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions import frames as fr
from barloom.operators.ordered import per_series

# --- contracts ----------------------------------------------------------------------------

WARMUP_COLUMNS = ("trend_score", "p_trend", "p_chop", "atr_14", "hurst_value")


def ohlc_ok() -> Column:
    h, l, o, c = (F.col(x) for x in ("high", "low", "open", "close"))
    return (h >= o) & (h >= c) & (h >= l) & (l <= o) & (l <= c)


def warmup_ok(cols=WARMUP_COLUMNS) -> Column:
    blank = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in cols])
    return ~F.col("insufficient_history") | blank


def exit_index_ok() -> Column:
    return F.col("exit_idx_absolute") == F.col("entry_idx") + 1 + F.col("exit_idx_relative")


def exit_time_ok() -> Column:
    return F.col("exit_timestamp_ms") >= F.col("entry_timestamp_ms")


def violations(df: DataFrame, checks: dict[str, Column], keys=()) -> DataFrame:
    """Rows failing each check, in one aggregate."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()]
    )


def manifest(df: DataFrame, params: str, ts: str = "ts_ms", keys=()) -> DataFrame:
    """Row count, time span and their sha256 together with the parameter text."""
    a = df.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.coalesce(F.min(ts), F.lit(0)).alias("start_time"), F.coalesce(F.max(ts), F.lit(0)).alias("end_time")
    )
    text = F.concat(
        F.lit('{"end_time": '), F.col("end_time").cast("string"), F.lit(', "n_rows": '), F.col("n_rows").cast("string"),
        F.lit(f', "params": {params}, "start_time": '), F.col("start_time").cast("string"), F.lit("}"),
    )
    return a.withColumn("manifest", F.sha2(text, 256))


def lineage(trades: DataFrame, expected: Column, column: str = "dataset_manifest_hash") -> DataFrame:
    """One row: number of distinct hashes and whether it is the expected one only."""
    a = trades.agg(F.count_distinct(column).alias("n_hashes"), F.min(column).alias("_h"))
    return a.select("n_hashes", ((F.col("n_hashes") == 1) & (F.col("_h") == expected)).alias("matches"))


def klines(raw: DataFrame) -> DataFrame:
    """Raw kline strings to bars; order-flow imbalance from the taker volume."""
    d = lambda c: F.col(c).cast("double")
    v, buy = d("volume"), d("taker_buy_base")
    ofi = F.when(v > 0, fr.div(buy - (v - buy), v)).otherwise(0.0)
    return raw.select(
        "symbol", F.col("open_time").cast("long").alias("ts_ms"), *[d(c).alias(c) for c in ("open", "high", "low", "close", "volume")],
        F.col("tick_count").cast("long").alias("tick_count"), F.coalesce(fr.clip(ofi, -1.0, 1.0), F.lit(0.0)).alias("ofi"),
    )


def resample_last(df: DataFrame, keys, bucket_ms: int, cols, ts="ts_ms") -> DataFrame:
    """Last value per epoch-anchored bucket, for stocks rather than flows."""
    b = (F.floor(F.col(ts) / bucket_ms) * bucket_ms).alias("bucket_ms")
    return df.groupBy(*keys, b).agg(*[F.max_by(c, ts).alias(c) for c in cols])


def resample_bars(bars: DataFrame, source_ms: int, target_ms: int) -> DataFrame:
    """Epoch-anchored buckets; a short last bucket per symbol is dropped."""
    if target_ms % source_ms:
        raise ValueError("target must be a multiple of source")
    b = F.floor(F.col("ts_ms") / target_ms) * target_ms
    g = bars.groupBy("symbol", b.alias("bucket_ms")).agg(
        F.min_by("open", "ts_ms").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts_ms").alias("close"),
        F.sum("volume").alias("volume"), F.sum("tick_count").alias("tick_count"), F.sum(F.col("ofi") * F.col("volume")).alias("_o"), F.count("*").alias("_n"),
    )
    last = F.max("bucket_ms").over(Window.partitionBy("symbol"))
    g = g.withColumn("_last", last).filter((F.col("bucket_ms") < F.col("_last")) | (F.col("_n") >= target_ms // source_ms))
    return g.withColumn("ofi", F.coalesce(fr.div("_o", "volume"), F.lit(0.0))).drop("_o", "_n", "_last")


# --- panels of several sources -----------------------------------------------------------------


def covered_panel(bars: DataFrame, min_bars: int, min_coverage: float) -> DataFrame:
    """Bars of symbols with enough rows, on a dense grid, then enough coverage."""
    from barloom.sources.tables import densify

    n = F.count("*").over(Window.partitionBy("symbol"))
    kept = bars.withColumn("_n", n).filter(F.col("_n") >= min_bars).drop("_n")
    p = densify(kept)
    share = F.avg(F.col("close").isNotNull().cast("double")).over(Window.partitionBy("symbol"))
    return p.withColumn("coverage", share).filter(F.col("coverage") >= min_coverage)


def align_symbols(panel: DataFrame, other: DataFrame) -> DataFrame:
    """Symbols of both sides; all of the panel when none is shared."""
    shared = panel.select("symbol").distinct().join(other.select("symbol").distinct(), "symbol")
    any_shared = shared.agg(F.count("*") > 0).scalar()
    mark = panel.join(shared.withColumn("_s", F.lit(True)), "symbol", "left")
    return mark.filter(F.coalesce("_s", F.lit(False)) | ~any_shared).drop("_s")


def universe(candidates: DataFrame, tradeable: DataFrame, volume: DataFrame, min_notional: DataFrame, history: DataFrame, min_volume: float, max_min_notional: float, min_bars: int) -> DataFrame:
    """(symbol, keep, reason): the first failing rule is the reason."""
    c = (
        candidates.join(tradeable.select("symbol", F.lit(True).alias("_t")), "symbol", "left")
        .join(volume.select("symbol", F.col("quote_volume").alias("_v")), "symbol", "left")
        .join(min_notional.select("symbol", F.col("min_notional").alias("_m")), "symbol", "left")
        .join(history.select("symbol", F.col("n_bars").alias("_h")), "symbol", "left")
    )
    # an empty liquidity source means the rule cannot be applied
    liquid = F.coalesce(F.col("_v") >= min_volume, F.lit(False)) | ~volume.agg(F.coalesce(F.max("quote_volume") >= min_volume, F.lit(False))).scalar()
    reason = (
        F.when(F.col("_t").isNull(), "not tradeable")
        .when(~liquid, "illiquid")
        .when(F.col("_m") > max_min_notional, "min notional")
        .when(F.coalesce("_h", F.lit(0)) < min_bars, "short history")
    )
    return c.select("symbol", reason.isNull().alias("keep"), F.coalesce(reason, F.lit("")).alias("reason"))


def first_filter(filters: Column, kind: str, field: str) -> Column:
    """Field of the first entry of a nested filter array with the given type."""
    hit = F.filter(filters, lambda f: f["filter_type"] == kind)
    return F.when(F.size(hit) > 0, F.element_at(hit, 1)[field])


# --- reconciliation and rebalancing ----------------------------------------------------------------


def reconcile(internal: DataFrame, exchange: DataFrame, tol: float = 1e-8) -> DataFrame:
    """(symbol, internal_qty, exchange_qty, kind) of every mismatch."""
    big = lambda d, n: d.filter(F.abs("qty") > tol).select("symbol", F.col("qty").alias(n))
    j = big(internal, "internal_qty").join(big(exchange, "exchange_qty"), "symbol", "full").fillna(0.0, ["internal_qty", "exchange_qty"])
    kind = F.when(F.col("internal_qty") == 0, "unknown to us").when(F.col("exchange_qty") == 0, "missing on exchange").otherwise("size mismatch")
    return j.filter(F.abs(F.col("exchange_qty") - F.col("internal_qty")) > tol).withColumn("kind", kind)


def orphans(open_orders: DataFrame, known: DataFrame, key: str = "order_id") -> DataFrame:
    return open_orders.join(known.select(key).filter(F.col(key).isNotNull()), key, "left_anti")


def net_position(fills: DataFrame) -> DataFrame:
    return fills.groupBy("symbol").agg(F.sum(F.when(F.col("side") == "BUY", F.col("filled_qty")).otherwise(-F.col("filled_qty"))).alias("qty"))


def exposure(positions: DataFrame, tol: float = 0.02, equity: float | None = None, target: float | None = None, gross_tol: float = 0.15, keys=()) -> DataFrame:
    v = F.col("qty") * F.coalesce("price", F.lit(0.0))
    a = positions.groupBy(*keys).agg(
        F.sum(F.abs(v)).alias("gross"), F.sum(v).alias("net"),
        F.sum(F.when(v > 0, v).otherwise(0.0)).alias("long_notional"), F.sum(F.when(v < 0, v).otherwise(0.0)).alias("short_notional"),
    )
    ratio = F.when(F.col("gross") > 1e-9, F.col("net") / F.col("gross")).otherwise(0.0)
    a = a.withColumn("net_ratio", ratio).withColumn("net_ok", F.abs("net_ratio") <= tol)
    if equity and target:
        a = a.withColumn("leverage", F.col("gross") / equity)
        return a.withColumn("gross_ok", F.abs(F.col("leverage") - target) <= gross_tol * target)
    return a.withColumns({"leverage": F.lit(None).cast("double"), "gross_ok": F.lit(True)})


def round_step(qty: Column, step: Column) -> Column:
    """Toward zero to the step."""
    return F.when(step > 0, F.signum(qty) * F.floor((F.abs(qty) + 1e-12) / step) * step).otherwise(qty)


def rebalance_rows(targets: DataFrame, held: DataFrame, market: DataFrame, equity: float, leverage: float = 1.0, band: float = 0.2, keys=()) -> DataFrame:
    """One decision row per symbol of targets or holdings.

    ``market``: symbol, price, step, min_qty, min_notional. status is ``order``, ``band``
    (inside the no-trade band), ``skip`` or ``hold``.
    """
    k = list(keys) + ["symbol"]
    j = targets.select(*k, "weight").join(held.select(*k, "qty"), k, "full").join(market, "symbol", "left")
    per = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    w = F.coalesce("weight", F.lit(0.0))
    total = F.sum(F.abs(w)).over(per)
    j = j.withColumns({"held": F.coalesce("qty", F.lit(0.0)), "_t": F.when(total > 0, w / total * equity * leverage).otherwise(0.0)})
    price, step = F.col("price"), F.col("step")
    ok_qty = lambda q: (F.abs(q) >= F.col("min_qty")) & (F.abs(q) > 0) & (F.abs(q) * price >= F.col("min_notional"))
    j = j.withColumn("_q", round_step(F.col("_t") / price, step))
    j = j.withColumn("target_qty", F.when((F.col("_q") != 0) & ~ok_qty(F.col("_q")), 0.0).otherwise(F.col("_q")))
    j = j.withColumn("delta", F.when(F.col("target_qty") == F.col("held"), 0.0).otherwise(round_step(F.col("target_qty") - F.col("held"), step)))
    tgt, cur, d = F.col("target_qty"), F.col("held"), F.col("delta")
    close_out = (cur != 0) & (tgt == 0)
    closing = close_out | ((F.abs(tgt) < F.abs(cur)) & (cur * tgt >= 0))
    ref = F.when(tgt != 0, F.abs(tgt)).otherwise(F.abs(cur))
    status = (
        F.when(price.isNull() | ~(price > 0) | step.isNull(), "skip")
        .when(d == 0, "hold")
        .when(~close_out & (ref > 0) & (F.abs(d) < band * ref), "band")
        .when(~closing & ~ok_qty(d), "skip")
        .otherwise("order")
    )
    j = j.withColumn("status", status)
    kept = F.when(tgt == 0, 0.0).when(F.col("status") == "order", tgt).when(F.col("status") == "skip", 0.0).when(
        (F.col("status") == "hold") & (tgt == cur), tgt
    ).otherwise(cur)
    return j.select(
        *k, "price", "held", "target_qty", "delta", "status",
        F.when(F.col("status") == "order", F.when(d > 0, "BUY").otherwise("SELL")).alias("side"),
        F.when(F.col("status") == "order", F.when(tgt == 0, "close").when(cur == 0, "open").otherwise("adjust")).alias("reason"),
        F.coalesce(F.abs(d) * price, F.lit(0.0)).alias("notional"),
        F.coalesce(kept * price, F.lit(0.0)).alias("book"),
        F.coalesce(ok_qty(d), F.lit(False)).alias("tradeable"),
    )


def repair_neutrality(rows: DataFrame, tol: float = 0.02, keys=("plan",)) -> DataFrame:
    """Re-admit band-skipped rows, largest first, until the book is neutral enough.

    Only band rows and two totals per plan reach Python; a plan has one row per symbol.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys)
    t = rows.withColumns({"_net": F.sum("book").over(w), "_gross": F.sum(F.abs("book")).over(w)})
    cand = t.filter((F.col("status") == "band") & (F.col("target_qty") != 0) & (F.col("delta") * F.col("_net") < 0) & F.col("tradeable"))
    cand = cand.withColumn("_o", F.row_number().over(w.orderBy(F.desc("notional"), "symbol")))
    out = T.StructType([rows.schema[k] for k in keys] + [rows.schema["symbol"], T.StructField("repaired", T.BooleanType())])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        net, gross, take = pdf["_net"].iloc[0], pdf["_gross"].iloc[0], []
        for d, p, tq, h in zip(pdf["delta"], pdf["price"], pdf["target_qty"], pdf["held"]):
            if gross <= 0 or abs(net) / gross <= tol or abs(net + d * p) >= abs(net):
                take.append(False)
                continue
            net, gross = net + d * p, gross + (abs(tq) - abs(h)) * p
            take.append(True)
        return pdf[keys + ["symbol"]].assign(repaired=take)

    r = per_series(cand, keys, walk, out, ["symbol", "delta", "price", "target_qty", "held", "_net", "_gross"], order="_o")
    j = rows.join(r, keys + ["symbol"], "left")
    hit = F.coalesce("repaired", F.lit(False))
    d = F.col("delta")
    return j.withColumns(
        {
            "side": F.when(hit, F.when(d > 0, "BUY").otherwise("SELL")).otherwise(F.col("side")),
            "reason": F.when(hit, "neutrality").otherwise(F.col("reason")),
            "status": F.when(hit, "order").otherwise(F.col("status")),
        }
    ).drop("repaired")


# --- logs and reports -----------------------------------------------------------------------------

MAKER_FEE, TAKER_FEE = 0.0002, 0.0005


def clean_run() -> Column:
    """Nothing failed, nothing left open, nobody intervened, both exposure gates passed."""
    return (
        (F.col("plan_failures") == 0) & (F.col("uncancelled") == 0) & F.col("exec_error").isNull() & ~F.col("manual_intervention")
        & F.coalesce(F.col("net_ok"), F.lit(True)) & F.coalesce(F.col("gross_ok"), F.lit(True))
    )


def failing_reasons() -> Column:
    r = [
        F.when(F.col("plan_failures") > 0, "orders not placed"),
        F.when(F.col("uncancelled") > 0, "orders not cancelled"),
        F.when(F.col("exec_error").isNotNull(), "execution error"),
        F.when(F.col("manual_intervention"), "manual intervention"),
        F.when(F.col("net_ok") == F.lit(False), "net exposure"),
        F.when(F.col("gross_ok") == F.lit(False), "leverage"),
    ]
    return F.array_compact(F.array(*r))


def execution_summary(log: DataFrame, keys=()) -> DataFrame:
    a = log.groupBy(*keys).agg(
        F.count("*").alias("n_rebalances"), F.sum("maker_notional").alias("_m"), F.sum("taker_notional").alias("_t"),
        F.sum("planned_notional").alias("_p"), F.avg(F.abs("net_exposure")).alias("_n"), F.min("timestamp_ms").alias("first_ms"), F.max("timestamp_ms").alias("last_ms"),
    )
    total, cost = F.col("_m") + F.col("_t"), F.col("_m") * MAKER_FEE + F.col("_t") * TAKER_FEE
    z = lambda n, d: F.when(d > 0, n / F.nullif(d, F.lit(0.0))).otherwise(0.0)
    return a.select(
        *keys, "n_rebalances", z(F.col("_m"), total).alias("maker_ratio"), z(total, F.col("_p")).alias("fill_ratio"),
        (z(cost, total) * 1e4).alias("realized_cost_bps"), cost.alias("total_cost_usd"), total.alias("total_traded_usd"),
        (F.col("_n") * 100).alias("avg_net_exposure_pct"), "first_ms", "last_ms",
    )


def clean_streak(log: DataFrame, needed: int, keys=()) -> DataFrame:
    """Clean runs since the last failing one, over runs that had orders."""
    r = log.filter("n_orders > 0").withColumn("_ok", clean_run())
    w = Window.partitionBy(*keys) if keys else None
    last_bad = F.max(F.when(~F.col("_ok"), F.col("timestamp_ms")))
    bad = r.groupBy(*keys).agg(last_bad.alias("_bad")) if keys else r.agg(last_bad.alias("_bad"))
    j = r.join(bad, list(keys)) if keys else r.withColumn("_bad", bad.scalar())
    s = F.count_if(F.col("_bad").isNull() | (F.col("timestamp_ms") > F.col("_bad")))
    return j.groupBy(*keys).agg(s.alias("streak")).withColumn("passed", F.col("streak") >= needed)


def income_pivot(income: DataFrame, types, day: Column) -> DataFrame:
    """Day x income type sums with absent types as zero, what is of no listed type, and the total."""
    p = income.groupBy(day.alias("day")).agg(
        *[F.coalesce(F.sum(F.when(F.col("type") == t, F.col("amount"))), F.lit(0.0)).alias(t) for t in types],
        F.coalesce(F.sum(F.when(~F.coalesce(F.col("type").isin(*types), F.lit(False)), F.col("amount"))), F.lit(0.0)).alias("other"),
    )
    return p.withColumn("total", sum(F.col(t) for t in [*types, "other"]))


def income_phases(income: DataFrame, boundary_ms: Column, keep: Column | None = None) -> DataFrame:
    """Sums before and from ``boundary_ms`` on, for each income type that the data hold and in all.

    ``keep`` leaves out what is no income (deposits). ``span_days`` is the time from a phase's
    first to its last entry; the row of a phase's total has the type ``ALL``, an entry without a
    type counts as ``NONE``. One combined aggregate: a phase of any size is reduced before it is shuffled.
    """
    rows = income if keep is None else income.filter(keep)
    rows = rows.select(
        F.when(F.col("ts_ms") < boundary_ms, "before").otherwise("after").alias("phase"),
        F.explode(F.array(F.coalesce("type", F.lit("NONE")), F.lit("ALL"))).alias("type"), "amount", "ts_ms",
    )
    return rows.groupBy("phase", "type").agg(
        F.coalesce(F.sum("amount"), F.lit(0.0)).alias("amount"), F.count("*").alias("n"),
        ((F.max("ts_ms") - F.min("ts_ms")) / 86_400_000.0).alias("span_days"),
    )


def concentration(income: DataFrame, k: int, key: str = "symbol") -> DataFrame:
    """Top and bottom k contributors and the share of the largest absolute one."""
    g = income.groupBy(key).agg(F.sum("amount").alias("amount"))
    share = g.agg((F.max(F.abs("amount")) / F.sum(F.abs("amount")))).scalar()
    top = g.orderBy(F.desc("amount"), key).limit(k).withColumn("rank_side", F.lit("top"))
    low = g.orderBy("amount", key).limit(k).withColumn("rank_side", F.lit("bottom"))
    return top.unionByName(low).withColumn("largest_share", share)


def position_rows(p: DataFrame, equity: float) -> DataFrame:
    """Margin, account share, distance to liquidation and moves per open position."""
    amt, n, lev, e, m, liq = (F.col(c) for c in ("amount", "notional", "leverage", "entry", "mark", "liq"))
    n = F.abs(n)
    side = F.when(amt > 0, 1).otherwise(-1)
    return p.filter(F.abs(amt) > 0).select(
        "symbol", F.when(amt > 0, "LONG").otherwise("SHORT").alias("side"), F.abs(amt).alias("qty"), n.alias("notional"),
        F.coalesce(fr.div(n, lev), F.lit(0.0)).alias("margin"), (n / equity * 100.0).alias("pct_account"),
        F.when((liq > 0) & (m > 0), F.abs(m - liq) / m * 100.0).alias("liq_distance_pct"),
        F.when(e > 0, (m - e) / e * 100.0 * side).otherwise(0.0).alias("price_move_pct"),
        F.when((n > 0) & (lev > 0), F.col("upnl") / (n / lev) * 100.0).otherwise(0.0).alias("upnl_pct_margin"),
    ).orderBy(F.desc("notional"))


def trade_summary(trades: DataFrame, keys, years: Column) -> DataFrame:
    """Repeated fold trades averaged per entry first, then the usual ratios."""
    keys = list(keys)
    e = trades.groupBy(*keys, "entry_idx").agg(F.avg("realized_return").alias("r"), F.count("*").alias("_d"))
    win, loss = F.when(F.col("r") > 0, F.col("r")), F.when(F.col("r") <= 0, F.col("r"))
    a = e.groupBy(*keys).agg(
        F.count("*").alias("n_trades"), F.sum("_d").alias("n_raw"), F.avg("r").alias("mean_ret"), F.stddev_samp("r").alias("_s"),
        F.avg((F.col("r") > 0).cast("double")).alias("win_rate"), F.avg(win).alias("_w"), F.avg(loss).alias("_l"),
    )
    p = F.col("win_rate")
    per_year = F.col("n_trades") / years
    ok = F.col("_s") > 1e-12
    return a.select(
        *keys, "n_trades", "n_raw", (F.col("n_raw") / F.col("n_trades")).alias("dup_factor"), "mean_ret", "win_rate",
        fr.div(F.col("_w"), F.abs("_l")).alias("payoff"), fr.div(1.0 - p, p).alias("payoff_needed"),
        F.when(ok, F.col("mean_ret") / F.col("_s") * F.sqrt(per_year)).otherwise(0.0).alias("sharpe"),
        F.when(ok, F.col("mean_ret") / F.col("_s") * F.sqrt("n_trades")).otherwise(0.0).alias("t_stat"),
    )


def cv_metrics(trades: DataFrame, years: Column) -> DataFrame:
    """Out-of-sample metrics over all folds; moments divide by n but scale by ddof 1."""
    fold = trades.groupBy("fold").agg(F.avg("realized_return").alias("m"), F.stddev_samp("realized_return").alias("s"))
    r = F.col("realized_return")
    a = trades.agg(
        F.count("*").alias("n_trades"), F.count_if("boundary_truncated").alias("n_truncated"), F.avg(r).alias("_m"), F.stddev_samp(r).alias("_s"),
        F.skewness(r).alias("_k3"), F.kurtosis(r).alias("_k4"),
    )
    per_year = F.col("n_trades") / years
    n = F.col("n_trades").cast("double")
    shrink = (n - 1) / n
    var = fold.agg(F.var_samp(F.when(F.col("s") > 1e-12, F.col("m") / F.col("s")))).scalar()
    return a.select(
        "n_trades", "n_truncated", (F.col("n_truncated") / n).alias("truncation_rate"), per_year.alias("trades_per_year"),
        (F.col("_m") / (F.col("_s") + 1e-12) * F.sqrt(per_year)).alias("sharpe_oos"),
        (var * per_year).alias("variance_of_srs"),
        F.when(n < 3, 0.0).otherwise(F.col("_k3") * F.pow(shrink, 1.5)).alias("skew"),
        F.when(n < 4, 3.0).otherwise((F.col("_k4") + 3.0) * shrink * shrink).alias("kurt"),
    )


def truncation_split(trades: DataFrame, limit: float = 0.15) -> DataFrame:
    a = trades.agg(F.count_if(~F.col("boundary_truncated")).alias("n_clean"), F.count_if("boundary_truncated").alias("n_diagnostic"))
    ratio = F.col("n_diagnostic") / (F.col("n_clean") + F.col("n_diagnostic"))
    return a.select("n_clean", "n_diagnostic", ratio.alias("ratio"), (ratio > limit).alias("warn"))


def drawdown_tiers(curve: DataFrame, keys, t1: float = 0.05, t2: float = 0.10, t3: float = 0.15, freeze_ms: int = 86_400_000, order: str = "ts_ms") -> DataFrame:
    """Tier, size multiplier and freeze along an equity curve (one row per period).

    The third tier latches, the second freezes for a day; both are running maxima.
    """
    o = Window.partitionBy(*keys).orderBy(order)
    upto, before = o.rowsBetween(Window.unboundedPreceding, 0), o.rowsBetween(Window.unboundedPreceding, -1)
    peak = F.max(F.greatest("equity", F.lit(0.0))).over(upto)
    c = curve.withColumn("dd", F.when(peak > 0, (peak - F.col("equity")) / peak).otherwise(0.0))
    dd = F.col("dd")
    c = c.withColumn("_dead", F.max((dd >= t3).cast("int")).over(upto) == 1)
    c = c.withColumn("_fz", F.max(F.when((dd >= t2) & (dd < t3), F.col(order) + freeze_ms)).over(before))
    frozen = F.coalesce(F.col(order) < F.col("_fz"), F.lit(False))
    tier = F.when(F.col("_dead"), "KILL").when(dd >= t2, "FLATTEN").when(dd >= t1, "REDUCE").otherwise("NORMAL")
    mult = F.when(F.col("_dead") | (dd >= t2) | frozen, 0.0).when(dd >= t1, 0.5).otherwise(1.0)
    return c.withColumns({"tier": tier, "multiplier": mult, "is_frozen": F.col("_dead") | (dd >= t2) | frozen}).drop("_dead", "_fz")


def chase_caps(bars: DataFrame, floor_bps: float, sigma_mult: float, wait_s: float, last: int = 200, least: int = 50) -> DataFrame:
    """(symbol, cap_bps) from the last closes of each symbol."""
    o = Window.partitionBy("symbol").orderBy(F.desc("bar_idx"))
    b = bars.withColumn("_k", F.row_number().over(o)).filter(F.col("_k") <= last)
    lr = F.when(F.col("_k") < last, F.log(F.col("close") / F.lead("close").over(o)))
    b = b.withColumn("_lr", lr)
    g = b.groupBy("symbol").agg(F.count("*").alias("_n"), F.stddev_pop("_lr").alias("_s")).filter((F.col("_n") >= least) & (F.col("_s") > 0))
    scale = (max(1.0, wait_s) / 3600.0) ** 0.5
    return g.select("symbol", F.greatest(F.lit(floor_bps), sigma_mult * F.col("_s") * scale * 1e4).alias("cap_bps"))


# --- order lifecycle --------------------------------------------------------------------------------

#: fixed values: the allowed moves between order states
TRANSITIONS = {
    "CREATED": ("SUBMITTED", "REJECTED", "CANCELED"),
    "SUBMITTED": ("ACKNOWLEDGED", "PARTIALLY_FILLED", "FILLED", "REJECTED", "CANCELED", "EXPIRED"),
    "ACKNOWLEDGED": ("PARTIALLY_FILLED", "FILLED", "CANCELED", "EXPIRED"),
    "PARTIALLY_FILLED": ("PARTIALLY_FILLED", "FILLED", "CANCELED", "EXPIRED"),
}


def lifecycle_audit(events: DataFrame, key: str = "order_id", order: str = "seq") -> DataFrame:
    """Order events plus ``problem``: an invalid move or a filled quantity going back."""
    o = Window.partitionBy(key).orderBy(order)
    e = events.withColumns({"_p": F.coalesce(F.lag("state").over(o), F.lit("CREATED")), "_f": F.coalesce(F.lag("filled_qty").over(o), F.lit(0.0))})
    allowed = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    may = F.coalesce(F.array_contains(F.try_element_at(allowed, F.col("_p")), F.col("state")), F.lit(False))
    problem = (
        F.when((F.col("state") != F.col("_p")) & ~may, "invalid transition")
        .when(F.col("filled_qty") < F.col("_f") - 1e-12, "filled decreased")
        .when(F.col("filled_qty") > F.col("qty") + 1e-9, "overfilled")
    )
    return e.withColumn("problem", problem).drop("_p", "_f")
