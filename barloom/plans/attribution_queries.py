"""Queries over return attribution, leverage, studies and period statistics."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import frames as fr
from barloom.operators import attribution as at
from barloom.operators import combine as cb
from barloom.operators import evaluate as ev
from barloom.operators import portfolio as pf
from barloom.operators import signals as sg
from barloom.operators import stats as st
from barloom.plans.evaluation_queries import BASE, SIG, fwd_cte, weekly, xs_ctes, _SPREAD
from barloom.plans.portfolio_queries import NAMED, RANK_W, TWO, named_returns, two_ctes
from barloom.plans.registry import L, W, out, query, sdiv, sln
from barloom.plans.signal_queries import PREP, signal_ctes
from barloom.sources import tables as tb

PPY = 52.0
COST = at.CostModel()
EVERY = 4


def weighted(spark, sf_dir, every=EVERY):
    """Weekly panel with weights of mom_fast on every k-th week."""
    p = sg.build_signals(tb.panel(spark, sf_dir), [SIG], keep=("close", "funding"))
    return pf.rank_weights(pf.sample_marks(p, every), SIG)


def attributed(spark, sf_dir):
    return at.simulate(weighted(spark, sf_dir), COST, bar_hours=4.0 * EVERY)


# marks: every k-th week with renumbered ti
MARKS = (
    f"WITH {PREP}, {signal_ctes(SIG, 'sig')}, mk AS (SELECT symbol, CAST(ti//{EVERY} AS BIGINT) AS ti, ts_ms, close, funding, value AS s FROM sig WHERE ti%{EVERY}=0), "
    + RANK_W.format(src="mk", frac=0.25)
)
SIM = """sm0 AS (SELECT *, lead(close) OVER o/close-1 AS r, lag(w) OVER o AS pw, lead(ti) OVER o IS NULL AS is_last FROM rw WINDOW o AS (PARTITION BY symbol ORDER BY ti)),
sm1 AS (SELECT *, lag(r) OVER (PARTITION BY symbol ORDER BY ti) AS pr FROM sm0),
sm2 AS (SELECT *, count(pr) OVER (PARTITION BY ti)>0 AS anyp, 1+coalesce(sum(pw*coalesce(pr,0)) OVER (PARTITION BY ti),0) AS den FROM sm1),
sm3 AS (SELECT *, abs(w-coalesce(CASE WHEN anyp THEN pw*(1+coalesce(pr,0))/den ELSE pw END,0)) AS tr FROM sm2),
sm AS (SELECT ti, ts_ms, CASE WHEN count(r)>0 THEN sum(w*coalesce(r,0)) END AS gross, sum(tr*4.0/1e4) AS cost,
  -sum(w*coalesce(funding,0))*(16.0/8) AS funding_pnl, sum(tr) AS turnover, count(*) FILTER (w<>0) AS n_positions, sum(w) AS net_exposure, sum(abs(w)) AS gross_exposure,
  bool_or(is_last) AS il FROM sm3 GROUP BY ti, ts_ms),
at_ AS (SELECT * EXCLUDE (il), CASE WHEN NOT il THEN gross-cost+funding_pnl END AS ret FROM sm)"""
ATTR = f"{MARKS}, {SIM}"
_AV = "gross, cost, funding_pnl, turnover, net_exposure, gross_exposure, ret"


@query("simulate", f"{ATTR} " + out("at_", "ti, ts_ms, n_positions", _AV))
def simulate(spark, sf_dir):
    return attributed(spark, sf_dir)


@query(
    "cost_per_side",
    f"WITH {PREP}, c AS (SELECT symbol, avg(ofi)*10 AS extra FROM prep GROUP BY symbol), d AS (SELECT symbol, greatest(4.0+extra, 0.5) AS bps FROM c) " + out("d", "symbol", "bps"),
)
def cost_per_side(spark, sf_dir):
    p = tb.panel(spark, sf_dir).groupBy("symbol").agg((F.avg("ofi") * 10).alias("extra"))
    return p.select("symbol", COST.bps(F.col("extra")).alias("bps"))


@query(
    "segment_cut_after_compute",
    f"{ATTR} " + out("(SELECT * FROM at_ WHERE ti >= floor(0.7::DOUBLE*(SELECT max(ti)+1 FROM at_)))", "ti, ts_ms", "ret"),
)
def segment_cut(spark, sf_dir):
    """The filter comes after every window, never below one."""
    a = attributed(spark, sf_dir)
    n = a.agg(F.max("ti") + 1).scalar()
    return a.filter(F.col("ti") >= (n * 0.7).cast("int")).select("ti", "ts_ms", "ret")


@query(
    "simulate_marked_to_market",
    f"""WITH RECURSIVE {PREP}, {signal_ctes(SIG, 'sig')}, mk AS (SELECT symbol, ti, ts_ms, close, funding, value AS s FROM sig WHERE ti%{EVERY}=0), {RANK_W.format(src='mk', frac=0.25)},
 b AS (SELECT sig.symbol, sig.ti, sig.ts_ms, coalesce(sig.funding,0) AS f, rw.w AS tgt, CASE WHEN sig.ti>0 THEN sig.close/lag(sig.close) OVER (PARTITION BY sig.symbol ORDER BY sig.ti)-1 END AS r FROM sig LEFT JOIN rw USING (symbol, ti)),
 rec AS (SELECT symbol, CAST(-1 AS BIGINT) AS ti, 0::DOUBLE AS before_, 0::DOUBLE AS after_, 0::DOUBLE AS held, 0::DOUBLE AS r, 0::DOUBLE AS f, false AS anyr, false AS mark_ FROM (SELECT DISTINCT symbol FROM b)
  UNION ALL SELECT x.symbol, x.ti, x.h, x.h*(1+coalesce(x.r,0))/(1+sum(x.h*coalesce(x.r,0)) OVER ()), CASE WHEN x.tgt IS NOT NULL THEN x.tgt ELSE x.h*(1+coalesce(x.r,0))/(1+sum(x.h*coalesce(x.r,0)) OVER ()) END, x.r, x.f, count(x.r) OVER ()>0, x.tgt IS NOT NULL
  FROM (SELECT b.symbol, b.ti, rec.held AS h, b.r, b.f, b.tgt FROM rec JOIN b ON b.symbol=rec.symbol AND b.ti=rec.ti+1) x),
 g AS (SELECT ti, CASE WHEN bool_or(anyr) AND sum(abs(before_))>0 THEN sum(before_*coalesce(r,0)) ELSE 0 END AS gross, sum(CASE WHEN mark_ THEN abs(held-after_) ELSE 0 END) AS turnover,
   CASE WHEN bool_or(anyr) AND sum(abs(before_))>0 THEN -sum(before_*f)*0.5 ELSE 0 END AS funding_pnl, sum(held) AS net_exposure, sum(abs(held)) AS gross_exposure, count(*) FILTER (held<>0) AS n_positions FROM rec WHERE ti>=0 GROUP BY ti),
 o AS (SELECT *, turnover*4.0/1e4 AS cost, gross-turnover*4.0/1e4+funding_pnl AS ret FROM g) """ + out("o", "ti, n_positions", _AV),
)
def mark_to_market(spark, sf_dir):
    p = sg.build_signals(tb.panel(spark, sf_dir), [SIG], keep=("close", "funding"))
    w = pf.rank_weights(p.filter(F.col("ti") % EVERY == 0), SIG).select("ti", "symbol", "w")
    return at.mark_to_market(p.join(w, ["ti", "symbol"], "left"), EVERY, COST).drop("ts_ms")


@query(
    "backtest_cross_sectional",
    f"""{MARKS}, b0 AS (SELECT *, lead(close) OVER o/close-1 AS r, abs(w-coalesce(lag(w) OVER o,0)) AS tr, lead(ti) OVER o IS NULL AS il FROM rw WINDOW o AS (PARTITION BY symbol ORDER BY ti)),
 b1 AS (SELECT ti, sum(w*r) AS gross, sum(tr) AS turnover, sum(tr)*0.0004 AS cost, -sum(w*funding)*2.0 AS funding_pnl, bool_or(il) AS il FROM b0 GROUP BY ti),
 b AS (SELECT *, CASE WHEN NOT il THEN coalesce(gross,0)-cost+coalesce(funding_pnl,0) END AS ret FROM b1) """ + out("b", "ti", "gross, turnover, cost, funding_pnl, ret"),
)
def simple(spark, sf_dir):
    return at.simple_attribution(weighted(spark, sf_dir), EVERY).drop("ts_ms")


# --- basis ------------------------------------------------------------------------------

SPOT = "avg(close) OVER (PARTITION BY symbol ORDER BY ti ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)"


def with_spot(spark, sf_dir):
    """Panel with a stand-in spot price: the two-step mean of the close."""
    p = tb.panel(spark, sf_dir)
    return p.withColumn("spot", F.avg("close").over(fr.frame(2)))


@query("basis_series", f"WITH {PREP}, s AS (SELECT ts_ms, symbol, close/nullif({SPOT},0)-1 AS basis FROM prep) " + out("s", "ts_ms, symbol", "basis"))
def basis_series(spark, sf_dir):
    return with_spot(spark, sf_dir).select("ts_ms", "symbol", at.basis(F.col("close"), F.col("spot")).alias("basis"))


@query("backtest_basis")
def backtest_basis(spark, sf_dir):
    return at.basis_carry(with_spot(spark, sf_dir), at.BasisSpec(n_positions=4, rebalance_bars=12))


# --- period statistics ---------------------------------------------------------------------

EQ = """eq0 AS (SELECT *, product(1+ret) OVER (PARTITION BY {k} ORDER BY ti ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM {src} WHERE ret IS NOT NULL),
eq AS (SELECT *, 1-e/max(e) OVER (PARTITION BY {k} ORDER BY ti ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS dd FROM eq0)"""
ST = """st0 AS (SELECT {k}, count(*) AS n, avg(ret) AS m, stddev_samp(ret) AS s, max(dd) AS max_dd, avg(CASE WHEN ret>0 THEN 1.0 ELSE 0.0 END) AS hit_rate, arg_max(e, ti) AS el,
  count(*) FILTER (ret<0) AS nn, stddev_samp(ret) FILTER (ret<0) AS ns, skewness(ret) AS skew, kurtosis(ret) AS kurtosis FROM eq GROUP BY {k}),
st AS (SELECT *, m*{p} AS ann_return, s*sqrt({p}) AS ann_vol, CASE WHEN s>1e-15 THEN m/s*sqrt({p}) ELSE 0 END AS sharpe, CASE WHEN nn>2 AND ns>1e-15 THEN m/ns*sqrt({p}) ELSE 0 END AS sortino,
  CASE WHEN s>1e-15 THEN m/s*sqrt(n) ELSE 0 END AS t_stat, CASE WHEN max_dd>1e-9 THEN m*{p}/max_dd ELSE 0 END AS calmar, el-1 AS total_return, CASE WHEN el>0 THEN pow(el,{p}/n)-1 ELSE -1 END AS cagr, n>=20 AS viable FROM st0)"""
_STV = "ann_return, ann_vol, sharpe, sortino, t_stat, max_dd, calmar, hit_rate, total_return, cagr, skew, kurtosis"


def stats_sql(k="name", src="nr", p="52.0"):
    return EQ.format(k=k, src=src) + ", " + ST.format(k=k, p=p)


@query("period_stats", f"{two_ctes()}, {NAMED}, {stats_sql()} " + out("st", "name, n, viable", _STV))
def period_stats(spark, sf_dir):
    return st.period_stats(named_returns(spark, sf_dir), ["name"], PPY)


@query(
    "portfolio_stats",
    f"{ATTR}, sr AS (SELECT *, 'book' AS name FROM at_), {stats_sql(src='sr', p='13.0')}, ex AS (SELECT avg(turnover) AS avg_turnover, avg(cost)*13 AS cost_drag_ann, avg(funding_pnl)*13 AS funding_ann, avg(n_positions) AS avg_positions FROM at_) "
    + out("(SELECT * FROM st, ex)", "name, n, viable", _STV + ", avg_turnover, cost_drag_ann, funding_ann, avg_positions"),
)
def portfolio_stats(spark, sf_dir):
    a = attributed(spark, sf_dir).withColumn("name", F.lit("book"))
    extras = {"avg_turnover": ("turnover", False), "cost_drag_ann": ("cost", True), "funding_ann": ("funding_pnl", True), "avg_positions": ("n_positions", False)}
    return st.period_stats(a, ["name"], 13.0, extras=extras)


@query(
    "sharpe_ci",
    f"{two_ctes()}, {NAMED}, a AS (SELECT name, count(*) AS n, avg(ret)/stddev_samp(ret) AS sr FROM nr WHERE ret IS NOT NULL GROUP BY name), b AS (SELECT name, n, sr*sqrt(52.0) AS sharpe, (sr-1.96*sqrt((1+0.5*sr*sr)/n))*sqrt(52.0) AS low, (sr+1.96*sqrt((1+0.5*sr*sr)/n))*sqrt(52.0) AS high FROM a) " + out("b", "name, n", "sharpe, low, high"),
)
def sharpe_ci(spark, sf_dir):
    return st.sharpe_ci(named_returns(spark, sf_dir), ["name"], PPY)


FOLDS = "fo0 AS (SELECT name, ret, ntile(8) OVER (PARTITION BY name ORDER BY ti) AS fold FROM nr WHERE ret IS NOT NULL), fo AS (SELECT name, fold, count(*) AS n, CASE WHEN stddev_samp(ret)>1e-15 THEN avg(ret)/stddev_samp(ret)*sqrt(52.0) ELSE 0 END AS sharpe FROM fo0 GROUP BY name, fold)"


@query("fold_statistics", f"{two_ctes()}, {NAMED}, {FOLDS} " + out("fo", "name, fold, n", "sharpe"))
def fold_statistics(spark, sf_dir):
    return st.fold_sharpes(named_returns(spark, sf_dir), ["name"], 8, PPY)


_FS = "fs0 AS (SELECT name, quantile_cont(sharpe,0.5) AS fold_median, min(sharpe) AS fold_min, avg(CASE WHEN sharpe>0 THEN 1.0 ELSE 0.0 END) AS share_positive FROM fo GROUP BY name), fs AS (SELECT *, fold_median*share_positive AS score FROM fs0)"


@query("stability_score", f"{two_ctes()}, {NAMED}, {FOLDS}, {_FS} " + out("fs", "name", "fold_median, fold_min, share_positive, score"))
def stability(spark, sf_dir):
    return st.fold_summary(st.fold_sharpes(named_returns(spark, sf_dir), ["name"], 8, PPY), ["name"])


@query("growth_and_drawdown", f"{two_ctes()}, {NAMED}, {EQ.format(k='name', src='nr')}, g AS (SELECT name, avg(ln(1+ret)) AS log_growth, max(dd) AS max_dd FROM eq GROUP BY name) " + out("g", "name", "log_growth, max_dd"))
def growth_dd(spark, sf_dir):
    return st.growth_and_drawdown(named_returns(spark, sf_dir), ["name"])


# --- leverage --------------------------------------------------------------------------------

_VT = """vt0 AS (SELECT *, CASE WHEN count(ret) OVER f>=20 THEN stddev_samp(ret) OVER f END AS v FROM nr WHERE ret IS NOT NULL WINDOW f AS (PARTITION BY name ORDER BY ti ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
vt AS (SELECT name, ti, ret, CASE WHEN lag(v) OVER (PARTITION BY name ORDER BY ti)>0 THEN least(0.3/(lag(v) OVER (PARTITION BY name ORDER BY ti)*sqrt(52.0)),3.0) ELSE 0 END AS lev FROM vt0)"""
LEV = at.LeverageSpec(periods_per_year=PPY)


@query("volatility_target", f"{two_ctes()}, {NAMED}, {_VT} " + out("vt", "name, ti", "ret, lev"))
def vol_target(spark, sf_dir):
    return at.vol_target(named_returns(spark, sf_dir).filter("ret is not null"), LEV)


@query(
    "drawdown_throttle",
    f"{two_ctes()}, {NAMED}, {EQ.format(k='name', src='nr')}, t AS (SELECT name, ti, coalesce(lag(least(1.0,greatest(0.0,1-(dd-0.1)/0.15))) OVER (PARTITION BY name ORDER BY ti),1.0) AS throttle FROM eq) " + out("t", "name, ti", "throttle"),
)
def dd_throttle(spark, sf_dir):
    curve = st.with_equity(named_returns(spark, sf_dir).filter("ret is not null"), ["name"])
    return at.drawdown_throttle(curve, LEV).select("name", "ti", "throttle")


@query(
    "apply_leverage",
    f"""WITH RECURSIVE {(two_ctes() + ', ' + NAMED + ', ' + _VT)[5:]}, o AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ti) AS i FROM vt),
 rec AS (SELECT DISTINCT name, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS ti, 1::DOUBLE AS equity, 1::DOUBLE AS peak, 0::DOUBLE AS ret, 0::DOUBLE AS leverage FROM o
  UNION ALL SELECT name, i, ti, equity*(1+greatest(lv*r,-0.999)), greatest(peak, equity*(1+greatest(lv*r,-0.999))), greatest(lv*r,-0.999), lv FROM (
   SELECT o.name, o.i, o.ti, rec.equity, rec.peak, o.ret AS r, o.lev*CASE WHEN 1-rec.equity/rec.peak>0.1 THEN least(1.0,greatest(0.0,1-((1-rec.equity/rec.peak)-0.1)/0.15)) ELSE 1 END AS lv
   FROM rec JOIN o ON o.name=rec.name AND o.i=rec.i+1)) """ + out("(SELECT * FROM rec WHERE i>0)", "name, ti", "ret, leverage, equity"),
)
def apply_leverage(spark, sf_dir):
    return at.apply_leverage(named_returns(spark, sf_dir), LEV)


@query("kelly_leverage", f"{two_ctes()}, {NAMED}, k AS (SELECT name, least(5.0,greatest(0.0,0.5*avg(ret)/(stddev_samp(ret)*stddev_samp(ret)))) AS kelly FROM nr GROUP BY name) " + out("k", "name", "kelly"))
def kelly(spark, sf_dir):
    g = named_returns(spark, sf_dir).groupBy("name").agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"))
    return g.select("name", at.kelly_leverage(F.col("m"), F.col("s")).alias("kelly"))


_CONF = [0.5, 0.75, 0.9]


@query(
    "required_sharpe",
    f"{two_ctes()}, {NAMED}, {EQ.format(k='name', src='nr')}, {ST.format(k='name', p=PPY)}, z AS (SELECT unnest({_CONF}::DOUBLE[]) AS confidence, unnest({[NormalDist().inv_cdf(1 - c) for c in _CONF]}::DOUBLE[]) AS z), rs AS (SELECT name, confidence, (total_return-z*0.6/sqrt({PPY})*sqrt(n))/n AS mu FROM st CROSS JOIN z), q AS (SELECT name, confidence, mu/(0.6/sqrt({PPY}))*sqrt({PPY}) AS required_ann_sharpe, mu*{PPY} AS required_ann_return FROM rs) "
    + out("q", "name", "confidence, required_ann_sharpe, required_ann_return"),
)
def required_sharpe(spark, sf_dir):
    """Sharpe needed to reach each strategy's own total return with given confidence."""
    s = st.period_stats(named_returns(spark, sf_dir), ["name"], PPY)
    q = at.explode_grid(s, "confidence", _CONF)
    z = st.norm_ppf(1.0 - F.col("confidence"))
    sigma = F.lit(0.6) / F.sqrt(F.lit(PPY))
    mu = (F.col("total_return") - z * sigma * F.sqrt("n")) / F.col("n")
    return q.select("name", "confidence", (mu / sigma * F.sqrt(F.lit(PPY))).alias("required_ann_sharpe"), (mu * PPY).alias("required_ann_return"))


GRID = [1.0, 2.0, 3.0, 5.0, 8.0]


@query(
    "leverage_growth_grid",
    f"""{two_ctes()}, {NAMED}, q AS (SELECT name, CAST(l AS DOUBLE) AS leverage, ti, greatest(1+l*ret,1e-12) AS g, 1+l*ret<=0 AS dead FROM nr, (SELECT unnest([1.0,2.0,3.0,5.0,8.0]) AS l) WHERE ret IS NOT NULL),
 e AS (SELECT *, product(g) OVER (PARTITION BY name, leverage ORDER BY ti ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM q),
 d AS (SELECT *, 1-e/greatest(max(e) OVER (PARTITION BY name, leverage ORDER BY ti ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),1.0) AS dd FROM e),
 r AS (SELECT name, leverage, avg(ln(g))*52 AS log_growth, max(dd) AS max_dd, avg(CASE WHEN dead THEN 1.0 ELSE 0.0 END) AS ruin_share FROM d GROUP BY name, leverage) """ + out("r", "name, leverage", "log_growth, max_dd, ruin_share"),
)
def growth_grid(spark, sf_dir):
    return at.growth_grid(named_returns(spark, sf_dir), GRID, PPY, keys=["name"])


@query("target_probability_table")
def bootstrap(spark, sf_dir):
    r = named_returns(spark, sf_dir).filter(F.col("name") == TWO[0])
    return at.bootstrap_table(r, 52, GRID, 0.2, n_paths=20000, ppy=PPY)


# --- costs -----------------------------------------------------------------------------------

CS = f"""cs0 AS (SELECT symbol, ti, CASE WHEN count(high) {W(6)}=6 THEN max(high) {W(6)} END AS hi, CASE WHEN count(low) {W(6)}=6 THEN min(low) {W(6)} END AS lo FROM panel),
cs1 AS (SELECT *, pow(ln(hi/lo),2) AS b FROM cs0 WHERE ti%6=0),
cs2 AS (SELECT *, CASE WHEN count(hi) {W(2)}=2 THEN max(hi) {W(2)} END AS h2, CASE WHEN count(lo) {W(2)}=2 THEN min(lo) {W(2)} END AS l2, CASE WHEN count(b) {W(2)}=2 THEN sum(b) {W(2)} END AS beta FROM cs1),
cs3 AS (SELECT symbol, CASE WHEN a<0 THEN 0 ELSE a END AS a FROM (SELECT symbol, (sqrt(2*beta)-sqrt(beta))/(3-2*sqrt(2.0)) - sqrt(pow(ln(h2/l2),2)/(3-2*sqrt(2.0))) AS a FROM cs2)),
cs AS (SELECT symbol, least(60.0,greatest(0.2,quantile_cont(2*(exp(a)-1)/(1+exp(a)),0.5)*1e4)) AS spread_bps FROM cs3 GROUP BY symbol)"""


@query("corwin_schultz_spread", f"WITH {PREP}, {CS} " + out("cs", "symbol", "spread_bps"))
def corwin_schultz(spark, sf_dir):
    return st.corwin_schultz(tb.panel(spark, sf_dir))


ADV = f"""ad AS (SELECT symbol, quantile_cont(dv,0.5)*6 AS adv, stddev_samp(lr)*sqrt(6.0) AS sigma_day FROM prep WHERE ti>(SELECT max(ti) FROM prep)-180 GROUP BY symbol)"""
_EC = f"""{CS}, {ADV}, ec0 AS (SELECT ad.*, spread_bps*0.5 AS half, least(20.0,greatest(0.0,sigma_day*sqrt(20.0/nullif(adv,0))*1e4)) AS imp FROM ad LEFT JOIN cs USING (symbol)),
ec1 AS (SELECT symbol, coalesce(half,(SELECT quantile_cont(half,0.5) FROM ec0))+coalesce(imp,0) AS t FROM ec0),
ec AS (SELECT symbol, greatest(coalesce(t,(SELECT quantile_cont(t,0.5) FROM ec1)),0.1) AS cost_bps FROM ec1)"""


@query("estimate_cost_bps", f"WITH {PREP}, {_EC} " + out("ec", "symbol", "cost_bps"))
def estimate_cost(spark, sf_dir):
    return st.estimate_cost(tb.panel(spark, sf_dir), lookback=180)


@query(
    "capacity_table",
    f"""WITH {PREP}, {CS}, {ADV}, au AS (SELECT CAST(unnest([5000,250000,2500000,25000000]) AS DOUBLE) AS aum), q AS (SELECT aum, aum*5.0/50 AS ord, adv, spread_bps*0.5+least(20.0,greatest(0.0,sigma_day*sqrt(aum*5.0/50/nullif(adv,0))*1e4)) AS slip0 FROM ad JOIN cs USING (symbol), au),
 r AS (SELECT aum, max(ord) AS notional_per_order, quantile_cont(least(slip0,20.0),0.5) AS median_bps, avg(CASE WHEN slip0>=20 THEN 1.0 ELSE 0.0 END) AS share_at_cap, quantile_cont(ord/adv,0.5) AS participation_median, quantile_cont(ord/adv,0.9) AS participation_p90 FROM q GROUP BY aum) """ + out("r", "aum", "notional_per_order, median_bps, share_at_cap, participation_median, participation_p90"),
)
def capacity(spark, sf_dir):
    p = tb.panel(spark, sf_dir)
    last = p.agg(F.max("ti")).scalar()
    q = p.withColumns({"_dv": F.col("volume") * F.col("close"), "_lr": fr.log_ret("close")}).filter(F.col("ti") > last - 180)
    adv = q.groupBy("symbol").agg(
        (F.percentile("_dv", F.lit(0.5)) * 6).alias("adv"), (F.stddev_samp("_lr") * 6**0.5).alias("sigma_day")
    ).join(st.corwin_schultz(p), "symbol")
    per_order = F.col("aum") * 5.0 / 50
    slip = F.col("spread_bps") * 0.5 + fr.clip(F.col("sigma_day") * F.sqrt(fr.div("order", "adv")) * 1e4, 0.0, 20.0)
    # the cap is applied inside; slippage reads the order column of the same row
    return st.capacity_table(adv, [5000, 250000, 2500000, 25000000], per_order, slip)


@query(
    "breadth_era_filter",
    f"{two_ctes()}, {NAMED}, br AS (SELECT ti, count(close) AS breadth FROM prep GROUP BY ti), j AS (SELECT nr.*, breadth FROM nr JOIN br USING (ti)), r AS (SELECT name, count(ret) AS n, count(ret) FILTER (breadth>=25) AS n_wide, avg(ret) FILTER (breadth>=25)/stddev_samp(ret) FILTER (breadth>=25)*sqrt(52.0) AS sharpe_wide, avg(ret)/stddev_samp(ret)*sqrt(52.0) AS sharpe FROM j GROUP BY name) " + out("r", "name, n, n_wide", "sharpe_wide, sharpe"),
)
def breadth_era(spark, sf_dir):
    p = weekly(spark, sf_dir, TWO)
    breadth = p.groupBy("ti").agg(F.count("close").alias("breadth"))
    from barloom.operators import combine as cb

    r = cb.factor_table(p, TWO).select(F.col("signal").alias("name"), "ti", F.col("spread").alias("ret"))
    wide = F.when(F.col("breadth") >= 25, F.col("ret"))
    return r.join(breadth, "ti").groupBy("name").agg(
        F.count("ret").alias("n"), F.count(wide).alias("n_wide"),
        (F.avg(wide) / F.stddev_samp(wide) * PPY**0.5).alias("sharpe_wide"),
        (F.avg("ret") / F.stddev_samp("ret") * PPY**0.5).alias("sharpe"),
    )


# --- studies: every configuration in one job ----------------------------------------------------

REB = (1, 2, 4, 8, 12)
FRACS = (0.1, 0.2, 0.25)


def study_rows(spark, sf_dir):
    """One attribution row set per (rebalance period, fraction); configs are exploded."""
    p = sg.build_signals(tb.panel(spark, sf_dir), [SIG], keep=("close", "funding"))
    cfg = F.array(*[F.struct(F.lit(k).alias("every"), F.lit(f).alias("frac")) for k in REB for f in FRACS])
    q = p.withColumn("c", F.explode(cfg)).select("*", "c.every", "c.frac").drop("c").filter(F.col("ti") % F.col("every") == 0)
    keys = ("every", "frac", "ti")
    n = F.count(SIG).over(fr.xs(keys))
    q = q.withColumns({"_n": n, "_pos": fr.first_rank(SIG, keys)})
    q = q.withColumn("_k", F.greatest(F.lit(1), fr.half_even(F.col("_n") * F.col("frac"))))
    live = F.col(SIG).isNotNull() & (F.col("_n") >= 4)
    w = F.when(live & (F.col("_pos") <= F.col("_k")), -0.5 / F.col("_k")).when(live & (F.col("_pos") > F.col("_n") - F.col("_k")), 0.5 / F.col("_k")).otherwise(0.0)
    return q.withColumn("w", w)


_CFG = f"cfg AS (SELECT * FROM (SELECT unnest([{','.join(map(str, REB))}]) AS every), (SELECT unnest([0.1::DOUBLE,0.2::DOUBLE,0.25::DOUBLE]) AS frac))"
STUDY = f"""{BASE.replace("symbol, ti, ts_ms, close, value AS s", "symbol, ti, ts_ms, close, funding, value AS s")}, {_CFG},
g0 AS (SELECT sg.*, every, frac, count(s) OVER (PARTITION BY every,frac,ti) AS n, row_number() OVER (PARTITION BY every,frac,ti ORDER BY s ASC NULLS LAST, symbol) AS pos FROM sg, cfg WHERE ti%every=0),
g1 AS (SELECT *, greatest(1,CAST(round_even(n*frac,0) AS INT)) AS k FROM g0),
g2 AS (SELECT *, CASE WHEN s IS NOT NULL AND n>=4 AND pos<=k THEN -0.5/k WHEN s IS NOT NULL AND n>=4 AND pos>n-k THEN 0.5/k ELSE 0.0 END AS w FROM g1),
g3 AS (SELECT *, lead(close) OVER o/close-1 AS r, abs(w-coalesce(lag(w) OVER o,0)) AS tr, lead(ti) OVER o IS NULL AS il FROM g2 WINDOW o AS (PARTITION BY every,frac,symbol ORDER BY ti)),
g4 AS (SELECT every, frac, ti, ts_ms, sum(w*r) AS gross, sum(tr)*0.0004 AS cost, coalesce(-sum(w*funding),0)*(every*4.0/8) AS fp, bool_or(il) AS il FROM g3 GROUP BY every,frac,ti,ts_ms),
g5 AS (SELECT every, frac, ti, ts_ms, CASE WHEN NOT il THEN coalesce(gross,0)-cost+fp END AS ret FROM g4)"""


def study_returns(spark, sf_dir):
    a = at.simple_attribution(study_rows(spark, sf_dir), 1, 4.0, config=("every", "frac"))
    # funding scales with the holding period of the configuration
    f = F.coalesce("funding_pnl", F.lit(0.0)) * F.col("every")
    net = F.coalesce("gross", F.lit(0.0)) - F.col("cost") + f
    return a.withColumn("ret", F.when(F.col("ret").isNotNull(), net))


GS = """g6 AS (SELECT *, ntile(5) OVER (PARTITION BY every,frac ORDER BY ti) AS fold FROM g5 WHERE ret IS NOT NULL),
g7 AS (SELECT every, frac, fold, CASE WHEN stddev_samp(ret)>1e-15 THEN avg(ret)/stddev_samp(ret)*sqrt(52.0) ELSE 0 END AS sh FROM g6 GROUP BY every,frac,fold),
g8 AS (SELECT every, frac, quantile_cont(sh,0.5) AS fold_median, min(sh) AS fold_min, avg(CASE WHEN sh>0 THEN 1.0 ELSE 0.0 END) AS share_positive FROM g7 GROUP BY every,frac),
g9 AS (SELECT every, frac, count(*) AS n, avg(ret)/stddev_samp(ret)*sqrt(52.0/every) AS sharpe, avg(ret)*52/every-pow(stddev_samp(ret),2)*52/every/2 AS kelly_growth FROM g5 WHERE ret IS NOT NULL GROUP BY every,frac)"""


@query("grid_study", f"{STUDY}, {GS} " + out("(SELECT *, fold_median*share_positive AS score FROM g8 JOIN g9 USING (every,frac))", "every, frac, n", "fold_median, fold_min, share_positive, score, sharpe, kelly_growth"))
def grid_study(spark, sf_dir):
    r = study_returns(spark, sf_dir)
    keys = ["every", "frac"]
    folds = st.fold_summary(st.fold_sharpes(r, keys, 5, PPY), keys)
    scale = F.lit(PPY) / F.col("every")
    a = r.filter("ret is not null").groupBy(*keys).agg(F.count("*").alias("n"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"))
    a = a.select(*keys, "n", (F.col("m") / F.col("s") * F.sqrt(scale)).alias("sharpe"), (F.col("m") * scale - F.col("s") * F.col("s") * scale / 2).alias("kelly_growth"))
    return folds.join(a, keys)


_COSTS = (0.0, 0.0001, 0.0004)


@query(
    "signal_screening",
    f"""{two_ctes()}, u AS (SELECT '{TWO[0]}' AS name, symbol, ti, close, funding, s0 AS s FROM two WHERE ti%4=0 UNION ALL SELECT '{TWO[1]}', symbol, ti, close, funding, s1 FROM two WHERE ti%4=0),
 h0 AS (SELECT *, count(s) OVER p AS n, row_number() OVER (PARTITION BY name,ti ORDER BY s ASC NULLS LAST, symbol) AS pos FROM u WINDOW p AS (PARTITION BY name,ti)),
 h1 AS (SELECT *, greatest(1,CAST(round_even(n*0.25,0) AS INT)) AS k FROM h0),
 h2 AS (SELECT *, CASE WHEN s IS NOT NULL AND n>=4 AND pos<=k THEN -0.5/k WHEN s IS NOT NULL AND n>=4 AND pos>n-k THEN 0.5/k ELSE 0.0 END AS w FROM h1),
 h3 AS (SELECT *, lead(close) OVER o/close-1 AS r, abs(w-coalesce(lag(w) OVER o,0)) AS tr, lead(ti) OVER o IS NULL AS il FROM h2 WINDOW o AS (PARTITION BY name,symbol ORDER BY ti)),
 h4 AS (SELECT name, ti, sum(w*r) AS gross, sum(tr) AS tr, coalesce(-sum(w*funding)*2.0,0) AS fp, bool_or(il) AS il FROM h3 GROUP BY name,ti),
 h5 AS (SELECT name, CAST(c AS DOUBLE) AS cost_rate, CASE WHEN NOT il THEN coalesce(gross,0)-tr*c+fp END AS ret FROM h4, (SELECT unnest([0.0,0.0001,0.0004]) AS c)),
 h AS (SELECT name, cost_rate, count(ret) AS n, avg(ret)/stddev_samp(ret)*sqrt(13.0) AS sharpe, avg(ret)/stddev_samp(ret)*sqrt(count(ret)) AS t_stat FROM h5 GROUP BY 1,2) """
    + out("(SELECT *, abs(t_stat)>2 AS flagged FROM h)", "name, cost_rate, n, flagged", "sharpe, t_stat"),
)
def screening(spark, sf_dir):
    p = pf.sample_marks(sg.build_signals(tb.panel(spark, sf_dir), list(TWO), keep=("close", "funding")), 4)
    long = sg.to_long(p, TWO, ("symbol", "ti", "ts_ms", "close", "funding"), "name")
    w = pf.rank_weights(long, "value", keys=("name", "ti"))
    a = at.simple_attribution(w, 4, config=("name",), cost_rate=0.0)
    a = at.explode_grid(a, "cost_rate", _COSTS)
    a = a.withColumn("ret", F.when(F.col("ret").isNotNull(), F.col("ret") - F.col("turnover") * F.col("cost_rate")))
    g = a.groupBy("name", "cost_rate").agg(F.count("ret").alias("n"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"))
    t = F.col("m") / F.col("s") * F.sqrt("n")
    return g.select("name", "cost_rate", "n", (F.abs(t) > 2).alias("flagged"), (F.col("m") / F.col("s") * 13.0**0.5).alias("sharpe"), t.alias("t_stat"))


@query(
    "incremental_change_ladder",
    f"{STUDY}, {GS}, l AS (SELECT every, frac, sharpe, sharpe-first_value(sharpe) OVER (ORDER BY every, frac) AS delta_vs_base, sharpe-lag(sharpe) OVER (ORDER BY every, frac) AS delta_vs_previous FROM g9) " + out("l", "every, frac", "sharpe, delta_vs_base, delta_vs_previous"),
)
def ladder(spark, sf_dir):
    r = study_returns(spark, sf_dir).filter("ret is not null")
    g = r.groupBy("every", "frac").agg((F.avg("ret") / F.stddev_samp("ret")).alias("u"))
    g = g.select("every", "frac", (F.col("u") * F.sqrt(F.lit(PPY) / F.col("every"))).alias("sharpe"))
    w = Window.partitionBy(F.lit(0)).orderBy("every", "frac")  # one row per configuration
    return g.withColumns({"delta_vs_base": F.col("sharpe") - F.first("sharpe").over(w), "delta_vs_previous": F.col("sharpe") - F.lag("sharpe").over(w)})


@query(
    "out_of_sample_report",
    f"""{STUDY}, sp AS (SELECT ts_ms AS cut FROM axis WHERE ti=floor(0.7::DOUBLE*(SELECT count(*) FROM axis))),
 o AS (SELECT every, frac, CASE WHEN ts_ms<cut THEN 'train' ELSE 'holdout' END AS segment, year(make_timestamp_ms(ts_ms)) AS yr, ret FROM g5, sp WHERE ret IS NOT NULL),
 r AS (SELECT every, frac, segment, count(*) AS n, avg(ret)/stddev_samp(ret)*sqrt(52.0/every) AS sharpe FROM o GROUP BY 1,2,3),
 t AS (SELECT h.every, h.frac, tr.n AS n_train, h.n AS n_holdout, tr.sharpe AS train, h.sharpe AS holdout, h.sharpe/nullif(tr.sharpe,0) AS retention FROM r h JOIN r tr ON h.every=tr.every AND h.frac=tr.frac AND h.segment='holdout' AND tr.segment='train') """
    + out("t", "every, frac, n_train, n_holdout", "train, holdout, retention"),
)
def oos_report(spark, sf_dir):
    r = study_returns(spark, sf_dir).filter("ret is not null")
    n = tb.panel(spark, sf_dir).agg(F.max("ti") + 1).scalar()
    hold = F.col("ti") >= (n * 0.7).cast("int")
    sharpe = lambda c: F.avg(F.when(c, F.col("ret"))) / F.stddev_samp(F.when(c, F.col("ret"))) * F.sqrt(F.lit(PPY) / F.first("every"))
    g = r.groupBy("every", "frac").agg(
        F.count_if(~hold).alias("n_train"), F.count_if(hold).alias("n_holdout"),
        sharpe(~hold).alias("train"), sharpe(hold).alias("holdout"),
    )
    return g.withColumn("retention", fr.div("holdout", "train"))


@query(
    "returns_by_year",
    f"{STUDY}, y AS (SELECT every, frac, CAST(year(make_timestamp_ms(ts_ms)) AS INT) AS yr, count(*) AS n, avg(ret)*52.0/every AS ann_return, avg(ret)/stddev_samp(ret)*sqrt(52.0/every) AS sharpe FROM g5 WHERE ret IS NOT NULL GROUP BY 1,2,3 HAVING count(*)>=10) " + out("y", "every, frac, yr, n", "ann_return, sharpe"),
)
def by_year(spark, sf_dir):
    r = study_returns(spark, sf_dir).filter("ret is not null").withColumn("yr", F.year(F.timestamp_millis("ts_ms")))
    scale = F.lit(PPY) / F.first("every")
    return r.groupBy("every", "frac", "yr").agg(
        F.count("*").alias("n"), (F.avg("ret") * scale).alias("ann_return"), (F.avg("ret") / F.stddev_samp("ret") * F.sqrt(scale)).alias("sharpe")
    ).filter("n >= 10")


@query("trial_dispersion", f"{STUDY}, {GS}, d AS (SELECT count(sharpe) AS n, avg(sharpe) AS mean, stddev_samp(sharpe) AS std, var_samp(sharpe) AS var, min(sharpe) AS min, quantile_cont(sharpe,0.25) AS p25, quantile_cont(sharpe,0.5) AS p50, quantile_cont(sharpe,0.75) AS p75, max(sharpe) AS max FROM g9) " + out("d", "n", "mean, std, var, min, p25, p50, p75, max"))
def trial_dispersion(spark, sf_dir):
    r = study_returns(spark, sf_dir).filter("ret is not null")
    g = r.groupBy("every", "frac").agg((F.avg("ret") / F.stddev_samp("ret") * F.sqrt(F.lit(PPY) / F.first("every"))).alias("sharpe"))
    return st.dispersion(g, "sharpe")


#: the positioning family and one signal of three others to hold it against
POSITIONING = [n for n, x in sg.SIGNALS.items() if x.family == "positioning"] + ["carry_level", "mom_slow", "ofi_mid"]
_PS = " UNION ALL ".join(f"SELECT '{n}' AS name, symbol, ti, round(value, 9) AS s, lead(close) OVER (PARTITION BY symbol ORDER BY ti)/close-1 AS r FROM ps{i}" for i, n in enumerate(POSITIONING))


@query(
    "position_study",
    f"""WITH {PREP}, {', '.join(signal_ctes(n, f'ps{i}') for i, n in enumerate(POSITIONING))}, ps AS ({_PS}), pq AS (SELECT *, count(*) OVER (PARTITION BY name, ti) AS n, row_number() OVER (PARTITION BY name, ti ORDER BY s, symbol) AS pos FROM ps WHERE s IS NOT NULL AND r IS NOT NULL),
 pr AS (SELECT *, greatest(1, CAST(round_even(n*0.1,0) AS INT)) AS k FROM pq WHERE n>=10), nr AS (SELECT name, ti, 0.5*(avg(r) FILTER (pos>n-k) - avg(r) FILTER (pos<=k)) AS ret FROM pr GROUP BY name, ti), {FOLDS}, {_FS} """
    + out("fs", "name", "fold_median, fold_min, share_positive, score"),
)
def position_study(spark, sf_dir):
    """Stability of the decile spread of every positioning signal, beside three known ones.

    Ratios of counts tie often: scores are rounded, so that ties break by symbol and not by the last bit.
    """
    wide = weekly(spark, sf_dir, POSITIONING).withColumns({n: F.round(n, 9) for n in POSITIONING})
    f = cb.factor_table(wide, POSITIONING)
    r = f.select(F.col("signal").alias("name"), "ti", F.col("spread").alias("ret"))
    return st.fold_summary(st.fold_sharpes(r, ["name"], 8, PPY), ["name"])


@query(
    "time_split",
    f"WITH {PREP}, sp AS (SELECT ts_ms AS cut FROM axis WHERE ti=CAST(floor(0.7::DOUBLE*(SELECT count(*) FROM axis)) AS INT)), r AS (SELECT symbol, ts_ms, CASE WHEN ts_ms<cut THEN 'train' ELSE 'holdout' END AS part FROM panel, sp) SELECT * FROM r",
)
def time_split(spark, sf_dir):
    p = tb.panel(spark, sf_dir)
    n = p.agg(F.max("ti") + 1).scalar()
    return p.select("symbol", "ts_ms", F.when(F.col("ti") < F.floor(n * 0.7), "train").otherwise("holdout").alias("part"))


# --- deflated Sharpe, overfitting ----------------------------------------------------------------


def _cdf(x: str) -> str:
    """Normal distribution function by Simpson's rule over 1 000 parts."""
    parts = f"list_sum(list_transform(range(0,1001), lambda t: (CASE WHEN t%1000=0 THEN 1 WHEN t%2=1 THEN 4 ELSE 2 END)*exp(-({x})*({x})*t*t/2e6)))"
    return f"(0.5+({x})/sqrt(2*pi())*{parts}/3000)"


_TRIALS = [30.0, 100.0, 200.0]
_EMAX = [(1 - st.EULER_GAMMA) * NormalDist().inv_cdf(1 - 1 / t) + st.EULER_GAMMA * NormalDist().inv_cdf(1 - 1 / (t * 2.718281828459045)) for t in _TRIALS]


@query(
    "deflated_sharpe",
    f"""{STUDY}, d0 AS (SELECT every, frac, ret, avg(ret) OVER (PARTITION BY every, frac) AS m FROM g5 WHERE ret IS NOT NULL),
 d1 AS (SELECT every, frac, count(*)::DOUBLE AS n, avg(ret)/stddev_samp(ret) AS sr, avg(pow(ret-m,3))/pow(avg(pow(ret-m,2)),1.5) AS skew, avg(pow(ret-m,4))/pow(avg(pow(ret-m,2)),2) AS kurt FROM d0 GROUP BY every, frac),
 d2 AS (SELECT *, unnest({_TRIALS}::DOUBLE[]) AS trials, unnest({_EMAX}::DOUBLE[])*sqrt(v) AS expected_max FROM (SELECT *, var_samp(sr) OVER () AS v, row_number() OVER (ORDER BY sr DESC, every, frac) AS rn FROM d1) WHERE rn=1),
 d3 AS (SELECT *, (sr-expected_max)*sqrt(n-1)/sqrt(greatest(1-skew*sr+(kurt-1)/4*sr*sr,1e-12)) AS zd, sr*sqrt(n-1)/sqrt(greatest(1-skew*sr+(kurt-1)/4*sr*sr,1e-12)) AS zp FROM d2),
 d4 AS (SELECT *, {_cdf('zd')} AS dsr, {_cdf('zp')} AS psr FROM d3) """ + out("(SELECT *, dsr>=0.95 AS approved FROM d4)", "every, approved", "frac, trials, n, sr, expected_max, psr, dsr"),
)
def deflated_sharpe(spark, sf_dir):
    """Best configuration of the study, discounted for 30/100/200 trials."""
    r = study_returns(spark, sf_dir).filter("ret is not null")
    n = F.count("*").cast("double")
    g = r.groupBy("every", "frac").agg(
        n.alias("n"), (F.avg("ret") / F.stddev_samp("ret")).alias("sr"), F.skewness("ret").alias("skew"), (F.kurtosis("ret") + 3.0).alias("kurt")
    )
    every = Window.partitionBy(F.lit(0))  # one row per configuration
    g = g.withColumn("var_sr", F.var_samp("sr").over(every))
    best = g.withColumn("_r", F.row_number().over(every.orderBy(F.desc("sr"), "every", "frac"))).filter("_r = 1").drop("_r")
    q = at.explode_grid(best, "trials", _TRIALS)
    z1, z2 = st.norm_ppf(1.0 - 1.0 / F.col("trials")), st.norm_ppf(1.0 - 1.0 / (F.col("trials") * 2.718281828459045))
    q = q.withColumn("expected_max", F.sqrt("var_sr") * ((1 - st.EULER_GAMMA) * z1 + st.EULER_GAMMA * z2))
    q = q.withColumn("dsr", st.psr(F.col("sr"), F.col("expected_max"), F.col("n"), F.col("skew"), F.col("kurt")))
    q = q.withColumn("psr", st.psr(F.col("sr"), F.lit(0.0), F.col("n"), F.col("skew"), F.col("kurt")))
    return q.select("every", "frac", "trials", "n", "sr", "expected_max", "psr", "dsr", (F.col("dsr") >= 0.95).alias("approved"))


@query(
    "path_risk_grid",
    f"""{two_ctes()}, {NAMED}, p0 AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ti)-1 AS i FROM nr WHERE ret IS NOT NULL), p1 AS (SELECT *, i//6 AS p, sum(ret) OVER (PARTITION BY name, i//6 ORDER BY i) AS c FROM p0),
 p2 AS (SELECT name, p, min(c) AS lo, max(c) AS hi, arg_min(c, i) AS c0, arg_max(c, i) AS c1 FROM p1 GROUP BY name, p HAVING count(*)=6), p3 AS (SELECT *, unnest({GRID}::DOUBLE[]) AS leverage FROM p2),
 p4 AS (SELECT *, 1+leverage*lo<=0.01*leverage AS ruin, CASE WHEN 1+leverage*lo<=0.01*leverage THEN greatest(1e-12,1+leverage*c0) ELSE 1+leverage*c1 END AS f FROM p3),
 p5 AS (SELECT *, coalesce(product(f) OVER (PARTITION BY name, leverage ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),1) AS e0 FROM p4),
 p6 AS (SELECT *, greatest(1.0,coalesce(max(CASE WHEN NOT ruin THEN e0*(1+leverage*hi) END) OVER (PARTITION BY name, leverage ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),1)) AS peak FROM p5),
 p7 AS (SELECT name, leverage, greatest(0,max(CASE WHEN ruin THEN 1 ELSE 1-e0*(1+leverage*lo)/peak END)) AS max_dd, avg(CASE WHEN ruin THEN 1.0 ELSE 0.0 END) AS ruin_share FROM p6 GROUP BY name, leverage) """ + out("p7", "name", "leverage, max_dd, ruin_share"),
)
def path_risk(spark, sf_dir):
    return at.path_risk(named_returns(spark, sf_dir), GRID, 6, keys=["name"])


@query(
    "executable_leverage",
    f"""WITH RECURSIVE {(two_ctes() + ', ' + NAMED)[5:]}, ev0 AS (SELECT *, CASE WHEN count(ret) OVER f>=20 THEN stddev_samp(ret) OVER f END AS v, row_number() OVER (PARTITION BY name ORDER BY ti) AS i FROM nr WHERE ret IS NOT NULL WINDOW f AS (PARTITION BY name ORDER BY ti ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
 ev1 AS (SELECT name, ti, i, ret, coalesce(0.3/nullif(lag(v) OVER (PARTITION BY name ORDER BY ti)*sqrt({PPY}),0),0.5) AS raw FROM ev0),
 rec AS (SELECT DISTINCT name, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS ti, [1.0::DOUBLE] AS es, 1::DOUBLE AS equity, 0::DOUBLE AS ret, 0::DOUBLE AS leverage FROM ev1
  UNION ALL SELECT name, i, ti, list_append(es, equity*(1+made))[-60:], equity*(1+made), made, lev FROM (SELECT *, greatest(lev*r,-0.999) AS made FROM (SELECT *, CASE WHEN w<0.5 THEN 0 ELSE least(w,3.0) END AS lev FROM
   (SELECT y.name, y.i, y.ti, rec.es, rec.equity, y.ret AS r, y.raw*(1-least(1,greatest(0,(1-rec.equity/list_max(rec.es)-0.1)/0.15))) AS w FROM rec JOIN ev1 y ON y.name=rec.name AND y.i=rec.i+1)))) """
    + out("(SELECT * FROM rec WHERE i>0)", "name, ti", "ret, leverage, equity"),
)
def executable_leverage(spark, sf_dir):
    return at.executable_leverage(named_returns(spark, sf_dir), 0.3, 60, PPY, 0.5, 3.0, 0.1, 0.25)
