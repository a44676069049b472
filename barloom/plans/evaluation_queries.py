"""Queries over signal evaluation on the weekly brand panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import frames as fr
from barloom.operators import evaluate as ev
from barloom.operators import signals as sg
from barloom.plans.registry import arank, out, query
from barloom.plans.signal_queries import PREP, signal_ctes
from barloom.sources import tables as tb

SIG = "mom_fast"
SEVERAL = ("mom_fast", "carry_level", "ofi_fast", "close_location")


def weekly(spark, sf_dir, names=(SIG,)):
    return sg.build_signals(tb.panel(spark, sf_dir), list(names), keep=("close",))


def monthly_ic_summary(spark, sf_dir):
    p = tb.panel(spark, sf_dir, "month")
    wide = sg.build_signals(p, [SIG], keep=("close",))
    ic = ev.information_coefficient(wide, SIG, (1,))
    return ev.series_summary(ic, "ic", ("horizon",)).select(
        "horizon", F.col("mean").alias("ic_mean"), F.col("std").alias("ic_std"),
        F.col("ir").alias("ic_ir"), "t_stat", "hit_rate", "n", "n_eff",
    )


# --- SQL pieces --------------------------------------------------------------------


def pair_ctes(src: str, configs: list[tuple], label: str, dst: str) -> str:
    """Rows (label, symbol, ti, ts_ms, a, b) where both are present."""
    u = " UNION ALL ".join(
        f"SELECT {k!r} AS {label}, symbol, ti, ts_ms, {a} AS a, {b} AS b FROM {src}" for k, a, b in configs
    )
    return f"{dst} AS (SELECT * FROM ({u}) WHERE a IS NOT NULL AND b IS NOT NULL)"


def corr_cte(src: str, keys: str, dst: str, spearman=True, least=8) -> str:
    a, b = (arank("a", keys), arank("b", keys)) if spearman else ("a", "b")
    return (
        f"{dst}_r AS (SELECT * EXCLUDE (a,b), {a} AS a, {b} AS b FROM {src}),"
        f"{dst} AS (SELECT {keys}, count(*) AS n_names, corr(a,b) AS ic FROM {dst}_r GROUP BY {keys}"
        f" HAVING count(*)>={least} AND stddev_samp(a)>1e-15 AND stddev_samp(b)>1e-15)"
    )


def fwd_cte(src: str, hs, dst: str, close="close") -> str:
    cols = ", ".join(f"lead({close},{h}) OVER (PARTITION BY symbol ORDER BY ti)/{close}-1 AS fwd_{h}" for h in hs)
    return f"{dst} AS (SELECT *, {cols} FROM {src})"


def summary_ctes(src: str, x: str, key: str, dst: str, order="ti") -> str:
    """Series statistics with the autocorrelation-adjusted sample size."""
    return f"""{dst}_d AS (SELECT {key} AS k0, {x} AS x, {x}-avg({x}) OVER (PARTITION BY {key}) AS d,
  row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS i, count(*) OVER (PARTITION BY {key}) AS n
  FROM {src} WHERE {x} IS NOT NULL),
{dst}_rho AS (SELECT p.k0, p.n, l.k, sum(p.d*q.d) AS c FROM {dst}_d p
  JOIN (SELECT unnest(range(1,50)) AS k) l ON l.k < least(50, p.n//4)
  JOIN {dst}_d q ON q.k0=p.k0 AND q.i=p.i-l.k GROUP BY 1,2,3),
{dst}_den AS (SELECT k0, sum(d*d) AS den, avg(x) AS mean, stddev_samp(x) AS std,
  avg(CASE WHEN x>1e-12 THEN 1.0 ELSE 0.0 END) AS hit_rate, count(*) AS n FROM {dst}_d GROUP BY k0),
{dst}_cut AS (SELECT r.*, r.c/d.den AS rho, min(CASE WHEN r.c/d.den<=0 THEN r.k END) OVER (PARTITION BY r.k0) AS cut
  FROM {dst}_rho r JOIN {dst}_den d USING (k0)),
{dst}_f AS (SELECT k0, 1+sum(2*rho*(1-k/n)) AS factor FROM {dst}_cut WHERE cut IS NULL OR k<cut GROUP BY k0),
{dst}_e AS (SELECT d.*, CASE WHEN d.n<10 THEN greatest(d.n,1) WHEN d.den<=1e-18 THEN d.n
   ELSE greatest(1.0, d.n/greatest(coalesce(f.factor,1.0),1.0)) END AS n_eff FROM {dst}_den d LEFT JOIN {dst}_f f USING (k0)),
{dst} AS (SELECT *, CASE WHEN std>1e-15 THEN mean/std ELSE 0 END AS ir,
   CASE WHEN std>1e-15 THEN mean/(std/sqrt(n_eff)) ELSE 0 END AS t_stat FROM {dst}_e)"""


BASE = f"WITH {PREP}, {signal_ctes(SIG, 'sig')}, sg AS (SELECT symbol, ti, ts_ms, close, value AS s FROM sig)"


def ic_ctes(hs=(6,), spearman=True) -> str:
    return ", ".join([
        BASE, fwd_cte("sg", hs, "fw"),
        pair_ctes("fw", [(h, "s", f"fwd_{h}") for h in hs], "horizon", "pr"),
        corr_cte("pr", "horizon, ti, ts_ms", "ic", spearman),
    ])


@query("information_coefficient", ic_ctes() + " " + out("ic", "horizon, ts_ms, n_names", "ic"))
def ic(spark, sf_dir):
    return ev.information_coefficient(weekly(spark, sf_dir), SIG).select("horizon", "ts_ms", "n_names", "ic")


@query("information_coefficient_pearson", ic_ctes(spearman=False) + " " + out("ic", "horizon, ts_ms, n_names", "ic"))
def ic_pearson(spark, sf_dir):
    return ev.information_coefficient(weekly(spark, sf_dir), SIG, method="pearson").select("horizon", "ts_ms", "n_names", "ic")


_SUM_VALS = "mean, std, ir, t_stat, hit_rate, n_eff"


@query("ic_summary", ic_ctes() + ", " + summary_ctes("ic", "ic", "horizon", "sm") + " " + out("(SELECT k0 AS horizon, * FROM sm)", "horizon, n", _SUM_VALS))
def ic_summary(spark, sf_dir):
    return ev.series_summary(ev.information_coefficient(weekly(spark, sf_dir), SIG), "ic", ("horizon",))


@query(
    "ic_decay_curve",
    ic_ctes(ev.HORIZONS) + ", " + summary_ctes("ic", "ic", "horizon", "sm") + " "
    + out("(SELECT k0 AS horizon, *, mean/sqrt(k0) AS ic_per_sqrt_period FROM sm)", "horizon, n", _SUM_VALS + ", ic_per_sqrt_period"),
)
def decay(spark, sf_dir):
    return ev.ic_decay(weekly(spark, sf_dir), SIG)


@query(
    "ic_by_period",
    ic_ctes() + " " + out(
        "(SELECT epoch_ms(date_trunc('year', make_timestamp_ms(ts_ms))) AS period_ms, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std,"
        " count(*) AS n, avg(CASE WHEN ic>1e-12 THEN 1.0 ELSE 0.0 END) AS hit_rate FROM ic GROUP BY 1)",
        "period_ms, n", "ic_mean, ic_std, hit_rate"),
)
def by_period(spark, sf_dir):
    return ev.ic_by_period(weekly(spark, sf_dir), SIG)


def auto_ctes(lags) -> str:
    cols = ", ".join(f"lag(s,{k}) OVER (PARTITION BY symbol ORDER BY ti) AS l_{k}" for k in lags)
    return ", ".join([
        BASE, f"lg AS (SELECT *, {cols} FROM sg)",
        pair_ctes("lg", [(k, "s", f"l_{k}") for k in lags], "lag", "pr"),
        corr_cte("pr", "lag, ti", "ac"),
        "au AS (SELECT lag, avg(ic) AS autocorr FROM ac GROUP BY lag)",
    ])


@query("signal_autocorrelation", auto_ctes(ev.LAGS) + " " + out("au", "lag", "autocorr"))
def autocorr(spark, sf_dir):
    return ev.signal_autocorrelation(weekly(spark, sf_dir), SIG)


@query(
    "effective_breadth",
    auto_ctes((6,)) + """, nm AS (SELECT CAST(floor(quantile_cont(n,0.5)) AS DOUBLE) AS n_names FROM (SELECT ti, count(s) AS n FROM sg GROUP BY ti)),
 r AS (SELECT least(greatest(coalesce((SELECT autocorr FROM au),0),0),0.999) AS rho)
 """ + out("(SELECT n_names, 52.0/6 AS rebalances_per_year, n_names*52.0/6 AS raw_breadth, rho AS signal_autocorr, 1-rho AS independence_factor, n_names*52.0/6*(1-rho) AS effective_breadth, 0.6*0.03*sqrt(n_names*52.0/6*(1-rho)) AS implied_sharpe FROM nm, r)",
           "", "n_names, rebalances_per_year, raw_breadth, signal_autocorr, independence_factor, effective_breadth, implied_sharpe"),
)
def breadth(spark, sf_dir):
    b = ev.effective_breadth(weekly(spark, sf_dir), SIG, 6, 52.0)
    return b.withColumn("implied_sharpe", ev.implied_sharpe(F.lit(0.03), F.col("effective_breadth")))


def several_ctes(close_h=6) -> str:
    parts = [signal_ctes(n, f"v{i}") for i, n in enumerate(SEVERAL)]
    u = " UNION ALL ".join(
        f"SELECT '{n}' AS signal, symbol, ti, ts_ms, value AS a, lead(close,{close_h}) OVER (PARTITION BY symbol ORDER BY ti)/close-1 AS b FROM v{i}"
        for i, n in enumerate(SEVERAL)
    )
    return f"WITH {PREP}, {','.join(parts)}, u0 AS ({u}), pr AS (SELECT * FROM u0 WHERE a IS NOT NULL AND b IS NOT NULL), " + corr_cte("pr", "signal, ti", "ic")


@query(
    "ic_correlation_matrix",
    several_ctes() + " " + out("(SELECT x.signal AS signal_a, y.signal AS signal_b, corr(x.ic,y.ic) AS corr FROM ic x JOIN ic y USING (ti) GROUP BY ALL)", "signal_a, signal_b", "corr"),
)
def ic_corr(spark, sf_dir):
    return ev.ic_correlation(weekly(spark, sf_dir, SEVERAL), SEVERAL)


def xs_ctes(h=1, least=10) -> str:
    return ", ".join([
        BASE, fwd_cte("sg", (h,), "fw"),
        f"x0 AS (SELECT symbol, ti, ts_ms, s, fwd_{h} AS r, count(*) OVER (PARTITION BY ti) AS n FROM fw WHERE s IS NOT NULL AND fwd_{h} IS NOT NULL)",
        f"x1 AS (SELECT *, row_number() OVER (PARTITION BY ti ORDER BY s, symbol) AS pos, r-avg(r) OVER (PARTITION BY ti) AS rel,"
        f" greatest(1, CAST(round_even(n*0.1,0) AS INT)) AS k FROM x0 WHERE n>={least})",
    ])


_Q = """q0 AS (SELECT ti, CAST(greatest(ceil((pos-1)*5/(n-1)),1) AS BIGINT) AS bucket, avg(rel) AS m FROM x1 GROUP BY 1,2),
q AS (SELECT bucket, avg(m) AS mean_rel_return, stddev_samp(m) AS std, count(m) AS n, avg(m)/(stddev_samp(m)/sqrt(count(m))) AS t_stat FROM q0 GROUP BY bucket)"""


@query("quantile_returns", xs_ctes() + ", " + _Q + " " + out("q", "bucket, n", "mean_rel_return, std, t_stat"))
def quantiles(spark, sf_dir):
    return ev.quantile_returns(weekly(spark, sf_dir), SIG)


@query("monotonicity", xs_ctes() + ", " + _Q + " " + out("(SELECT corr(bucket, rk) AS monotonicity FROM (SELECT bucket, rank() OVER (ORDER BY mean_rel_return) AS rk FROM q))", "", "monotonicity"))
def mono(spark, sf_dir):
    return ev.monotonicity(ev.quantile_returns(weekly(spark, sf_dir), SIG))


_SPREAD = "sp AS (SELECT ti, ts_ms, 0.5*(avg(r) FILTER (pos>n-k) - avg(r) FILTER (pos<=k)) AS spread, 1 AS one FROM x1 GROUP BY ti, ts_ms)"


@query("factor_returns", xs_ctes() + ", " + _SPREAD + " " + out("sp", "ts_ms", "spread"))
def factor(spark, sf_dir):
    return ev.factor_returns(weekly(spark, sf_dir), SIG).select("ts_ms", "spread")


@query("decile_spread", xs_ctes() + ", " + _SPREAD + ", " + summary_ctes("sp", "spread", "one", "sm") + " " + out("(SELECT *, ir AS sharpe_per_period FROM sm)", "n", "mean, std, t_stat, sharpe_per_period, hit_rate"))
def spread(spark, sf_dir):
    return ev.decile_spread(weekly(spark, sf_dir), SIG)


@query(
    "ic_weighted_combination",
    several_ctes() + """, w0 AS (SELECT signal, greatest(avg(ic),0) AS p FROM ic GROUP BY signal),
 w AS (SELECT signal, p/nullif(sum(p) OVER (),0) AS weight FROM w0),
 cb AS (SELECT ts_ms, symbol, CASE WHEN count(a)>0 THEN sum(coalesce(a,0)*coalesce(weight,0)) END AS value FROM u0 JOIN w USING (signal) GROUP BY 1,2) """
    + out("cb", "ts_ms, symbol", "value"),
)
def ic_weighted(spark, sf_dir):
    wide = weekly(spark, sf_dir, SEVERAL)
    return ev.ic_weighted_combination(wide, SEVERAL).select("ts_ms", "symbol", F.col("combined").alias("value"))


_MONTH = PREP.replace("ts_ms//604800000*604800000", "epoch_ms(date_trunc('month', make_timestamp_ms(ts_ms)))")


@query(
    "minimum_slice_monthly_ic",
    ", ".join([
        f"WITH {_MONTH}, {signal_ctes(SIG, 'sig')}, sg AS (SELECT symbol, ti, ts_ms, close, value AS s FROM sig)",
        fwd_cte("sg", (1,), "fw"), pair_ctes("fw", [(1, "s", "fwd_1")], "horizon", "pr"),
        corr_cte("pr", "horizon, ti, ts_ms", "ic"), summary_ctes("ic", "ic", "horizon", "sm"),
    ]) + " " + out("(SELECT k0 AS horizon, n, mean AS ic_mean, std AS ic_std, ir AS ic_ir, t_stat, hit_rate, n_eff FROM sm)", "horizon, n", "ic_mean, ic_std, ic_ir, t_stat, hit_rate, n_eff"),
)
def minimum_slice(spark, sf_dir):
    return monthly_ic_summary(spark, sf_dir)
