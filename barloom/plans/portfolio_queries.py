"""Queries over combination, portfolio construction and covariance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import frames as fr
from barloom.operators import combine as cb
from barloom.operators import portfolio as pf
from barloom.operators import signals as sg
from barloom.operators.ordered import asof_grid
from barloom.plans.evaluation_queries import BASE, SIG, weekly
from barloom.plans.registry import L, W, guarded, out, query, rstd, sdiv, xz
from barloom.plans.signal_queries import PREP, signal_ctes
from barloom.sources import tables as tb

TWO = ("mom_fast", "ofi_fast")
ADAPTIVE = cb.AdaptiveSpec(lookback=120, min_periods=40)


# --- selection and weights -----------------------------------------------------------

RANK_W = """rw0 AS (SELECT *, count(s) OVER (PARTITION BY ti) AS n, row_number() OVER (PARTITION BY ti ORDER BY s ASC NULLS LAST, symbol) AS pos FROM {src}),
rw1 AS (SELECT *, greatest(1, CAST(round_even(n*{frac},0) AS INT)) AS k FROM rw0),
rw AS (SELECT * EXCLUDE (n,pos,k), CASE WHEN s IS NOT NULL AND n>=4 AND pos<=k THEN -0.5/k WHEN s IS NOT NULL AND n>=4 AND pos>n-k THEN 0.5/k ELSE 0.0 END AS w FROM rw1)"""


@query("rank_to_weights", f"{BASE}, {RANK_W.format(src='sg', frac=0.25)} " + out("rw", "ts_ms, symbol", "w"))
def rank_to_weights(spark, sf_dir):
    return pf.rank_weights(weekly(spark, sf_dir), SIG).select("ts_ms", "symbol", "w")


SEL = """se0 AS (SELECT *, count(s) OVER (PARTITION BY ti) AS n, row_number() OVER (PARTITION BY ti ORDER BY s ASC NULLS LAST, symbol) AS pos FROM {src}),
se1 AS (SELECT *, greatest(1, CAST(round_even(n*0.1,0) AS INT)) AS k FROM se0),
se AS (SELECT * EXCLUDE (n,pos,k), CASE WHEN s IS NOT NULL AND n>=4 AND pos>n-k THEN 1.0 WHEN s IS NOT NULL AND n>=4 AND pos<=k THEN -1.0 ELSE 0.0 END AS sel FROM se1)"""


@query("selection_mask", f"{BASE}, {SEL.format(src='sg')} " + out("se", "ts_ms, symbol", "sel"))
def selection_mask(spark, sf_dir):
    return pf.selection(weekly(spark, sf_dir), SIG, pf.PortfolioSpec()).select("ts_ms", "symbol", "sel")


@query("rank_to_weights_buffered")
def buffered_v1(spark, sf_dir):
    return pf.buffered_weights(weekly(spark, sf_dir), SIG).select("ts_ms", "symbol", "w")


@query("apply_buffer")
def buffered_v2(spark, sf_dir):
    p = weekly(spark, sf_dir)
    held = pf.buffered_selection(p, SIG, 0.1, 0.25, rule="v2")
    return p.select("ti", "ts_ms", "symbol").join(held, ["ti", "symbol"]).select("ts_ms", "symbol", "side")


RISK = f"""rk0 AS (SELECT *, {rstd('lr', 60, 20)} AS v_, {sdiv(
    f"CASE WHEN count(CASE WHEN mkt IS NOT NULL THEN r1 END) {W(120)}>=40 THEN covar_samp(r1,mkt) {W(120)} END",
    f"CASE WHEN count(mkt) {W(120)}>=40 THEN var_samp(CAST(mkt AS DOUBLE)) {W(120)} END")} AS b_ FROM prep),
rk AS (SELECT symbol, ti, ts_ms, {L('v_', 1)} AS vol, {L('b_', 1)} AS beta FROM rk0)"""


@query("realized_vol", f"WITH {PREP}, {RISK} " + out("rk", "ts_ms, symbol", "vol"))
def realized_vol(spark, sf_dir):
    return pf.with_risk(tb.panel(spark, sf_dir), pf.PortfolioSpec()).select("ts_ms", "symbol", "vol")


@query("rolling_beta", f"WITH {PREP}, {RISK} " + out("rk", "ts_ms, symbol", "beta"))
def rolling_beta(spark, sf_dir):
    return pf.with_risk(tb.panel(spark, sf_dir), pf.PortfolioSpec()).select("ts_ms", "symbol", "beta")


def risky(spark, sf_dir, names=(SIG,)):
    """Scored weekly panel with lagged vol and beta."""
    p = pf.with_risk(tb.panel(spark, sf_dir), pf.PortfolioSpec())
    return sg.build_signals(p, list(names), keep=("close", "vol", "beta", "r1", "funding"))


_SR = f"{BASE}, {RISK}, sv AS (SELECT sg.*, rk.vol, rk.beta FROM sg JOIN rk USING (symbol, ti)), {SEL.format(src='sv')}"
_IV = """iv0 AS (SELECT *, quantile_cont(vol,0.1) OVER (PARTITION BY ti) AS p10, quantile_cont(vol,0.5) OVER (PARTITION BY ti) AS p50 FROM se),
iv1 AS (SELECT *, CASE WHEN p10>0 THEN p10 WHEN p50>0 THEN p50 END AS floor_ FROM iv0),
iv AS (SELECT *, sel/nullif(CASE WHEN vol>floor_ THEN vol ELSE floor_ END,0) AS w0 FROM iv1),
dn0 AS (SELECT *, coalesce(w0,0) AS w FROM iv),
dn1 AS (SELECT *, sum(CASE WHEN w>0 THEN w ELSE 0 END) OVER (PARTITION BY ti) AS up, sum(CASE WHEN w<0 THEN -w ELSE 0 END) OVER (PARTITION BY ti) AS dn FROM dn0),
dn AS (SELECT * EXCLUDE (w), CASE WHEN up>1e-12 AND dn>1e-12 THEN CASE WHEN w>0 THEN w/up*0.5 WHEN w<0 THEN w/dn*0.5 ELSE 0 END ELSE 0 END AS w FROM dn1)"""


def _inverse(spark, sf_dir):
    p = pf.selection(risky(spark, sf_dir), SIG, pf.PortfolioSpec())
    p = p.withColumn("_f", pf.vol_floor(0.10))
    return p.withColumn("w", pf.inverse_vol(F.col("sel"), F.col("vol"), F.col("_f")))


@query("inverse_vol_weights", f"{_SR}, {_IV} " + out("iv", "ts_ms, symbol", "w0").replace("w0", "w0"))
def inverse_vol_weights(spark, sf_dir):
    return _inverse(spark, sf_dir).select("ts_ms", "symbol", F.col("w").alias("w0"))


def _neutral(spark, sf_dir):
    p = _inverse(spark, sf_dir).withColumn("w", F.coalesce("w", F.lit(0.0)))
    return p.withColumn("w", pf.dollar_neutralize("w"))


@query("dollar_neutralize", f"{_SR}, {_IV} " + out("dn", "ts_ms, symbol", "w"))
def dollar_neutralize(spark, sf_dir):
    return _neutral(spark, sf_dir).select("ts_ms", "symbol", "w")


@query(
    "beta_neutralize",
    f"""{_SR}, {_IV}, bn0 AS (SELECT *, w<>0 AND beta IS NOT NULL AS act FROM dn),
 bn1 AS (SELECT *, count(*) FILTER (act) OVER (PARTITION BY ti) AS m, sum(beta*beta) FILTER (act) OVER (PARTITION BY ti) AS bb, sum(w*beta) FILTER (act) OVER (PARTITION BY ti) AS wb FROM bn0),
 bn AS (SELECT ts_ms, symbol, CASE WHEN act AND m>=2 AND bb>1e-12 THEN w-wb/nullif(bb,0)*beta ELSE w END AS w FROM bn1) """ + out("bn", "ts_ms, symbol", "w"),
)
def beta_neutralize(spark, sf_dir):
    p = _neutral(spark, sf_dir)
    return p.withColumn("w", pf.beta_neutralize("w", "beta")).select("ts_ms", "symbol", "w")


@query(
    "project_neutral",
    f"""{_SR}, {_IV}, pn0 AS (SELECT ts_ms, ti, symbol, w, w<>0 AS act, CASE WHEN w<>0 THEN beta END AS kb, beta FROM dn),
 pn1 AS (SELECT *, coalesce(beta, quantile_cont(kb,0.5) OVER (PARTITION BY ti), 1.0) AS b FROM pn0),
 pn2 AS (SELECT *, count(*) FILTER (act) OVER p AS n, sum(w) FILTER (act) OVER p AS sx, sum(b) FILTER (act) OVER p AS sb, sum(b*b) FILTER (act) OVER p AS sbb, sum(w*b) FILTER (act) OVER p AS sxb FROM pn1 WINDOW p AS (PARTITION BY ti)),
 pn AS (SELECT ts_ms, symbol, CASE WHEN act AND n>=3 THEN CASE WHEN abs(n*sbb-sb*sb)>1e-12*n*sbb
   THEN w-(sbb*sx-sb*sxb)/nullif(n*sbb-sb*sb,0)-(n*sxb-sb*sx)/nullif(n*sbb-sb*sb,0)*b ELSE w-sx/n END ELSE 0.0 END AS w FROM pn2) """ + out("pn", "ts_ms, symbol", "w"),
)
def project_neutral(spark, sf_dir):
    p = _neutral(spark, sf_dir)
    return p.withColumns(pf.project_neutral("w", "beta")).select("ts_ms", "symbol", "w")


_P = "OVER (PARTITION BY ti)"


def cap_ctes(src: str, dst: str, rounds: int = 8) -> str:
    """Gross 1 with a cap of 0.2, the overflow spread over the rest, unrolled."""
    parts = [f"{dst}_b0 AS (SELECT ti, symbol, CASE WHEN sum(abs(w)) {_P}<=1e-12 THEN 0 ELSE w/sum(abs(w)) {_P} END AS w, false AS fin FROM {src})"]
    for r in range(rounds):
        parts.append(
            f"{dst}_a{r} AS (SELECT *, abs(w)>0.2+1e-12 AS o, count(*) FILTER (abs(w)>0.2+1e-12) {_P} AS m, sum(CASE WHEN abs(w)>0.2+1e-12 THEN 0 ELSE abs(w) END) {_P} AS rest FROM {dst}_b{r}),"
            f"{dst}_b{r + 1} AS (SELECT ti, symbol, CASE WHEN fin OR m=0 THEN w WHEN o THEN sign(w)*0.2 WHEN rest<=1e-12 OR 1-0.2*m<=0 THEN w ELSE w/rest*(1-0.2*m) END AS w,"
            f" fin OR m=0 OR rest<=1e-12 OR 1-0.2*m<=0 AS fin FROM {dst}_a{r})"
        )
    return ",".join(parts) + f",{dst} AS (SELECT ti, symbol, w FROM {dst}_b{rounds})"


def finish_ctes(src: str, dst: str) -> str:
    """Three rounds of cap and projection, then gross 1."""
    parts, cur = [], src
    for r in range(3):
        parts.append(cap_ctes(cur, f"{dst}_c{r}"))
        parts.append(f"{dst}_p{r} AS (SELECT ti, symbol, CASE WHEN w<>0 AND count(*) FILTER (w<>0) {_P}>=3 THEN w-sum(w) {_P}/count(*) FILTER (w<>0) {_P} ELSE 0 END AS w FROM {dst}_c{r})")
        cur = f"{dst}_p{r}"
    parts.append(f"{dst} AS (SELECT ti, symbol, w/greatest(sum(abs(w)) {_P},1e-12) AS w FROM {cur})")
    return ",".join(parts)


@query("cap_and_scale", f"{_SR}, {_IV}, {cap_ctes('dn', 'cs')} " + out("cs", "ti, symbol", "w"))
def cap_and_scale(spark, sf_dir):
    p = _neutral(spark, sf_dir)
    return pf.cap_and_scale(p, "w").select("ti", "symbol", "w")


# side-neutral sized weights of eight positions; {size} is the size of a chosen name
RAW_W = f"""{BASE}, {RISK}, sv AS (SELECT sg.*, rk.vol, rk.beta FROM sg JOIN rk USING (symbol, ti)),
ra AS (SELECT *, count(s) {_P} AS n, row_number() OVER (PARTITION BY ti ORDER BY s ASC NULLS LAST, symbol) AS pos, avg(s) {_P} AS mu, stddev_samp(s) {_P} AS sd, quantile_cont(vol,0.1) {_P} AS p10, quantile_cont(vol,0.5) {_P} AS p50 FROM sv),
rb AS (SELECT *, greatest(1,least(4,n//2)) AS k, CASE WHEN p10>0 THEN p10 WHEN p50>0 THEN p50 END AS fl FROM ra),
rc AS (SELECT *, CASE WHEN s IS NOT NULL AND n>=4 AND pos>n-k THEN 1.0 WHEN s IS NOT NULL AND n>=4 AND pos<=k THEN -1.0 ELSE 0.0 END AS sel FROM rb),
rd AS (SELECT *, count(*) FILTER (sel<>0) {_P} AS m FROM rc),
re AS (SELECT ti, symbol, coalesce(CASE WHEN sel<>0 AND fl IS NOT NULL AND m>=6 THEN {{size}} END,0) AS w FROM rd),
rf AS (SELECT *, sum(CASE WHEN w>0 THEN w ELSE 0 END) {_P} AS up, sum(CASE WHEN w<0 THEN -w ELSE 0 END) {_P} AS dn FROM re),
rg AS (SELECT ti, symbol, CASE WHEN up>1e-12 AND dn>1e-12 THEN CASE WHEN w>0 THEN w/up*0.5 WHEN w<0 THEN w/dn*0.5 ELSE 0 END ELSE 0 END AS w FROM rf)"""
_ZSIZE = "CASE WHEN sd>1e-12 THEN least(2.5,abs((s-mu)/sd))*sel/CASE WHEN vol>fl THEN vol ELSE fl END END"


def weights_sql(size: str) -> str:
    return f"{RAW_W.format(size=size)}, {finish_ctes('rg', 'fw')} " + out("fw", "ti, symbol", "w")


def _built(name, spec, sql=None):
    @query(name, sql)
    def run(spark, sf_dir):
        return pf.build_weights(risky(spark, sf_dir), SIG, spec, risk=False)


_built("build_weights_zscore_riskparity", pf.PortfolioSpec(n_positions=8), weights_sql(_ZSIZE))
_built("build_weights_rank_binary", pf.PortfolioSpec(mode="rank_binary", n_positions=8), weights_sql("sel"))
_built("build_weights_beta_neutral", pf.PortfolioSpec(beta_neutral=True, n_positions=12))
_built("build_weights_buffered", pf.PortfolioSpec(exit_frac=0.2, n_positions=8))
_built("build_weights_mvo", pf.PortfolioSpec(mode="mvo", n_positions=8, cov_window=120))


@query("strategy_target_weights")
def strategy_targets(spark, sf_dir):
    """Signals on the full grid, sampled every 6th step; risk from the sampled closes; combined, then weighted."""
    wide = sg.build_signals(tb.panel(spark, sf_dir), list(TWO), keep=("close",))
    marks = pf.with_risk(pf.sample_marks(wide, 6), pf.PortfolioSpec())
    scored = cb.combine_adaptive(marks, TWO, cb.AdaptiveSpec(lookback=40, min_periods=20))
    return pf.build_weights(scored, "combined", pf.PortfolioSpec(n_positions=8), risk=False)


@query("ensemble_weights")
def ensemble(spark, sf_dir):
    """Two members on their own grids, carried onto the common grid and mixed."""
    p = risky(spark, sf_dir, TWO)
    grid = p.select("symbol", "ti")
    parts = []
    for sig, every, share in ((TWO[0], 2, 0.6), (TWO[1], 4, 0.4)):
        marks = pf.sample_marks(p.select("symbol", "ti", "ts_ms", "close", sig), every)
        w = pf.build_weights(pf.with_risk(marks, pf.PortfolioSpec()), sig, pf.PortfolioSpec(n_positions=8), risk=False)
        w = w.withColumn("ti", F.col("ti") * every)
        parts.append(asof_grid(grid, w, ("symbol",), "ti", "w").fillna(0.0, ["w"]).withColumn("share", F.lit(share)))
    return pf.ensemble(parts[0].unionByName(parts[1]), p, max_positions=10)


@query(
    "align_to_grid",
    f"""{BASE}, {RANK_W.format(src='(SELECT * FROM sg WHERE ti%4=0)', frac=0.25)},
 g AS (SELECT sg.symbol, sg.ti, sg.ts_ms, rw.w AS w0 FROM sg LEFT JOIN rw USING (symbol, ti)),
 f AS (SELECT ts_ms, symbol, last_value(w0 IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ti) AS w FROM g) """ + out("f", "ts_ms, symbol", "w"),
)
def align_to_grid(spark, sf_dir):
    p = weekly(spark, sf_dir)
    w = pf.rank_weights(p.filter("ti % 4 = 0"), SIG)
    return asof_grid(p, w, ("symbol",), "ti", "w").join(p.select("symbol", "ti", "ts_ms"), ["symbol", "ti"]).select("ts_ms", "symbol", "w")


# --- combination ----------------------------------------------------------------------


def two_ctes() -> str:
    parts = [signal_ctes(n, f"v{i}") for i, n in enumerate(TWO)]
    return (
        f"WITH {PREP}, {','.join(parts)}, two AS (SELECT v0.symbol, v0.ti, v0.ts_ms, v0.close, v0.funding, v0.value AS s0, v1.value AS s1,"
        " lead(v0.close) OVER (PARTITION BY v0.symbol ORDER BY v0.ti)/v0.close-1 AS fwd FROM v0 JOIN v1 USING (symbol, ti))"
    )


def _fac(i):
    return f"""fa{i} AS (SELECT ti, symbol, s{i} AS s, fwd AS r, count(*) OVER (PARTITION BY ti) AS n, row_number() OVER (PARTITION BY ti ORDER BY s{i}, symbol) AS pos FROM two WHERE s{i} IS NOT NULL AND fwd IS NOT NULL),
fb{i} AS (SELECT ti, 0.5*(avg(r) FILTER (pos>n-greatest(1,CAST(round_even(n*0.1,0) AS INT))) - avg(r) FILTER (pos<=greatest(1,CAST(round_even(n*0.1,0) AS INT)))) AS f{i} FROM fa{i} WHERE n>=10 GROUP BY ti)"""


def _ev(i):
    b = "OVER (ORDER BY ti ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING)"
    return f"""count(f{i}) {b} AS n{i}, avg(f{i}) {b} AS m{i}, stddev_samp(f{i}) {b} AS d{i}"""


def _score(i):
    t = f"(m{i}/(d{i}/sqrt(n{i})))"
    return f"CASE WHEN n{i}>=20 AND d{i}>1e-15 AND abs({t})>1 THEN sign({t})*abs(m{i}/d{i})*((abs({t})-1)/abs({t})) ELSE 0.0 END AS e{i}"


EVIDENCE = f"{_fac(0)}, {_fac(1)}, fx AS (SELECT ti, f0, f1 FROM fb0 FULL JOIN fb1 USING (ti)), fy AS (SELECT ti, row_number() OVER (ORDER BY ti)-1 AS i, {_ev(0)}, {_ev(1)} FROM fx), fz AS (SELECT ti, i, {_score(0)}, {_score(1)} FROM fy)"


@query("adaptive_evidence", f"{two_ctes()}, {EVIDENCE} " + out("fz", "ti, i", "e0, e1"))
def adaptive_evidence(spark, sf_dir):
    fac = cb.factor_table(weekly(spark, sf_dir, TWO), TWO)
    e = cb.evidence(fac, TWO, ADAPTIVE)
    return e.select("ti", "i", F.col(f"e_{TWO[0]}").alias("e0"), F.col(f"e_{TWO[1]}").alias("e1"))


# the step-limited recursion written as a recursive query over the evidence rows
_STEP = """tg0 AS (SELECT *, abs(e0)+abs(e1) AS tot FROM fz),
tg1 AS (SELECT i, ti, CASE WHEN least(i,120)<40 OR tot<=1e-12 THEN 0.5 ELSE e0/nullif(tot,0) END AS a0, CASE WHEN least(i,120)<40 OR tot<=1e-12 THEN 0.5 ELSE e1/nullif(tot,0) END AS a1, least(i,120)>=40 AND tot>1e-12 AS live FROM tg0),
tg2 AS (SELECT *, CASE WHEN live THEN greatest(-0.45,least(0.45,a0)) ELSE a0 END AS c0, CASE WHEN live THEN greatest(-0.45,least(0.45,a1)) ELSE a1 END AS c1, live AND (abs(a0)>0.45 OR abs(a1)>0.45) AS capped FROM tg1),
tg AS (SELECT i, ti, CASE WHEN capped THEN c0/(abs(c0)+abs(c1)) ELSE a0 END AS t0, CASE WHEN capped THEN c1/(abs(c0)+abs(c1)) ELSE a1 END AS t1 FROM tg2),
rec AS (SELECT CAST(-1 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS w0, CAST(0 AS DOUBLE) AS w1
 UNION ALL SELECT i, CASE WHEN abs(x0)+abs(x1)>1e-12 THEN x0*((abs(t0)+abs(t1))/(abs(x0)+abs(x1))) ELSE x0 END,
   CASE WHEN abs(x0)+abs(x1)>1e-12 THEN x1*((abs(t0)+abs(t1))/(abs(x0)+abs(x1))) ELSE x1 END
 FROM (SELECT tg.i, tg.t0, tg.t1, w0+greatest(-0.1,least(0.1,t0-w0)) AS x0, w1+greatest(-0.1,least(0.1,t1-w1)) AS x1 FROM rec JOIN tg ON tg.i=rec.i+1)),
aw AS (SELECT tg.ti, rec.w0, rec.w1 FROM rec JOIN tg USING (i))"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("adaptive_weights", recursive(f"{two_ctes()}, {EVIDENCE}, {_STEP} " + out("aw", "ti", "w0, w1")))
def adaptive_weights(spark, sf_dir):
    fac = cb.factor_table(weekly(spark, sf_dir, TWO), TWO)
    w = cb.adaptive_weights(fac, TWO, ADAPTIVE)
    return w.select("ti", F.col(f"w_{TWO[0]}").alias("w0"), F.col(f"w_{TWO[1]}").alias("w1"))


@query(
    "combine_adaptive",
    recursive(f"""{two_ctes()}, {EVIDENCE}, {_STEP},
 ax AS (SELECT ti, coalesce(last_value(w0 IGNORE NULLS) OVER (ORDER BY ti),0) AS w0, coalesce(last_value(w1 IGNORE NULLS) OVER (ORDER BY ti),0) AS w1 FROM axis LEFT JOIN aw USING (ti)),
 cx AS (SELECT two.ts_ms, two.ti, two.symbol, CASE WHEN (CASE WHEN s0 IS NOT NULL THEN abs(w0) ELSE 0 END)+(CASE WHEN s1 IS NOT NULL THEN abs(w1) ELSE 0 END)>1e-9 THEN coalesce(s0*w0,0)+coalesce(s1*w1,0) END AS c FROM two JOIN ax USING (ti)),
 cy AS (SELECT ts_ms, symbol, {xz('c')} AS value FROM cx) """ + out("cy", "ts_ms, symbol", "value")),
)
def combine_adaptive(spark, sf_dir):
    q = cb.combine_adaptive(weekly(spark, sf_dir, TWO), TWO, ADAPTIVE)
    return q.select("ts_ms", "symbol", F.col("combined").alias("value"))


REG = cb.RegressionSpec(beta_window=60, min_periods=20)
# two regressors: the normal equations solved in closed form
BETAS = """rg0 AS (SELECT ti, symbol, s0, s1, fwd, count(*) OVER (PARTITION BY ti) AS n FROM two WHERE s0 IS NOT NULL AND s1 IS NOT NULL AND fwd IS NOT NULL),
rg1 AS (SELECT ti, n, (s0-avg(s0) OVER p)/(CASE WHEN stddev_pop(s0) OVER p<1e-12 THEN 1 ELSE stddev_pop(s0) OVER p END) AS x0, (s1-avg(s1) OVER p)/(CASE WHEN stddev_pop(s1) OVER p<1e-12 THEN 1 ELSE stddev_pop(s1) OVER p END) AS x1,
  greatest(quantile_cont(fwd,0.02) OVER p, least(quantile_cont(fwd,0.98) OVER p, fwd)) AS y0 FROM rg0 WHERE n>=15 WINDOW p AS (PARTITION BY ti)),
rg2 AS (SELECT *, y0-avg(y0) OVER (PARTITION BY ti) AS y FROM rg1),
rg3 AS (SELECT ti, sum(x0*x0)+{pen} AS a, sum(x0*x1) AS b, sum(x1*x1)+{pen} AS d, sum(x0*y) AS u, sum(x1*y) AS v FROM rg2 GROUP BY ti),
bt AS (SELECT ti, (d*u-b*v)/(a*d-b*b) AS b0, (a*v-b*u)/(a*d-b*b) AS b1 FROM rg3)"""


def _betas(name, spec, pen):
    @query(name, f"{two_ctes()}, {BETAS.replace('{pen}', pen)} " + out("bt", "ti", "b0, b1"))
    def run(spark, sf_dir):
        b = cb.cross_sectional_betas(weekly(spark, sf_dir, TWO), TWO, spec)
        return b.select("ti", F.col(f"b_{TWO[0]}").alias("b0"), F.col(f"b_{TWO[1]}").alias("b1"))


_betas("cross_sectional_betas_ols", REG, "0")
_betas("cross_sectional_betas_ridge", cb.RegressionSpec(method="ridge", alpha=0.1), "0.1*count(*)")


@query("cross_sectional_betas_elastic_net")
def betas_enet(spark, sf_dir):
    return cb.cross_sectional_betas(weekly(spark, sf_dir, TWO), TWO, cb.RegressionSpec(method="elastic_net"))


@query(
    "combine_xs_regression",
    f"""{two_ctes()}, {BETAS.replace('{pen}', '0')},
 l AS (SELECT ti, lag(b0) OVER (ORDER BY ti) AS b0, lag(b1) OVER (ORDER BY ti) AS b1 FROM bt),
 m AS (SELECT ti, CASE WHEN count(b0) OVER f>=20 THEN avg(b0) OVER f END AS b0, CASE WHEN count(b1) OVER f>=20 THEN avg(b1) OVER f END AS b1 FROM l WINDOW f AS (ORDER BY ti ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
 ax AS (SELECT ti, last_value(b0 IGNORE NULLS) OVER (ORDER BY ti) AS b0, last_value(b1 IGNORE NULLS) OVER (ORDER BY ti) AS b1 FROM axis LEFT JOIN m USING (ti)),
 cx AS (SELECT two.ts_ms, two.ti, two.symbol, CASE WHEN (s0 IS NOT NULL OR s1 IS NOT NULL) AND (b0 IS NOT NULL OR b1 IS NOT NULL) THEN coalesce(s0*b0,0)+coalesce(s1*b1,0) END AS c FROM two JOIN ax USING (ti)),
 cy AS (SELECT ts_ms, symbol, {xz('c')} AS value FROM cx) """ + out("cy", "ts_ms, symbol", "value"),
)
def combine_regression(spark, sf_dir):
    q = cb.combine_regression(weekly(spark, sf_dir, TWO), TWO, REG)
    return q.select("ts_ms", "symbol", F.col("combined").alias("value"))


NAMED = f"{_fac(0)}, {_fac(1)}, nr AS (SELECT '{TWO[0]}' AS name, ti, f0 AS ret FROM fb0 UNION ALL SELECT '{TWO[1]}', ti, f1 FROM fb1)"


def named_returns(spark, sf_dir):
    return cb.factor_table(weekly(spark, sf_dir, TWO), TWO).select(
        F.col("signal").alias("name"), "ti", F.col("spread").alias("ret")
    )


@query(
    "combine_inverse_vol",
    f"""{two_ctes()}, {NAMED},
 a AS (SELECT *, CASE WHEN count(ret) OVER f>=30 THEN stddev_samp(ret) OVER f END AS v FROM nr WINDOW f AS (PARTITION BY name ORDER BY ti ROWS BETWEEN 89 PRECEDING AND CURRENT ROW)),
 b AS (SELECT *, 1/nullif(lag(v) OVER (PARTITION BY name ORDER BY ti),0) AS inv FROM a),
 c AS (SELECT ti, ret*inv/nullif(sum(inv) OVER (PARTITION BY ti),0) AS x FROM b),
 d AS (SELECT ti, sum(x) AS ret FROM c GROUP BY ti HAVING sum(x) IS NOT NULL) """ + out("d", "ti", "ret"),
)
def combine_inverse_vol(spark, sf_dir):
    return cb.combine_inverse_vol(named_returns(spark, sf_dir))


@query(
    "equal_weight_mix",
    f"{two_ctes()}, {NAMED}, d AS (SELECT ti, avg(ret) AS ret FROM nr GROUP BY ti HAVING count(ret)=2) " + out("d", "ti", "ret"),
)
def equal_mix(spark, sf_dir):
    return cb.equal_mix(named_returns(spark, sf_dir), TWO)


# --- covariance -------------------------------------------------------------------------

_CR = f"WITH {PREP}, cm AS (SELECT ti FROM prep GROUP BY ti HAVING count(r1)=(SELECT count(DISTINCT symbol) FROM prep)), x AS (SELECT symbol, ti, r1 AS v FROM prep JOIN cm USING (ti))"
_CC = _CR + """, c AS (SELECT symbol, ti, v-avg(v) OVER (PARTITION BY symbol) AS d FROM x), t AS (SELECT count(*)::DOUBLE AS t FROM cm),
 s AS (SELECT a.symbol AS symbol_a, b.symbol AS symbol_b, avg(a.d*b.d) AS s, avg(a.d*a.d*b.d*b.d) AS s22, avg(a.d*a.d*a.d*b.d) AS s31 FROM c a JOIN c b USING (ti) GROUP BY 1,2),
 v AS (SELECT symbol_a AS symbol, s AS var, sqrt(s) AS sd FROM s WHERE symbol_a=symbol_b),
 rb AS (SELECT avg(s/(va.sd*vb.sd)) AS rbar FROM s JOIN v va ON va.symbol=symbol_a JOIN v vb ON vb.symbol=symbol_b WHERE symbol_a<>symbol_b),
 f AS (SELECT s.*, va.var AS vara, vb.var AS varb, va.sd AS sda, vb.sd AS sdb, CASE WHEN s.symbol_a=s.symbol_b THEN s.s ELSE rbar*va.sd*vb.sd END AS f, rev.s31 AS s13, rbar
   FROM s JOIN v va ON va.symbol=s.symbol_a JOIN v vb ON vb.symbol=s.symbol_b JOIN s rev ON rev.symbol_a=s.symbol_b AND rev.symbol_b=s.symbol_a, rb),
 d AS (SELECT least(1,greatest(0,(sum(s22-s*s) - (sum(CASE WHEN symbol_a=symbol_b THEN s22-s*s ELSE 0 END) + sum(CASE WHEN symbol_a<>symbol_b THEN rbar*(sdb/sda*(s31-vara*s)+sda/sdb*(s13-varb*s))/2 ELSE 0 END)))/sum((f-s)*(f-s))/max(t))) AS delta FROM f, t),
 r AS (SELECT symbol_a, symbol_b, (delta*f+(1-delta)*s)*t/(t-1) AS cov, delta FROM f, d, t) """


@query("covariance_constant_correlation", _CC + out("r", "symbol_a, symbol_b", "cov, delta"))
def cov_cc(spark, sf_dir):
    return pf.covariance(sg.prepare(tb.panel(spark, sf_dir)))


@query(
    "covariance_single_index",
    _CR + """, m AS (SELECT ti, avg(v) AS m FROM x GROUP BY ti), j AS (SELECT x.*, m.m FROM x JOIN m USING (ti)),
 b AS (SELECT symbol, covar_samp(v,m)/var_samp(m) AS beta, count(*) AS t, var_samp(m) AS vm, var_samp(v)*(count(*)-1) AS ss, (covar_samp(v,m)/var_samp(m))*(covar_samp(v,m)/var_samp(m))*var_samp(m)*(count(*)-1) AS es FROM j GROUP BY symbol),
 r AS (SELECT a.symbol AS symbol_a, c.symbol AS symbol_b, a.beta*c.beta*a.vm + CASE WHEN a.symbol=c.symbol THEN (a.ss-a.es)/(a.t-2) ELSE 0 END AS cov FROM b a, b c) """ + out("r", "symbol_a, symbol_b", "cov"),
)
def cov_si(spark, sf_dir):
    return pf.covariance(sg.prepare(tb.panel(spark, sf_dir)), "single_index").drop("delta")


@query(
    "covariance_ewma",
    _CR + """, w0 AS (SELECT ti, pow(0.5,(row_number() OVER (ORDER BY ti DESC)-1)/60.0) AS w FROM cm), w AS (SELECT ti, w/sum(w) OVER () AS w FROM w0),
 mu AS (SELECT symbol, sum(v*w) AS mu FROM x JOIN w USING (ti) GROUP BY symbol), c AS (SELECT x.symbol, x.ti, v-mu AS d, w FROM x JOIN mu USING (symbol) JOIN w USING (ti)),
 r AS (SELECT a.symbol AS symbol_a, b.symbol AS symbol_b, sum(a.d*b.d*a.w)/(1-(SELECT sum(w*w) FROM w)) AS cov FROM c a JOIN c b USING (ti) GROUP BY 1,2) """ + out("r", "symbol_a, symbol_b", "cov"),
)
def cov_ewma(spark, sf_dir):
    return pf.covariance(sg.prepare(tb.panel(spark, sf_dir)), "ewma").drop("delta")
