"""Queries over the signal library: every signal scored on the weekly brand panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import signals as sg
from barloom.plans.registry import (
    L, arank, guarded, out, panel_sql, query, rmean, rskew, rstd, sdiv, sln, W, xz,
)
from barloom.sources import tables as tb

#: windows longer than the weekly axis are scaled down
PARAMS = {
    "mom_52w_high": {"window": 180},
    "signal_long_term_reversal": {"lookback": 120, "skip": 30},
}

PREP = panel_sql("week") + f""",
prep0 AS (SELECT *, {sdiv('close', L('close', 1))}-1 AS r1, {sln(sdiv('close', L('close', 1)))} AS lr,
  volume*close AS dv, sign(ofi) AS so FROM panel),
prep AS (SELECT *, avg(r1) OVER (PARTITION BY ti) AS mkt, avg(lr) OVER (PARTITION BY ti) AS lmkt,
  {rmean('funding', 24, 8)} AS sm24, {rmean('funding', 6, 1)} AS sm6,
  {rmean(sln('crowd_ratio'), 12, 4)} AS smc, {rstd('lr', 24, 12)} AS v24,
  so*{L('so', 1)} AS sign_run FROM prep0)"""


def mom(lb, skip):
    return f"{sdiv(L('close', skip), L('close', skip + lb))}-1"


_rd, _md = "(CASE WHEN lmkt<0 THEN lr END)", "(CASE WHEN lmkt<0 THEN lmkt END)"

RAW_SQL = {
    "carry_level": f"-{rmean('funding', 24, 8)}",
    "carry_level_slow": f"-{rmean('funding', 120, 40)}",
    "carry_zscore": f"-{sdiv('funding-' + rmean('funding', 240, 60), rstd('funding', 240, 60))}",
    "carry_momentum": f"-(sm24-{L('sm24', 168)})",
    "carry_vol": f"-{rstd('funding', 240, 60)}",
    "mom_fast": mom(6, 0),
    "mom_mid": mom(42, 1),
    "mom_slow": mom(90, 1),
    "mom_vlong": mom(180, 1),
    "mom_risk_adj": sdiv(mom(90, 1), rstd("lr", 60, 20)),
    "mom_consistency": rmean("(CASE WHEN lr>0 THEN 1.0 ELSE 0.0 END)", 90, 30) + "-0.5",
    "mom_52w_high": sdiv("close", guarded("max(high)", "high", 180, 45)) + "-1",
    "ofi_fast": rmean("ofi", 6, 2),
    "ofi_mid": rmean("ofi", 30, 10),
    "ofi_slow": rmean("ofi", 120, 40),
    "ofi_persistence": rmean("sign_run", 90, 30),
    "volume_shock": sln(sdiv(rmean("dv", 24, 8), rmean("dv", 168, 56))) + f"*sign({sdiv('close', L('close', 24))}-1)",
    "amihud_illiq": guarded(
        f"quantile_cont({sdiv('abs(r1)', 'dv')}, 0.5)", sdiv("abs(r1)", "dv"), 168, 56
    ),
    "low_idio_vol": f"-{rstd('(lr-lmkt)', 90, 30)}",
    "neg_skew": f"-{rskew('lr', 168, 56)}",
    "low_max_ret": "-" + guarded("max(lr)", "lr", 168, 56),
    "vol_of_vol": f"-{sdiv(rstd('v24', 240, 80), rmean('v24', 240, 80))}",
    "downside_beta": "-" + sdiv(
        f"CASE WHEN count({_rd}) {W(240)} >= 60 THEN covar_samp({_rd},CASE WHEN lr IS NOT NULL THEN {_md} END) {W(240)} END",
        f"CASE WHEN count({_md}) {W(240)} >= 60 THEN var_samp({_md}) {W(240)} END",
    ),
    "close_location": rmean(sdiv("(close-low)-(high-close)", "high-low"), 24, 8),
    "range_compression": "-" + sln(sdiv(
        rmean(sdiv("high-low", "close"), 24, 8), rmean(sdiv("high-low", "close"), 168, 56)
    )) + f"*sign({sdiv('close', L('close', 168))}-1)",
    "trade_intensity": sdiv(
        sln(sdiv("dv", "tick_count")) + "-" + rmean(sln(sdiv("dv", "tick_count")), 168, 56),
        rstd(sln(sdiv("dv", "tick_count")), 168, 56),
    ),
    "oi_growth": sdiv("oi_value", L("oi_value", 42)) + "-1",
    "oi_price_confirm": f"({sdiv('oi_value', L('oi_value', 42))}-1)*sign({sdiv('close', L('close', 42))}-1)",
    "oi_zscore": sdiv("oi_value-" + rmean("oi_value", 240, 60), rstd("oi_value", 240, 60)),
    "oi_turnover": sdiv("oi_value", rmean("dv", 120, 30)),
    "crowd_ls": rmean(sln("crowd_ratio"), 12, 4),
    "smart_ls": rmean(sln("smart_ratio"), 12, 4),
    "smart_minus_crowd": rmean("(ln(smart_ratio)-ln(crowd_ratio))", 12, 4),
    "smart_count_vs_size": rmean("(ln(smart_ratio)-ln(smart_count_ratio))", 12, 4),
    "taker_aggression": rmean(sln("taker_ratio"), 12, 4),
    "crowd_ls_momentum": f"smc-{L('smc', 42)}",
    "signal_momentum": mom(30, 1),
    "signal_reversal": f"-({mom(1, 0)})",
    "signal_funding_carry": f"-{rmean('funding', 6, 1)}",
    "signal_low_vol": f"-{rstd('r1', 30, 15)}",
    "signal_ofi": rmean("ofi", 6, 1),
    "signal_risk_adjusted_momentum": sdiv(mom(90, 1), rstd("r1", 30, 15)),
    "signal_long_term_reversal": f"-({mom(120, 30)})",
    "signal_negative_skew": f"-{rskew('r1', 90, 45)}",
    "signal_funding_momentum": f"-(sm6-{L('sm6', 42)})",
    "signal_idiosyncratic_vol": f"-{rstd('(r1-mkt)', 60, 30)}",
}


def clipped_sql(src: str, col: str, dst: str) -> str:
    """Two CTEs: z, then clipped and re-standardised."""
    return (
        f"{dst}_z AS (SELECT *, {xz(col)} AS z_ FROM {src}),"
        f"{dst}_c AS (SELECT *, CASE WHEN z_>4 THEN 4.0 WHEN z_<-4 THEN -4.0 ELSE z_ END AS c_ FROM {dst}_z),"
        f"{dst} AS (SELECT * EXCLUDE (z_, c_), {xz('c_')} AS value FROM {dst}_c)"
    )


def score_sql(src: str, scoring: str, dst: str = "scored", col: str = "raw") -> str:
    if scoring == "rank":
        return f"{dst} AS (SELECT *, 2*({arank(col)}/nullif(count({col}) OVER (PARTITION BY ti),0)-0.5) AS value FROM {src})"
    if scoring == "plain":
        return f"{dst} AS (SELECT *, {xz(col)} AS value FROM {src})"
    return clipped_sql(src, col, dst)


def signal_ctes(name: str, dst: str = "scored") -> str:
    s = sg.SIGNALS[name]
    return (
        f"{dst}_raw AS (SELECT symbol, ti, ts_ms, close, funding, {RAW_SQL[name]} AS raw FROM prep),"
        + score_sql(f"{dst}_raw", s.scoring, dst)
    )


def signal_sql(name: str) -> str:
    return f"WITH {PREP}, {signal_ctes(name)} " + out("scored", "ts_ms, symbol", "value")


def _register(name: str) -> None:
    @query(name, signal_sql(name))
    def run(spark, sf_dir):
        return sg.build_signal(tb.panel(spark, sf_dir), name, **PARAMS.get(name, {}))


for _n in sg.SIGNALS:
    _register(_n)


# --- families and combinations ----------------------------------------------------


def family_ctes(members: list[str], least: int, dst: str = "fam") -> str:
    parts = [signal_ctes(n, f"s{i}") for i, n in enumerate(members)]
    union = " UNION ALL ".join(f"SELECT symbol, ti, ts_ms, value FROM s{i}" for i in range(len(members)))
    return ",".join(parts) + (
        f", {dst}_u AS ({union}), {dst}_m AS (SELECT symbol, ti, ts_ms,"
        f" CASE WHEN count(value)>={least} THEN sum(value)/nullif(count(value),0) END AS raw"
        f" FROM {dst}_u GROUP BY ALL)"
    )


_CARRY = [n for n, s in sg.SIGNALS.items() if s.family == "carry"]
_SOME = ["mom_fast", "carry_level", "ofi_fast"]


@query(
    "combine_signals_zscore",
    f"WITH {PREP}, {family_ctes(_SOME, 2)} " + out("(SELECT ts_ms, symbol, raw AS value FROM fam_m)", "ts_ms, symbol", "value"),
)
def combine_signals(spark, sf_dir):
    wide = sg.build_signals(tb.panel(spark, sf_dir), _SOME, PARAMS)
    return sg.combine_mean(wide, _SOME, 2).select("ts_ms", "symbol", F.col("combined").alias("value"))


@query(
    "build_family",
    f"WITH {PREP}, {family_ctes(_CARRY, 1)}, {clipped_sql('fam_m', 'raw', 'scored')} " + out("scored", "ts_ms, symbol", "value"),
)
def family(spark, sf_dir):
    wide = sg.build_family(tb.panel(spark, sf_dir), "carry", params=PARAMS)
    return wide.select("ts_ms", "symbol", F.col("carry").alias("value"))


@query(
    "build_all_families",
    " ".join([
        "WITH", PREP, ",",
        ",".join(signal_ctes(n, f"q{i}") for i, n in enumerate(n for n, s in sg.SIGNALS.items() if s.family != "classic")),
        ", u AS (", " UNION ALL ".join(
            f"SELECT '{sg.SIGNALS[n].family}' AS family, symbol, ti, ts_ms, value FROM q{i}"
            for i, n in enumerate(n for n, s in sg.SIGNALS.items() if s.family != "classic")
        ), "), m AS (SELECT family, symbol, ti, ts_ms, sum(value)/nullif(count(value),0) AS raw FROM u GROUP BY ALL),",
        f"z AS (SELECT *, {xz('raw', 'family, ti')} AS z_ FROM m),",
        "c AS (SELECT *, CASE WHEN z_>4 THEN 4.0 WHEN z_<-4 THEN -4.0 ELSE z_ END AS c_ FROM z),",
        f"f AS (SELECT family, ts_ms, symbol, {xz('c_', 'family, ti')} AS value FROM c)",
        out("f", "family, ts_ms, symbol", "value"),
    ]),
)
def all_families(spark, sf_dir):
    wide = sg.build_families(tb.panel(spark, sf_dir), params=PARAMS)
    return sg.to_long(wide, sg.FAMILIES, ("ts_ms", "symbol"), "family")


# --- cross-section primitives -------------------------------------------------------


def _prim(name, spark_fn, sql):
    @query(name, f"WITH {PREP}, q AS (SELECT ts_ms, symbol, {sql} AS value FROM prep) " + out("q", "ts_ms, symbol", "value"))
    def run(spark, sf_dir):
        p = sg.prepare(tb.panel(spark, sf_dir))
        return p.select("ts_ms", "symbol", spark_fn().alias("value"))


from barloom.functions import frames as fr  # noqa: E402

_prim("xs_zscore", lambda: fr.xs_z("r1"), xz("r1"))
_prim("xs_rank", lambda: fr.xs_rank_unit("tick_count"), f"2*({arank('tick_count')}/nullif(count(tick_count) OVER (PARTITION BY ti),0)-0.5)")
_prim("forward_return", lambda: fr.div(fr.lead("close", 6), "close") - 1.0, "lead(close,6) OVER (PARTITION BY symbol ORDER BY ti)/close-1")


@query("xs_zscore_clipped", f"WITH {PREP}, {clipped_sql('prep', 'dv', 'scored')} " + out("scored", "ts_ms, symbol", "value"))
def xs_clipped(spark, sf_dir):
    p = sg.prepare(tb.panel(spark, sf_dir)).select("ts_ms", "symbol", "ti", F.col("dv").alias("value"))
    return sg.score_columns(p, {"value": "clipped"}).select("ts_ms", "symbol", "value")
