"""Signal registry: each signal is a Column over a dense panel, then scored per ts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import frames as fr

SIGNALS: dict[str, "Signal"] = {}


@dataclass(frozen=True)
class Signal:
    name: str
    family: str
    raw: Callable[..., Column]
    scoring: str = "clipped"  # clipped z | plain z | rank
    needs: tuple[str, ...] = ()
    defaults: dict = field(default_factory=dict)


def signal(name, family, scoring="clipped", needs=(), **defaults):
    def register(fn):
        SIGNALS[name] = Signal(name, family, fn, scoring, tuple(needs), defaults)
        return fn

    return register


def prepare(p: DataFrame) -> DataFrame:
    """Per-symbol and per-ts building blocks that several signals share.

    Log return, simple return and dollar volume come from one sort by symbol; the
    equal-weight market means from one exchange by ts.
    """
    p = p.withColumns(
        {
            "r1": fr.ret("close"),
            "lr": fr.log_ret("close"),
            "dv": F.col("volume") * F.col("close"),
        }
    )
    w = fr.xs()
    return p.withColumns(
        {"mkt": F.avg("r1").over(w), "lmkt": F.avg("lr").over(w)}
    )


def mean_of(x, w, m):
    return fr.roll_mean(x, w, m)


# carry ---------------------------------------------------------------------------


@signal("carry_level", "carry", smooth=24)
@signal("carry_level_slow", "carry", smooth=120)
def carry_level(smooth):
    return -mean_of("funding", smooth, smooth // 3)


@signal("carry_zscore", "carry", window=240)
def carry_zscore(window):
    m = window // 4
    return -fr.div(
        F.col("funding") - mean_of("funding", window, m), fr.roll_std("funding", window, m)
    )


@signal("carry_momentum", "carry", needs=("sm_funding",), lookback=168)
def carry_momentum(lookback):
    return -(F.col("sm_funding") - fr.lag("sm_funding", lookback))


@signal("carry_vol", "carry", "rank", window=240)
def carry_vol(window):
    return -fr.roll_std("funding", window, window // 4)


# momentum ------------------------------------------------------------------------


@signal("mom_fast", "momentum", lookback=6, skip=0)
@signal("mom_mid", "momentum", lookback=42, skip=1)
@signal("mom_slow", "momentum", lookback=90, skip=1)
@signal("mom_vlong", "momentum", lookback=180, skip=1)
def momentum(lookback, skip):
    return fr.div(fr.lag("close", skip), fr.lag("close", skip + lookback)) - 1.0


@signal("mom_risk_adj", "momentum", lookback=90, vol_window=60)
def mom_risk_adj(lookback, vol_window):
    return fr.div(momentum(lookback, 1), fr.roll_std("lr", vol_window, vol_window // 3))


@signal("mom_consistency", "momentum", lookback=90)
def mom_consistency(lookback):
    up = F.coalesce((F.col("lr") > 0).cast("double"), F.lit(0.0))
    return mean_of(up, lookback, lookback // 3) - 0.5


@signal("mom_52w_high", "momentum", window=720)
def mom_52w_high(window):
    return fr.div("close", fr.roll_max("high", window, window // 4)) - 1.0


# flow ----------------------------------------------------------------------------


@signal("ofi_fast", "flow", window=6, least=2)
@signal("ofi_mid", "flow", window=30, least=10)
@signal("ofi_slow", "flow", window=120, least=40)
def ofi_mean(window, least):
    return mean_of("ofi", window, least)


@signal("ofi_persistence", "flow", "rank", window=90)
def ofi_persistence(window):
    return mean_of("sign_run", window, window // 3)


@signal("volume_shock", "flow", short=24, long=168)
def volume_shock(short, long):
    ratio = fr.div(mean_of("dv", short, short // 3), mean_of("dv", long, long // 3))
    return fr.safe_log(ratio) * F.signum(fr.ret("close", short))


@signal("amihud_illiq", "flow", "rank", window=168)
def amihud_illiq(window):
    return fr.roll_median(fr.div(F.abs(F.col("r1")), F.col("dv")), window, window // 3)


# volatility ----------------------------------------------------------------------


@signal("low_idio_vol", "volatility", "rank", window=90)
def low_idio_vol(window):
    return -fr.roll_std(F.col("lr") - F.col("lmkt"), window, window // 3)


@signal("neg_skew", "volatility", "rank", window=168)
def neg_skew(window):
    return -fr.roll_skew("lr", window, window // 3)


@signal("low_max_ret", "volatility", "rank", window=168)
def low_max_ret(window):
    return -fr.roll_max("lr", window, window // 3)


@signal("vol_of_vol", "volatility", "rank", needs=("vol_short",), short=24, window=240)
def vol_of_vol(short, window):
    m = window // 3
    return -fr.div(fr.roll_std("vol_short", window, m), mean_of("vol_short", window, m))


@signal("downside_beta", "volatility", window=240)
def downside_beta(window):
    down = F.col("lmkt") < 0
    r = F.when(down, F.col("lr"))
    m = F.when(down, F.col("lmkt"))
    f = fr.frame(window)
    both = r.isNotNull() & m.isNotNull()
    cov = F.when(F.count_if(both).over(f) >= window // 4, F.covar_samp(r, m).over(f))
    var = F.when(F.count(m).over(f) >= window // 4, F.var_samp(m).over(f))
    return -fr.div(cov, var)


# microstructure ------------------------------------------------------------------


@signal("close_location", "microstructure", window=24)
def close_location(window):
    h, l, c = F.col("high"), F.col("low"), F.col("close")
    return mean_of(fr.div((c - l) - (h - c), h - l), window, window // 3)


@signal("range_compression", "microstructure", short=24, long=168)
def range_compression(short, long):
    tr = fr.div(F.col("high") - F.col("low"), F.col("close"))
    ratio = fr.div(mean_of(tr, short, short // 3), mean_of(tr, long, long // 3))
    return -fr.safe_log(ratio) * F.signum(fr.ret("close", long))


@signal("trade_intensity", "microstructure", "rank", window=168)
def trade_intensity(window):
    z = fr.safe_log(fr.div("dv", "tick_count"))
    m = window // 3
    return fr.div(z - mean_of(z, window, m), fr.roll_std(z, window, m))


# positioning ---------------------------------------------------------------------


@signal("oi_growth", "positioning", lookback=42)
def oi_growth(lookback):
    return fr.ret("oi_value", lookback)


@signal("oi_price_confirm", "positioning", lookback=42)
def oi_price_confirm(lookback):
    return fr.ret("oi_value", lookback) * F.signum(fr.ret("close", lookback))


@signal("oi_zscore", "positioning", window=240)
def oi_zscore(window):
    m = window // 4
    return fr.div(
        F.col("oi_value") - mean_of("oi_value", window, m), fr.roll_std("oi_value", window, m)
    )


@signal("oi_turnover", "positioning", window=120)
def oi_turnover(window):
    return fr.div("oi_value", mean_of("dv", window, window // 4))


def _log_ratio(name, smooth):
    return mean_of(fr.safe_log(name), smooth, max(2, smooth // 3))


@signal("crowd_ls", "positioning", smooth=12, ratio="crowd_ratio")
@signal("smart_ls", "positioning", smooth=12, ratio="smart_ratio")
@signal("taker_aggression", "positioning", smooth=12, ratio="taker_ratio")
def ratio_level(smooth, ratio):
    return _log_ratio(ratio, smooth)


@signal("smart_minus_crowd", "positioning", smooth=12, a="smart_ratio", b="crowd_ratio")
@signal("smart_count_vs_size", "positioning", smooth=12, a="smart_ratio", b="smart_count_ratio")
def ratio_gap(smooth, a, b):
    return mean_of(fr.safe_log(a) - fr.safe_log(b), smooth, max(2, smooth // 3))


@signal("crowd_ls_momentum", "positioning", needs=("sm_crowd",), lookback=42)
def crowd_ls_momentum(lookback):
    return F.col("sm_crowd") - fr.lag("sm_crowd", lookback)


# the older set, scored by the plain z --------------------------------------------


@signal("signal_momentum", "classic", "plain", lookback=30, skip=1)
def classic_momentum(lookback, skip):
    return momentum(lookback, skip)


@signal("signal_reversal", "classic", "plain", lookback=1)
def classic_reversal(lookback):
    return -fr.ret("close", lookback)


@signal("signal_funding_carry", "classic", "plain", smooth=6)
def classic_carry(smooth):
    return -mean_of("funding", smooth, 1)


@signal("signal_low_vol", "classic", "plain", lookback=30)
def classic_low_vol(lookback):
    return -fr.roll_std("r1", lookback, lookback // 2)


@signal("signal_ofi", "classic", "plain", smooth=6)
def classic_ofi(smooth):
    return mean_of("ofi", smooth, 1)


@signal("signal_risk_adjusted_momentum", "classic", "plain", lookback=90, skip=1, vol_window=30)
def classic_risk_adjusted(lookback, skip, vol_window):
    return fr.div(momentum(lookback, skip), fr.roll_std("r1", vol_window, vol_window // 2))


@signal("signal_long_term_reversal", "classic", "plain", lookback=360, skip=90)
def classic_long_reversal(lookback, skip):
    return -momentum(lookback, skip)


@signal("signal_negative_skew", "classic", "plain", lookback=90)
def classic_negative_skew(lookback):
    return -fr.roll_skew("r1", lookback, lookback // 2)


@signal("signal_funding_momentum", "classic", "plain", needs=("sm_funding6",), lookback=42)
def classic_funding_momentum(lookback):
    return -(F.col("sm_funding6") - fr.lag("sm_funding6", lookback))


@signal("signal_idiosyncratic_vol", "classic", "plain", lookback=60)
def classic_idio_vol(lookback):
    return -fr.roll_std(F.col("r1") - F.col("mkt"), lookback, lookback // 2)


FAMILIES = ("carry", "momentum", "flow", "volatility", "microstructure", "positioning")


def _helpers(names, params) -> dict[str, Column]:
    """First-level windows a second-level window reads; one pass each."""
    out: dict[str, Column] = {}
    for n in names:
        for need in SIGNALS[n].needs:
            if need == "sm_funding":
                out[need] = mean_of("funding", 24, 8)
            elif need == "sm_funding6":
                out[need] = mean_of("funding", 6, 1)
            elif need == "sm_crowd":
                out[need] = mean_of(fr.safe_log("crowd_ratio"), 12, 4)
            elif need == "vol_short":
                short = {**SIGNALS[n].defaults, **params.get(n, {})}["short"]
                out[need] = fr.roll_std("lr", short, short // 2)
    if "ofi_persistence" in names:
        s = F.signum("ofi")
        out["sign_run"] = s * F.lag(s, 1).over(fr.series())
    return out


def score(x, scoring: str) -> list[Callable]:
    if scoring == "rank":
        return [fr.xs_rank_unit]
    if scoring == "plain":
        return [fr.xs_z]
    return [fr.xs_z, lambda c: fr.xs_z(fr.clip(c, -4.0, 4.0))]


def raw_signals(p: DataFrame, names, params: dict | None = None) -> DataFrame:
    """Panel plus one raw column per signal (wide): one sort by symbol for all."""
    params = params or {}
    p = prepare(p)
    helpers = _helpers(names, params)
    if helpers:
        p = p.withColumns(helpers)
    raws = {}
    for n in names:
        s = SIGNALS[n]
        raws[n] = fr.finite(s.raw(**{**s.defaults, **params.get(n, {})}))
    return p.withColumns(raws)


def build_signals(p: DataFrame, names, params: dict | None = None, keep=()) -> DataFrame:
    """(symbol, ti, ts_ms, keep..., one scored column per signal)."""
    wide = raw_signals(p, list(names), params).select("symbol", "ti", "ts_ms", *keep, *names)
    return score_columns(wide, {n: SIGNALS[n].scoring for n in names})


def score_columns(wide: DataFrame, scoring: dict[str, str], keys=fr.BY_TS) -> DataFrame:
    first, second = {}, {}
    for n, how in scoring.items():
        if how == "rank":
            first[n] = fr.xs_rank_unit(n, keys)
        else:
            first[n] = fr.xs_z(n, keys)
            if how == "clipped":
                second[n] = fr.xs_z(fr.clip(F.col(n), -4.0, 4.0), keys)
    wide = wide.withColumns(first)
    return wide.withColumns(second) if second else wide


def build_signal(p: DataFrame, name: str, **params) -> DataFrame:
    return build_signals(p, [name], {name: params}).select(
        "ts_ms", "symbol", F.col(name).alias("value")
    )


def to_long(wide: DataFrame, names, keep=("symbol", "ti", "ts_ms"), label="signal") -> DataFrame:
    """Unpivot wide signal columns; narrow rows, no shuffle."""
    return wide.unpivot(list(keep), list(names), label, "value")


def mean_covered(names, least: int) -> Column:
    """Mean over the non-null columns where at least ``least`` are present."""
    n = sum(F.col(c).isNotNull().cast("int") for c in names)
    total = sum(F.coalesce(F.col(c), F.lit(0.0)) for c in names)
    return F.when(n >= F.lit(max(least, 1)), total / F.nullif(n, F.lit(0)))


def build_family(p: DataFrame, family: str, members=None, least: int = 1, params=None, keep=()) -> DataFrame:
    names = list(members or [n for n, s in SIGNALS.items() if s.family == family])
    if not names:
        raise ValueError(f"empty family: {family}")
    return families_from(build_signals(p, names, params, keep), {family: names}, least, keep)


def build_families(p: DataFrame, families=FAMILIES, least: int = 1, params=None, keep=()) -> DataFrame:
    members = {f: [n for n, s in SIGNALS.items() if s.family == f] for f in families}
    names = [n for m in members.values() for n in m]
    return families_from(build_signals(p, names, params, keep), members, least, keep)


def families_from(wide: DataFrame, members: dict[str, list[str]], least: int, keep=()) -> DataFrame:
    out = wide.select(
        "symbol", "ti", "ts_ms", *keep,
        *[mean_covered(m, least).alias(f) for f, m in members.items()],
    )
    return score_columns(out, {f: "clipped" for f in members})


def combine_mean(wide: DataFrame, names, least: int = 2) -> DataFrame:
    if not names or least < 1:
        raise ValueError("need at least one signal and a coverage of one")
    return wide.withColumn("combined", mean_covered(names, least))
