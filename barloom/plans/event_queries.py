"""Queries over bar features, filters, events, labels, exits, weights and folds.

Bars are the weekly brand bars; events are CUSUM triggers on them.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import frames as fr
from barloom.operators import events as ev
from barloom.operators import features as ft
from barloom.operators import sizing as sz
from barloom.plans.registry import bars_sql, out, query
from barloom.sources import tables as tb

O = "(PARTITION BY symbol ORDER BY bar_idx)"
BASE = f"WITH RECURSIVE {bars_sql('week')}, b0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms)-1 AS bar_idx, ln(close/lag(close) OVER (PARTITION BY symbol ORDER BY ts_ms)) AS lr FROM bars)"
ATR = f"""b1 AS (SELECT *, CASE WHEN lag(close) OVER o IS NULL THEN high-low ELSE greatest(high-low, abs(high-lag(close) OVER o), abs(low-lag(close) OVER o)) END AS tr FROM b0 WINDOW o AS {O}),
b AS (SELECT *, avg(tr) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS atr_14 FROM b1)"""


def bars(spark, sf_dir):
    b = ft.indexed(tb.bucket_bars(spark, sf_dir, tb.week_bucket))
    lr = F.log(F.col("close") / F.lag("close").over(Window.partitionBy("symbol").orderBy("bar_idx")))
    return b.withColumn("lr", lr)


def atr_bars(spark, sf_dir):
    return ft.with_atr(bars(spark, sf_dir))


@query("true_range_atr", f"{BASE}, {ATR} " + out("b", "symbol, bar_idx", "tr, atr_14"))
def atr(spark, sf_dir):
    return atr_bars(spark, sf_dir).select("symbol", "bar_idx", "tr", "atr_14")


GAP = 7 * 86_400_000


@query(
    "gap_warmup_mask",
    f"{BASE}, g AS (SELECT *, CASE WHEN ts_ms-lag(ts_ms) OVER o>{GAP} THEN bar_idx END AS s FROM b0 WINDOW o AS {O}), r AS (SELECT symbol, bar_idx, bar_idx<10 OR coalesce(bar_idx-last_value(s IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_idx)<10,false) AS insufficient_history FROM g) SELECT * FROM r",
)
def gap_warmup(spark, sf_dir):
    return ft.with_gap_mask(bars(spark, sf_dir), GAP, 10).select("symbol", "bar_idx", "insufficient_history")


_F20 = "(PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


FEATURES = f"""f0 AS (SELECT *, (close-lag(close) OVER o)/lag(close) OVER o AS r, lag(close,5) OVER o AS c5 FROM b0 WINDOW o AS {O}),
 f AS (SELECT symbol, bar_idx, (high-low)/greatest(close,1e-6) AS hl_spread, coalesce(r,0) AS ret_1, coalesce((close-c5)/c5,0) AS ret_5, volume/greatest(avg(volume) OVER w,1e-6) AS vol_ratio,
  CASE WHEN high-low<=1e-12 THEN 0.5 ELSE (close-low)/(high-low) END AS range_position, avg(ofi) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS ofi_ma5,
  CASE WHEN count(volume) OVER w<5 OR stddev_pop(volume) OVER w<=1e-12 THEN 0 ELSE (volume-avg(volume) OVER w)/stddev_pop(volume) OVER w END AS volume_z,
  CASE WHEN count(r) OVER w<5 OR stddev_pop(r) OVER w<=1e-12 THEN 0 ELSE r/stddev_pop(r) OVER w END AS ret_zscore FROM f0 WINDOW w AS {_F20})"""


@query("batch_features", f"{BASE}, {FEATURES} " + out("f", "symbol, bar_idx", ", ".join(ft.DERIVED)))
def batch_features(spark, sf_dir):
    return ft.batch_features(bars(spark, sf_dir)).select("symbol", "bar_idx", *ft.DERIVED)


_HD = ", ".join(f"abs(close-lag(close,{t}) OVER o) AS d{t}" for t in range(1, 11))
_HM = " UNION ALL ".join(
    f"SELECT symbol, bar_idx, ln({t}.0) AS x, CASE WHEN m>0 THEN ln(m) END AS y FROM (SELECT symbol, bar_idx, avg(d{t}) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN {50 - t} PRECEDING AND CURRENT ROW) AS m FROM h0)"
    for t in range(1, 11)
)


@query(
    "generalized_hurst",
    f"{BASE}, h0 AS (SELECT symbol, bar_idx, {_HD} FROM b0 WINDOW o AS {O}), h1 AS ({_HM}), h2 AS (SELECT symbol, bar_idx, regr_slope(y,x) AS s FROM h1 GROUP BY 1,2), h AS (SELECT symbol, bar_idx, CASE WHEN bar_idx>=50 AND s IS NOT NULL THEN least(1.0,greatest(0.0,s)) ELSE 0.5 END AS hurst_value FROM h2) " + out("h", "symbol, bar_idx", "hurst_value"),
)
def hurst(spark, sf_dir):
    return ft.with_hurst(bars(spark, sf_dir)).select("symbol", "bar_idx", "hurst_value")


_FW = ft.ffd_weights(0.4, 1e-3)


@query(
    "fractional_diff",
    f"{BASE}, w AS (SELECT unnest(range(0,{len(_FW)})) AS m, unnest([{','.join(f'{v!r}::DOUBLE' for v in _FW)}]) AS w), r AS (SELECT x.symbol, x.bar_idx, sum(y.close*w.w) AS ffd FROM b0 x JOIN w ON x.bar_idx>={len(_FW) - 1} JOIN b0 y ON y.symbol=x.symbol AND y.bar_idx=x.bar_idx-w.m GROUP BY 1,2), q AS (SELECT b0.symbol, b0.bar_idx, ffd FROM b0 LEFT JOIN r USING (symbol,bar_idx)) " + out("q", "symbol, bar_idx", "ffd", 5),
    digits=5,
)
def fractional(spark, sf_dir):
    return ft.fractional_diff(bars(spark, sf_dir), 0.4, 1e-3).select("symbol", "bar_idx", "ffd")


@query("stationary_order")
def stationary(spark, sf_dir):
    return ft.stationary_order(bars(spark, sf_dir), [0.0, 0.2, 0.4, 0.6, 0.8, 1.0], 1e-3)


ER = f"""er0 AS (SELECT symbol, bar_idx, close, CASE WHEN bar_idx>=2 THEN least(1.0,abs(close-coalesce(lag(close,20) OVER o, first_value(close) OVER o))/nullif(sum(dc) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),0)) END AS e FROM (SELECT *, abs(close-lag(close) OVER o) AS dc FROM b0 WINDOW o AS {O}) WINDOW o AS {O}),
err AS (SELECT symbol, bar_idx, coalesce(e,0) AS p FROM er0 WHERE bar_idx=2 UNION ALL SELECT x.symbol, x.bar_idx, 0.3*coalesce(x.e,0)+0.7*r.p FROM err r JOIN er0 x ON x.symbol=r.symbol AND x.bar_idx=r.bar_idx+1),
er AS (SELECT er0.symbol, er0.bar_idx, coalesce(err.p,0.5) AS p_trend, 1-coalesce(err.p,0.5) AS p_chop FROM er0 LEFT JOIN err USING (symbol,bar_idx))"""


@query("efficiency_regime", f"{BASE}, {ER} " + out("er", "symbol, bar_idx", "p_trend, p_chop"))
def efficiency(spark, sf_dir):
    return ft.efficiency_regime(bars(spark, sf_dir))


@query(
    "local_linear_trend",
    f"""{BASE}, k AS (SELECT symbol, bar_idx, close AS x, 0::DOUBLE AS v, 1::DOUBLE AS a, 0::DOUBLE AS b, 1::DOUBLE AS d FROM b0 WHERE bar_idx=0
 UNION ALL SELECT symbol, bar_idx, xp+ap/(ap+0.01)*(z-xp), vp+bp/(ap+0.01)*(z-xp), (1-ap/(ap+0.01))*ap, (1-ap/(ap+0.01))*bp, dp-bp/(ap+0.01)*bp FROM
 (SELECT y.symbol, y.bar_idx, y.close AS z, k.x+k.v AS xp, k.v AS vp, k.a+2*k.b+k.d+1e-4 AS ap, k.b+k.d AS bp, k.d+1e-5 AS dp FROM k JOIN b0 y ON y.symbol=k.symbol AND y.bar_idx=k.bar_idx+1)),
 r AS (SELECT symbol, bar_idx, x AS level, v AS trend FROM k) """ + out("r", "symbol, bar_idx", "level, trend", 5),
    digits=5,
)
def local_trend(spark, sf_dir):
    return ft.local_trend(bars(spark, sf_dir))


_N = lambda s: f"greatest(exp(-0.5*power(lr/{s},2))/({s}*sqrt(2*pi())),1e-15)"


@query(
    "causal_hmm",
    f"""{BASE}, h AS (SELECT symbol, bar_idx, 0.5::DOUBLE AS p0, 0.5::DOUBLE AS p1 FROM b0 WHERE bar_idx=0
 UNION ALL SELECT symbol, bar_idx, w0/(w0+w1), w1/(w0+w1) FROM (SELECT y.symbol, y.bar_idx, {_N('0.05')}*(h.p0*0.95+h.p1*0.05) AS w0, {_N('0.2')}*(h.p0*0.05+h.p1*0.95) AS w1 FROM h JOIN b0 y ON y.symbol=h.symbol AND y.bar_idx=h.bar_idx+1)),
 r AS (SELECT symbol, bar_idx, p0 AS p_0, p1 AS p_1 FROM h) """ + out("r", "symbol, bar_idx", "p_0, p_1"),
)
def causal_hmm(spark, sf_dir):
    return ft.hmm_posteriors(bars(spark, sf_dir), "lr", stds=(0.05, 0.2))


@query("imm_trend_score")  # at prices of 50 000 its covariances are near singular: two roundings of it part, so no SQL; stream_imm_trend has
def imm(spark, sf_dir):
    b = atr_bars(spark, sf_dir)
    return ft.imm_scores(b.join(ft.efficiency_regime(b), ["symbol", "bar_idx"]))


@query("signal_bars")
def signal_bars(spark, sf_dir):
    return ft.signal_bars(bars(spark, sf_dir))


@query(
    "two_regime_test",
    f"""{BASE}, q AS (SELECT symbol, bar_idx, pow((lr-avg(lr) OVER s)/stddev_pop(lr) OVER s, 2) AS q FROM b0 WHERE lr IS NOT NULL WINDOW s AS (PARTITION BY symbol)),
 p AS (SELECT *, lag(q) OVER (PARTITION BY symbol ORDER BY bar_idx) AS p FROM q),
 g AS (SELECT symbol, count(*) AS n, count(*)*(pow(avg(q*q)-3,2)/24+pow(sum((q-1)*(p-1))/sum(pow(q-1,2)),2)) AS statistic FROM p GROUP BY symbol),
 r AS (SELECT *, exp(-statistic/2) AS p_value, exp(-statistic/2)<0.01 AS two_regimes FROM g) """ + out("r", "symbol, n, two_regimes", "statistic, p_value"),
)
def two_regime(spark, sf_dir):
    return ft.two_regime_test(bars(spark, sf_dir))


# --- events ------------------------------------------------------------------------------------

THR = "t AS (SELECT *, least(0.05,greatest(1e-4,2.5*atr_14/close)) AS threshold FROM b)"


@query("dynamic_cusum_threshold", f"{BASE}, {ATR}, {THR} " + out("t", "symbol, bar_idx", "threshold", 8), digits=8)
def cusum_threshold(spark, sf_dir):
    return atr_bars(spark, sf_dir).select("symbol", "bar_idx", ev.cusum_threshold().alias("threshold"))


@query(
    "smoothed_cusum_threshold",
    f"""{BASE}, {ATR}, e AS (SELECT symbol, bar_idx, atr_14/close AS v FROM b WHERE bar_idx=0 UNION ALL SELECT y.symbol, y.bar_idx, CASE WHEN y.bar_idx%50=0 THEN y.atr_14/y.close ELSE 2.0/51*(y.atr_14/y.close)+(1-2.0/51)*e.v END FROM e JOIN b y ON y.symbol=e.symbol AND y.bar_idx=e.bar_idx+1),
 r AS (SELECT symbol, bar_idx, least(0.5,greatest(1e-4,0.5*v)) AS threshold FROM e) """ + out("r", "symbol, bar_idx", "threshold", 8),
    digits=8,
)
def smoothed_threshold(spark, sf_dir):
    b = atr_bars(spark, sf_dir).withColumn("restart", F.col("bar_idx") % 50 == 0)
    return ev.smoothed_threshold(b, multiplier=0.5, most=0.5, reset="restart").select("symbol", "bar_idx", "threshold")


@query(
    "threshold_summary",
    f"{BASE}, {ATR}, {THR}, r AS (SELECT symbol, avg(threshold) AS mean, stddev_pop(threshold) AS std, min(threshold) AS min, max(threshold) AS max, quantile_cont(threshold,0.5) AS median, arg_max(threshold,bar_idx) AS last FROM t GROUP BY symbol) " + out("r", "symbol", "mean, std, min, max, median, last"),
)
def threshold_summary(spark, sf_dir):
    t = atr_bars(spark, sf_dir).withColumn("t", ev.cusum_threshold())
    return t.groupBy("symbol").agg(
        F.avg("t").alias("mean"), F.stddev_pop("t").alias("std"), F.min("t").alias("min"), F.max("t").alias("max"),
        F.percentile("t", F.lit(0.5)).alias("median"), F.max_by("t", "bar_idx").alias("last"),
    )


CUS = f"""cu AS (SELECT symbol, bar_idx, 0::DOUBLE AS up, 0::DOUBLE AS dn, close, CAST(NULL AS BIGINT) AS li, CAST(NULL AS DOUBLE) AS lp, 0 AS hit FROM t WHERE bar_idx=0
 UNION ALL SELECT symbol, bar_idx, CASE WHEN side<>0 THEN 0 ELSE u END, CASE WHEN side<>0 THEN 0 ELSE d END, close, CASE WHEN ok THEN bar_idx ELSE li END, CASE WHEN ok THEN close ELSE lp END, CASE WHEN ok THEN side ELSE 0 END FROM
 (SELECT *, side<>0 AND (li IS NULL OR (bar_idx-li>=5 AND abs(close-lp)>0.5*atr_14)) AS ok FROM
 (SELECT *, CASE WHEN u>threshold THEN 1 WHEN d<-threshold THEN -1 ELSE 0 END AS side FROM
 (SELECT y.symbol, y.bar_idx, y.close, y.threshold, y.atr_14, c.li, c.lp, greatest(0,c.up+ln(y.close/c.close)) AS u, least(0,c.dn+ln(y.close/c.close)) AS d FROM cu c JOIN t y ON y.symbol=c.symbol AND y.bar_idx=c.bar_idx+1)))),
ce AS (SELECT symbol, bar_idx, hit AS raw_dir FROM cu WHERE hit<>0)"""
EVS = f"{BASE}, {ATR}, {THR}, {CUS}"


def threshold_bars(spark, sf_dir):
    b = atr_bars(spark, sf_dir)
    return b.withColumn("threshold", ev.cusum_threshold())


def triggers(spark, sf_dir):
    b = threshold_bars(spark, sf_dir)
    # bars of a symbol are bounded by the calendar: one block
    return b, ev.cusum_events(b, 5, 0.5)


@query("cusum_events", f"{EVS} SELECT symbol, bar_idx, raw_dir FROM ce")
def cusum_events(spark, sf_dir):
    return triggers(spark, sf_dir)[1]


@query(
    "cusum_event_sides",
    f"""{EVS}, {ER}, s AS (SELECT ce.symbol, ce.bar_idx, raw_dir, CASE WHEN p_trend>=0.5 THEN 'follow' WHEN p_chop>0.8 THEN 'fade' ELSE 'none' END AS trade_mode, ofi FROM ce JOIN er USING (symbol,bar_idx) JOIN b0 USING (symbol,bar_idx))
 SELECT symbol, bar_idx, raw_dir, trade_mode, CAST(CASE trade_mode WHEN 'none' THEN raw_dir WHEN 'follow' THEN CASE WHEN ofi>=0 THEN 1 ELSE -1 END ELSE CASE WHEN ofi>=0 THEN -1 ELSE 1 END END AS INT) AS side FROM s""",
)
def event_sides(spark, sf_dir):
    b, e = triggers(spark, sf_dir)
    feats = ft.efficiency_regime(b).join(b.select("symbol", "bar_idx", F.col("ofi").alias("trend_score")), ["symbol", "bar_idx"])
    return ev.event_sides(e, feats, fade=True).select("symbol", "bar_idx", "raw_dir", "trade_mode", "side")


@query(
    "brier_drift",
    f"""WITH RECURSIVE {bars_sql('week')}, s AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms)-1 AS pos, least(1.0,abs(ofi)) AS score FROM bars),
 r AS (SELECT symbol, CAST(-1 AS BIGINT) AS pos, 0::DOUBLE AS carry, 0::DOUBLE AS s_plus, false AS alarm FROM (SELECT DISTINCT symbol FROM s) UNION ALL SELECT symbol, pos, CASE WHEN v>0.5 THEN 0 ELSE v END, v, v>0.5 FROM (SELECT s.symbol, s.pos, greatest(0,r.carry+s.score-0.3) AS v FROM r JOIN s ON s.symbol=r.symbol AND s.pos=r.pos+1)) """
    + out("(SELECT * FROM r WHERE pos>=0)", "symbol, pos, alarm", "s_plus"),
)
def brier_drift(spark, sf_dir):
    s = bars(spark, sf_dir).select("symbol", F.col("bar_idx").cast("long").alias("pos"), F.least(F.lit(1.0), F.abs("ofi")).alias("score"))
    return ev.drift_alarms(s, ["symbol"], "score", 0.3, 0.5)


@query(
    "drawdown_tiers",
    f"""{BASE}, d AS (SELECT symbol, bar_idx, ts_ms, (max(close) OVER u-close)/max(close) OVER u AS dd FROM b0 WINDOW u AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 e AS (SELECT *, coalesce(bool_or(dd>=0.65) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),false) AS dead, max(CASE WHEN dd>=0.4 AND dd<0.65 THEN ts_ms+86400000 END) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fz FROM d),
 r AS (SELECT symbol, bar_idx, CASE WHEN dead THEN 'KILL' WHEN dd>=0.4 THEN 'FLATTEN' WHEN dd>=0.2 THEN 'REDUCE' ELSE 'NORMAL' END AS tier, CASE WHEN dead OR dd>=0.4 OR coalesce(ts_ms<fz,false) THEN 0.0 WHEN dd>=0.2 THEN 0.5 ELSE 1.0 END AS multiplier, dd FROM e) """ + out("r", "symbol, bar_idx, tier", "multiplier, dd"),
)
def drawdown_tiers(spark, sf_dir):
    from barloom.operators.ledger import drawdown_tiers as tiers

    b = bars(spark, sf_dir).withColumnRenamed("close", "equity")
    return tiers(b, ("symbol",), 0.2, 0.4, 0.65).select("symbol", "bar_idx", "tier", "multiplier", "dd")


@query(
    "chase_cap",
    f"{BASE}, l AS (SELECT symbol, lr, row_number() OVER (PARTITION BY symbol ORDER BY bar_idx DESC) AS k FROM b0), c AS (SELECT symbol, count(*) AS n, stddev_pop(CASE WHEN k<200 THEN lr END) AS s FROM l WHERE k<=200 GROUP BY symbol), r AS (SELECT symbol, greatest(15.0, 1.5*s*sqrt(900/3600.0)*1e4) AS cap_bps FROM c WHERE n>=50 AND s>0) " + out("r", "symbol", "cap_bps"),
)
def chase_cap(spark, sf_dir):
    from barloom.operators.ledger import chase_caps

    return chase_caps(bars(spark, sf_dir), 15.0, 1.5, 900.0)


@query(
    "regime_exit_threshold",
    f"{BASE}, {ER}, r AS (SELECT symbol, least(1.0,greatest(0.0,quantile_cont(p_trend,0.1))) AS follow, least(1.0,greatest(0.0,quantile_cont(p_trend,0.9))) AS fade FROM er GROUP BY symbol) " + out("r", "symbol", "follow, fade"),
)
def regime_exit(spark, sf_dir):
    p = ft.efficiency_regime(bars(spark, sf_dir))
    a = ev.exit_threshold(p, ["symbol"]).withColumnRenamed("threshold", "follow")
    return a.join(ev.exit_threshold(p, ["symbol"], mode="fade").withColumnRenamed("threshold", "fade"), "symbol")


# --- labels -----------------------------------------------------------------------------------

BAR_SQL = f"""{EVS}, {ER}, e0 AS (SELECT ce.symbol, ce.bar_idx AS t0, CAST(ce.raw_dir AS INT) AS side, b.close AS entry, p_trend AS pt, p_chop AS pc, greatest(b.atr_14/b.close*0.3,1e-6) AS sg FROM ce JOIN b USING (symbol,bar_idx) JOIN er USING (symbol,bar_idx)),
e1 AS (SELECT *, entry*(1+side*(pc*1.5+pt*3)*sg) AS tp, entry*(1-side*((pc*1.5+pt*2)*sg+0.0004)) AS sl FROM e0)"""


def barrier_events(spark, sf_dir):
    b, e = triggers(spark, sf_dir)
    j = e.join(b, ["symbol", "bar_idx"]).join(ft.efficiency_regime(b), ["symbol", "bar_idx"])
    tp, sl = ev.barriers(F.col("close"), F.col("raw_dir"), F.col("p_trend"), F.col("p_chop"), F.col("atr_14") / F.col("close") * 0.3, F.lit(False))
    return b, j.select("symbol", F.col("bar_idx").alias("t0"), F.col("raw_dir").alias("side"), F.col("close").alias("entry"), tp.alias("tp"), sl.alias("sl"), "p_trend", "p_chop", "atr_14", "ts_ms")


@query("dynamic_barriers", f"{BAR_SQL} " + out("e1", "symbol, t0, side", "entry, tp, sl"))
def dynamic_barriers(spark, sf_dir):
    return barrier_events(spark, sf_dir)[1].select("symbol", "t0", "side", "entry", "tp", "sl")


LAB = f"""{BAR_SQL}, p AS (SELECT e1.*, y.bar_idx-t0 AS k, y.high, y.low, y.close AS pc_ FROM e1 JOIN b y ON y.symbol=e1.symbol AND y.bar_idx BETWEEN t0+1 AND t0+20),
l0 AS (SELECT symbol, t0, any_value(side) AS side, any_value(entry) AS entry, any_value(tp) AS tp, any_value(sl) AS sl, min(k) FILTER ((side>0 AND low<=sl) OR (side<0 AND high>=sl)) AS ks, min(k) FILTER ((side>0 AND high>=tp) OR (side<0 AND low<=tp)) AS kt, max(k) AS ke, arg_max(pc_,k) AS lc FROM p GROUP BY symbol, t0),
l1 AS (SELECT *, CASE WHEN ks IS NOT NULL AND (kt IS NULL OR ks<=kt) THEN 'SL' WHEN kt IS NOT NULL THEN 'TP' ELSE 'TIME' END AS hit_barrier FROM l0),
l2 AS (SELECT *, CASE hit_barrier WHEN 'SL' THEN sl WHEN 'TP' THEN tp ELSE lc END AS exit_price, t0+CASE hit_barrier WHEN 'SL' THEN ks WHEN 'TP' THEN kt ELSE ke END AS t1 FROM l1),
lb AS (SELECT *, side*(exit_price-entry)/entry AS realized_return, CASE hit_barrier WHEN 'SL' THEN 0 WHEN 'TP' THEN 1 ELSE CASE WHEN side*(exit_price-entry)/entry>0 THEN 1 ELSE 0 END END AS label FROM l2)"""


def labelled(spark, sf_dir):
    b, e = barrier_events(spark, sf_dir)
    return b, ev.triple_barrier(e, b)


@query("triple_barrier_labels", f"{LAB} " + out("lb", "symbol, t0, t1, side, label, hit_barrier", "realized_return, exit_price"))
def triple_barrier(spark, sf_dir):
    return labelled(spark, sf_dir)[1]


CON = f"""{LAB}, dl AS (SELECT symbol, bar_idx, sum(d) AS d FROM (SELECT symbol, t0 AS bar_idx, 1 AS d FROM lb UNION ALL SELECT symbol, t1+1, -1 FROM lb) GROUP BY 1,2),
cn AS (SELECT b.symbol, b.bar_idx, CAST(coalesce(sum(d) OVER (PARTITION BY b.symbol ORDER BY b.bar_idx),0) AS BIGINT) AS c FROM b LEFT JOIN dl USING (symbol,bar_idx))"""


@query("concurrent_events", f"{CON} SELECT symbol, bar_idx, c FROM cn")
def concurrent(spark, sf_dir):
    b, l = labelled(spark, sf_dir)
    return ev.concurrency(l, b)


UNI = f"{CON}, un AS (SELECT lb.symbol, lb.t0, lb.t1, any_value(lb.realized_return) AS realized_return, avg(1.0/cn.c) AS uniqueness FROM lb JOIN cn ON cn.symbol=lb.symbol AND cn.bar_idx BETWEEN lb.t0 AND lb.t1 GROUP BY 1,2,3)"


def unique(spark, sf_dir):
    b, l = labelled(spark, sf_dir)
    return ev.average_uniqueness(l, ev.concurrency(l, b))


@query("average_uniqueness", f"{UNI} " + out("un", "symbol, t0, t1", "uniqueness"))
def average_uniqueness(spark, sf_dir):
    return unique(spark, sf_dir).select("symbol", "t0", "t1", "uniqueness")


@query("sample_weights", f"{UNI}, w AS (SELECT symbol, t0, CASE WHEN sum(abs(realized_return)*uniqueness) OVER (PARTITION BY symbol)>0 THEN abs(realized_return)*uniqueness*count(*) OVER (PARTITION BY symbol)/sum(abs(realized_return)*uniqueness) OVER (PARTITION BY symbol) ELSE 1.0 END AS weight FROM un) " + out("w", "symbol, t0", "weight"))
def sample_weights(spark, sf_dir):
    return ev.sample_weights(unique(spark, sf_dir)).select("symbol", "t0", "weight")


# --- exits ---------------------------------------------------------------------------------------

EX = """x0 AS (SELECT e1.symbol, e1.t0, e1.side, e1.entry, e1.sl, e1.entry*(1-e1.side*0.3) AS liq, {fe} AS fe FROM e1),
xp AS (SELECT x0.*, y.bar_idx-t0 AS k, y.high, y.low, y.atr_14, er.p_trend AS fp FROM x0 JOIN b y ON y.symbol=x0.symbol AND y.bar_idx BETWEEN t0+1 AND t0+40 AND y.bar_idx<fe JOIN er ON er.symbol=y.symbol AND er.bar_idx=y.bar_idx),
xq AS (SELECT *, CASE WHEN side>0 THEN greatest(entry,max(high) OVER pr) ELSE least(entry,min(low) OVER pr) END AS ex FROM xp WINDOW pr AS (PARTITION BY symbol,t0 ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
xr AS (SELECT *, CASE WHEN side>0 THEN greatest(ex*exp(-2.0*(1+0.75*fp)*greatest(atr_14,0.001,entry*0.001)/ex),sl) ELSE least(ex*exp(2.0*(1+0.75*fp)*greatest(atr_14,0.001,entry*0.001)/ex),sl) END AS tr, fp<0.2 AND coalesce(lag(fp) OVER (PARTITION BY symbol,t0 ORDER BY k)<0.2,false) AS fl FROM xq),
xs AS (SELECT *, CASE WHEN (side>0 AND low<=liq) OR (side<0 AND high>=liq) THEN 'LIQUIDATION' WHEN (side>0 AND low<=sl) OR (side<0 AND high>=sl) THEN 'SL' WHEN (side>0 AND low<=tr) OR (side<0 AND high>=tr) THEN 'TRAIL' WHEN fl THEN 'REGIME_FLIP' END AS rs FROM xr),
xg AS (SELECT symbol, t0, min(k) FILTER (rs IS NOT NULL) AS kk, arg_min(rs,k) FILTER (rs IS NOT NULL) AS rr, max(k) AS n FROM xs GROUP BY symbol, t0),
xx AS (SELECT x0.symbol, x0.t0, CAST(coalesce(kk-1, greatest(least(40, {ah}, coalesce(n,0))-1,0)) AS INT) AS exit_rel, coalesce(rr,'TIME_STOP') AS exit_reason, rr IS NULL AND (coalesce(n,0)<40 OR least(40,{ah})<40) AS boundary_truncated FROM x0 LEFT JOIN xg USING (symbol,t0))"""


def exit_events(spark, sf_dir):
    b, e = barrier_events(spark, sf_dir)
    b = b.join(ft.efficiency_regime(b), ["symbol", "bar_idx"])
    e = e.select("symbol", "t0", "side", "entry", "sl", (F.col("entry") * (1 - F.col("side") * 0.3)).alias("liq"), F.lit("follow").alias("mode"), F.lit(0.2).alias("thr"))
    return b, e


@query("trailing_exit", f"{BAR_SQL}, {EX.format(fe='1000000000', ah='40')} SELECT *, CAST(t0+1+exit_rel AS INT) AS exit_idx FROM xx")
def trailing_exit(spark, sf_dir):
    b, e = exit_events(spark, sf_dir)
    return ev.trailing_exit(e, b, 40).select("symbol", "t0", "exit_rel", "exit_reason", "boundary_truncated", "exit_idx")


@query("fold_bounded_exit", f"{BAR_SQL}, {EX.format(fe='(t0//60+1)*60', ah='greatest(fe-(t0+1),0)')} SELECT *, CAST(t0+1+exit_rel AS INT) AS exit_idx FROM xx")
def fold_bounded_exit(spark, sf_dir):
    b, e = exit_events(spark, sf_dir)
    e = e.withColumn("fold_end", (F.floor(F.col("t0") / 60) + 1) * 60)
    return ev.trailing_exit(e, b, 40, fold_end="fold_end").select("symbol", "t0", "exit_rel", "exit_reason", "boundary_truncated", "exit_idx")


@query(
    "limit_fill_with_queue",
    f"""{EVS}, o AS (SELECT ce.symbol, ce.bar_idx AS t0, raw_dir AS side, close*(1-raw_dir*0.001) AS lp, volume AS queue, 100.0 AS size FROM ce JOIN b USING (symbol,bar_idx)),
 q AS (SELECT o.*, y.bar_idx-t0 AS k, (side>0 AND y.low<=lp) OR (side<0 AND y.high>=lp) AS tch, y.volume FROM o JOIN b y ON y.symbol=o.symbol AND y.bar_idx BETWEEN t0+1 AND t0+5),
 r AS (SELECT *, sum(CASE WHEN tch THEN volume ELSE 0 END) OVER (PARTITION BY symbol,t0 ORDER BY k) AS cv FROM q),
 g AS (SELECT symbol, t0, min(k) FILTER (tch AND cv>=queue+size) AS f, max(queue+size) AS required_volume, count(*) AS n, min(cv) FILTER (tch AND cv>=queue+size) AS vf, max(cv) AS va FROM r GROUP BY 1,2),
 z AS (SELECT symbol, t0, f IS NOT NULL AS filled, CAST(coalesce(f,-1) AS INT) AS fill_bar, coalesce(vf,va) AS processed_volume, required_volume, f IS NULL AND n>=5 AS timeout_reached FROM g) """ + out("z", "symbol, t0, filled, fill_bar, timeout_reached", "processed_volume, required_volume"),
)
def limit_fill(spark, sf_dir):
    b, e = triggers(spark, sf_dir)
    o = e.join(b, ["symbol", "bar_idx"]).select("symbol", F.col("bar_idx").alias("t0"), F.col("raw_dir").alias("side"), (F.col("close") * (1 - F.col("raw_dir") * 0.001)).alias("limit_price"), F.col("volume").alias("queue"), F.lit(100.0).alias("size"))
    return ev.limit_fill(o, b)


# --- folds ---------------------------------------------------------------------------------------

PK = """f0 AS (SELECT symbol, t0, t1, ntile(5) OVER (PARTITION BY symbol ORDER BY t0)-1 AS own_fold FROM lb),
f1 AS (SELECT symbol, own_fold AS fold, min(t0) AS s, max(t1) AS e FROM f0 GROUP BY 1,2),
pk AS (SELECT f0.*, f1.fold, s, e, CASE WHEN own_fold=f1.fold THEN 'test' WHEN own_fold<f1.fold AND t1<=s THEN 'train' WHEN own_fold>f1.fold AND t0>e+24 THEN 'train' ELSE 'dropped' END AS role FROM f0 JOIN f1 ON f0.symbol=f1.symbol)"""


@query("purged_kfold", f"{LAB}, {PK} SELECT symbol, t0, t1, CAST(own_fold AS INT) AS own_fold, CAST(fold AS INT) AS fold, role FROM pk")
def purged_kfold(spark, sf_dir):
    l = labelled(spark, sf_dir)[1].select("symbol", "t0", "t1")
    return ev.purged_kfold(l)


@query("purge_audit", f"{LAB}, {PK} SELECT symbol, CAST(fold AS INT) AS fold, count(*) FILTER ((own_fold<fold AND t1>s) OR (own_fold>fold AND t0<e+24)) AS violations FROM pk WHERE role='train' GROUP BY 1,2")
def purge_audit(spark, sf_dir):
    l = labelled(spark, sf_dir)[1].select("symbol", "t0", "t1")
    return ev.purge_violations(ev.purged_kfold(l), 24)


@query(
    "combinatorial_purged_cv",
    f"""{LAB}, g0 AS (SELECT symbol, t0, t1, ntile(6) OVER (PARTITION BY symbol ORDER BY t0)-1 AS own_group FROM lb), g1 AS (SELECT symbol, own_group AS g, min(t0) AS s, arg_max(t1,t0) AS e FROM g0 GROUP BY 1,2),
 cb AS (SELECT row_number() OVER (ORDER BY a.i, c.i)-1 AS fold, a.i AS ga, c.i AS gb FROM (SELECT unnest(range(6)) AS i) a JOIN (SELECT unnest(range(6)) AS i) c ON a.i<c.i),
 q AS (SELECT g0.*, fold, ga, gb, NOT (t1<=x.s OR t0>=x.e) OR (t0>=x.e AND t0<x.e+24) OR NOT (t1<=y.s OR t0>=y.e) OR (t0>=y.e AND t0<y.e+24) AS bad FROM g0 CROSS JOIN cb LEFT JOIN g1 x ON x.symbol=g0.symbol AND x.g=ga LEFT JOIN g1 y ON y.symbol=g0.symbol AND y.g=gb)
 SELECT symbol, t0, t1, CAST(own_group AS INT) AS own_group, CAST(fold AS INT) AS fold, CASE WHEN own_group IN (ga,gb) THEN 'test' WHEN bad THEN 'dropped' ELSE 'train' END AS role FROM q""",
)
def cpcv(spark, sf_dir):
    return ev.combinatorial_purged(labelled(spark, sf_dir)[1].select("symbol", "t0", "t1"))


# --- funding ----------------------------------------------------------------------------------------

HOLD = f"""{LAB}, tr AS (SELECT lb.symbol, lb.t0, lb.side, x.ts_ms AS entry_ts, y.ts_ms AS exit_ts FROM lb JOIN b x ON x.symbol=lb.symbol AND x.bar_idx=lb.t0 JOIN b y ON y.symbol=lb.symbol AND y.bar_idx=lb.t1)"""
_DAY24 = 24 * 3_600_000


def held(spark, sf_dir):
    b, l = labelled(spark, sf_dir)
    t = lambda k, n: b.select("symbol", F.col("bar_idx").alias(k), F.col("ts_ms").alias(n))
    j = l.join(t("t0", "entry_ts"), ["symbol", "t0"]).join(t("t1", "exit_ts"), ["symbol", "t1"])
    return b, j.select("symbol", "t0", "side", "entry_ts", "exit_ts", F.lit(10000.0).alias("size_notional"))


@query("funding_settlements", f"{HOLD} SELECT symbol, t0, exit_ts//28800000 - entry_ts//28800000 AS n_settlements FROM tr")
def settlements(spark, sf_dir):
    t = held(spark, sf_dir)[1]
    return t.select("symbol", "t0", F.size(ev.settlements(F.col("entry_ts"), F.col("exit_ts"))).cast("long").alias("n_settlements"))


@query("funding_accrued_flat", f"{HOLD}, r AS (SELECT symbol, t0, (exit_ts//28800000 - entry_ts//28800000)*10000*0.0001*side AS funding_usd FROM tr) " + out("r", "symbol, t0", "funding_usd"))
def funding_flat(spark, sf_dir):
    return ev.funding_accrued(held(spark, sf_dir)[1]).select("symbol", "t0", "funding_usd")


@query(
    "funding_accrued_schedule",
    f"{HOLD}, r AS (SELECT tr.symbol, tr.t0, coalesce(sum(least(0.0075,greatest(-0.0075,b.funding))),0)*10000*any_value(tr.side) AS funding_usd FROM tr LEFT JOIN b ON b.symbol=tr.symbol AND b.ts_ms>tr.entry_ts AND b.ts_ms<=tr.exit_ts AND b.ts_ms%{_DAY24}=0 GROUP BY 1,2) " + out("r", "symbol, t0", "funding_usd"),
)
def funding_schedule(spark, sf_dir):
    b, t = held(spark, sf_dir)
    rates = b.select("symbol", "ts_ms", F.col("funding").alias("rate"))
    return ev.funding_accrued(t, rates, hours=24).select("symbol", "t0", "funding_usd")
