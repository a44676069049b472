"""Queries over tick cleaning, thresholds and dollar bars (ticks per supplier)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import ticks as tk
from barloom.plans.registry import TICKS_SUPP, out, query
from barloom.plans.signal_queries import PREP
from barloom.sources import tables as tb

WIN = 20  # suppliers have a few hundred ticks at the smallest scale
DAYS30 = 30 * 86_400_000
FREQ = 0.2

NUM = f"WITH RECURSIVE {TICKS_SUPP}, tk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms, seq)-1 AS pos FROM ticks)"


def mad_sql(src: str, dst: str, extra: str = "") -> str:
    f = f"(PARTITION BY symbol ORDER BY pos ROWS BETWEEN {WIN} PRECEDING AND 1 PRECEDING)"
    return f"""{dst}_0 AS (SELECT *, list(price) OVER f AS l, quantile_cont(price,0.5) OVER f AS m {extra} FROM {src} WINDOW f AS {f}),
{dst} AS (SELECT * EXCLUDE (l,m), CASE WHEN len(l)={WIN} THEN 1.4826*list_aggregate(list_transform(l, lambda x: abs(x-m)),'median') END AS sigma FROM {dst}_0)"""


def numbered(spark, sf_dir):
    return tk.numbered(tb.ticks_by_supplier(spark, sf_dir))


@query("compute_rolling_mad", f"{NUM}, {mad_sql('tk', 'md')} " + out("md", "symbol, pos", "sigma"))
def rolling_mad(spark, sf_dir):
    return tk.rolling_mad(numbered(spark, sf_dir), WIN).select("symbol", "pos", "sigma")


FLAG = mad_sql("tk", "fl0", ", quantile_cont(volume,0.5) OVER f AS vm, lag(price) OVER (PARTITION BY symbol ORDER BY pos) AS p0, lead(price) OVER (PARTITION BY symbol ORDER BY pos) AS p1") + f""",
fl1 AS (SELECT *, pos>={WIN} AND p1 IS NOT NULL AND sigma>0 AND abs(price-p0)>5*sigma AS big, volume<2*vm AS thin, abs(p1-p0)<0.3*abs(price-p0) AS rev FROM fl0),
fl AS (SELECT *, coalesce(big AND thin AND rev,false) AS is_bad, coalesce(big AND NOT thin,false) AS is_tail FROM fl1)"""


@query("detect_bad_tick_core", f"{NUM}, {FLAG} " + out("fl", "symbol, pos, is_bad, is_tail", "sigma"))
def bad_tick_core(spark, sf_dir):
    return tk.flag_ticks(numbered(spark, sf_dir), WIN).select("symbol", "pos", "is_bad", "is_tail", "sigma")


def venues(spark, sf_dir):
    """Open lines are the venue, finished lines the other venue of the same supplier."""
    li = tb.read(spark, sf_dir, "lineitem")
    cols = (
        F.col("l_suppkey").alias("symbol"), tb.epoch_ms("l_shipdate").alias("ts_ms"), F.expr(tb.SEQ).alias("seq"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("volume"),
    )
    return li.filter("l_linestatus = 'O'").select(*cols), li.filter("l_linestatus = 'F'").select(*cols)


VEN = f"""WITH {TICKS_SUPP}, tk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms, seq)-1 AS pos FROM ticks WHERE l_linestatus='O'),
rf0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms, seq)-1 AS pos FROM ticks WHERE l_linestatus='F'), {mad_sql('rf0', 'rf')}, {FLAG},
an AS (SELECT t.symbol, t.pos, arg_max(r.price, (r.ts_ms, r.seq)) AS ap, arg_max(r.pos, (r.ts_ms, r.seq)) AS ai FROM tk t JOIN rf r ON r.symbol=t.symbol AND r.ts_ms<=t.ts_ms GROUP BY 1,2),
wd AS (SELECT t.symbol, t.pos, max(r.price) AS hi, min(r.price) AS lo FROM tk t JOIN rf r ON r.symbol=t.symbol AND r.ts_ms BETWEEN t.ts_ms-{DAYS30} AND t.ts_ms+{DAYS30} GROUP BY 1,2),
cv AS (SELECT t.symbol, t.pos, coalesce(s.sigma>0 AND greatest(hi-ap, ap-lo)<2*s.sigma, false) AS confirmed FROM tk t LEFT JOIN an USING (symbol,pos) LEFT JOIN wd USING (symbol,pos) LEFT JOIN rf s ON s.symbol=t.symbol AND s.pos=an.ai)"""


@query("detect_bad_tick_cross_venue", f"{VEN} SELECT * FROM cv")
def cross_venue(spark, sf_dir):
    main, ref = venues(spark, sf_dir)
    r = tk.rolling_mad(tk.numbered(ref), WIN)
    q = tk.cross_venue(tk.numbered(main), r, DAYS30, 2.0, block_ms=4 * DAYS30)
    return q.select("symbol", "pos", "confirmed")


@query("filter_outliers_4_conditions", f"{VEN} SELECT fl.symbol, fl.pos, is_bad AND confirmed AS is_bad, is_tail FROM fl JOIN cv USING (symbol,pos)")
def filter_outliers(spark, sf_dir):
    main, ref = venues(spark, sf_dir)
    q = tk.filter_outliers(tk.numbered(main), ref, WIN, DAYS30, 2.0, block_ms=4 * DAYS30)
    return q.select("symbol", "pos", "is_bad", "is_tail")


# level/trend filter written as a recursive query; prediction (xp..dp) then update
KAL = """rec AS (SELECT symbol, pos, price AS clean, price AS x, 0::DOUBLE AS v, 1::DOUBLE AS a, 0::DOUBLE AS b, 1::DOUBLE AS d FROM fl WHERE pos=0
 UNION ALL SELECT symbol, pos, CASE WHEN is_bad THEN xp ELSE price END, CASE WHEN is_bad THEN xp ELSE xp+ap/(ap+0.01)*(price-xp) END, CASE WHEN is_bad THEN vp ELSE vp+bp/(ap+0.01)*(price-xp) END,
  CASE WHEN is_bad THEN ap ELSE (1-ap/(ap+0.01))*ap END, CASE WHEN is_bad THEN bp ELSE (1-ap/(ap+0.01))*bp END, CASE WHEN is_bad THEN dp ELSE dp-bp/(ap+0.01)*bp END
 FROM (SELECT f.symbol, f.pos, f.price, f.is_bad, r.x+r.v AS xp, r.v AS vp, r.a+2*r.b+r.d+1e-4 AS ap, r.b+r.d AS bp, r.d+1e-5 AS dp FROM rec r JOIN fl f ON f.symbol=r.symbol AND f.pos=r.pos+1))"""


@query("clean_tick_stream", f"{NUM}, {FLAG}, {KAL}, c AS (SELECT symbol, pos, clean AS clean_price, x AS level, v AS trend FROM rec) " + out("c", "symbol, pos", "clean_price, level, trend"))
def clean_stream(spark, sf_dir):
    return tk.clean_ticks(tb.ticks_by_supplier(spark, sf_dir), None, WIN).select("symbol", "pos", "clean_price", "level", "trend")


@query(
    "classify_tick_rule",
    f"""{NUM}, a AS (SELECT symbol, pos, nullif(sign(price-lag(price) OVER (PARTITION BY symbol ORDER BY pos)),0) AS d FROM tk),
 b AS (SELECT symbol, pos, CAST(coalesce(last_value(d IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY pos), first_value(d IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS DOUBLE) AS sign FROM a) SELECT * FROM b""",
)
def tick_rule(spark, sf_dir):
    return tk.tick_sign(numbered(spark, sf_dir)).select("symbol", "pos", "sign")


@query(
    "compute_rolling_ofi",
    f"""WITH {PREP}, b AS (SELECT symbol, ts_ms, close, volume, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms) AS i FROM bars),
 w AS (SELECT x.symbol, x.i, x.ts_ms, y.i AS j, y.volume, CASE WHEN y.i>x.i-13 THEN nullif(sign(y.close-z.close),0) END AS d FROM b x JOIN b y ON y.symbol=x.symbol AND y.i BETWEEN x.i-13 AND x.i LEFT JOIN b z ON z.symbol=y.symbol AND z.i=y.i-1 WHERE x.i>=14),
 s AS (SELECT *, coalesce(last_value(d IGNORE NULLS) OVER (PARTITION BY symbol,i ORDER BY j), first_value(d IGNORE NULLS) OVER (PARTITION BY symbol,i ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS sg FROM w),
 o AS (SELECT symbol, ts_ms, sum(sg*volume)/sum(volume) AS window_ofi FROM s GROUP BY symbol, ts_ms),
 r AS (SELECT b.symbol, b.ts_ms, window_ofi FROM b LEFT JOIN o USING (symbol, ts_ms)) """ + out("r", "symbol, ts_ms", "window_ofi"),
)
def rolling_ofi(spark, sf_dir):
    bars = tb.bucket_bars(spark, sf_dir, tb.week_bucket)
    return tk.window_ofi(bars).select("symbol", "ts_ms", "window_ofi")


DAILY = "dl AS (SELECT symbol, ts_ms//86400000 AS day, sum({p}*volume) AS dollar_volume, min(ts_ms) AS ts_ms FROM {src} GROUP BY 1,2)"


@query("daily_dollar_volume", f"{NUM}, {DAILY.format(p='price', src='tk')} " + out("dl", "symbol, day, ts_ms", "dollar_volume"))
def daily_volume(spark, sf_dir):
    return tk.daily_dollar_volume(tb.ticks_by_supplier(spark, sf_dir))


THETA = f"""th0 AS (SELECT *, lag(dollar_volume) OVER (PARTITION BY symbol ORDER BY day) AS pv FROM dl),
th AS (SELECT symbol, day, CASE WHEN count(pv) OVER f={WIN} THEN avg(pv) OVER f END/{FREQ} AS theta FROM th0 WINDOW f AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN {WIN - 1} PRECEDING AND CURRENT ROW))"""


@query("pit_daily_threshold", f"{NUM}, {DAILY.format(p='price', src='tk')}, {THETA} " + out("th", "symbol, day", "theta"))
def pit_threshold(spark, sf_dir):
    d = tk.daily_dollar_volume(tb.ticks_by_supplier(spark, sf_dir))
    return tk.daily_threshold(d, WIN, FREQ).select("symbol", "day", "theta")


MAPPED = """mt0 AS (SELECT t.*, th.theta AS t0 FROM {src} t LEFT JOIN th ON th.symbol=t.symbol AND th.day=t.ts_ms//86400000),
mt AS (SELECT * EXCLUDE (t0), coalesce(t0, quantile_cont(t0,0.1) OVER (PARTITION BY symbol), 1e6) AS theta FROM mt0)"""


@query("map_daily_threshold_to_ticks", f"{NUM}, {DAILY.format(p='price', src='tk')}, {THETA}, {MAPPED.format(src='tk')} " + out("mt", "symbol, pos", "theta"))
def map_threshold(spark, sf_dir):
    raw = tb.ticks_by_supplier(spark, sf_dir)
    th = tk.daily_threshold(tk.daily_dollar_volume(raw), WIN, FREQ)
    return tk.map_threshold(tk.numbered(raw), th).select("symbol", "pos", "theta")


# bars: the accumulator runs as a recursive query, everything else is aggregation
BARS = """acc AS (SELECT symbol, pos, {p}*volume AS s, {p}*volume>=theta AS closes FROM mt WHERE pos=0
 UNION ALL SELECT m.symbol, m.pos, CASE WHEN r.closes THEN 0 ELSE r.s END + m.{p}*m.volume, CASE WHEN r.closes THEN 0 ELSE r.s END + m.{p}*m.volume>=m.theta FROM acc r JOIN mt m ON m.symbol=r.symbol AND m.pos=r.pos+1),
br0 AS (SELECT m.*, a.closes, coalesce(sum(CASE WHEN a.closes THEN 1 ELSE 0 END) OVER (PARTITION BY m.symbol ORDER BY m.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS bar,
  coalesce(last_value(nullif(sgn,0) IGNORE NULLS) OVER (PARTITION BY m.symbol ORDER BY m.pos),1) AS sign FROM (SELECT *, sign({p}-lag({p}) OVER (PARTITION BY symbol ORDER BY pos)) AS sgn FROM mt) m JOIN acc a USING (symbol,pos)),
br1 AS (SELECT symbol, CAST(bar AS BIGINT) AS bar_idx, arg_max(ts_ms,pos) AS ts_ms, arg_min({p},pos) AS open, max({p}) AS high, min({p}) AS low, arg_max({p},pos) AS close, sum(volume) AS volume, sum(CASE WHEN sign>0 THEN 1 ELSE -1 END*{p}*volume)/(sum({p}*volume)+1e-8) AS ofi, count(*) AS tick_count, bool_or({tail}) AS is_tail_event FROM br0 GROUP BY symbol, bar HAVING bool_or(closes)),
br2 AS (SELECT *, lag(tick_count::DOUBLE) OVER (PARTITION BY symbol ORDER BY bar_idx) AS c FROM br1),
br3 AS (SELECT *, CASE WHEN count(c) OVER f=20 THEN quantile_cont(c,0.5) OVER f END AS median_ticks FROM br2 WINDOW f AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
br AS (SELECT *, coalesce(tick_count<0.5*median_ticks AND median_ticks>10,false) AS is_toxic_flag FROM br3)"""
_RAW = f"{NUM}, {DAILY.format(p='price', src='tk')}, {THETA}, {MAPPED.format(src='tk')}, {BARS.format(p='price', tail='false')}"
_BK, _BV = "symbol, bar_idx, ts_ms, tick_count, is_toxic_flag, is_tail_event", "open, high, low, close, volume, ofi"


@query("dollar_volume_bars", f"{_RAW} " + out("br", _BK, _BV + ", median_ticks"))
def dollar_bars(spark, sf_dir):
    raw = tb.ticks_by_supplier(spark, sf_dir)
    th = tk.daily_threshold(tk.daily_dollar_volume(raw), WIN, FREQ)
    return tk.dollar_bars(tk.map_threshold(tk.numbered(raw), th), "price", 20)


@query("median_ticks_to_fill", f"{_RAW} " + out("br", "symbol, bar_idx, tick_count", "median_ticks"))
def median_ticks(spark, sf_dir):
    raw = tb.ticks_by_supplier(spark, sf_dir)
    th = tk.daily_threshold(tk.daily_dollar_volume(raw), WIN, FREQ)
    return tk.dollar_bars(tk.map_threshold(tk.numbered(raw), th), "price", 20).select("symbol", "bar_idx", "tick_count", "median_ticks")


_CLEANED = f"{NUM}, {FLAG}, {KAL}, ct AS (SELECT fl.symbol, fl.pos, fl.ts_ms, fl.volume, fl.is_tail, rec.clean AS clean_price FROM fl JOIN rec USING (symbol,pos)), {DAILY.format(p='clean_price', src='ct')}, {THETA}, {MAPPED.format(src='ct')}, {BARS.format(p='clean_price', tail='is_tail')}"


@query("build_clean_dollar_bars", f"{_CLEANED} " + out("(SELECT *, bar_idx<20 AS insufficient_history FROM br)", _BK + ", insufficient_history", _BV))
def clean_dollar_bars(spark, sf_dir):
    b = tk.build_dollar_bars(tb.ticks_by_supplier(spark, sf_dir), None, WIN, FREQ, 20)
    return b.select(*[c.strip() for c in (_BK + ", insufficient_history, " + _BV).split(",")])


@query(
    "kalman_gap_projection",
    f"""{NUM}, {FLAG}, {KAL}, g AS (SELECT symbol, pos, x, v, a, b, d, (lead(ts_ms) OVER (PARTITION BY symbol ORDER BY pos)-ts_ms)//86400000 AS n FROM rec JOIN tk USING (symbol, pos)),
 r AS (SELECT symbol, pos, n, x+n*v AS level_n, v AS trend_n, a+2*n*b+n*n*d+n*1e-4+1e-5*(n-1)*n*(2*n-1)/6 AS p00_n, b+n*d+1e-5*n*(n-1)/2 AS p01_n, d+n*1e-5 AS p11_n FROM g WHERE n>1) """ + out("r", "symbol, pos, n", "level_n, trend_n, p00_n, p01_n, p11_n"),
)
def gap_projection(spark, sf_dir):
    """The filter's state carried over the days without a tick, per supplier."""
    from pyspark.sql import Window

    from barloom.operators.ordered import blocked

    clean = tk.clean_ticks(tb.ticks_by_supplier(spark, sf_dir), None, WIN)
    b = blocked(clean, before=0, after=1)
    o = Window.partitionBy("symbol", "blk").orderBy("pos")
    g = b.withColumn("n", F.floor((F.lead("ts_ms").over(o) - F.col("ts_ms")) / tb.DAY_MS)).filter("own and n > 1 and p00 is not null")
    state = [F.col(c) for c in ("level", "trend", "p00", "p01", "p11")]
    return g.select("symbol", "pos", "n", *[c.alias(k) for k, c in tk.gap_projection(*state, F.col("n")).items()])
