"""Streaming queries over the event table: read as a stream, drained, read back.

Keys are users, the event value is the price (orders: the filled quantity); each has the batch
recursion as SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barloom.operators import ledger as lg
from barloom.plans.registry import imm_sql, out, query
from barloom.session import checkpoint_dir, pin_utc
from barloom.sources import tables as tb
from barloom.streaming import stateful as sf


def source(spark, sf_dir):
    pin_utc(spark)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a glob, because a file stream watches a folder or a pattern
    e = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{sf_dir}/events*.parquet")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def stream(spark, sf_dir):
    e = source(spark, sf_dir)
    ts = F.unix_micros("ts")
    v = F.col("value")
    return e.select(
        F.col("user_id").alias("symbol"), ts.alias("ts_us"), (v + 100.0).alias("close"), (v + 101.0).alias("high"), (v + 99.0).alias("low"),
        (v + 100.0).alias("open"), (F.col("event_id") % 50 + 1.0).alias("volume"), ((F.col("event_id") % 21 - 10) / 10.0).alias("ofi"),
        F.lit(2.0).alias("atr_14"), (F.col("event_id") % 10 / 10.0).alias("p_trend"), F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "click", -1).otherwise(0).alias("signal"),
        (v + 100.0 + F.col("event_id") % 3 - 1.0).alias("opened"), ((F.col("event_id") % 7 - 3) / 10000.0).alias("funding_rate"), (F.col("event_id") % 97 == 0).alias("flatten"),
        ((F.col("event_id") % 41 - 20) / 500.0).alias("lr"), (F.col("event_id") % 4 / 4.0).alias("p_chop"),
    )


def run(spark, sf_dir, op):
    path = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    return sf.drain(op(stream(spark, sf_dir)), path)


E = "WITH RECURSIVE e AS (SELECT user_id AS symbol, epoch_us(ts) AS ts_us, value+100.0 AS close, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts)-1 AS i FROM events)"


@query(
    "stream_efficiency_regime",
    f"""{E}, a AS (SELECT symbol, ts_us, i, close, CASE WHEN i>=2 THEN least(1.0,abs(close-coalesce(lag(close,20) OVER o, first_value(close) OVER o))/nullif(sum(dc) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),0)) END AS er FROM (SELECT *, abs(close-lag(close) OVER o) AS dc FROM e WINDOW o AS (PARTITION BY symbol ORDER BY i)) WINDOW o AS (PARTITION BY symbol ORDER BY i)),
 r AS (SELECT symbol, i, coalesce(er,0) AS p FROM a WHERE i=2 UNION ALL SELECT a.symbol, a.i, 0.3*coalesce(a.er,0)+0.7*r.p FROM r JOIN a ON a.symbol=r.symbol AND a.i=r.i+1),
 q AS (SELECT a.symbol, a.ts_us, coalesce(r.p,0.5) AS p_trend, 1-coalesce(r.p,0.5) AS p_chop, false AS late FROM a LEFT JOIN r USING (symbol,i)) """ + out("q", "symbol, ts_us, late", "p_trend, p_chop"),
)
def stream_efficiency(spark, sf_dir):
    return run(spark, sf_dir, lambda s: sf.efficiency(s, ts="ts_us"))


@query(
    "stream_cusum_triggers",
    f"""{E}, c AS (SELECT symbol, i, ts_us, close, 0::DOUBLE AS up, 0::DOUBLE AS dn, NULL::BIGINT AS li, NULL::DOUBLE AS lp, 0 AS hit FROM e WHERE i=0
 UNION ALL SELECT symbol, i, ts_us, close, CASE WHEN sd<>0 THEN 0 ELSE u END, CASE WHEN sd<>0 THEN 0 ELSE d END, CASE WHEN ok THEN i ELSE li END, CASE WHEN ok THEN close ELSE lp END, CASE WHEN ok THEN sd ELSE 0 END FROM
 (SELECT *, sd<>0 AND (li IS NULL OR (i-li>=5 AND abs(close-lp)>=1.0)) AS ok FROM (SELECT *, CASE WHEN u>h THEN 1 WHEN d<-h THEN -1 ELSE 0 END AS sd FROM
 (SELECT y.symbol, y.i, y.ts_us, y.close, c.li, c.lp, greatest(4.0/y.close,1e-4) AS h, greatest(0,c.up+ln(y.close/c.close)) AS u, least(0,c.dn+ln(y.close/c.close)) AS d FROM c JOIN e y ON y.symbol=c.symbol AND y.i=c.i+1))))
 SELECT symbol, ts_us, CAST(hit AS INT) AS side, false AS late FROM c""",
)
def stream_cusum(spark, sf_dir):
    return run(spark, sf_dir, lambda s: sf.cusum(s, ts="ts_us"))


_F = "(PARTITION BY symbol ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@query(
    "stream_bar_features",
    f"""{E}, f0 AS (SELECT *, event_id%50+1.0 AS volume, (event_id%21-10)/10.0 AS ofi, (close-lag(close) OVER o)/lag(close) OVER o AS r, lag(close,5) OVER o AS c5 FROM e WINDOW o AS (PARTITION BY symbol ORDER BY i)),
 f AS (SELECT symbol, ts_us, false AS late, 2.0/close AS hl_spread, coalesce(r,0) AS ret_1, coalesce((close-c5)/c5,0) AS ret_5, volume/avg(volume) OVER w AS vol_ratio, 0.5 AS range_position, avg(ofi) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS ofi_ma5,
  CASE WHEN count(volume) OVER w<5 OR stddev_pop(volume) OVER w<=1e-12 THEN 0 ELSE (volume-avg(volume) OVER w)/stddev_pop(volume) OVER w END AS volume_z, CASE WHEN count(r) OVER w<5 OR stddev_pop(r) OVER w<=1e-12 THEN 0 ELSE r/stddev_pop(r) OVER w END AS ret_zscore FROM f0 WINDOW w AS {_F}) """
    + out("f", "symbol, ts_us, late", "hl_spread, ret_1, ret_5, vol_ratio, range_position, ofi_ma5, volume_z, ret_zscore"),
)
def stream_features(spark, sf_dir):
    return run(spark, sf_dir, lambda s: sf.bar_features(s, ts="ts_us"))


@query(
    "stream_drawdown_tiers",
    f"""{E}, d AS (SELECT symbol, i, ts_us, (max(close) OVER u-close)/max(close) OVER u AS dd FROM e WINDOW u AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 x AS (SELECT *, coalesce(bool_or(dd>=0.7) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),false) AS dead, max(CASE WHEN dd>=0.5 AND dd<0.7 THEN ts_us+86400000000 END) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fz FROM d),
 r AS (SELECT symbol, ts_us, false AS late, CASE WHEN dead THEN 'KILL' WHEN dd>=0.5 THEN 'FLATTEN' WHEN dd>=0.3 THEN 'REDUCE' ELSE 'NORMAL' END AS tier, CASE WHEN dead OR dd>=0.5 OR coalesce(ts_us<fz,false) THEN 0.0 WHEN dd>=0.3 THEN 0.5 ELSE 1.0 END AS multiplier, dd FROM x) """ + out("r", "symbol, ts_us, late, tier", "multiplier, dd"),
)
def stream_tiers(spark, sf_dir):
    return run(spark, sf_dir, lambda s: sf.drawdown_tiers(s, ts="ts_us", equity="close", t1=0.3, t2=0.5, t3=0.7, per_ms=1000))


_RULES = sf.ExitRules(m_sl=8.0, m_trail=12.0, t_max=6, flip_below=0.35, flips=2, per_ms=1000)
_STEP = _RULES.hours * 3_600_000_000
_MARGIN = _RULES.size / _RULES.leverage
_ROOM = 1 / _RULES.leverage - _RULES.mmr - _RULES.fee - _RULES.liq_fee - _RULES.expected_rate


@query(
    "stream_exit_state",
    f"""WITH RECURSIVE e AS (SELECT user_id AS symbol, epoch_us(ts) AS ts_us, value+100.0 AS c, value+101.0 AS h, value+99.0 AS l, value+99.0+event_id%3 AS o, event_id%10/10.0 AS p, (event_id%7-3)/10000.0 AS rate, event_id%97=0 AS flat,
  CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN -1 ELSE 0 END AS sig, row_number() OVER (PARTITION BY user_id ORDER BY ts)-1 AS i FROM events),
 q AS (SELECT *, c*exp(-sig*({_RULES.m_sl}*2.0/c+{_RULES.fee})) AS stop0, c*(1-sig*{_ROOM!r}) AS liq0 FROM e),
 y AS (SELECT *, sig<>0 AND NOT flat AS wants, {_RULES.m_sl}*2.0/c+{_RULES.fee}<=0.5 AND sig*(c-stop0)<=sig*(c-liq0)*{1 - _RULES.buffer!r} AS safe FROM q),
 r AS (SELECT symbol, -1::BIGINT AS i, 0::BIGINT AS ts_us, 0 AS side, 0::DOUBLE AS entry, 0::DOUBLE AS s0, 0::DOUBLE AS s, 0::DOUBLE AS liq, 0::DOUBLE AS ext, 0 AS weak, 0 AS age, 0::DOUBLE AS fund, '' AS action, NULL::DOUBLE AS price, NULL::DOUBLE AS stop, NULL::DOUBLE AS funding FROM y WHERE i=0
 UNION ALL SELECT symbol, yi, yts, CASE WHEN act='ENTRY' THEN sig WHEN act='HOLD' THEN side ELSE 0 END, CASE WHEN act='ENTRY' THEN c ELSE entry END, CASE WHEN act='ENTRY' THEN stop0 ELSE s0 END, CASE WHEN act='ENTRY' THEN stop0 ELSE s2 END, CASE WHEN act='ENTRY' THEN liq0 ELSE liq END, CASE WHEN act='ENTRY' THEN c ELSE e2 END, CASE WHEN act='HOLD' THEN w2 ELSE 0 END, CASE WHEN act='HOLD' THEN age+1 ELSE 0 END, CASE WHEN act='ENTRY' THEN 0 ELSE f2 END, act,
  CASE act WHEN 'ENTRY' THEN c WHEN 'LIQUIDATION' THEN liq WHEN 'SL' THEN fill WHEN 'TRAIL' THEN fill WHEN 'FLATTEN' THEN c*(1-side*{_RULES.slip}) WHEN 'TIME_STOP' THEN c WHEN 'REGIME_FLIP' THEN c END,
  CASE WHEN act='ENTRY' THEN stop0 WHEN act IN ('FLAT','UNSAFE') THEN NULL ELSE s2 END, CASE WHEN act='ENTRY' THEN 0 WHEN act IN ('FLAT','UNSAFE') THEN NULL ELSE f2 END FROM
 (SELECT *, CASE WHEN side=0 THEN CASE WHEN NOT wants THEN 'FLAT' WHEN safe THEN 'ENTRY' ELSE 'UNSAFE' END WHEN hit_liq THEN 'LIQUIDATION' WHEN hit_stop THEN CASE WHEN s=s0 THEN 'SL' ELSE 'TRAIL' END WHEN w2>={_RULES.flips} THEN 'REGIME_FLIP' WHEN age+1>={_RULES.t_max} THEN 'TIME_STOP' WHEN flat THEN 'FLATTEN' ELSE 'HOLD' END AS act,
   CASE WHEN side>0 THEN greatest(least(s,o)*{1 - _RULES.slip!r},l) ELSE least(greatest(s,o)*{1 + _RULES.slip!r},h) END AS fill, CASE WHEN hit_liq OR hit_stop THEN s WHEN side>0 THEN greatest(s,e2-{_RULES.m_trail}*2.0) ELSE least(s,e2+{_RULES.m_trail}*2.0) END AS s2 FROM
  (SELECT r.symbol, r.side, r.entry, r.s0, r.s, r.liq, r.age, y.i AS yi, y.ts_us AS yts, y.c, y.h, y.l, y.o, y.sig, y.flat, y.stop0, y.liq0, y.wants, y.safe, CASE WHEN r.side>0 THEN y.l<=r.liq ELSE y.h>=r.liq END AS hit_liq, CASE WHEN r.side>0 THEN y.l<=r.s ELSE y.h>=r.s END AS hit_stop,
    CASE WHEN r.side>0 THEN greatest(r.ext,y.h) ELSE least(r.ext,y.l) END AS e2, CASE WHEN y.p<{_RULES.flip_below} THEN r.weak+1 ELSE 0 END AS w2, r.fund+r.side*{_RULES.size}*y.rate*(y.ts_us//{_STEP}-r.ts_us//{_STEP}) AS f2 FROM r JOIN y ON y.symbol=r.symbol AND y.i=r.i+1))),
 n AS (SELECT *, lag(side) OVER w AS sd, lag(entry) OVER w AS en FROM r WINDOW w AS (PARTITION BY symbol ORDER BY i)),
 t AS (SELECT symbol, ts_us, false AS late, action, price, stop, funding, CASE WHEN action='LIQUIDATION' THEN -{_MARGIN!r} WHEN action IN ('SL','TRAIL','REGIME_FLIP','TIME_STOP','FLATTEN') THEN greatest({_RULES.size}*(sd*(price-en)/en-{_RULES.fee}-price/en*{_RULES.fee})-funding,-{_MARGIN!r}) END AS net_pnl FROM n WHERE i>=0) """
    + out("t", "symbol, ts_us, late, action", "price, stop, funding, net_pnl"),
)
def stream_exits(spark, sf_dir):
    return run(spark, sf_dir, lambda s: sf.exits(s.withColumn("open", F.col("opened")), ts="ts_us", rules=_RULES))


@query(
    "stream_trend_filter",
    f"""{E}, k AS (SELECT symbol, i, ts_us, close AS x, 0::DOUBLE AS v, 1::DOUBLE AS a, 0::DOUBLE AS b, 1::DOUBLE AS d FROM e WHERE i=0
 UNION ALL SELECT symbol, i, ts_us, xp+ap/(ap+0.01)*(z-xp), vp+bp/(ap+0.01)*(z-xp), (1-ap/(ap+0.01))*ap, (1-ap/(ap+0.01))*bp, dp-bp/(ap+0.01)*bp FROM
 (SELECT y.symbol, y.i, y.ts_us, y.close AS z, k.x+k.v AS xp, k.v AS vp, k.a+2*k.b+k.d+1e-4 AS ap, k.b+k.d AS bp, k.d+1e-5 AS dp FROM k JOIN e y ON y.symbol=k.symbol AND y.i=k.i+1)),
 r AS (SELECT symbol, ts_us, false AS late, x AS level, v AS trend FROM k) """ + out("r", "symbol, ts_us, late", "level, trend"),
)
def stream_trend(spark, sf_dir):
    return run(spark, sf_dir, lambda s: sf.trend(s, ts="ts_us"))


@query(
    "stream_hmm_regime",
    f"""{E}, x AS (SELECT *, (event_id%41-20)/500.0 AS lr FROM e), h AS (SELECT symbol, -1::BIGINT AS i, 0::BIGINT AS ts_us, 0.5::DOUBLE AS p0, 0.5::DOUBLE AS p1 FROM x WHERE i=0
 UNION ALL SELECT symbol, i, ts_us, w0/(w0+w1), w1/(w0+w1) FROM (SELECT y.symbol, y.i, y.ts_us, greatest(exp(-0.5*power(lr/0.01,2))/(0.01*sqrt(2*pi())),1e-15)*(h.p0*0.95+h.p1*0.05) AS w0, greatest(exp(-0.5*power(lr/0.03,2))/(0.03*sqrt(2*pi())),1e-15)*(h.p0*0.05+h.p1*0.95) AS w1 FROM h JOIN x y ON y.symbol=h.symbol AND y.i=h.i+1)),
 r AS (SELECT symbol, ts_us, false AS late, p0 AS p_0, p1 AS p_1 FROM h WHERE i>=0) """ + out("r", "symbol, ts_us, late", "p_0, p_1"),
)
def stream_hmm(spark, sf_dir):
    return run(spark, sf_dir, lambda s: sf.hmm(s, ts="ts_us"))


@query(
    "stream_imm_trend",
    f"""{E}, z AS (SELECT symbol, i, ts_us, close AS obs, event_id%10/10.0 AS pt, event_id%4/4.0 AS pc, 2.0 AS atr FROM e), {imm_sql('z')},
 t AS (SELECT r.symbol, z.ts_us, false AS late, p_hat, nu_hat, trend_score FROM imm r JOIN z USING (symbol, i)) """ + out("t", "symbol, ts_us, late", "p_hat, nu_hat, trend_score", 5),
    digits=5,
)
def stream_imm(spark, sf_dir):
    return run(spark, sf_dir, lambda s: sf.imm(s, ts="ts_us"))


STUCK, RETAIN = 43_200_001, 21_600_001
_OPEN = "('CREATED','SUBMITTED','ACKNOWLEDGED','PARTIALLY_FILLED')"
_MOVES = " OR ".join(f"(held='{k}' AND state IN ({', '.join(repr(v) for v in vs)}))" for k, vs in lg.TRANSITIONS.items())


@query(
    "stream_order_lifecycle",
    f"""WITH RECURSIVE e AS (SELECT user_id AS order_id, epoch_us(ts)//1000 AS ts_ms, event_id AS seq, value AS done, CASE event_type WHEN 'signup' THEN 'SUBMITTED' WHEN 'view' THEN 'ACKNOWLEDGED' WHEN 'click' THEN 'PARTIALLY_FILLED' WHEN 'purchase' THEN 'FILLED' ELSE 'CANCELED' END AS state, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts)//1000, event_id)-1 AS i FROM events),
 r AS (SELECT order_id, -1::BIGINT AS i, NULL::BIGINT AS ts_ms, NULL::BIGINT AS seq, '' AS state, 'CREATED' AS held, 0::DOUBLE AS filled, NULL::BIGINT AS deadline, NULL::VARCHAR AS problem, NULL::BIGINT AS expired FROM e WHERE i=0
 UNION ALL SELECT order_id, yi, yts, yseq, state, CASE WHEN problem IS NULL AND alive THEN state ELSE held END, CASE WHEN problem IS NULL AND alive THEN done ELSE filled END,
  CASE WHEN NOT alive THEN deadline WHEN problem IS NULL AND state NOT IN {_OPEN} THEN yts+{RETAIN} ELSE yts+{STUCK} END, problem, expired FROM
 (SELECT *, held IN {_OPEN} AS alive, CASE WHEN held NOT IN {_OPEN} THEN CASE WHEN state<>held THEN 'after the end' END WHEN state<>held AND NOT ({_MOVES}) THEN 'invalid transition' WHEN done<filled-1e-12 THEN 'filled decreased' WHEN done>200.0+1e-9 THEN 'overfilled' END AS problem FROM
 (SELECT order_id, yi, yts, yseq, state, done, expired, CASE WHEN h2 NOT IN {_OPEN} AND d2<yts THEN 'CREATED' ELSE h2 END AS held, CASE WHEN h2 NOT IN {_OPEN} AND d2<yts THEN 0 ELSE filled END AS filled, d2 AS deadline FROM
 (SELECT r.order_id, r.filled, y.i AS yi, y.ts_ms AS yts, y.seq AS yseq, y.state, y.done, CASE WHEN r.held IN {_OPEN} AND r.deadline<y.ts_ms THEN r.deadline END AS expired, CASE WHEN r.held IN {_OPEN} AND r.deadline<y.ts_ms THEN 'EXPIRED' ELSE r.held END AS h2, CASE WHEN r.held IN {_OPEN} AND r.deadline<y.ts_ms THEN r.deadline+{RETAIN} ELSE r.deadline END AS d2 FROM r JOIN e y ON y.order_id=r.order_id AND y.i=r.i+1)))),
 w AS (SELECT max(ts_ms)-3600000 AS wm FROM e), l AS (SELECT order_id, max_by(held, i) AS held, max_by(deadline, i) AS deadline FROM r GROUP BY 1)
 SELECT order_id, ts_ms, seq, state, held, problem FROM r WHERE i>=0
 UNION ALL SELECT order_id, expired, NULL, 'EXPIRED', 'EXPIRED', 'stuck' FROM r WHERE expired IS NOT NULL
 UNION ALL SELECT order_id, deadline, NULL, 'EXPIRED', 'EXPIRED', 'stuck' FROM l, w WHERE held IN {_OPEN} AND deadline<wm""",
)
def stream_orders(spark, sf_dir):
    """A user's events as the life of one order at a time, ended by timers on the watermark."""
    state = F.expr("CASE event_type WHEN 'signup' THEN 'SUBMITTED' WHEN 'view' THEN 'ACKNOWLEDGED' WHEN 'click' THEN 'PARTIALLY_FILLED' WHEN 'purchase' THEN 'FILLED' ELSE 'CANCELED' END")
    e = source(spark, sf_dir).select(F.col("user_id").alias("order_id"), "ts", F.unix_millis("ts").alias("ts_ms"), F.col("event_id").alias("seq"), state.alias("state"), F.col("value").alias("filled_qty"), F.lit(200.0).alias("qty"))
    path = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    return sf.drain(sf.order_lifecycle(e, stuck_ms=STUCK, retain_ms=RETAIN), path)
