"""Queries over sizing, contracts, logs, plans and reports.

Trade-like rows are the line items: probability and regime stand-ins come from their
prices, side from the line status, volatility and fees from tax and discount.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import frames as fr
from barloom.operators import ledger as lg
from barloom.operators import sizing as sz
from barloom.operators.ordered import asof_grid
from barloom.plans.registry import bars_sql, out, panel_sql, query
from barloom.sources import tables as tb

KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
ROWS = f"""WITH RECURSIVE rw AS (SELECT {KEY}, l_extendedprice/l_quantity AS entry, CASE WHEN l_linestatus='O' THEN 1 ELSE -1 END AS side, l_extendedprice/105000.0 AS p_i, l_extendedprice/l_quantity/105000.0*4 AS pc0,
 l_tax AS sigma, l_quantity AS qty, l_discount AS disc, l_extendedprice AS notional FROM lineitem),
tr AS (SELECT *, least(1.0,pc0) AS p_chop_i FROM rw)"""


def rows(spark, sf_dir):
    li = tb.read(spark, sf_dir, "lineitem")
    px = F.col("l_extendedprice") / F.col("l_quantity")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", px.alias("entry"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(-1).alias("side"),
        (F.col("l_extendedprice") / 105000.0).alias("p_i"), F.least(F.lit(1.0), px / 105000.0 * 4).alias("p_chop_i"),
        F.col("l_tax").alias("sigma"), F.col("l_quantity").alias("qty"), F.col("l_discount").alias("disc"), F.col("l_extendedprice").alias("notional"),
    )


KEYS = [c.strip() for c in KEY.split(",")]
MODE = "CASE WHEN p_i>=0.5 THEN 'follow' WHEN p_chop_i>0.8 THEN 'fade' ELSE 'none' END"


def both(name, sql_body, keys, vals, digits=6):
    """Register a row-wise query: SQL over ``tr`` and a Spark select."""
    def wrap(fn):
        q = query(name, f"{ROWS}, q AS ({sql_body}) " + out("q", f"{KEY}{', ' + keys if keys else ''}", vals, digits), digits=digits)
        return q(lambda spark, sf_dir: fn(rows(spark, sf_dir)))
    return wrap


@query("classify_trade_mode", f"{ROWS} SELECT {KEY}, {MODE} AS mode FROM tr")
def trade_mode(spark, sf_dir):
    return rows(spark, sf_dir).select(*KEYS, sz.trade_mode(F.col("p_i"), F.col("p_chop_i"), True).alias("mode"))


STOP = "CASE WHEN side>0 THEN greatest(entry*exp(-(2*sigma+0.0004)),1e-4) ELSE entry*exp(2*sigma+0.0004) END"


@both("initial_stop", f"SELECT {KEY}, {STOP} AS stop, CASE WHEN side>0 THEN greatest(1e-4,floor(({STOP}+1e-12)/0.5)*0.5) ELSE greatest(1e-4,ceil(({STOP}-1e-12)/0.5)*0.5) END AS stop_tick FROM tr", "", "stop, stop_tick")
def initial_stop(r):
    a, _ = sz.initial_stop(F.col("entry"), F.col("side"), 2.0, F.col("sigma"), 0.0004)
    b, _ = sz.initial_stop(F.col("entry"), F.col("side"), 2.0, F.col("sigma"), 0.0004, tick=0.5)
    return r.select(*KEYS, a.alias("stop"), b.alias("stop_tick"))


def liq_sql(lev, fee="0.005"):
    room = f"(1/({lev})-0.005-0.0004-{fee})"
    return f"CASE WHEN {room}<=0 THEN entry WHEN side>0 THEN greatest(entry*(1-{room}),1e-4) ELSE entry*(1+{room}) END"


@both("liquidation_price", f"SELECT {KEY}, {liq_sql('qty')} AS liq FROM tr", "", "liq")
def liquidation(r):
    return r.select(*KEYS, sz.liquidation_price(F.col("entry"), F.col("side"), F.col("qty")).alias("liq"))


@both(
    "leverage_vs_stop",
    f"SELECT *, CASE WHEN dl<=0 THEN 'LIQ_PRICE_CROSSED_ENTRY' WHEN ds<=dl*0.85 THEN 'SAFE' ELSE 'SL_TOO_CLOSE_TO_LIQ' END AS reason FROM (SELECT {KEY}, side*(entry-({liq_sql('qty')})) AS dl, side*(entry-({STOP})) AS ds FROM tr)",
    "reason", "dl, ds",
)
def leverage_check(r):
    stop, _ = sz.initial_stop(F.col("entry"), F.col("side"), 2.0, F.col("sigma"), 0.0004)
    r = r.withColumn("c", sz.leverage_check(F.col("entry"), F.col("side"), stop, F.col("qty")))
    return r.select(*KEYS, F.col("c.reason").alias("reason"), F.col("c.dist_liq").alias("dl"), F.col("c.dist_sl").alias("ds"))


MAXLEV = "least(1/greatest(side*(entry-stop)/entry/0.85+0.005+0.0004+{fee},1e-6),20.0)"


@both("max_safe_leverage", f"SELECT *, {MAXLEV.format(fee='0.005')} AS max_leverage FROM (SELECT *, {STOP} AS stop FROM tr)", "", "max_leverage")
def max_leverage(r):
    stop, _ = sz.initial_stop(F.col("entry"), F.col("side"), 2.0, F.col("sigma"), 0.0004)
    return r.select(*KEYS, sz.max_safe_leverage(F.col("entry"), F.col("side"), stop).alias("max_leverage"))


TIERS = [(10000.0, 0.004), (50000.0, 0.006), (80000.0, 0.01)]


@both("margin_tier", f"SELECT {KEY}, CASE WHEN notional<=10000 THEN 0.004 WHEN notional<=50000 THEN 0.006 ELSE 0.01 END AS mmr FROM tr", "", "mmr")
def margin_tier(r):
    return r.select(*KEYS, sz.margin_rate(F.col("notional"), TIERS).alias("mmr"))


RES = f"""m AS (SELECT *, {MODE} AS mode FROM tr), n AS (SELECT * REPLACE (CASE WHEN mode='follow' THEN side ELSE -side END AS side) FROM m WHERE mode<>'none'),
s AS (SELECT *, {STOP} AS stop FROM n), l AS (SELECT *, least(10.0,{MAXLEV.format(fee='0.001')}) AS leverage FROM s), rs AS (SELECT *, {liq_sql('leverage', '0.001')} AS liq, CASE WHEN mode='follow' THEN 120 ELSE 40 END AS t_max FROM l WHERE leverage>=1)"""


@query("resolve_trade_params", f"{ROWS}, {RES} " + out("rs", f"{KEY}, mode, side, t_max", "stop, leverage, liq"))
def resolve(spark, sf_dir):
    r = sz.resolve_trades(rows(spark, sf_dir), True)
    return r.select(*KEYS, "mode", "side", "t_max", F.col("sl").alias("stop"), "leverage", "liq")


@both("position_size", f"SELECT {KEY}, CASE WHEN disc=0 THEN 0 ELSE greatest(0,floor((least(disc*10*0.5*1000*least(2.5,greatest(0.2,0.04/nullif(sigma,0))), 3*1000.0, 2500.0)+1e-12)/10)*10) END AS size FROM tr WHERE sigma>0", "", "size")
def position_size(r):
    f = F.col("disc") * 10
    size = sz.position_size(f, F.lit(1000.0), F.lit(3.0), cap=2500.0, atr_hist=F.lit(0.04), atr_now=F.col("sigma"), lot=10.0)
    return r.filter("sigma > 0").select(*KEYS, size.alias("size"))


PNL = """SELECT *, (notional*0.0004 + CASE WHEN liq THEN 0 ELSE notional*(ex/entry)*0.0001 END) AS fee_paid, CASE WHEN liq THEN -notional/qty ELSE mv*notional END AS gross_pnl FROM (SELECT *, entry*(1+disc-0.05) AS ex, side*(entry*(1+disc-0.05)-entry)/entry AS mv, sigma>=0.08 AS liq FROM tr)"""


@both("realized_pnl", f"SELECT *, CASE WHEN liq THEN gross_pnl-notional*0.0004 ELSE mv*notional-notional*0.0004-notional*(ex/entry)*0.0001-1.5 END AS net_pnl, CASE WHEN liq THEN mv ELSE (mv*notional-notional*0.0004-notional*(ex/entry)*0.0001-1.5)/notional END AS realized_return FROM ({PNL})", "", "gross_pnl, net_pnl, realized_return, fee_paid")
def pnl(r):
    reason = F.when(F.col("sigma") >= 0.08, "LIQUIDATION").otherwise("SL")
    p = sz.realized_pnl(F.col("entry"), F.col("entry") * (1 + F.col("disc") - 0.05), F.col("side"), F.col("notional"), F.col("qty"), reason, exit_fill="maker", funding=1.5)
    return r.select(*KEYS, *[c.alias(k) for k, c in p.items()])


# --- Kelly ---------------------------------------------------------------------------------------

TRD = f"{ROWS}, v AS (SELECT *, disc-0.05+(sigma-0.035)*0.5 AS ret, least(1.0,greatest(0.0,p_i)) AS pi FROM tr)"
_TENTHS = lambda x: "unnest([" + ",".join(f"quantile_cont({x},{k / 10})" for k in range(1, 10)) + "])"
EDG = f"""pe0 AS (SELECT unnest(range(1,10)) AS k, {_TENTHS('pi')} AS e FROM v),
pb AS (SELECT v.*, (SELECT count(*) FROM pe0 WHERE e<=pi) AS p_bin FROM v),
ce0 AS (SELECT p_bin, unnest(range(1,10)) AS k, {_TENTHS('p_chop_i')} AS e0 FROM pb GROUP BY p_bin),
ce AS (SELECT p_bin, k, e0 + 1e-12*(row_number() OVER (PARTITION BY p_bin, e0 ORDER BY k)-1) AS e FROM ce0)"""


def trades(spark, sf_dir):
    return rows(spark, sf_dir).withColumn("ret", F.col("disc") - 0.05 + (F.col("sigma") - 0.035) * 0.5)


@query("kelly_bin_edges", f"{TRD}, {EDG}, q AS (SELECT -1 AS p_bin, e FROM pe0 UNION ALL SELECT p_bin, e FROM ce) " + out("q", "p_bin", "e"))
def kelly_edges(spark, sf_dir):
    _, p, c = sz.kelly_bins(trades(spark, sf_dir))
    a = p.select(F.lit(-1).alias("p_bin"), F.explode("edges").alias("e"))
    return a.unionByName(c.select("p_bin", F.explode("edges").alias("e"))).withColumn("p_bin", F.col("p_bin").cast("long"))


@query(
    "kelly_bins",
    f"{TRD}, {EDG}, cb AS (SELECT pb.p_bin, pb.ret, (SELECT count(*) FROM ce WHERE ce.p_bin=pb.p_bin AND ce.e<=pb.p_chop_i) AS chop_bin FROM pb), q AS (SELECT p_bin, chop_bin, count(*) AS n, avg(ret) AS mean_ret FROM cb GROUP BY 1,2) " + out("q", "p_bin, chop_bin, n", "mean_ret", 9),
    digits=9,
)
def kelly_bins(spark, sf_dir):
    t, _, _ = sz.kelly_bins(trades(spark, sf_dir))
    return t.groupBy(F.col("p_bin").cast("long").alias("p_bin"), F.col("chop_bin").cast("long").alias("chop_bin")).agg(F.count("*").alias("n"), F.avg("ret").alias("mean_ret"))


@query("empirical_kelly_fraction", f"""{TRD}, x AS (SELECT l_suppkey, ret AS r FROM v), s AS (SELECT l_suppkey, count(*) AS n, avg(r) AS m, min(r) AS lo FROM x GROUP BY 1),
 bs AS (SELECT l_suppkey, n, 0 AS i, 0::DOUBLE AS a, CASE WHEN lo<0 THEN least(20.0,0.999/abs(lo)) ELSE 20.0 END AS b, m>0 AND n>=5 AS ok FROM s
  UNION ALL SELECT bs.l_suppkey, bs.n, i+1, CASE WHEN g>0 THEN (a+b)/2 ELSE a END, CASE WHEN g>0 THEN b ELSE (a+b)/2 END, ok FROM bs, LATERAL (SELECT avg(r/(1+(bs.a+bs.b)/2*r)) AS g FROM x WHERE x.l_suppkey=bs.l_suppkey) WHERE i<46 AND ok),
 q AS (SELECT l_suppkey AS symbol, n, CASE WHEN ok THEN arg_max((a+b)/2,i) ELSE 0 END AS f_point FROM bs GROUP BY l_suppkey, n, ok) """ + out("q", "symbol, n", "f_point"))
def kelly_fraction(spark, sf_dir):
    return sz.kelly_fraction(trades(spark, sf_dir), ["l_suppkey"], F.lit(20.0)).select(F.col("l_suppkey").alias("symbol"), "n", "f_point")


@query("bootstrap_kelly")
def bootstrap_kelly(spark, sf_dir):
    t = trades(spark, sf_dir).withColumn("regime", F.col("side"))
    return sz.bootstrap_kelly(t, ["regime"], F.lit(20.0), 1000)


@query("kelly_table")
def kelly_table(spark, sf_dir):
    t, _, _ = sz.kelly_bins(trades(spark, sf_dir))
    return sz.kelly_table(t)


@query("kelly_lookup")
def kelly_lookup(spark, sf_dir):
    t, p, c = sz.kelly_bins(trades(spark, sf_dir))
    return sz.kelly_lookup(rows(spark, sf_dir), sz.kelly_table(t), p, c, 10, True).select(*KEYS, "mode", "p_bin", "chop_bin", "f_target")


@query("regime_kelly")
def regime_kelly(spark, sf_dir):
    return sz.regime_kelly(trades(spark, sf_dir), {"trending": 0.6, "choppy": 0.4})


@query(
    "pbo_cscv",
    f"""{panel_sql('week').join(['WITH ', ''])}, r AS (SELECT symbol AS config, ti, coalesce(close/lag(close) OVER (PARTITION BY symbol ORDER BY ti)-1,0) AS ret FROM panel),
 b AS (SELECT config, blk, sum(ret) AS s FROM (SELECT *, ntile(16) OVER (PARTITION BY config ORDER BY ti)-1 AS blk FROM r) GROUP BY 1,2), mk AS (SELECT m FROM (SELECT unnest(range(65536)) AS m) WHERE bit_count(m)=8),
 p AS (SELECT m, config, sum(CASE WHEN (m>>blk)&1=1 THEN s ELSE 0 END) AS i, sum(CASE WHEN (m>>blk)&1=0 THEN s ELSE 0 END) AS o FROM mk, b GROUP BY 1,2),
 k AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY i DESC, config) AS bi, row_number() OVER (PARTITION BY m ORDER BY o, config) AS ro, count(*) OVER (PARTITION BY m) AS n FROM p),
 q AS (SELECT count(*) AS n_combinations, avg(CASE WHEN (ro-1.0)/(n-1)<0.5 THEN 1.0 ELSE 0.0 END) AS pbo FROM k WHERE bi=1) """ + out("q", "n_combinations", "pbo"),
)
def pbo(spark, sf_dir):
    p = tb.panel(spark, sf_dir)
    r = p.select(F.col("symbol").alias("config"), "ti", F.coalesce(fr.ret("close"), F.lit(0.0)).alias("ret"))
    return sz.pbo(r)


# --- contracts and sources -------------------------------------------------------------------------

WB = f"WITH {panel_sql('week')}"


def week_bars(spark, sf_dir):
    return tb.bucket_bars(spark, sf_dir, tb.week_bucket)


@query("bar_scan", f"{WB} " + out("bars", "symbol, ts_ms, tick_count", "open, high, low, close, volume, ofi"))
def bar_scan(spark, sf_dir):
    return week_bars(spark, sf_dir).select("symbol", "ts_ms", "tick_count", "open", "high", "low", "close", "volume", "ofi")


@query("ohlc_contract", f"{WB} SELECT symbol, count(*) AS n_rows, count(*) FILTER (NOT (high>=open AND high>=close AND high>=low AND low<=open AND low<=close)) AS ohlc FROM bars GROUP BY symbol")
def ohlc(spark, sf_dir):
    return lg.violations(week_bars(spark, sf_dir), {"ohlc": lg.ohlc_ok()}, ("symbol",))


@query("warmup_null_contract", f"WITH {bars_sql('week')}, i AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms)-1 AS k FROM bars) SELECT symbol, count(*) AS n_rows, count(*) FILTER (k<20 AND k%2=0) AS warmup FROM i GROUP BY symbol")
def warmup(spark, sf_dir):
    b = week_bars(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy("ts_ms")) - 1)
    b = b.withColumn("insufficient_history", F.col("k") < 20)
    leak = F.when((F.col("k") >= 20) | (F.col("k") % 2 == 0), F.col("close"))
    b = b.withColumns({c: leak for c in lg.WARMUP_COLUMNS})
    return lg.violations(b, {"warmup": lg.warmup_ok()}, ("symbol",))


@query(
    "trade_index_time_contract",
    "SELECT l_suppkey AS symbol, count(*) AS n_rows, count(*) FILTER (l_linenumber<>l_orderkey%3+1+l_linenumber%4) AS bad_index, count(*) FILTER (l_shipdate<o_orderdate) AS bad_time FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY 1",
)
def trade_contract(spark, sf_dir):
    li, o = tb.read(spark, sf_dir, "lineitem"), tb.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    t = li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("l_suppkey").alias("symbol"), (F.col("l_orderkey") % 3).alias("entry_idx"), (F.col("l_linenumber") % 4).alias("exit_idx_relative"),
        F.col("l_linenumber").alias("exit_idx_absolute"), tb.epoch_ms("o_orderdate").alias("entry_timestamp_ms"), tb.epoch_ms("l_shipdate").alias("exit_timestamp_ms"),
    )
    return lg.violations(t, {"bad_index": lg.exit_index_ok(), "bad_time": lg.exit_time_ok()}, ("symbol",))


_MF = """mf AS (SELECT symbol, count(*) AS n_rows, min(ts_ms) AS start_time, max(ts_ms) AS end_time FROM bars GROUP BY symbol),
mh AS (SELECT *, sha256('{"end_time": '||end_time||', "n_rows": '||n_rows||', "params": {"grid": "week"}, "start_time": '||start_time||'}') AS manifest FROM mf)"""


@query("dataset_manifest", f"{WB}, {_MF} SELECT * FROM mh")
def manifest(spark, sf_dir):
    return lg.manifest(week_bars(spark, sf_dir), '{"grid": "week"}', keys=("symbol",))


@query("lineage_check", f"{WB}, {_MF} SELECT count(DISTINCT manifest) AS n_hashes, count(DISTINCT manifest)=1 AS matches FROM mh")
def lineage(spark, sf_dir):
    m = lg.manifest(week_bars(spark, sf_dir), '{"grid": "week"}', keys=("symbol",))
    return lg.lineage(m, m.agg(F.min("manifest")).scalar(), "manifest")


@query(
    "kline_projection",
    f"{KEY.join(['SELECT ', ''])}, l_quantity AS volume, CASE WHEN l_quantity>0 THEN least(1,greatest(-1,(l_quantity*l_discount*10-(l_quantity-l_quantity*l_discount*10))/l_quantity)) ELSE 0 END AS ofi FROM lineitem".join(["SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, volume, round(ofi,6)+0.0 AS ofi FROM (", ")"]),
)
def kline_projection(spark, sf_dir):
    li = tb.read(spark, sf_dir, "lineitem")
    s = lambda c: c.cast("string")
    raw = li.select(
        F.struct(*KEYS).alias("symbol"), s(tb.epoch_ms("l_shipdate")).alias("open_time"), *[s(F.col("l_extendedprice")).alias(c) for c in ("open", "high", "low", "close")],
        s(F.col("l_quantity")).alias("volume"), s(F.col("l_linenumber")).alias("tick_count"), s(F.col("l_quantity") * F.col("l_discount") * 10).alias("taker_buy_base"),
    )
    return lg.klines(raw).select("symbol.*", "volume", "ofi")


@query(
    "bar_upsert",
    "SELECT o_custkey AS symbol, epoch_ms(o_orderdate) AS ts_ms, arg_max(o_totalprice, (CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END, o_orderkey)) AS close FROM orders GROUP BY 1,2",
)
def bar_upsert(spark, sf_dir):
    """Finished orders are the later batch; within a batch the last order key wins."""
    o = tb.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("symbol"), tb.epoch_ms("o_orderdate").alias("ts_ms"), F.col("o_totalprice").alias("close"), "o_orderstatus", "o_orderkey")
    part = lambda c: tb.keep_last(o.filter(c).drop("o_orderstatus"), ["symbol", "ts_ms"], "o_orderkey")
    return tb.upsert_bars(part("o_orderstatus <> 'F'"), part("o_orderstatus = 'F'"))


@query(
    "positioning_resample",
    f"SELECT user_id AS symbol, epoch_ms(ts)//86400000*86400000 AS bucket_ms, arg_max(value, ts) AS value FROM events GROUP BY 1,2",
)
def resample_last(spark, sf_dir):
    e = tb.read(spark, sf_dir, "events").select(F.col("user_id").alias("symbol"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")
    e = e.withColumn("ts_ms", F.floor(F.col("us") / 1000))
    b = (F.floor(F.col("ts_ms") / tb.DAY_MS) * tb.DAY_MS).alias("bucket_ms")
    return e.groupBy("symbol", b).agg(F.max_by("value", "us").alias("value"))


@query(
    "resample_bars",
    f"""WITH {bars_sql('day')}, g AS (SELECT symbol, ts_ms//604800000*604800000 AS bucket_ms, arg_min(open,ts_ms) AS open, max(high) AS high, min(low) AS low, arg_max(close,ts_ms) AS close, sum(volume) AS volume, CAST(sum(tick_count) AS BIGINT) AS tick_count, sum(ofi*volume)/sum(volume) AS ofi, count(*) AS n FROM bars GROUP BY 1,2),
 q AS (SELECT *, max(bucket_ms) OVER (PARTITION BY symbol) AS lb FROM g), r AS (SELECT * FROM q WHERE bucket_ms<lb OR n>=7) """ + out("r", "symbol, bucket_ms, tick_count", "open, high, low, close, volume, ofi"),
)
def resample(spark, sf_dir):
    b = tb.bucket_bars(spark, sf_dir, tb.day_bucket)
    return lg.resample_bars(b, tb.DAY_MS, tb.WEEK_MS)


# --- joins --------------------------------------------------------------------------------------------


@query(
    "panel_outer_join",
    f"{WB}, n AS (SELECT symbol FROM bars GROUP BY symbol HAVING count(*)>=300), k AS (SELECT panel.* FROM panel JOIN n USING (symbol)), c AS (SELECT *, count(close) OVER (PARTITION BY symbol)*1.0/count(*) OVER (PARTITION BY symbol) AS coverage FROM k), r AS (SELECT * FROM c WHERE coverage>=0.9) " + out("r", "symbol, ts_ms", "close, coverage"),
)
def panel_join(spark, sf_dir):
    return lg.covered_panel(week_bars(spark, sf_dir), 300, 0.9).select("symbol", "ts_ms", "close", "coverage")


@query(
    "funding_asof_panel",
    f"{WB}, f AS (SELECT symbol, ts_ms, funding FROM bars WHERE tick_count>=8), u AS (SELECT symbol, ts_ms, NULL::DOUBLE AS f, 1 AS g FROM panel UNION ALL SELECT symbol, ts_ms, funding, 0 FROM f), w AS (SELECT *, last_value(f IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts_ms, g) AS funding FROM u), r AS (SELECT symbol, ts_ms, funding FROM w WHERE g=1) " + out("r", "symbol, ts_ms", "funding"),
)
def funding_panel(spark, sf_dir):
    """Rates observed on busy weeks only, carried onto the full grid."""
    p = tb.panel(spark, sf_dir)
    facts = week_bars(spark, sf_dir).filter("tick_count >= 8").select("symbol", "ts_ms", "funding")
    return asof_grid(p, facts, ("symbol",), "ts_ms", "funding")


@query("exact_grid_reindex", f"{WB}, r AS (SELECT p.symbol, p.ts_ms, b.crowd_ratio AS ratio FROM panel p LEFT JOIN (SELECT * FROM bars WHERE tick_count>=8) b ON b.symbol=p.symbol AND b.ts_ms=p.ts_ms) " + out("r", "symbol, ts_ms", "ratio"))
def exact_reindex(spark, sf_dir):
    m = week_bars(spark, sf_dir).filter("tick_count >= 8").select("symbol", "ts_ms", F.col("crowd_ratio").alias("ratio"))
    return tb.panel(spark, sf_dir).select("symbol", "ts_ms").join(m, ["symbol", "ts_ms"], "left")


@query("align_symbols", f"{WB}, s AS (SELECT DISTINCT p_brand AS symbol FROM part WHERE p_size>=49) SELECT symbol, count(*) AS n FROM panel WHERE symbol IN (SELECT symbol FROM s) GROUP BY symbol")
def align(spark, sf_dir):
    big = tb.read(spark, sf_dir, "part").filter("p_size >= 49").select(F.col("p_brand").alias("symbol"))
    return lg.align_symbols(tb.panel(spark, sf_dir).select("symbol"), big).groupBy("symbol").agg(F.count("*").alias("n"))


UNI = """v AS (SELECT l_suppkey AS symbol, sum(l_extendedprice) AS qv, count(*) AS nb, min(l_extendedprice) AS mn FROM lineitem GROUP BY 1),
u AS (SELECT s_suppkey AS symbol, CASE WHEN s_acctbal<=0 THEN 'not tradeable' WHEN coalesce(qv,0)<(SELECT avg(qv) FROM v)*0.97 THEN 'illiquid' WHEN mn>1100 THEN 'min notional' WHEN coalesce(nb,0)<600 THEN 'short history' ELSE '' END AS reason FROM supplier LEFT JOIN v ON v.symbol=s_suppkey)"""


@query("universe_filter", f"WITH {UNI} SELECT symbol, reason='' AS keep, reason FROM u")
def universe(spark, sf_dir):
    s = tb.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol"), "s_acctbal")
    li = tb.read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("symbol")).agg(
        F.sum("l_extendedprice").alias("quote_volume"), F.count("*").alias("n_bars"), F.min("l_extendedprice").alias("min_notional")
    )
    cut = li.agg(F.avg("quote_volume") * 0.97).scalar()
    li = li.withColumn("quote_volume", F.when(F.col("quote_volume") >= cut, 1.0).otherwise(0.0))
    return lg.universe(s.select("symbol"), s.filter("s_acctbal > 0"), li, li, li, 1.0, 1100.0, 600)


@query("symbol_sets", "SELECT o_custkey AS symbol, count(*) AS n_open, min(o_totalprice) AS min_notional FROM orders WHERE o_orderstatus='O' AND o_orderpriority IN ('1-URGENT','2-HIGH') GROUP BY 1 HAVING sum(o_totalprice)>=500000")
def symbol_sets(spark, sf_dir):
    o = tb.read(spark, sf_dir, "orders").filter("o_orderstatus = 'O' and o_orderpriority in ('1-URGENT', '2-HIGH')")
    f = o.withColumn("filters", F.array(F.struct(F.lit("LOT_SIZE").alias("filter_type"), F.lit(0.0).alias("notional")), F.struct(F.lit("MIN_NOTIONAL").alias("filter_type"), F.col("o_totalprice").alias("notional"))))
    f = f.withColumn("mn", lg.first_filter(F.col("filters"), "MIN_NOTIONAL", "notional"))
    return f.groupBy(F.col("o_custkey").alias("symbol")).agg(F.count("*").alias("n_open"), F.min("mn").alias("min_notional"), F.sum("o_totalprice").alias("v")).filter("v >= 500000").drop("v")


POS = """it AS (SELECT l_suppkey AS symbol, sum(CASE WHEN l_linestatus='O' THEN l_quantity ELSE -l_quantity END) AS qty FROM lineitem WHERE l_returnflag<>'R' GROUP BY 1),
ex AS (SELECT l_suppkey AS symbol, sum(CASE WHEN l_linestatus='O' THEN l_quantity ELSE -l_quantity END) AS qty FROM lineitem WHERE l_returnflag<>'A' GROUP BY 1)"""


ALL = POS.split(",\nex AS")[0].replace("WHERE l_returnflag<>'R' ", "")


def fills(spark, sf_dir, cond="true"):
    li = tb.read(spark, sf_dir, "lineitem").filter(cond)
    return li.select(F.col("l_suppkey").alias("symbol"), F.when(F.col("l_linestatus") == "O", "BUY").otherwise("SELL").alias("side"), F.col("l_quantity").alias("filled_qty"))


@query("net_position", f"WITH {ALL} SELECT symbol, qty FROM it")
def net_position(spark, sf_dir):
    return lg.net_position(fills(spark, sf_dir))


@query("reconcile_positions", f"WITH {POS} SELECT symbol, coalesce(it.qty,0) AS internal_qty, coalesce(ex.qty,0) AS exchange_qty, CASE WHEN coalesce(it.qty,0)=0 THEN 'unknown to us' WHEN coalesce(ex.qty,0)=0 THEN 'missing on exchange' ELSE 'size mismatch' END AS kind FROM (SELECT * FROM it WHERE abs(qty)>1e-8) it FULL JOIN (SELECT * FROM ex WHERE abs(qty)>1e-8) ex USING (symbol) WHERE abs(coalesce(it.qty,0)-coalesce(ex.qty,0))>1e-8")
def reconcile(spark, sf_dir):
    return lg.reconcile(lg.net_position(fills(spark, sf_dir, "l_returnflag <> 'R'")), lg.net_position(fills(spark, sf_dir, "l_returnflag <> 'A'")))


@query("orphan_orders", "SELECT o_orderkey AS order_id, o_custkey AS symbol FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def orphan_orders(spark, sf_dir):
    o = tb.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("symbol"))
    return lg.orphans(o, tb.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id")))


_PX = "px AS (SELECT l_suppkey AS symbol, avg(l_extendedprice/l_quantity) AS price FROM lineitem GROUP BY 1)"


def prices(spark, sf_dir):
    li = tb.read(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("symbol")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))


@query(
    "exposure_check",
    f"WITH {ALL}, {_PX}, v AS (SELECT qty*price AS v FROM it JOIN px USING (symbol)), a AS (SELECT sum(abs(v)) AS gross, sum(v) AS net, sum(CASE WHEN v>0 THEN v ELSE 0 END) AS long_notional, sum(CASE WHEN v<0 THEN v ELSE 0 END) AS short_notional FROM v), r AS (SELECT *, net/gross AS net_ratio, abs(net/gross)<=0.02 AS net_ok, gross/1e6 AS leverage, abs(gross/1e6-2)<=0.3 AS gross_ok FROM a) " + out("r", "net_ok, gross_ok", "gross, net, long_notional, short_notional, net_ratio, leverage", 3),
    digits=3,
)
def exposure(spark, sf_dir):
    p = lg.net_position(fills(spark, sf_dir)).join(prices(spark, sf_dir), "symbol")
    return lg.exposure(p, equity=1e6, target=2.0)


RB = f"""{POS}, {_PX}, tg AS (SELECT symbol, qty AS weight FROM ex WHERE qty<60), j AS (SELECT coalesce(tg.symbol,it.symbol) AS symbol, coalesce(weight,0) AS w, coalesce(it.qty,0) AS held FROM tg FULL JOIN it ON it.symbol=tg.symbol),
k AS (SELECT j.*, price, w/sum(abs(w)) OVER ()*5e7 AS tn FROM j JOIN px USING (symbol)), l AS (SELECT *, sign(tn/price)*floor((abs(tn/price)+1e-12)/5.0)*5.0 AS q0 FROM k),
m AS (SELECT *, CASE WHEN q0<>0 AND NOT (abs(q0)>=5 AND abs(q0)*price>=20000) THEN 0 ELSE q0 END AS tq FROM l), n AS (SELECT *, CASE WHEN tq=held THEN 0 ELSE sign(tq-held)*floor((abs(tq-held)+1e-12)/5.0)*5.0 END AS d FROM m),
o AS (SELECT *, CASE WHEN d=0 THEN 'hold' WHEN NOT (held<>0 AND tq=0) AND abs(d)<0.2*CASE WHEN tq<>0 THEN abs(tq) ELSE abs(held) END THEN 'band' WHEN NOT ((held<>0 AND tq=0) OR (abs(tq)<abs(held) AND held*tq>=0)) AND NOT (abs(d)>=5 AND abs(d)*price>=20000) THEN 'skip' ELSE 'order' END AS status FROM n),
rb AS (SELECT symbol, status, CASE WHEN status='order' THEN CASE WHEN d>0 THEN 'BUY' ELSE 'SELL' END END AS side, CASE WHEN status='order' THEN CASE WHEN tq=0 THEN 'close' WHEN held=0 THEN 'open' ELSE 'adjust' END END AS reason, held, tq AS target_qty, d AS delta, abs(d)*price AS notional FROM o)"""


def rebalance(spark, sf_dir):
    t = lg.net_position(fills(spark, sf_dir, "l_returnflag <> 'A'")).filter("qty < 60").withColumnRenamed("qty", "weight").withColumn("plan", F.lit(1))
    h = lg.net_position(fills(spark, sf_dir, "l_returnflag <> 'R'")).withColumn("plan", F.lit(1))
    m = prices(spark, sf_dir).withColumns({"step": F.lit(5.0), "min_qty": F.lit(5.0), "min_notional": F.lit(20000.0)})
    return lg.rebalance_rows(t, h, m, 5e7, keys=("plan",))


@query("rebalance_plan", f"WITH {RB} " + out("rb", "symbol, status, side, reason", "held, target_qty, delta, notional", 3), digits=3)
def rebalance_plan(spark, sf_dir):
    return rebalance(spark, sf_dir).select("symbol", "status", "side", "reason", "held", "target_qty", "delta", "notional")


@query(
    "rebalance_neutrality_repair",
    f"""WITH RECURSIVE {RB}, bk AS (SELECT *, CASE WHEN tq=0 OR status='skip' THEN 0 WHEN status='order' OR tq=held THEN tq ELSE held END*price AS book, abs(d)*price AS worth FROM o), tt AS (SELECT sum(book) AS net, sum(abs(book)) AS gross FROM bk),
 ca AS (SELECT bk.*, row_number() OVER (ORDER BY worth DESC, symbol) AS i FROM bk, tt WHERE status='band' AND tq<>0 AND d*tt.net<0 AND abs(d)>=5 AND worth>=20000),
 walk AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS symbol, net, gross, false AS hit FROM tt
  UNION ALL SELECT i, symbol, CASE WHEN ok THEN net+v ELSE net END, CASE WHEN ok THEN gross+gv ELSE gross END, ok FROM (SELECT ca.i, ca.symbol, walk.net, walk.gross, d*price AS v, (abs(tq)-abs(held))*price AS gv, walk.gross>0 AND abs(walk.net)/walk.gross>0.02 AND abs(walk.net+d*price)<abs(walk.net) AS ok FROM walk JOIN ca ON ca.i=walk.i+1)),
 rp AS (SELECT rb.symbol, CASE WHEN h.hit THEN 'order' ELSE status END AS status, CASE WHEN h.hit THEN CASE WHEN delta>0 THEN 'BUY' ELSE 'SELL' END ELSE side END AS side, CASE WHEN h.hit THEN 'neutrality' ELSE reason END AS reason, delta, notional FROM rb LEFT JOIN walk h ON h.symbol=rb.symbol) """ + out("rp", "symbol, status, side, reason", "delta, notional", 3),
    digits=3,
)
def neutrality_repair(spark, sf_dir):
    return lg.repair_neutrality(rebalance(spark, sf_dir)).select("symbol", "status", "side", "reason", "delta", "notional")


# --- logs and reports -------------------------------------------------------------------------------------

LOG = """lg0 AS (SELECT o_custkey%10 AS book, epoch_ms(o_orderdate)+o_orderkey AS timestamp_ms, o_orderkey%5 AS n_orders, o_totalprice*CASE WHEN o_orderstatus='F' THEN 1 ELSE 0.4 END AS maker, o_totalprice*CASE WHEN o_orderstatus='F' THEN 0 ELSE 0.5 END AS taker, o_totalprice AS planned, (o_orderkey%21-10)/100.0 AS net,
 CASE WHEN o_orderpriority='1-URGENT' THEN 1 ELSE 0 END AS pf, 0 AS uc, CASE WHEN o_orderkey%97=0 THEN 'x' END AS er, o_orderkey%89=0 AS mi, CASE WHEN o_orderkey%3=0 THEN o_orderkey%31<>0 END AS nk FROM orders),
lg AS (SELECT *, pf=0 AND uc=0 AND er IS NULL AND NOT mi AND coalesce(nk,true) AS clean FROM lg0)"""


def log(spark, sf_dir):
    o = tb.read(spark, sf_dir, "orders")
    f, k, p = F.col("o_orderstatus") == "F", F.col("o_orderkey"), F.col("o_totalprice")
    return o.select(
        (F.col("o_custkey") % 10).alias("book"), (tb.epoch_ms("o_orderdate") + k).alias("timestamp_ms"), (k % 5).alias("n_orders"),
        (p * F.when(f, 1.0).otherwise(0.4)).alias("maker_notional"), (p * F.when(f, 0.0).otherwise(0.5)).alias("taker_notional"), p.alias("planned_notional"),
        ((k % 21 - 10) / 100.0).alias("net_exposure"), F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("plan_failures"), F.lit(0).alias("uncancelled"),
        F.when(k % 97 == 0, "x").alias("exec_error"), (k % 89 == 0).alias("manual_intervention"), F.when(k % 3 == 0, k % 31 != 0).alias("net_ok"), F.lit(None).cast("boolean").alias("gross_ok"), k.alias("o_orderkey"),
    )


@query("clean_run_flags", f"WITH {LOG} SELECT book, timestamp_ms, clean, (pf>0)::INT+(er IS NOT NULL)::INT+mi::INT+(nk IS NOT NULL AND NOT nk)::INT AS n_reasons FROM lg")
def clean_flags(spark, sf_dir):
    return log(spark, sf_dir).select("book", "timestamp_ms", lg.clean_run().alias("clean"), F.size(lg.failing_reasons()).alias("n_reasons"))


@query("execution_summary", f"WITH {LOG}, a AS (SELECT book, count(*) AS n_rebalances, sum(maker) AS m, sum(taker) AS t, sum(planned) AS p, avg(abs(net)) AS n, min(timestamp_ms) AS first_ms, max(timestamp_ms) AS last_ms FROM lg GROUP BY book), r AS (SELECT book, n_rebalances, m/(m+t) AS maker_ratio, (m+t)/p AS fill_ratio, (m*0.0002+t*0.0005)/(m+t)*1e4 AS realized_cost_bps, m*0.0002+t*0.0005 AS total_cost_usd, m+t AS total_traded_usd, n*100 AS avg_net_exposure_pct, first_ms, last_ms FROM a) " + out("r", "book, n_rebalances, first_ms, last_ms", "maker_ratio, fill_ratio, realized_cost_bps, total_cost_usd, total_traded_usd, avg_net_exposure_pct", 4), digits=4)
def execution_summary(spark, sf_dir):
    return lg.execution_summary(log(spark, sf_dir), ("book",))


@query("clean_streak", f"WITH {LOG}, r AS (SELECT * FROM lg WHERE n_orders>0), b AS (SELECT book, max(timestamp_ms) FILTER (NOT clean) AS bad FROM r GROUP BY book) SELECT book, count(*) FILTER (bad IS NULL OR timestamp_ms>bad) AS streak, count(*) FILTER (bad IS NULL OR timestamp_ms>bad)>=3 AS passed FROM r JOIN b USING (book) GROUP BY book")
def clean_streak(spark, sf_dir):
    return lg.clean_streak(log(spark, sf_dir), 3, ("book",))


_TYPES = ("view", "click", "purchase", "refund")


@query("income_pivot", "WITH p AS (SELECT epoch_ms(ts)//86400000 AS day, coalesce(sum(value) FILTER (event_type='view'),0) AS view, coalesce(sum(value) FILTER (event_type='click'),0) AS click, coalesce(sum(value) FILTER (event_type='purchase'),0) AS purchase, 0.0 AS refund, coalesce(sum(value) FILTER (event_type NOT IN ('view','click','purchase','refund') OR event_type IS NULL),0) AS other, coalesce(sum(value),0) AS total FROM events GROUP BY 1) " + out("p", "day", "view, click, purchase, refund, other, total"))
def income_pivot(spark, sf_dir):
    e = tb.read(spark, sf_dir, "events").select(F.col("event_type").alias("type"), F.col("value").alias("amount"), tb.epoch_ms("ts").alias("ts_ms"))
    return lg.income_pivot(e, _TYPES, F.floor(F.col("ts_ms") / tb.DAY_MS))


@query(
    "income_phases",
    "WITH e AS (SELECT epoch_ms(ts) AS ts_ms, coalesce(event_type,'NONE') AS type, value AS amount, (SELECT (min(epoch_ms(ts))+max(epoch_ms(ts)))//2 FROM events) AS b FROM events WHERE event_type IS DISTINCT FROM 'signup'), "
    "p AS (SELECT CASE WHEN ts_ms<b THEN 'before' ELSE 'after' END AS phase, * FROM e), "
    "g AS (SELECT phase, type, coalesce(sum(amount),0) AS amount, count(*) AS n, (max(ts_ms)-min(ts_ms))/86400000.0 AS span_days FROM p GROUP BY ALL "
    "UNION ALL SELECT phase, 'ALL', coalesce(sum(amount),0), count(*), (max(ts_ms)-min(ts_ms))/86400000.0 FROM p GROUP BY phase) "
    + out("g", "phase, type, n", "amount, span_days"),
)
def income_phases(spark, sf_dir):
    """Income before and after the middle of the observed time; sign-ups stand for deposits."""
    e = tb.read(spark, sf_dir, "events").select(F.col("event_type").alias("type"), F.col("value").alias("amount"), tb.epoch_ms("ts").alias("ts_ms"))
    middle = e.agg(F.expr("(min(ts_ms) + max(ts_ms)) div 2")).scalar()
    return lg.income_phases(e, middle, ~F.col("type").eqNullSafe("signup"))


@query("income_concentration", "WITH g AS (SELECT user_id AS symbol, sum(CASE WHEN event_type='error' THEN -value ELSE value END) AS amount FROM events GROUP BY 1), s AS (SELECT max(abs(amount))/sum(abs(amount)) AS largest_share FROM g), r AS (SELECT * FROM (SELECT symbol, amount, 'top' AS rank_side FROM g ORDER BY amount DESC, symbol LIMIT 5) UNION ALL SELECT * FROM (SELECT symbol, amount, 'bottom' FROM g ORDER BY amount, symbol LIMIT 5)) " + out("(SELECT * FROM r, s)", "symbol, rank_side", "amount, largest_share"))
def income_concentration(spark, sf_dir):
    e = tb.read(spark, sf_dir, "events").select(F.col("user_id").alias("symbol"), F.when(F.col("event_type") == "error", -F.col("value")).otherwise(F.col("value")).alias("amount"))
    return lg.concentration(e, 5)


@query(
    "position_report",
    f"WITH {ALL}, {_PX}, q AS (SELECT symbol, qty AS amt, price AS mark, price*0.98 AS entry, abs(qty*price) AS n, CASE WHEN symbol%3=0 THEN 0 ELSE price*0.7 END AS liq FROM it JOIN px USING (symbol) WHERE abs(qty)>0), r AS (SELECT symbol, CASE WHEN amt>0 THEN 'LONG' ELSE 'SHORT' END AS side, abs(amt) AS qty, n AS notional, n/20 AS margin, n/1e6*100 AS pct_account, CASE WHEN liq>0 THEN abs(mark-liq)/mark*100 END AS liq_distance_pct, (mark-entry)/entry*100*sign(amt) AS price_move_pct, amt*(mark-entry)/(n/20)*100 AS upnl_pct_margin FROM q) " + out("r", "symbol, side", "qty, notional, margin, pct_account, liq_distance_pct, price_move_pct, upnl_pct_margin", 4),
    digits=4,
)
def position_report(spark, sf_dir):
    p = lg.net_position(fills(spark, sf_dir)).join(prices(spark, sf_dir), "symbol")
    p = p.select("symbol", F.col("qty").alias("amount"), F.col("price").alias("mark"), (F.col("price") * 0.98).alias("entry"), (F.col("qty") * F.col("price")).alias("notional"), F.when(F.col("symbol") % 3 == 0, 0.0).otherwise(F.col("price") * 0.7).alias("liq"), F.lit(20.0).alias("leverage"))
    return lg.position_rows(p.withColumn("upnl", F.col("amount") * (F.col("mark") - F.col("entry"))), 1e6)


_TS = f"{ROWS}, t AS (SELECT l_suppkey AS symbol, l_orderkey AS entry_idx, disc-0.05+(sigma-0.035)*0.5 AS rr, sigma>=0.07 AS trunc, l_linenumber AS fold FROM tr)"


@query(
    "trade_summary",
    f"{_TS}, e AS (SELECT symbol, entry_idx, avg(rr) AS r, count(*) AS d FROM t GROUP BY 1,2), a AS (SELECT symbol, count(*) AS n_trades, CAST(sum(d) AS BIGINT) AS n_raw, avg(r) AS mean_ret, stddev_samp(r) AS s, avg(CASE WHEN r>0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(r) FILTER (r>0) AS w, avg(r) FILTER (r<=0) AS l FROM e GROUP BY 1), q AS (SELECT symbol, n_trades, n_raw, n_raw*1.0/n_trades AS dup_factor, mean_ret, win_rate, w/abs(l) AS payoff, (1-win_rate)/win_rate AS payoff_needed, mean_ret/s*sqrt(n_trades/6.8) AS sharpe, mean_ret/s*sqrt(n_trades) AS t_stat FROM a) " + out("q", "symbol, n_trades, n_raw", "dup_factor, mean_ret, win_rate, payoff, payoff_needed, sharpe, t_stat"),
)
def trade_summary(spark, sf_dir):
    # a sum like 0.01 + -0.01 is zero up to rounding; both sides add the same doubles
    t = rows(spark, sf_dir).select(F.col("l_suppkey").alias("symbol"), F.col("l_orderkey").alias("entry_idx"), (F.col("disc") - 0.05 + (F.col("sigma") - 0.035) * 0.5).alias("realized_return"))
    return lg.trade_summary(t, ["symbol"], F.lit(6.8))


def fold_trades(spark, sf_dir):
    return rows(spark, sf_dir).select(F.col("l_linenumber").alias("fold"), (F.col("disc") - 0.05 + (F.col("sigma") - 0.035) * 0.5).alias("realized_return"), (F.col("sigma") >= 0.07).alias("boundary_truncated"))


@query(
    "cpcv_metrics",
    f"{_TS}, f AS (SELECT fold, avg(rr)/stddev_samp(rr) AS u FROM t GROUP BY fold), a AS (SELECT count(*) AS n, count(*) FILTER (trunc) AS nt, avg(rr) AS m, stddev_samp(rr) AS s FROM t), mo AS (SELECT avg(power((rr-m)/s,3)) AS skew, avg(power((rr-m)/s,4)) AS kurt FROM t, a), q AS (SELECT n AS n_trades, nt AS n_truncated, nt*1.0/n AS truncation_rate, n/6.8 AS trades_per_year, m/(s+1e-12)*sqrt(n/6.8) AS sharpe_oos, (SELECT var_samp(u) FROM f)*n/6.8 AS variance_of_srs, skew, kurt FROM a, mo) " + out("q", "n_trades, n_truncated", "truncation_rate, trades_per_year, sharpe_oos, variance_of_srs, skew, kurt"),
)
def cv_metrics(spark, sf_dir):
    return lg.cv_metrics(fold_trades(spark, sf_dir), F.lit(6.8))


@query("truncation_split", f"{_TS}, q AS (SELECT count(*) FILTER (NOT trunc) AS n_clean, count(*) FILTER (trunc) AS n_diagnostic FROM t) " + out("(SELECT *, n_diagnostic*1.0/(n_clean+n_diagnostic) AS ratio, n_diagnostic*1.0/(n_clean+n_diagnostic)>0.15 AS warn FROM q)", "n_clean, n_diagnostic, warn", "ratio"))
def truncation(spark, sf_dir):
    return lg.truncation_split(fold_trades(spark, sf_dir))


_STATES = "CASE (l_linenumber+l_orderkey)%5 WHEN 0 THEN 'SUBMITTED' WHEN 1 THEN 'ACKNOWLEDGED' WHEN 2 THEN 'PARTIALLY_FILLED' WHEN 3 THEN 'FILLED' ELSE 'CANCELED' END"


@query(
    "order_lifecycle_audit",
    f"""WITH e AS (SELECT l_orderkey AS order_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq, {_STATES} AS state, l_quantity AS filled_qty, 40.0 AS qty FROM lineitem),
 p AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY order_id ORDER BY seq),'CREATED') AS ps, coalesce(lag(filled_qty) OVER (PARTITION BY order_id ORDER BY seq),0) AS pf FROM e)
 SELECT order_id, seq, state, CASE WHEN state<>ps AND NOT ((ps='CREATED' AND state IN ('SUBMITTED','REJECTED','CANCELED')) OR (ps='SUBMITTED' AND state IN ('ACKNOWLEDGED','PARTIALLY_FILLED','FILLED','REJECTED','CANCELED','EXPIRED')) OR (ps='ACKNOWLEDGED' AND state IN ('PARTIALLY_FILLED','FILLED','CANCELED','EXPIRED')) OR (ps='PARTIALLY_FILLED' AND state IN ('FILLED','CANCELED','EXPIRED'))) THEN 'invalid transition' WHEN filled_qty<pf-1e-12 THEN 'filled decreased' WHEN filled_qty>qty+1e-9 THEN 'overfilled' END AS problem FROM p""",
)
def lifecycle(spark, sf_dir):
    li = tb.read(spark, sf_dir, "lineitem")
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    e = li.select(F.col("l_orderkey").alias("order_id"), seq.alias("seq"), F.expr(_STATES).alias("state"), F.col("l_quantity").alias("filled_qty"), F.lit(40.0).alias("qty"))
    return lg.lifecycle_audit(e).select("order_id", "seq", "state", "problem")


@query("trial_log_count", "SELECT sha256('{\"priority\":\"'||o_orderpriority||'\",\"status\":\"'||o_orderstatus||'\"}') AS params_hash, count(*) AS n_trials FROM orders GROUP BY 1")
def trial_log(spark, sf_dir):
    o = tb.read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return o.groupBy(tb.params_hash("status", "priority").alias("params_hash")).agg(F.count("*").alias("n_trials"))


# --- order book ---------------------------------------------------------------------------------------------

_BOOK = """bk AS (SELECT l_orderkey AS snapshot_id, list(struct_pack(p := l_extendedprice/l_quantity, v := l_quantity)) AS levels FROM lineitem WHERE l_linestatus='O' GROUP BY 1),
om AS (SELECT o_orderkey AS snapshot_id, o_totalprice/100 AS limit_price, o_custkey%4000 AS age, coalesce(list_sum(list_transform(list_filter(levels, lambda x: x.p>=o_totalprice/100), lambda x: x.v)),0) AS queue_visible, levels IS NOT NULL AS valid FROM orders LEFT JOIN bk ON bk.snapshot_id=o_orderkey),
oq AS (SELECT *, queue_visible*0.7 AS queue_effective, CASE WHEN NOT valid OR age>2000 THEN 2 WHEN age>500 THEN 1 ELSE 0 END AS tier FROM om)"""


def books(spark, sf_dir):
    li = tb.read(spark, sf_dir, "lineitem").filter("l_linestatus = 'O'")
    # an order has at most a handful of lines, so the level array is short
    b = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct((F.col("l_extendedprice") / F.col("l_quantity")).alias("p"), F.col("l_quantity").alias("v"))).alias("bids"))
    o = tb.read(spark, sf_dir, "orders").join(b, "o_orderkey", "left")
    return o.select(F.col("o_orderkey").alias("snapshot_id"), (F.col("o_totalprice") / 100).alias("limit_price"), F.lit(1).alias("side"), (F.col("o_custkey") % 4000).alias("age_ms"), "bids", F.lit(None).cast("array<struct<p:double,v:double>>").alias("asks"))


@query("queue_ahead", f"WITH {_BOOK} " + out("oq", "snapshot_id", "queue_visible, queue_effective"))
def queue_ahead(spark, sf_dir):
    from barloom.operators.book import queue_ahead as qa

    return qa(books(spark, sf_dir)).select("snapshot_id", "queue_visible", "queue_effective")


@query("order_mode_by_age", f"WITH {_BOOK}, r AS (SELECT snapshot_id, tier, CASE tier WHEN 2 THEN 'ABORT_ENTRY' WHEN 1 THEN 'POST_ONLY_LIMIT' ELSE 'LIMIT' END AS mode, queue_effective*CASE WHEN tier=1 THEN 1.5 ELSE 1 END AS queue FROM oq) " + out("r", "snapshot_id, tier, mode", "queue"))
def order_mode(spark, sf_dir):
    from barloom.operators.book import order_mode as om

    return om(books(spark, sf_dir), "ENTRY").select("snapshot_id", "tier", "mode", F.col("queue_effective").alias("queue"))
