"""Queries over learning operators and the out-of-sample trade table."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import events as ev
from barloom.operators import features as ft
from barloom.operators import learn as ln
from barloom.operators import sizing as sz
from barloom.plans.event_queries import BASE, FEATURES, barrier_events, labelled
from barloom.plans.evaluation_queries import weekly
from barloom.plans.portfolio_queries import TWO, two_ctes
from barloom.plans.registry import arank, out, query

NAMES = ft.DERIVED
K = 3
FOREST = dict(trees=100, depth=5)


def training(spark, sf_dir):
    b, l = labelled(spark, sf_dir)
    w = ev.sample_weights(ev.average_uniqueness(l, ev.concurrency(l, b))).select("symbol", "t0", "t1", "label", "weight")
    rows = ln.training_rows(w, ft.batch_features(b), NAMES)
    splits = ev.purged_kfold(l.select("symbol", "t0", "t1"), K, 5)
    return ln.settle(rows, splits)


@query("weighted_forest")
def weighted_forest(spark, sf_dir):
    rows, splits = training(spark, sf_dir)
    return ln.out_of_fold(rows, splits, K, **FOREST).select("symbol", "t0", "fold", "label", "p")


@query("isotonic_calibration")
def calibration(spark, sf_dir):
    rows, splits = training(spark, sf_dir)
    return ln.calibrated(rows, splits, K, **FOREST).select("symbol", "t0", "p", "calibrated")


@query("mdi_importance")
def mdi(spark, sf_dir):
    rows, _ = training(spark, sf_dir)
    return ln.mdi(ln.forest(rows, **FOREST), NAMES, spark)


@query("mda_importance")
def mda(spark, sf_dir):
    rows, splits = training(spark, sf_dir)
    return ln.mda(rows, splits, K, NAMES, **FOREST)


@query("sfi_importance")
def sfi(spark, sf_dir):
    rows, splits = training(spark, sf_dir)
    return ln.sfi(rows, splits, K, NAMES, **FOREST)


FEATS = ft.DERIVED
_F = f"""{BASE}, {FEATURES},
lf AS (SELECT symbol, bar_idx, feature, v FROM f UNPIVOT (v FOR feature IN ({', '.join(FEATS)}))), lr_ AS (SELECT *, {arank('v', 'feature')} AS rk FROM lf),
ds AS (SELECT a.feature AS feature_a, b.feature AS feature_b, least(1.0,greatest(0.0,1-abs(corr(a.rk,b.rk)))) AS distance FROM lr_ a JOIN lr_ b ON a.symbol=b.symbol AND a.bar_idx=b.bar_idx GROUP BY 1,2)"""


def feature_table(spark, sf_dir):
    from barloom.plans.event_queries import bars

    return ft.batch_features(bars(spark, sf_dir), FEATS)


@query("correlation_distance", f"{_F} " + out("ds", "feature_a, feature_b", "distance"))
def distance(spark, sf_dir):
    return ln.correlation_distance(feature_table(spark, sf_dir), ("symbol", "bar_idx"), FEATS)


# three scores per feature taken from the table itself, so the ranks can be checked
_S = f"{_F}, sc AS (SELECT feature, avg(v) AS mdi_mean, stddev_samp(v) AS mda_mean, max(v) AS sfi_mean FROM lf GROUP BY feature), r1 AS (SELECT feature, one, {arank('-mdi_mean', 'one')}+{arank('-mda_mean', 'one')}+{arank('-sfi_mean', 'one')} AS rank_sum FROM (SELECT *, 1 AS one FROM sc)), cr AS (SELECT feature, CAST(rank_sum AS DOUBLE) AS rank_sum, {arank('rank_sum', 'one')} AS final_rank FROM r1)"


def scores(spark, sf_dir):
    t = feature_table(spark, sf_dir).unpivot(["symbol", "bar_idx"], list(FEATS), "feature", "v")
    s = t.groupBy("feature").agg(F.avg("v").alias("mdi_mean"), F.stddev_samp("v").alias("mda_mean"), F.max("v").alias("sfi_mean"))
    return ln.consensus_rank(s)


@query("consensus_rank", f"{_S} " + out("cr", "feature", "rank_sum, final_rank"))
def consensus(spark, sf_dir):
    return scores(spark, sf_dir).select("feature", "rank_sum", "final_rank")


@query("redundancy_filter")
def redundancy(spark, sf_dir):
    d = ln.correlation_distance(feature_table(spark, sf_dir), ("symbol", "bar_idx"), FEATS)
    return ln.redundancy_filter(d, scores(spark, sf_dir), 0.3)


@query(
    "rank_training_table",
    f"{two_ctes()}, c AS (SELECT *, count(*) OVER (PARTITION BY ti) AS n, row_number() OVER (PARTITION BY ti ORDER BY fwd, symbol) AS pos FROM two WHERE s0 IS NOT NULL AND s1 IS NOT NULL AND fwd IS NOT NULL), g AS (SELECT ts_ms, symbol, s0, s1, CAST(least(floor(pos/n*5),4) AS INT) AS grade FROM c WHERE n>=10) " + out("g", "ts_ms, symbol, grade", "s0, s1"),
)
def rank_table(spark, sf_dir):
    r = ln.rank_dataset(weekly(spark, sf_dir, TWO), TWO)
    return r.select("ts_ms", "symbol", "grade", F.col(TWO[0]).alias("s0"), F.col(TWO[1]).alias("s1"))


@query("cpcv_trade_table")
def cpcv_trades(spark, sf_dir):
    """Events, labels, fold models, bounded exits, funding and profit in one table."""
    groups, tests, n_folds = 4, 2, 6
    b, e = barrier_events(spark, sf_dir)
    b, e = ln.settle(b.join(ft.efficiency_regime(b), ["symbol", "bar_idx"]), e)
    (l,) = ln.settle(ev.triple_barrier(e.select("symbol", "t0", "side", "entry", "tp", "sl"), b))
    w = ev.sample_weights(ev.average_uniqueness(l, ev.concurrency(l, b))).select("symbol", "t0", "t1", "label", "weight")
    rows = ln.training_rows(w, ft.batch_features(b), NAMES)
    rows, splits = ln.settle(rows, ev.combinatorial_purged(l.select("symbol", "t0", "t1"), groups, tests, 5))
    oof = ln.out_of_fold(rows, splits, n_folds, **FOREST).select("symbol", "t0", "fold", F.col("p").alias("p_i"))
    ends = splits.filter("role = 'test'").groupBy("symbol", "fold").agg(F.max("t1").alias("fold_end"))
    thr = ev.exit_threshold(splits.filter("role = 'train'").join(b.select("symbol", F.col("bar_idx").alias("t0"), "p_trend"), ["symbol", "t0"]), ["symbol", "fold"]).withColumnRenamed("threshold", "thr")
    t = oof.join(e.select("symbol", "t0", "side", "entry", F.col("p_chop").alias("p_chop_i"), (F.col("atr_14") / F.col("entry") * 0.1).alias("sigma")), ["symbol", "t0"])
    t = sz.resolve_trades(t, True).join(ends, ["symbol", "fold"]).join(thr, ["symbol", "fold"])
    x = ev.trailing_exit(t, b, fold_end="fold_end")
    px = lambda k, n: b.select("symbol", F.col("bar_idx").alias(k), F.col("ts_ms").alias(n))
    last = b.groupBy("symbol").agg(F.max("bar_idx").alias("_l"))
    x = x.join(last, "symbol").withColumn("exit_idx", F.least("exit_idx", "_l")).drop("_l")
    x = x.join(px("t0", "entry_ts"), ["symbol", "t0"]).join(px("exit_idx", "exit_ts"), ["symbol", "exit_idx"])
    x = ev.funding_accrued(x.withColumn("size_notional", F.lit(10000.0)), rate=0.0001)
    r = sz.finalize_trades(x.drop("size_notional"), b)
    return r.select("symbol", "fold", F.col("t0").alias("entry_idx"), "entry_ts", "entry", "p_i", "p_chop_i", "mode", "side", "sl", "leverage", "liq", "exit_idx", "exit_ts", "exit_reason", "boundary_truncated", "fill_price_exit", "fee_entry", "fee_exit", "funding_usd", "gross_pnl", "realized_return")
