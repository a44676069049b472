"""Signal evaluation: information coefficients, quantile returns, decile spreads.

Input is a wide frame ``(symbol, ti, ts_ms, close, <signal>...)``. Everything that is
per symbol (forward returns, lagged signals) is taken in one pass by symbol, then one
exchange by ``ti`` serves the ranks and the per-timestamp statistics.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import frames as fr

HORIZONS = (1, 2, 3, 6, 12, 24, 48, 90, 180)
LAGS = (1, 3, 6, 12, 24, 48, 90)
MAX_LAG = 50
#: a correlation that is zero up to rounding is not a hit
ZERO = 1e-12


def with_forward(p: DataFrame, horizons, close: str = "close") -> DataFrame:
    return p.withColumns(
        {f"fwd_{h}": fr.div(fr.lead(close, h), close) - 1.0 for h in horizons}
    )


def by_config(p: DataFrame, pairs: dict, label: str, keep=("symbol", "ti", "ts_ms")) -> DataFrame:
    """One row per (row, config): the pairs of columns (a, b) of every config."""
    structs = [
        F.struct(F.lit(k).alias(label), F.col(a).alias("a"), F.col(b).alias("b"))
        for k, (a, b) in pairs.items()
    ]
    return (
        p.select(*keep, F.explode(F.array(*structs)).alias("c"))
        .select(*keep, "c.*")
        .filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    )


def rank_correlation(rows: DataFrame, keys, method: str = "spearman", min_names: int = 8) -> DataFrame:
    """Correlation of a and b per key on rows where both are present."""
    a, b = F.col("a"), F.col("b")
    if method == "spearman":
        rows = rows.withColumns({"a": fr.average_rank("a", keys), "b": fr.average_rank("b", keys)})
    return (
        rows.groupBy(*keys)
        .agg(
            F.count("*").alias("n_names"),
            F.stddev_samp(a).alias("_sa"),
            F.stddev_samp(b).alias("_sb"),
            F.corr(a, b).alias("ic"),
        )
        .filter((F.col("n_names") >= min_names) & (F.col("_sa") > 1e-15) & (F.col("_sb") > 1e-15))
        .drop("_sa", "_sb")
    )


def information_coefficient(p: DataFrame, sig: str, horizons=(6,), method="spearman", min_names=8) -> DataFrame:
    """(horizon, ti, ts_ms, n_names, ic): all horizons in one pass."""
    rows = by_config(
        with_forward(p, horizons), {h: (sig, f"fwd_{h}") for h in horizons}, "horizon"
    )
    return rank_correlation(rows, ("horizon", "ti", "ts_ms"), method, min_names)


def series_summary(series: DataFrame, x: str, keys=(), order="ti", max_lag: int = MAX_LAG) -> DataFrame:
    """Mean, deviation, IR, hit rate and the autocorrelation-adjusted t statistic.

    The adjusted size is n / (1 + 2 sum rho_k), the sum cut at the first non-positive
    autocorrelation. A series has one row per timestamp, so the array a group carries
    is bounded by the calendar; one aggregate does it all.
    """
    c = F.col(x)
    g = series.filter(c.isNotNull()).groupBy(*keys).agg(
        F.avg(c).alias("mean"),
        F.stddev_samp(c).alias("std"),
        F.avg((c > ZERO).cast("double")).alias("hit_rate"),
        F.count(c).alias("n"),
        F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), c.alias("v")))).alias("_s"),
    )
    g = g.withColumn("_d", F.expr("transform(_s, s -> s.v - mean)"))
    g = g.withColumn("_den", F.expr("aggregate(_d, 0D, (a, v) -> a + v * v)"))
    # products at each lag; the walk below stops at the first one that is not positive
    g = g.withColumn(
        "_c",
        F.expr(
            f"""transform(sequence(1, greatest(1, least({max_lag}, cast(n div 4 as int)) - 1)),
            k -> aggregate(zip_with(slice(_d, 1, greatest(0, cast(n as int) - k)),
                slice(_d, k + 1, greatest(0, cast(n as int) - k)), (p, q) -> p * q), 0D, (a, v) -> a + v))"""
        ),
    )
    n = F.col("n").cast("double")
    init = F.struct(F.lit(1.0).alias("f"), F.lit(False).alias("stop"), F.lit(1).alias("k"))

    def step(acc, prod):
        rho = F.coalesce(fr.div(prod, F.col("_den")), F.lit(0.0))
        live = ~acc["stop"] & (rho > 0)
        f = F.when(live, acc["f"] + 2.0 * rho * (1.0 - acc["k"] / n)).otherwise(acc["f"])
        return F.struct(f.alias("f"), (~live).alias("stop"), (acc["k"] + 1).alias("k"))

    factor = F.aggregate("_c", init, step)["f"]
    g = g.withColumn(
        "n_eff",
        F.when(F.col("n") < 10, F.greatest(n, F.lit(1.0)))
        .when(F.col("_den") <= 1e-18, n)
        .otherwise(F.greatest(F.lit(1.0), n / F.greatest(factor, F.lit(1.0)))),
    )
    ok = F.col("std") > 1e-15
    return g.select(
        *keys, "n", "mean", "std", "hit_rate", "n_eff",
        F.when(ok, F.col("mean") / F.col("std")).otherwise(0.0).alias("ir"),
        F.when(ok, fr.div(F.col("mean"), F.col("std") / F.sqrt("n_eff"))).otherwise(0.0).alias("t_stat"),
    )


def ic_decay(p: DataFrame, sig: str, horizons=HORIZONS, method="spearman") -> DataFrame:
    ic = information_coefficient(p, sig, horizons, method)
    s = series_summary(ic, "ic", ("horizon",))
    return s.withColumn("ic_per_sqrt_period", F.col("mean") / F.sqrt("horizon"))


def ic_by_period(p: DataFrame, sig: str, horizon: int = 6, unit: str = "year") -> DataFrame:
    ic = information_coefficient(p, sig, (horizon,))
    start = F.unix_millis(F.date_trunc(unit, F.timestamp_millis("ts_ms")))
    return ic.groupBy(start.alias("period_ms")).agg(
        F.avg("ic").alias("ic_mean"),
        F.stddev_samp("ic").alias("ic_std"),
        F.count("*").alias("n"),
        F.avg((F.col("ic") > ZERO).cast("double")).alias("hit_rate"),
    )


def signal_autocorrelation(p: DataFrame, sig: str, lags=LAGS) -> DataFrame:
    q = p.withColumns({f"_lag_{k}": fr.lag(sig, k) for k in lags})
    rows = by_config(q, {k: (sig, f"_lag_{k}") for k in lags}, "lag")
    return rank_correlation(rows, ("lag", "ti")).groupBy("lag").agg(F.avg("ic").alias("autocorr"))


def effective_breadth(p: DataFrame, sig: str, rebalance_every: int, periods_per_year: float) -> DataFrame:
    rho = signal_autocorrelation(p, sig, (rebalance_every,)).select("autocorr").scalar()
    names = (
        p.groupBy("ti").agg(F.count(sig).alias("n"))
        .agg(F.percentile("n", F.lit(0.5)).cast("int").cast("double").alias("n_names"))
    )
    r = fr.clip(F.coalesce(rho, F.lit(0.0)), 0.0, 0.999)
    per_year = periods_per_year / rebalance_every
    raw = F.col("n_names") * per_year
    return names.select(
        "n_names",
        F.lit(per_year).alias("rebalances_per_year"),
        raw.alias("raw_breadth"),
        r.alias("signal_autocorr"),
        (1.0 - r).alias("independence_factor"),
        (raw * (1.0 - r)).alias("effective_breadth"),
    )


def implied_sharpe(ic_mean: Column, breadth: Column, transfer: float = 0.6) -> Column:
    return transfer * ic_mean * F.sqrt(F.greatest(breadth, F.lit(0.0)))


def ic_correlation(p: DataFrame, sigs, horizon: int = 6) -> DataFrame:
    """Pairwise correlation of IC series: one conditional pivot, one aggregate.

    The pairs are columns of one row per timestamp, so nothing is self-joined.
    """
    q = with_forward(p, (horizon,))
    rows = by_config(q, {s: (s, f"fwd_{horizon}") for s in sigs}, "signal")
    ic = rank_correlation(rows, ("signal", "ti"))
    wide = ic.groupBy("ti").agg(
        *[F.max(F.when(F.col("signal") == s, F.col("ic"))).alias(s) for s in sigs]
    )
    pairs = [(a, b) for a in sigs for b in sigs]
    one = wide.agg(
        F.array(
            *[
                F.struct(F.lit(a).alias("signal_a"), F.lit(b).alias("signal_b"), F.corr(a, b).alias("corr"))
                for a, b in pairs
            ]
        ).alias("m")
    )
    return one.select(F.explode("m").alias("r")).select("r.*")


def _cross_section(p: DataFrame, sig: str, horizon: int, min_names: int) -> DataFrame:
    rows = (
        with_forward(p, (horizon,))
        .select("symbol", "ti", "ts_ms", F.col(sig).alias("s"), F.col(f"fwd_{horizon}").alias("r"))
        .filter(F.col("s").isNotNull() & F.col("r").isNotNull())
    )
    return rows.withColumn("n", F.count("*").over(fr.xs())).filter(F.col("n") >= min_names)


def quantile_returns(p: DataFrame, sig: str, horizon: int = 1, k: int = 5, min_names: int = 10) -> DataFrame:
    """Mean relative return per rank bucket; edges are linear quantiles of 1..n."""
    rows = _cross_section(p, sig, horizon, min_names)
    pos = fr.first_rank("s")
    bucket = F.greatest(F.ceil((pos - 1) * k / (F.col("n") - 1)), F.lit(1))
    rows = rows.withColumns({"bucket": bucket, "rel": F.col("r") - F.avg("r").over(fr.xs())})
    per_ts = rows.groupBy("ti", "bucket").agg(F.avg("rel").alias("m"))
    g = per_ts.groupBy("bucket").agg(
        F.avg("m").alias("mean_rel_return"), F.stddev_samp("m").alias("std"), F.count("m").alias("n")
    )
    return g.withColumn(
        "t_stat", fr.div("mean_rel_return", F.col("std") / F.sqrt(F.greatest("n", F.lit(1))))
    )


def factor_returns(p: DataFrame, sig: str, horizon: int = 1, top_frac: float = 0.1, min_names: int = 10) -> DataFrame:
    """Half of the top-minus-bottom mean forward return per timestamp."""
    rows = _cross_section(p, sig, horizon, min_names)
    rows = rows.withColumns({"pos": fr.first_rank("s"), "k": fr.side_count(F.col("n"), top_frac)})
    top = F.col("pos") > F.col("n") - F.col("k")
    low = F.col("pos") <= F.col("k")
    return rows.groupBy("ti", "ts_ms").agg(
        (0.5 * (F.avg(F.when(top, F.col("r"))) - F.avg(F.when(low, F.col("r"))))).alias("spread")
    )


def decile_spread(p: DataFrame, sig: str, horizon=1, top_frac=0.1, min_names=10) -> DataFrame:
    s = series_summary(factor_returns(p, sig, horizon, top_frac, min_names), "spread")
    few = F.col("n") < 20
    z = lambda c: F.when(few, 0.0).otherwise(F.col(c))
    return s.select(
        "n",
        z("mean").alias("mean"),
        F.when(~few, F.col("std")).alias("std"),
        z("t_stat").alias("t_stat"),
        z("ir").alias("sharpe_per_period"),
        F.when(~few, F.col("hit_rate")).alias("hit_rate"),
    )


def monotonicity(q: DataFrame) -> DataFrame:
    """Rank correlation of bucket number and mean return (at least 3 buckets)."""
    w = Window.partitionBy()
    r = q.select(
        F.col("bucket").cast("double").alias("a"),
        fr.average_rank("mean_rel_return", ()).alias("b"),
    )
    return r.agg(
        F.when(F.count("*") >= 3, F.corr("a", "b")).alias("monotonicity")
    )


def ic_weights(p: DataFrame, sigs, horizon: int = 6) -> DataFrame:
    """Mean IC floored at zero and normalised: one row per signal."""
    q = with_forward(p, (horizon,))
    rows = by_config(q, {s: (s, f"fwd_{horizon}") for s in sigs}, "signal")
    m = rank_correlation(rows, ("signal", "ti")).groupBy("signal").agg(F.avg("ic").alias("ic_mean"))
    pos = F.greatest("ic_mean", F.lit(0.0))
    return m.withColumn("weight", fr.div(pos, F.sum(pos).over(Window.partitionBy())))


def ic_weighted_combination(p: DataFrame, sigs, horizon: int = 6) -> DataFrame:
    """Signals combined with their IC weights; the weights are a k-row scalar map."""
    w = ic_weights(p, sigs, horizon).agg(
        F.map_from_entries(F.collect_list(F.struct("signal", "weight"))).alias("m")
    ).scalar()
    q = p.withColumn("_w", w)
    terms = [F.coalesce(F.col(s), F.lit(0.0)) * F.coalesce(F.col("_w")[s], F.lit(0.0)) for s in sigs]
    present = reduce(lambda a, b: a | b, [F.col(s).isNotNull() for s in sigs])
    return q.withColumn("combined", F.when(present, sum(terms))).drop("_w")
