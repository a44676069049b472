"""Rolling row frames per symbol and cross-section statistics per timestamp.

All helpers return Columns. A panel is a long DataFrame ``(symbol, ti, ts_ms, ...)``
on a dense grid, ``ti`` being the position of ``ts_ms`` on that grid; so a frame of
``w`` rows is a frame of ``w`` grid steps. One symbol never holds more rows than the
grid has timestamps, and one timestamp never more than there are symbols, which
bounds every window partition by the calendar and the universe, not by the ticks.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

BY_SYMBOL = ("symbol",)
BY_TS = ("ti",)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(a, b) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def clip(x, lo=None, hi=None) -> Column:
    """Clip that keeps nulls (least/greatest alone would skip them)."""
    x = col(x)
    out = x.cast("double")
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(x.isNotNull(), out)


def safe_log(x) -> Column:
    x = col(x)
    return F.when(x > 0, F.log(x))


def series(keys=BY_SYMBOL, order="ti"):
    return Window.partitionBy(*keys).orderBy(order)


def frame(w: int, keys=BY_SYMBOL, order="ti"):
    return series(keys, order).rowsBetween(-(w - 1), 0)


def lag(x, n: int = 1, keys=BY_SYMBOL, order="ti") -> Column:
    x = col(x)
    return x if n == 0 else F.lag(x, n).over(series(keys, order))


def lead(x, n: int = 1, keys=BY_SYMBOL, order="ti") -> Column:
    return F.lead(col(x), n).over(series(keys, order))


def rolling(agg, x, w: int, m: int | None = None, keys=BY_SYMBOL, order="ti") -> Column:
    """``agg`` over the last ``w`` rows, null with fewer than ``m`` non-null values."""
    x = col(x)
    f = frame(w, keys, order)
    m = w if m is None else m
    return F.when(F.count(x).over(f) >= m, agg(x).over(f))


def roll_mean(x, w, m=None, **k):
    return rolling(F.avg, x, w, m, **k)


def roll_std(x, w, m=None, **k):
    return rolling(F.stddev_samp, x, w, m, **k)


def roll_max(x, w, m=None, **k):
    return rolling(F.max, x, w, m, **k)


def roll_median(x, w, m=None, **k):
    return rolling(lambda c: F.percentile(c, F.lit(0.5)), x, w, m, **k)


def skew_unbiased(skew: Column, n: Column) -> Column:
    """Sample skewness from the population one."""
    n = n.cast("double")
    return F.when(n >= 3, skew * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def kurt_unbiased(kurt_excess_pop: Column, n: Column) -> Column:
    """Sample excess kurtosis from the population one."""
    n = n.cast("double")
    return F.when(
        n >= 4,
        try_scale((n - 1), (n - 2) * (n - 3)) * ((n + 1) * kurt_excess_pop + 6),
    )


def try_scale(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def roll_skew(x, w, m=None, keys=BY_SYMBOL, order="ti"):
    x = col(x)
    f = frame(w, keys, order)
    m = w if m is None else m
    n = F.count(x).over(f)
    return F.when(n >= F.lit(max(m, 3)), skew_unbiased(F.skewness(x).over(f), n))


def ret(x, n: int = 1, **k) -> Column:
    return div(x, lag(x, n, **k)) - 1.0


def log_ret(x, **k) -> Column:
    return safe_log(div(x, lag(x, 1, **k)))


def finite(x) -> Column:
    """Null for NaN and infinities."""
    x = col(x)
    bad = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(~bad, x)


# --- cross-section -------------------------------------------------------------


def xs(keys=BY_TS):
    return Window.partitionBy(*keys)


def xs_z(x, keys=BY_TS) -> Column:
    x = col(x)
    w = xs(keys)
    return div(x - F.avg(x).over(w), F.stddev_samp(x).over(w))


def average_rank(x, keys=BY_TS) -> Column:
    """Rank with ties averaged; one sort serves both the low and the high rank."""
    x = col(x)
    w = Window.partitionBy(*keys).orderBy(x.asc_nulls_last())
    upto = F.count(x).over(w.rangeBetween(Window.unboundedPreceding, 0))
    return F.when(x.isNotNull(), (F.rank().over(w) + upto) / 2.0)


def xs_rank_unit(x, keys=BY_TS) -> Column:
    """Average-tie percent rank mapped to [-1, 1]."""
    n = F.count(col(x)).over(xs(keys))
    return 2.0 * (div(average_rank(x, keys), n) - 0.5)


def first_rank(x, keys=BY_TS, tie="symbol", desc=False) -> Column:
    """1-based position by value with ties broken by name; nulls come last."""
    x = col(x)
    o = (
        [x.desc_nulls_last(), F.col(tie).desc()]
        if desc
        else [x.asc_nulls_last(), F.col(tie).asc()]
    )
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*o))


def half_even(x: Column) -> Column:
    """Round half to even, as an integer."""
    return F.bround(x, 0).cast("int")


def side_count(n: Column, frac: float) -> Column:
    return F.greatest(F.lit(1), half_even(n * F.lit(frac)))
