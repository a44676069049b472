"""Tick cleaning and dollar bars.

A symbol may hold a third of all ticks, so every operator works on blocks of rows or of
time; nothing sorts a symbol in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions import frames as fr
from barloom.operators import maps
from barloom.operators.ordered import BLOCK_ROWS, along, blocked, carried, fill_forward, kept, let_go, positions, runs_of

DAY_MS = 86_400_000
#: rows of a segment whose steps are composed; a fixed value, so results do not depend on blocks
SEGMENT = 1024


def numbered(ticks: DataFrame) -> DataFrame:
    """Ticks with ``pos`` in (ts_ms, seq) order per symbol."""
    return positions(ticks, ["symbol"], ["ts_ms", "seq"])


def _inside(*order):
    return Window.partitionBy("symbol", "blk").orderBy(*(order or ("pos",)))


def median_of_sorted(a: Column, n: int) -> Column:
    if n % 2:
        return F.element_at(a, n // 2 + 1)
    return (F.element_at(a, n // 2) + F.element_at(a, n // 2 + 1)) / 2.0


def median_of_any(a: Column) -> Column:
    """Median of a sorted array of any length; null if it is empty."""
    n = F.size(a)
    at = lambda k: F.element_at(a, F.floor(k).cast("int"))
    return F.when(n > 0, (at((n + 1) / 2) + at(n / 2 + 1)) / 2.0)


def with_mad(b: DataFrame, w: int, over) -> DataFrame:
    """Adds ``sigma``: 1.4826 x median absolute deviation of the ``w`` rows before.

    Staged in columns, so the window array and its median are computed once per row.
    """
    a = F.sort_array(F.collect_list("price").over(over.rowsBetween(-w, -1)))
    b = b.withColumn("_a", a).withColumn("_m", F.when(F.size("_a") == w, median_of_sorted(F.col("_a"), w)))
    b = b.withColumn("_a", F.expr("sort_array(transform(_a, x -> abs(x - _m)))"))
    return b.withColumn(
        "sigma", F.when(F.col("_m").isNotNull(), 1.4826 * median_of_sorted(F.col("_a"), w))
    ).drop("_a", "_m")


def rolling_mad(ticks: DataFrame, window: int = 100, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Numbered ticks plus ``sigma``."""
    b = blocked(ticks, before=window, block_rows=block_rows)
    return with_mad(b, window, _inside()).filter("own").drop("blk", "own")


def flag_ticks(ticks: DataFrame, window: int = 100, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``sigma, is_bad, is_tail``: jump, volume and reversal rules."""
    b = blocked(ticks, before=window + 1, after=1, block_rows=block_rows)
    o = _inside()
    back = o.rowsBetween(-window, -1)
    b = with_mad(b, window, o).withColumns(
        {
            "_vs": F.sort_array(F.collect_list("volume").over(back)),
            "_p0": F.lag("price").over(o),
            "_p1": F.lead("price").over(o),
            "_next": F.lead("pos").over(o),
        }
    ).filter("own").withColumn("_vm", median_of_any(F.col("_vs")))
    jump = F.abs(F.col("price") - F.col("_p0"))
    usable = (F.col("pos") >= window) & F.col("_next").isNotNull() & (F.col("sigma") > 0)
    blank = F.col("price").isNull() | F.col("_p0").isNull()
    big = usable & ~blank & (jump > 5.0 * F.col("sigma"))
    thin = F.col("volume") < 2.0 * F.col("_vm")
    back_again = F.abs(F.col("_p1") - F.col("_p0")) < 0.3 * jump
    no = F.lit(False)
    return b.withColumns(
        {
            "is_bad": F.coalesce(usable & blank, no) | F.coalesce(big & thin & back_again, no),
            "is_tail": F.coalesce(big & ~thin, no),
        }
    ).drop("_vs", "_vm", "_p0", "_p1", "_next", "blk", "own")


def cross_venue(ticks: DataFrame, ref: DataFrame, window_ms: int = 500, eta: float = 2.0, block_ms: int = 3_600_000) -> DataFrame:
    """Adds ``confirmed``: the other venue stayed within eta sigma of its anchor.

    ``ref``: (symbol, ts_ms, seq, price, sigma). Ticks and reference rows meet in time
    blocks; a sliding range frame takes the extremes of the reference price, so no
    tick-reference pair is ever produced. The anchor (last reference at or before the
    tick) is carried over block summaries when the block holds none.
    """
    block_ms = max(block_ms, window_ms)
    home = F.floor(F.col("ts_ms") / block_ms)
    anchor = F.struct(F.col("price").alias("p"), F.col("sigma").alias("s"))
    r = ref.withColumns({"_home": home, "ref": anchor})
    off = F.col("ts_ms") - F.col("_home") * block_ms
    near = F.array_compact(
        F.array(
            F.col("_home"),
            F.when(off < window_ms, F.col("_home") - 1),
            F.when(off >= block_ms - window_ms, F.col("_home") + 1),
        )
    )
    refs = r.select("symbol", "ts_ms", "seq", F.explode(near).alias("blk"), "ref", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("pos"))
    mine = ticks.select(
        "symbol", "ts_ms", "seq", home.alias("blk"),
        F.lit(None).cast(refs.schema["ref"].dataType).alias("ref"), F.lit(1).alias("kind"), "pos",
    )
    u = refs.unionByName(mine)
    part = Window.partitionBy("symbol", "blk")
    around = part.orderBy("ts_ms").rangeBetween(-window_ms, window_ms)
    upto = part.orderBy("ts_ms", "kind", "seq").rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumns(
        {
            "hi": F.max("ref.p").over(around),
            "lo": F.min("ref.p").over(around),
            "a_in": F.last("ref", ignorenulls=True).over(upto),
        }
    ).filter("kind = 1")
    ends = r.groupBy("symbol", F.col("_home").alias("blk")).agg(
        F.max_by("ref", F.struct("ts_ms", "seq")).alias("end")
    )
    blocks = mine.select("symbol", "blk").distinct().join(ends, ["symbol", "blk"], "full")
    prior = Window.partitionBy("symbol").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select("symbol", "blk", F.last("end", ignorenulls=True).over(prior).alias("a_prev"))
    u = u.join(carry, ["symbol", "blk"])
    a = F.coalesce("a_in", "a_prev")
    move = F.greatest(F.col("hi") - a["p"], a["p"] - F.col("lo"))
    ok = (a["s"] > 0) & (move < eta * a["s"])
    flags = u.select("symbol", "pos", F.coalesce(ok, F.lit(False)).alias("confirmed"))
    return ticks.join(flags, ["symbol", "pos"])


def filter_outliers(ticks: DataFrame, ref: DataFrame | None = None, window: int = 100, window_ms: int = 500, eta: float = 2.0, block_rows: int = BLOCK_ROWS, block_ms: int = 3_600_000) -> DataFrame:
    """Three conditions alone, or with the other venue when one is given.

    A symbol whose given reference is empty has nothing confirmed, hence nothing bad.
    Missing prices are always bad.
    """
    f = flag_ticks(ticks, window, block_rows)
    if ref is not None:
        f = cross_venue(f, rolling_mad(numbered(ref), window, block_rows), window_ms, eta, block_ms)
        f = f.withColumn("is_bad", F.col("is_bad") & F.col("confirmed")).drop("confirmed")
    missing = F.col("price").isNull() | F.isnan("price") | (F.abs("price") == float("inf"))
    return f.withColumns({"is_bad": F.col("is_bad") | missing, "is_tail": F.col("is_tail") & ~missing})


CLEAN = T.StructType(
    [
        T.StructField("pos", T.LongType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
        T.StructField("clean_price", T.DoubleType()),
        T.StructField("level", T.DoubleType()),
        T.StructField("trend", T.DoubleType()),
        T.StructField("p00", T.DoubleType()),
        T.StructField("p01", T.DoubleType()),
        T.StructField("p11", T.DoubleType()),
        T.StructField("is_bad", T.BooleanType()),
        T.StructField("is_tail", T.BooleanType()),
        T.StructField("sigma", T.DoubleType()),
    ]
)


def _carried(rows: DataFrame, part: str, size: int, elements, compose, names) -> DataFrame:
    """``rows``, and ahead of each block ``part`` of a symbol a row with ``before``, the product of the blocks before it.

    A block of ``size`` positions has one such row, so products are neither joined to ticks nor
    copied to each; the other rows have no ``before``. Symbols with one block have nothing to carry
    and are not composed.
    """
    kind = T.StructType([rows.schema["symbol"], T.StructField(part, T.LongType()), T.StructField("element", T.ArrayType(T.DoubleType()))])
    several = rows.filter(F.col(part) > 0).select("symbol").distinct()
    if several.isEmpty():
        return rows.withColumn("before", F.lit(None).cast("array<double>"))
    found = along(rows, ["symbol"], part, "pos", elements, kind, names)
    found = kept(found)
    before = carried(found.join(several, "symbol", "left_semi"), ["symbol"], part, "element", compose)
    ahead = before.filter("before is not null").select("symbol", part, (F.col(part) * size).alias("pos"), "before")
    return rows.unionByName(ahead, allowMissingColumns=True)


def _handed(table: pa.Table, part: str) -> tuple[pa.Table, list]:
    """The ticks of a table of ``_carried`` rows, and for each of their blocks what stands before it."""
    before = table.column("before")
    first = runs_of(table, ["symbol", part])[:-1]
    return table.filter(before.is_null()), before.take(pa.array(first)).to_pylist()


def _as_table(schema: T.StructType, columns: list) -> pa.Table:
    return pa.table(dict(zip(schema.names, columns, strict=True)))


def _array(table: pa.Table, name: str, kind=float) -> np.ndarray:
    return table.column(name).cast(pa.float64()).to_numpy().astype(kind, copy=False)


def _lists(rows: list) -> pa.Array:
    return pa.array(rows, pa.list_(pa.float64()))


def replace_bad_ticks(flagged: DataFrame, block_rows: int = BLOCK_ROWS, q=(1e-4, 1e-5), r: float = 1e-2, segment: int = SEGMENT) -> DataFrame:
    """Kalman replacement of flagged ticks along each symbol.

    Once it is known which ticks are bad, a segment of ticks maps the state before it to the
    state behind it, and these maps compose; so every segment gets its start state from the
    product of those before it and is filtered once. Segments are cut by position alone, so
    the result has the same bits however rows are grouped (``block_rows`` is the least number of
    rows dealt out together).
    """
    if min(q) < 1e-8 or r < 1e-12:
        raise ValueError("noise too small for the covariance to stay definite")
    states = ("clean_price", "level", "trend", "p00", "p01", "p11")
    schema = T.StructType([flagged.schema["symbol"]] + [f for f in CLEAN.fields if f.name in (*flagged.columns, *states)])
    cols = [c for c in ("pos", "ts_ms", "seq", "price", "volume", "is_bad", "is_tail", "sigma") if c in flagged.columns]
    rows = kept(flagged.select("symbol", *cols).withColumn("_seg", F.floor(F.col("pos") / segment)))
    together = max(1, block_rows // segment)

    def opened(table: pa.Table):
        at = runs_of(table, ["symbol", "_seg"])
        price = _array(table, "price")
        with np.errstate(invalid="ignore"):
            skip = table.column("is_bad").to_numpy() | ~np.isfinite(price) | (price <= 0)
        return at, price, skip.astype(bool)

    def elements(table: pa.Table) -> pa.Table:
        at, price, skip = opened(table)
        head = table.select(["symbol", "_seg"]).take(pa.array(at[:-1]))
        return head.append_column("element", _lists(maps.filter_elements(at, price, skip, q, r).tolist()))

    def final(table: pa.Table) -> pa.Table:
        table, before = _handed(table, "_seg")
        at, price, skip = opened(table)
        state = np.tile([np.nan, 0.0, 1.0, 0.0, 1.0], (len(at) - 1, 1))
        for i, e in enumerate(before):
            if e is not None and e[14]:
                state[i] = e[15:20]
        out = maps.filter_segments(at, price, skip, state, q, r)[0]
        found = [pa.array(c, from_pandas=True) for c in out.T]
        put = dict(zip(states, found, strict=True))
        return _as_table(schema, [put[n] if n in put else table.column(n) for n in schema.names])

    known = _carried(rows, "_seg", segment, elements, maps.filter_product, ["price", "is_bad"])
    known = known.withColumn("_blk", F.floor(F.col("_seg") / together))
    return along(known, ["symbol"], "_blk", "pos", final, schema, [*cols, "_seg", "before"], ahead="before")


def clean_ticks(ticks: DataFrame, ref: DataFrame | None = None, window: int = 100, window_ms: int = 500, eta: float = 2.0, block_rows: int = BLOCK_ROWS, block_ms: int = 3_600_000) -> DataFrame:
    flagged = filter_outliers(numbered(ticks), ref, window, window_ms, eta, block_rows, block_ms)
    clean = replace_bad_ticks(flagged, block_rows)
    let_go(flagged)  # the numbered ticks
    return clean


def gap_projection(level: Column, trend: Column, p00: Column, p01: Column, p11: Column, n: Column, q0=1e-4, q1=1e-5) -> dict[str, Column]:
    """State and covariance after ``n`` predict-only steps, in closed form.

    A step adds the process noise, so a definite covariance stays definite; one that is not (or
    whose diagonal is not positive) is widened as in the filter, before the steps and after them.
    """

    def guarded(a, b, d):
        a, d = F.greatest(a, F.lit(1e-8)), F.greatest(d, F.lit(1e-8))
        floor = F.sqrt(b * b + 1e-6) + 1e-4
        tight = a * d - b * b <= 1e-16
        return F.when(tight, F.greatest(a, floor)).otherwise(a), b, F.when(tight, F.greatest(d, floor)).otherwise(d)

    p00, p01, p11 = guarded(p00, p01, p11)
    a, b, d = guarded(
        p00 + 2 * n * p01 + n * n * p11 + n * q0 + q1 * (n - 1) * n * (2 * n - 1) / 6,
        p01 + n * p11 + q1 * n * (n - 1) / 2,
        p11 + n * q1,
    )
    return {
        "level_n": level + n * trend,
        "trend_n": trend,
        "p00_n": a,
        "p01_n": b,
        "p11_n": d,
    }


# --- tick rule ------------------------------------------------------------------------


def tick_sign(ticks: DataFrame, price: str = "price", initial: float | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``sign`` of the last non-zero move; leading ticks take the first move's sign,
    or ``initial`` when one is given; a flat symbol is +1."""
    b = blocked(ticks, before=1, block_rows=block_rows)
    d = F.signum(F.col(price) - F.lag(price).over(_inside()))
    b = b.withColumn("_d", F.when(d != 0, d)).filter("own").drop("blk", "own")
    f = fill_forward(b, ["symbol"], "_d", "_s", block_rows)
    if initial is not None:
        return f.withColumn("sign", F.coalesce("_s", F.lit(float(initial)))).drop("_d", "_s")
    first = b.filter(F.col("_d").isNotNull()).groupBy("symbol").agg(F.min_by("_d", "pos").alias("_first"))
    return (
        f.join(first, "symbol", "left")
        .withColumn("sign", F.coalesce("_s", "_first", F.lit(1.0)))
        .drop("_d", "_s", "_first")
    )


def window_ofi(bars: DataFrame, window: int = 14, price="close", volume="volume", order="ts_ms") -> DataFrame:
    """Order-flow imbalance of the last ``window`` bars, the sign re-seeded inside each."""
    o = Window.partitionBy("symbol").orderBy(order).rowsBetween(-(window - 1), 0)
    rows = F.collect_list(F.struct(F.col(price).alias("p"), F.col(volume).alias("v"))).over(o)
    b = bars.withColumn("_w", rows)
    folded = F.expr(
        """aggregate(_w, named_struct('p', cast(null as double), 's', 0D, 'wait', 0D, 'buy', 0D, 'sell', 0D),
          (a, x) -> named_struct('p', x.p,
            's', if(a.p is null or x.p = a.p, a.s, signum(x.p - a.p)),
            'wait', if(a.s = 0 and (a.p is null or x.p = a.p), a.wait + greatest(x.v, 0D), 0D),
            'buy', a.buy + if(if(a.p is null or x.p = a.p, a.s, signum(x.p - a.p)) > 0, greatest(x.v, 0D) + a.wait, 0D),
            'sell', a.sell + if(if(a.p is null or x.p = a.p, a.s, signum(x.p - a.p)) < 0, greatest(x.v, 0D) + a.wait, 0D)))"""
    )
    b = b.withColumn("_f", folded)
    buy = F.col("_f.buy") + F.col("_f.wait")  # a window without a move counts as buying
    total = buy + F.col("_f.sell")
    ofi = F.when(total <= 1e-12, 0.0).otherwise(fr.clip(fr.div(buy - F.col("_f.sell"), total), -1.0, 1.0))
    return b.withColumn("window_ofi", F.when(F.size("_w") == window, ofi)).drop("_w", "_f")


# --- thresholds ----------------------------------------------------------------------------


def daily_dollar_volume(ticks: DataFrame, price: str = "price", *more: Column) -> DataFrame:
    """One row for each symbol and day with ticks; ``more``: further aggregates."""
    day = F.floor(F.col("ts_ms") / DAY_MS).alias("day")
    return ticks.groupBy("symbol", day).agg(
        F.sum(F.col(price) * F.col("volume")).alias("dollar_volume"), F.min("ts_ms").alias("ts_ms"), *more
    )


def daily_threshold(daily: DataFrame, window: int = 21, bars_per_day: float = 50.0) -> DataFrame:
    """Mean dollar volume of the previous days over the bars wanted per day.

    One row per day and symbol: windows are bounded by the calendar.
    """
    o = Window.partitionBy("symbol").orderBy("day")
    upto = o.rowsBetween(Window.unboundedPreceding, 0)
    d = daily.withColumn("_f", F.last("dollar_volume", ignorenulls=True).over(upto))
    d = d.withColumn("_p", F.lag("_f").over(o))
    f = o.rowsBetween(-(window - 1), 0)
    d = d.withColumn("_m", F.when(F.count("_p").over(f) == window, F.avg("_p").over(f)))
    return d.withColumn("theta", F.last("_m", ignorenulls=True).over(upto) / bars_per_day).drop("_f", "_p", "_m")


def threshold_violations(thresholds: DataFrame, window: int = 21) -> DataFrame:
    """Days after the warm-up whose threshold is missing or not positive."""
    o = Window.partitionBy("symbol").orderBy("day")
    t = thresholds.withColumn("_i", F.row_number().over(o) - 1)
    return t.filter((F.col("_i") >= window) & ~F.coalesce(F.col("theta") > 0, F.lit(False))).drop("_i")


def map_threshold(ticks: DataFrame, thresholds: DataFrame) -> DataFrame:
    """As-of threshold per tick; ticks before the first one get the tick-weighted p10.

    The as-of step runs on the days of a symbol, not on its ticks: days with ticks take
    the last threshold, and ticks join on (symbol, day).
    """
    t = ticks.withColumn("day", F.floor(F.col("ts_ms") / DAY_MS))
    days = t.groupBy("symbol", "day").agg(F.count("*").alias("n_ticks"), F.lit(1).alias("is_day"))
    th = thresholds.select("symbol", "day", "theta")
    o = Window.partitionBy("symbol").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    # a full join puts threshold and day on one row, so equal days match
    filled = days.join(th, ["symbol", "day"], "full").withColumn(
        "theta", F.last("theta", ignorenulls=True).over(o)
    ).filter("is_day = 1")
    return t.join(_every_day(filled), ["symbol", "day"]).drop("day")


def _every_day(days: DataFrame) -> DataFrame:
    """``(symbol, day, theta)``; days of ``(symbol, day, n_ticks, theta)`` without a threshold get one."""
    p10 = F.percentile("theta", F.lit(0.1), F.col("n_ticks")).over(Window.partitionBy("symbol"))
    return days.select("symbol", "day", F.coalesce("theta", p10, F.lit(1_000_000.0)).alias("theta"))


# --- dollar bars ----------------------------------------------------------------------------


def cut_bars(ticks: DataFrame, price: str = "price", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Ticks with ``closes`` (the accumulated dollars reached the threshold), ``sign`` of
    the tick rule (starting at +1) and the number ``bar`` of the bar they belong to.

    Dollars are summed in fixed decimals (``maps.UNITS``); a tick without a threshold closes
    nothing. A block maps the amount that is open before it to
    the amount open behind it and the bars closed in between, and the last price and move before
    it to those behind it; the maps of a symbol's blocks compose, so no block waits for another and
    the result does not depend on their size.
    """
    extra = [c for c in ("is_tail",) if c in ticks.columns]
    names = ["pos", "ts_ms", price, "volume", "theta"] + extra
    schema = T.StructType(
        [ticks.schema["symbol"]] + [ticks.schema[c] for c in names]
        + [T.StructField("closes", T.IntegerType()), T.StructField("sign", T.DoubleType()), T.StructField("bar", T.LongType())]
    )
    rows = kept(ticks.select("symbol", *names).withColumn("_blk", F.floor(F.col("pos") / block_rows)))
    usd = F.col(price) * F.col("volume")
    low = int((rows.filter(usd < 0).agg(F.sum(usd)).first()[0] or 0.0) * maps.UNITS * 1.01)

    def blocks(table: pa.Table):
        at = runs_of(table, ["symbol", "_blk"])
        d, t = maps.amounts(_array(table, price), _array(table, "volume"), _array(table, "theta"), low)
        return at, [maps.Closes(d[a:b], t[a:b], low) for a, b in zip(at[:-1], at[1:], strict=True)]

    def elements(table: pa.Table) -> pa.Table:
        at, found = blocks(table)
        head = table.select(["symbol", "_blk"]).take(pa.array(at[:-1]))
        moves = maps.move_elements(at, _array(table, price)).tolist()
        return head.append_column("element", _lists([[*m, *c.element().tolist()] for m, c in zip(moves, found, strict=True)]))

    def product(first, then):
        return [*maps.moves_product(first[:3], then[:3]), *maps.bars_product(first[3:], then[3:])]

    def final(table: pa.Table) -> pa.Table:
        table, before = _handed(table, "_blk")
        at, found = blocks(table)
        closes, bar = np.zeros(table.num_rows, np.int32), np.zeros(table.num_rows, np.int64)
        held = np.array([(np.nan, 1.0) if e is None else (e[1], e[2] or 1.0) for e in before])
        for a, b, c, e in zip(at[:-1], at[1:], found, before, strict=True):
            carry, done = (0, 0) if e is None else maps.bars_after(e[3:])
            closes[a:b] = marks = c.marks(int(carry))
            bar[a:b] = int(done) + np.cumsum(marks) - marks
        sign = maps.last_moves(at, _array(table, price), held)
        put = {"closes": pa.array(closes), "sign": pa.array(sign), "bar": pa.array(bar)}
        return _as_table(schema, [put[n] if n in put else table.column(n) for n in schema.names])

    known = _carried(rows, "_blk", block_rows, elements, product, [price, "volume", "theta"])
    return along(known, ["symbol"], "_blk", "pos", final, schema, [*names, "before"], ahead="before")


def dollar_bars(ticks: DataFrame, price: str = "price", median_window: int = 100, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Bars of (at least) the threshold amount; the trailing partial bar is dropped.

    ``ticks``: numbered, with ``theta`` and optionally ``is_tail``.
    """
    t = cut_bars(ticks, price, block_rows)
    usd = F.col(price) * F.col("volume")
    tail = F.max(F.col("is_tail").cast("int")) if "is_tail" in ticks.columns else F.lit(0)
    g = t.groupBy("symbol", "bar").agg(
        F.max_by("ts_ms", "pos").alias("ts_ms"),
        F.min_by(price, "pos").alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, "pos").alias("close"),
        F.sum("volume").alias("volume"),
        F.sum(usd * F.when(F.col("sign") > 0, 1.0).otherwise(-1.0)).alias("_net"),
        F.sum(usd).alias("_usd"),
        F.count("*").alias("tick_count"),
        tail.alias("_tail"),
        F.max("closes").alias("_closed"),
    ).filter("_closed = 1")
    g = ticks_to_fill(g, median_window)
    toxic = (F.col("tick_count") < 0.5 * F.col("median_ticks")) & (F.col("median_ticks") > 10.0)
    return g.select(
        "symbol", F.col("bar").alias("bar_idx"), "ts_ms", "open", "high", "low", "close", "volume",
        (F.col("_net") / (F.col("_usd") + 1e-8)).alias("ofi"), "tick_count", "median_ticks",
        F.coalesce(toxic, F.lit(False)).alias("is_toxic_flag"), (F.col("_tail") > 0).alias("is_tail_event"),
    )


def ticks_to_fill(bars: DataFrame, window: int = 100, bar: str = "bar") -> DataFrame:
    """Median tick count of the ``window`` bars before each bar; null while unknown.

    A symbol has a bounded number of bars per day, so the frame runs over its bars.
    """
    o = Window.partitionBy("symbol").orderBy(bar)
    b = bars.withColumn("_c", F.lag(F.col("tick_count").cast("double")).over(o))
    f = o.rowsBetween(-(window - 1), 0)
    m = F.when(F.count("_c").over(f) == window, F.percentile("_c", F.lit(0.5)).over(f))
    return b.withColumn("median_ticks", m).drop("_c")


def build_dollar_bars(ticks: DataFrame, ref=None, window: int = 100, bars_per_day: float = 50.0, median_window: int = 100, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Clean ticks, derive point-in-time thresholds, cut bars; the 19-column contract.

    The cleaning window also serves as the threshold window, as in the bar contract.
    """
    # tables that several steps read are written once, with the columns that follow, and go when the next is written
    flagged = filter_outliers(numbered(ticks), ref, window, block_rows=block_rows)
    states = replace_bad_ticks(flagged.select("symbol", "pos", "ts_ms", "price", "volume", "is_bad", "is_tail"), block_rows)
    let_go(flagged)
    clean = kept(states.filter(F.col("clean_price").isNotNull()).select("symbol", "pos", "ts_ms", "clean_price", "volume", "is_tail"))
    let_go(states)
    daily = daily_dollar_volume(clean, "clean_price", F.count("*").alias("n_ticks"))
    days = kept(_every_day(daily_threshold(daily, window, bars_per_day)))  # the days of the ticks themselves
    mapped = clean.withColumn("day", F.floor(F.col("ts_ms") / DAY_MS)).join(days, ["symbol", "day"]).drop("day")
    bars = dollar_bars(mapped, "clean_price", median_window, block_rows)
    let_go(mapped)
    blank = F.lit(None).cast("double")
    return bars.drop("median_ticks").withColumns(
        {
            "insufficient_history": F.col("bar_idx") < median_window,
            "trend_score": blank, "p_trend": blank, "p_chop": blank,
            "atr_14": blank, "hurst_value": blank, "d_star_used": blank,
        }
    )
