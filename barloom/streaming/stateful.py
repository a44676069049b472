"""Stateful stream operators built on the same kernels as the batch scans.

State per key is a small JSON text with the last timestamp and sequence number; rows of a
micro-batch are put in that order per key. A row strictly before what its key has already
emitted is marked ``late`` and leaves the state alone, so late data is visible, not lost; rows
of equal time are all taken, by sequence number if there is one, else as they arrive.
"""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barloom.functions import kernels as kn
from barloom.session import ROCKSDB_PROVIDER

STATE = T.StructType([T.StructField("text", T.StringType()), T.StructField("last", T.LongType()), T.StructField("seq", T.LongType())])


class KernelProcessor(StatefulProcessor):
    """Runs ``step(state, *inputs) -> (state, outputs)`` along each key.

    ``many(state, *columns) -> (state, rows)`` does the same for all rows of a key at once.
    """

    def __init__(self, step: Callable, inputs, ts: str, out_names, initial=None, seq: str | None = None, many: Callable | None = None):
        self.step, self.inputs, self.ts, self.seq, self.many = step, list(inputs), ts, seq, many
        self.out_names, self.initial = list(out_names), initial

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cell = handle.getValueState("state", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        pdf = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        if self.seq or not pdf[self.ts].is_monotonic_increasing:
            pdf = pdf.sort_values([self.ts] + ([self.seq] if self.seq else []), kind="stable")
        held = self.cell.get() if self.cell.exists() else None
        state = json.loads(held[0]) if held else self.initial
        last = (held[1], held[2]) if held and held[1] is not None else None
        seqs = pdf[self.seq].astype("int64").tolist() if self.seq else [0] * len(pdf)
        times = list(zip(pdf[self.ts].astype("int64").tolist(), seqs, strict=True))
        cols = [[None if v is None or v != v else v for v in pdf[c].tolist()] for c in self.inputs]
        out, late = [], []
        if self.many:  # rows are in order of time: the late ones come first
            n = 0 if last is None else next((i for i, t in enumerate(times) if t >= last), len(times))
            late = [True] * n + [False] * (len(times) - n)
            out = [(None,) * len(self.out_names)] * n
            if n < len(times):
                state, found = self.many(state, *(x[n:] for x in cols))
                out, last = out + found, times[-1]
            times = []
        for t, vals in zip(times, zip(*cols)):
            if last is not None and t < last:
                out.append((None,) * len(self.out_names))
                late.append(True)
                continue
            state, o = self.step(state, *vals)
            out.append(o if isinstance(o, tuple) else (o,))
            late.append(False)
            last = t
        self.cell.update((json.dumps(state), *(last or (None, None))))
        found = {f"_k{i}": [k] * len(pdf) for i, k in enumerate(key)} | {self.ts: pdf[self.ts].to_numpy()}
        yield pd.DataFrame(found | dict(zip(self.out_names, map(list, zip(*out)), strict=True)) | {"late": late})

    def close(self) -> None:
        pass


def run_kernel(df: DataFrame, keys, ts: str, step: Callable, inputs, outputs: list[T.StructField], initial=None, seq: str | None = None, many: Callable | None = None) -> DataFrame:
    """(keys.., ts, outputs.., late) for a stream or a static frame."""
    keys = list(keys)
    # the stateful runner does not see added files: send the two modules by value
    for m in (sys.modules[__name__], kn):
        cloudpickle.register_pickle_by_value(m)
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    schema = T.StructType(
        [T.StructField(f"_k{i}", df.schema[k].dataType) for i, k in enumerate(keys)]
        + [T.StructField(ts, T.LongType())] + outputs + [T.StructField("late", T.BooleanType())]
    )
    proc = KernelProcessor(step, inputs, ts, [o.name for o in outputs], initial, seq, many)
    cols = list(dict.fromkeys(keys + [ts] + ([seq] if seq else []) + list(inputs)))
    out = df.select(*cols).groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=proc, outputStructType=schema, outputMode="Append", timeMode="None"
    )
    for i, k in enumerate(keys):
        out = out.withColumnRenamed(f"_k{i}", k)
    return out


def doubles(*names):
    return [T.StructField(n, T.DoubleType()) for n in names]


# --- operators ---------------------------------------------------------------------------------


def efficiency(df, keys=("symbol",), ts="ts_ms", price="close", window=20, smoothing=0.3):
    return run_kernel(df, keys, ts, lambda s, p: kn.efficiency_step(s, p, window, smoothing), [price], doubles("p_trend", "p_chop"))


def hmm(df, keys=("symbol",), ts="ts_ms", x="lr", **kw):
    return run_kernel(df, keys, ts, lambda s, o: kn.hmm_step(s, o, **kw), [x], doubles("p_0", "p_1"))


def trend(df, keys=("symbol",), ts="ts_ms", x="close"):
    return run_kernel(df, keys, ts, kn.trend_step, [x], doubles("level", "trend"))


def imm(df, keys=("symbol",), ts="ts_ms"):
    return run_kernel(df, keys, ts, kn.imm_step, ["close", "p_trend", "p_chop", "atr_14"], doubles("p_hat", "nu_hat", "trend_score"))


def replace_ticks(df, keys=("symbol",), ts="ts_ms", price="price", bad="is_bad"):
    return run_kernel(df, keys, ts, kn.replace_tick, [price, bad], doubles("clean_price", "level", "trend"))


def live_cusum_step(state, price, atr, cooldown=5, spatial=0.5):
    """The online trigger: threshold 2 ATR/price, distance gate inclusive."""
    i, inner = (state[0] + 1, state[1]) if state else (0, None)
    inner, side = kn.cusum_step(inner, i, price, max(2.0 * atr / max(price, 1e-6), 1e-4), atr, cooldown, spatial, inclusive=True)
    return [i, inner], (side,)


def cusum(df, keys=("symbol",), ts="ts_ms", cooldown=5, spatial=0.5):
    step = lambda s, p, a: live_cusum_step(s, p, a, cooldown, spatial)
    return run_kernel(df, keys, ts, step, ["close", "atr_14"], [T.StructField("side", T.IntegerType())])


def tier_step(state, equity, now, t1=0.05, t2=0.10, t3=0.15, freeze_ms=86_400_000):
    """Drawdown tier with a latching last tier and a freeze. state: [peak, dead, until]."""
    peak, dead, until = state or [0.0, False, 0]
    peak = max(peak, equity)
    dd = (peak - equity) / peak if peak > 0 else 0.0
    frozen = now < until
    dead = dead or dd >= t3
    if dead:
        tier, mult = "KILL", 0.0
    elif dd >= t2:
        tier, mult, until = "FLATTEN", 0.0, max(until, now + freeze_ms)
    elif dd >= t1:
        tier, mult = "REDUCE", 0.0 if frozen else 0.5
    else:
        tier, mult = "NORMAL", 0.0 if frozen else 1.0
    return [peak, dead, until], (tier, mult, dd)


def drawdown_tiers(df, keys=("symbol",), ts="ts_ms", equity="equity", t1=0.05, t2=0.10, t3=0.15, per_ms=1):
    """``per_ms``: units of ``ts`` in a millisecond; the freeze lasts a day of them."""
    out = [T.StructField("tier", T.StringType())] + doubles("multiplier", "dd")
    return run_kernel(df, keys, ts, lambda s, e, now: tier_step(s, e, int(now), t1, t2, t3, 86_400_000 * per_ms), [equity, ts], out)


def feature_step(state, o, h, l, c, v, ofi):
    """The derived bar features from the last 21 bars; an incomplete bar is rejected.

    state: rows of (high, low, close, volume, ofi).
    """
    state, out = feature_rows(state, [o], [h], [l], [c], [v], [ofi])
    return state, out[0]


def feature_rows(state, o, h, l, c, v, ofi):
    """``feature_step`` along columns: the bars of a batch at once, behind those of the state."""
    new = np.array([h, l, c, v, ofi], float).T  # None becomes NaN
    whole = ~np.isnan(new).any(axis=1)
    held = np.array(state or [], float).reshape(-1, 5)
    a, n = np.concatenate([held, new[whole]]), int(whole.sum())
    out = [(None,) * 8] * len(new)
    if not n:
        return state, out
    high, low, close, vol, flow = a.T
    size = np.minimum(np.arange(len(held), len(a)) + 1, 21)  # bars up to each, itself included

    def last(x: np.ndarray, k: int) -> np.ndarray:
        """The last ``k`` values up to each new bar, NaN where there are fewer."""
        return np.lib.stride_tricks.sliding_window_view(np.append(np.full(k - 1, np.nan), x), k)[len(x) - n :]

    def spread(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number, mean and standard deviation of what is no NaN."""
        has = ~np.isnan(x)
        k = has.sum(axis=1)
        mean = np.where(has, x, 0.0).sum(axis=1) / np.maximum(k, 1)
        return k, mean, np.sqrt((np.where(has, x - mean[:, None], 0.0) ** 2).sum(axis=1) / np.maximum(k, 1))

    def back(k: int) -> np.ndarray:
        old = last(close, k + 1)[:, 0]
        return np.where((size > k) & (old != 0), (c - old) / old, 0.0)

    move = np.append(np.nan, np.diff(close) / np.maximum(close[:-1], 1e-12))
    h, l, c, v = high[-n:], low[-n:], close[-n:], vol[-n:]
    span = h - l
    with np.errstate(invalid="ignore", divide="ignore"):
        kv, mean, sd = spread(last(vol, 20))
        kr, _, rsd = spread(last(move, 20))
        found = np.stack([
            span / np.maximum(c, 1e-6), back(1), back(5), v / np.maximum(mean, 1e-6),
            np.where(span <= 1e-12, 0.5, (c - l) / span), spread(last(flow, 5))[1],
            np.where((kv < 5) | (sd <= 1e-12), 0.0, (v - mean) / sd),
            np.where((kr < 5) | (rsd <= 1e-12), 0.0, move[-n:] / rsd),
        ], 1)
    for i, x in zip(np.flatnonzero(whole).tolist(), found.tolist(), strict=True):
        out[i] = tuple(x)
    return a[-21:].tolist(), out


def bar_features(df, keys=("symbol",), ts="ts_ms"):
    from barloom.operators.features import DERIVED

    return run_kernel(df, keys, ts, feature_step, ["open", "high", "low", "close", "volume", "ofi"], doubles(*DERIVED), many=feature_rows)


@dataclass(frozen=True)
class ExitRules:
    """Terms of a position: size and costs, stop and trail in ATR, limits in bars.

    ``slip`` is half the spread plus the penalty of a market exit; ``flip_below`` (off when
    None) closes after ``flips`` bars in a row whose trend probability lies below it.
    """

    size: float = 10_000.0
    leverage: float = 3.0
    m_sl: float = 2.0
    m_trail: float = 2.0
    t_max: int = 20
    fee: float = 4e-4
    slip: float = 1.2e-4
    mmr: float = 5e-3
    liq_fee: float = 5e-3
    buffer: float = 0.15
    expected_rate: float = 1e-4
    rate_cap: float = 0.0075
    hours: int = 8
    flip_below: float | None = None
    flips: int = 2
    per_ms: int = 1


def _open_position(now, close, atr, side, r: ExitRules):
    """A position entered at the close, or None when its stop is not safely inside the liquidation price."""
    cushion = r.m_sl * atr / max(close, 1e-6) + r.fee
    if not close > 0 or not 0 <= cushion <= 0.5:
        return None
    stop = max(close * math.exp(-cushion), 1e-4) if side > 0 else close * math.exp(cushion)
    room = 1.0 / r.leverage - r.mmr - r.fee - r.liq_fee - r.expected_rate * max(1.0, r.t_max / 8.0)
    if room <= 0:
        return None
    liq = max(close * (1.0 - room), 1e-4) if side > 0 else close * (1.0 + room)
    if not 0 < side * (close - stop) <= side * (close - liq) * (1.0 - r.buffer):
        return None
    return [side, close, stop, stop, liq, close, 0, 0, 0.0, now]


def exit_step(state, now, opened, high, low, close, atr, p_trend, rate, signal, flatten, r: ExitRules):
    """One position per key: labels each bar with an entry, an exit or nothing.

    state: [side, entry, first stop, stop, liquidation, extreme, weak bars, age, funding, time] or
    None when flat. Funding settled since the last bar is added first. Then the bar is
    held against liquidation, stop, weak trend, age and the order to flatten, in this order. A
    stop set by earlier bars fills at itself or at the open, whichever is worse, less slippage and
    within the bar; only a bar that stays clear of it moves the trail. A key does not
    enter on the bar it leaves on. An incomplete bar changes nothing.
    """
    if any(not kn.usable(x) for x in (opened, high, low, close)):
        return state, ("INCOMPLETE", None, None, None, None)
    atr, p_trend, rate = atr if kn.usable(atr) else 1.0, p_trend if kn.usable(p_trend) else 0.5, rate if kn.usable(rate) else 0.0
    if state is None:
        if not signal or flatten:
            return None, ("FLAT", None, None, None, None)
        pos = _open_position(now, close, atr, 1 if signal > 0 else -1, r)
        return pos, ("ENTRY", close, pos[3], 0.0, None) if pos else ("UNSAFE", None, None, None, None)
    side, entry, first, stop, liq, ext, weak, age, funding, then = state
    step = r.hours * 3_600_000 * r.per_ms
    funding += max(now // step - then // step, 0) * r.size * min(max(rate, -r.rate_cap), r.rate_cap) * side
    age += 1
    worst, best = (low, high) if side > 0 else (high, low)
    weak = weak + 1 if r.flip_below is not None and p_trend < r.flip_below else 0
    away = 1.0 - side * r.slip
    reason = price = None
    if liq > 0 and side * (worst - liq) <= 0:
        reason, price = "LIQUIDATION", liq
    elif side * (worst - stop) <= 0:
        reason = "SL" if stop == first else "TRAIL"
        price = side * max(min(side * stop, side * opened) * away, side * worst)
    else:
        ext = side * max(side * ext, side * best)
        stop = side * max(side * stop, side * ext - r.m_trail * atr)
        if weak >= r.flips:
            reason, price = "REGIME_FLIP", close
        elif age >= r.t_max:
            reason, price = "TIME_STOP", close
        elif flatten:
            reason, price = "FLATTEN", close * away
    if reason is None:
        return [side, entry, first, stop, liq, ext, weak, age, funding, now], ("HOLD", None, stop, funding, None)
    margin = r.size / r.leverage
    if reason == "LIQUIDATION":
        net = -margin - r.size * r.fee
    else:
        net = r.size * (side * (price - entry) / entry - r.fee - price / entry * r.fee) - funding
    return None, (reason, price, stop, funding, max(net, -margin))


def exits(df, keys=("symbol",), ts="ts_ms", rules: ExitRules = ExitRules(), seq: str | None = None):
    """(action, price, stop, funding, net_pnl) of every bar.

    Needs open, high, low, close, atr_14, p_trend, funding_rate, an entry ``signal`` (its sign is
    the side) and ``flatten``.
    """
    step = lambda s, *bar: exit_step(s, *bar, rules)
    out = [T.StructField("action", T.StringType())] + doubles("price", "stop", "funding", "net_pnl")
    return run_kernel(df, keys, ts, step, [ts, "open", "high", "low", "close", "atr_14", "p_trend", "funding_rate", "signal", "flatten"], out, seq=seq)


# --- orders with timers ---------------------------------------------------------------------------


def order_move(moves: dict, held: str, filled: float, state: str, done, qty: float):
    """(problem or None, state, filled) of one event; a rejected event changes nothing."""
    if held not in moves:
        return ("after the end" if state != held else None), held, filled
    if state != held and state not in moves[held]:
        return "invalid transition", held, filled
    if done is not None and done < filled - 1e-12:
        return "filled decreased", held, filled
    if done is not None and done > qty + 1e-9:
        return "overfilled", held, filled
    return None, state, filled if done is None else done


class OrderProcessor(StatefulProcessor):
    """Order events against the table of moves, with an end by event time.

    An open order without an event for ``stuck`` ms expires; an order that has ended is forgotten
    ``retain`` ms later, so state is held for live orders only. A timer does either once the
    watermark has passed; an event that comes after the deadline does the same first, so the rows do
    not depend on where micro-batches are cut.
    """

    COLUMNS = ("ts_ms", "seq", "state", "held", "problem")

    def __init__(self, key: str, stuck: int, retain: int, moves: dict):
        self.key, self.stuck, self.retain, self.moves = key, stuck, retain, moves

    def ended(self, state: str) -> bool:
        return state not in self.moves

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cell = handle.getValueState("order", T.StructType([
            T.StructField("state", T.StringType()), T.StructField("filled", T.DoubleType()), T.StructField("deadline", T.LongType()),
            T.StructField("last", T.LongType()), T.StructField("seq", T.LongType()),
        ]))

    def settle(self, cell, now: int, out: list):
        """The order as it stands at ``now``: expired or forgotten, if a deadline lies before."""
        if cell and not self.ended(cell[0]) and cell[2] < now:
            out.append((cell[2], None, "EXPIRED", "EXPIRED", "stuck"))
            cell = ("EXPIRED", cell[1], cell[2] + self.retain, cell[3], cell[4])
        return None if cell and self.ended(cell[0]) and cell[2] < now else cell

    def keep(self, cell, before) -> None:
        if before:
            self.handle.deleteTimer(before[2])
        if cell:
            self.cell.update(cell)
            self.handle.registerTimer(cell[2])
        elif before:
            self.cell.clear()

    def frame(self, key, out: list) -> pd.DataFrame:
        res = pd.DataFrame(out, columns=self.COLUMNS)
        res["seq"] = res["seq"].astype("Int64")
        res.insert(0, self.key, key[0])
        return res

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["ts_ms", "seq"], kind="stable")
        before = cell = tuple(self.cell.get()) if self.cell.exists() else None
        out: list = []
        for ts, seq, state, done, qty in zip(*(pdf[c].tolist() for c in ("ts_ms", "seq", "state", "filled_qty", "qty")), strict=True):
            ts, seq, done = int(ts), int(seq), None if done is None or done != done else float(done)
            if cell and (ts, seq) < (cell[3], cell[4]):
                out.append((ts, seq, state, cell[0], "late"))
                continue
            cell = self.settle(cell, ts, out)
            open_before = not (cell and self.ended(cell[0]))
            problem, held, filled = order_move(self.moves, cell[0] if cell else "CREATED", cell[1] if cell else 0.0, state, done, qty)
            deadline = cell[2] if not open_before else ts + (self.retain if self.ended(held) else self.stuck)
            cell = (held, filled, deadline, ts, seq)
            out.append((ts, seq, state, held, problem))
        self.keep(cell, before)
        yield self.frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before = tuple(self.cell.get()) if self.cell.exists() else None
        out: list = []
        # a timer stands for its own deadline: one passed since then has its own timer
        cell = self.settle(before, expiredTimerInfo.getExpiryTimeInMs() + 1, out)
        if cell != before:
            if cell:
                self.cell.update(cell)
                self.handle.registerTimer(cell[2])
            else:
                self.cell.clear()
        yield self.frame(key, out)

    def close(self) -> None:
        pass


def order_lifecycle(df: DataFrame, key: str = "order_id", event_time: str = "ts", delay: str = "1 hour", stuck_ms: int = 86_400_000, retain_ms: int = 86_400_000) -> DataFrame:
    """(key, ts_ms, seq, state, held, problem): every event, judged, and the expiry of stuck orders.

    Rows: key, ``event_time`` (timestamp), ts_ms (the same in ms), seq, state, filled_qty, qty. ``held`` is the state
    the order is in behind the row. Events older than the watermark are dropped by Spark.
    """
    from barloom.operators.ledger import TRANSITIONS

    for m in (sys.modules[__name__], kn):
        cloudpickle.register_pickle_by_value(m)
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    schema = T.StructType([
        df.schema[key], T.StructField("ts_ms", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("state", T.StringType()),
        T.StructField("held", T.StringType()), T.StructField("problem", T.StringType()),
    ])
    proc = OrderProcessor(key, stuck_ms, retain_ms, dict(TRANSITIONS))
    return df.select(key, event_time, "ts_ms", "seq", "state", "filled_qty", "qty").withWatermark(event_time, delay).groupBy(key).transformWithStateInPandas(
        statefulProcessor=proc, outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )


# --- running to completion ------------------------------------------------------------------------


def drain(stream: DataFrame, path: str) -> DataFrame:
    """Write everything available to parquet, exactly once, and read it back."""
    q = (
        stream.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/state")
        .outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data")


def upsert_batches(stream: DataFrame, path: str, part_col: str, keys) -> None:
    """Idempotent bar upsert of a stream: each micro-batch rewrites its partitions."""
    from barloom.sources.tables import upsert_bars, write_partitioned

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        parts = batch.select(part_col).distinct()
        try:
            old = spark.read.schema(batch.schema).parquet(path).join(parts, part_col, "left_semi")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # only the first batch has nothing to merge with
                raise
            old = batch.limit(0)
        merged = upsert_bars(old.select(batch.columns), batch, keys).checkpoint()
        write_partitioned(merged, path, part_col)

    q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}_state").trigger(availableNow=True).start()
    q.awaitTermination()


def windowed_bars(ticks: DataFrame, event_time: str = "ts", width: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Event-time bars with a watermark; late ticks inside the delay still count."""
    return (
        ticks.withWatermark(event_time, delay)
        .groupBy("symbol", F.window(event_time, width).alias("w"))
        .agg(
            F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", "seq").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("tick_count"),
        )
    )
