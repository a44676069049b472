import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException

from barloom.streaming import stateful as sf


class Cell:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def feed(batches, seq=None):
    """Rows of one key over several micro-batches through a running sum."""
    p = sf.KernelProcessor(lambda s, x: ((s or 0) + x, ((s or 0) + x,)), ["x"], "ts", ["total"], None, seq)
    p.cell = Cell()
    out = [r for b in batches for r in p.handleInputRows(("k",), iter([pd.DataFrame(b)]), None)]
    return pd.concat(out)


def test_rows_of_equal_time_all_count():
    got = feed([{"ts": [1, 2, 2, 3], "x": [1, 1, 1, 1]}, {"ts": [3, 2, 4], "x": [1, 9, 1]}])
    assert got["late"].sum() == 1 and len(got) == 7
    assert got.loc[~got["late"], "total"].tolist() == [1, 2, 3, 4, 5, 6]


def test_sequence_numbers_order_rows_of_equal_time():
    got = feed([{"ts": [5, 5], "seq": [4, 2], "x": [10, 1]}, {"ts": [5, 5], "seq": [3, 6], "x": [7, 100]}], seq="seq")
    assert got["late"].tolist() == [False, False, True, False]
    assert got.loc[~got["late"], "total"].tolist() == [1, 11, 111]


def test_upsert_stops_at_a_broken_table(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "bars"
    df = spark.createDataFrame([("a", 1, "d1", 2.0), ("b", 1, "d2", 3.0)], "symbol string, ts_ms long, day string, close double")
    df.write.parquet(str(source))
    from barloom.session import checkpoint_dir

    checkpoint_dir(spark)
    stream = lambda: spark.readStream.schema(df.schema).parquet(f"{source}*")
    sf.upsert_batches(stream(), str(target), "day", ["symbol", "ts_ms"])
    assert spark.read.parquet(str(target)).count() == 2
    for f in target.glob("day=*/*.parquet"):
        f.write_bytes(b"no parquet")
    df.write.parquet(f"{source}-more")  # new rows for the stream
    before = sorted(f.name for f in target.glob("day=*/*.parquet"))
    with pytest.raises(StreamingQueryException):
        sf.upsert_batches(stream(), str(target), "day", ["symbol", "ts_ms"])
    assert sorted(f.name for f in target.glob("day=*/*.parquet")) == before


RULES = sf.ExitRules(m_sl=1.0, m_trail=1.0, t_max=4)


def bars(*rows, signal=1, rules=RULES, flatten=(), rate=0.0):
    """Actions of one key: the first bar enters, the others are (open, high, low, close)."""
    state, out = None, []
    for i, (o, h, l, c) in enumerate([(100.0, 101.0, 99.0, 100.0), *rows]):
        hour = 3_600_000
        state, res = sf.exit_step(state, i * 8 * hour, o, h, l, c, 2.0, 0.5, rate, signal, i in flatten, rules)
        out.append(res)
    return state, out


STOP = 100.0 * math.exp(-0.0204)


def test_entry_stands_at_the_close_and_a_quiet_bar_holds():
    state, out = bars((100.0, 100.5, 99.5, 100.0))
    assert out[0][:3] == ("ENTRY", 100.0, pytest.approx(STOP)) and out[1][0] == "HOLD"
    assert state[5] == 100.5


@pytest.mark.parametrize("opened, low, price", [(99.0, 97.0, STOP * (1 - 1.2e-4)), (97.5, 97.0, 97.5 * (1 - 1.2e-4)), (97.5, 97.495, 97.495)])
def test_a_stop_fills_at_itself_or_a_worse_open_within_the_bar(opened, low, price):
    _, out = bars((opened, 99.0, low, 98.9))
    assert out[1][0] == "SL" and out[1][1] == pytest.approx(price)


def test_short_is_the_mirror_of_long():
    _, out = bars((102.5, 103.0, 102.0, 102.2), signal=-1)
    assert out[1][0] == "SL" and out[1][1] == pytest.approx(102.5 * (1 + 1.2e-4))
    assert out[1][4] == pytest.approx(10_000 * (-(out[1][1] - 100) / 100 - 4e-4 - out[1][1] / 100 * 4e-4))


def test_trail_follows_the_extreme_of_clear_bars_and_binds_on_the_next():
    _, out = bars((100.0, 110.0, 100.0, 109.0), (109.0, 112.0, 107.9, 108.0))
    assert out[1][:3] == ("HOLD", None, 108.0)
    assert out[2][0] == "TRAIL" and out[2][1] == pytest.approx(108.0 * (1 - 1.2e-4))


def test_liquidation_comes_first_and_loses_the_margin():
    _, out = bars((60.0, 61.0, 50.0, 60.0))
    assert out[1][0] == "LIQUIDATION" and out[1][4] == pytest.approx(-10_000 / 3)


def test_age_flatten_and_reentry_on_a_later_bar_only():
    quiet = (100.0, 100.1, 99.9, 100.0)
    _, out = bars(*[quiet] * 6)
    assert [o[0] for o in out] == ["ENTRY", "HOLD", "HOLD", "HOLD", "TIME_STOP", "ENTRY", "HOLD"]
    _, out = bars(quiet, quiet, flatten={2})
    assert out[2][0] == "FLATTEN" and out[2][1] == pytest.approx(100.0 * (1 - 1.2e-4))


def test_weak_trend_closes_after_some_bars_in_a_row():
    quiet = (100.0, 100.1, 99.9, 100.0)
    _, out = bars(*[quiet] * 3, rules=sf.ExitRules(m_sl=1.0, m_trail=1.0, flip_below=0.6))
    assert [o[0] for o in out][:3] == ["ENTRY", "HOLD", "REGIME_FLIP"]


def test_funding_is_settled_with_its_sign_and_capped():
    quiet = (100.0, 100.1, 99.9, 100.0)
    _, out = bars(quiet, quiet, rate=0.0005)
    assert [o[3] for o in out] == [0.0, 5.0, 10.0]
    _, out = bars(quiet, rate=0.0005, signal=-1)
    assert out[1][3] == -5.0
    _, out = bars(quiet, rate=0.5)
    assert out[1][3] == 75.0


def test_stop_behind_the_liquidation_price_is_no_entry_and_incomplete_bars_change_nothing():
    _, out = bars(rules=sf.ExitRules(m_sl=20.0))
    assert out[0][0] == "UNSAFE"
    state, _ = bars()
    again, res = sf.exit_step(state, 1, None, 1.0, 1.0, 1.0, 2.0, 0.5, 0.0, 1, False, RULES)
    assert again == state and res[0] == "INCOMPLETE"


def order_rows():
    """(order, ms, seq, state, filled): 7 goes quiet and comes back, 8 is filled, 9 stays open."""
    return [
        (7, 1_000, 1, "SUBMITTED", 0.0), (8, 1_500, 2, "SUBMITTED", 0.0), (8, 2_000, 3, "FILLED", 5.0), (8, 2_100, 4, "FILLED", 5.0),
        (8, 2_200, 5, "CANCELED", 5.0), (9, 9_000, 6, "SUBMITTED", None), (9, 9_100, 7, "PARTIALLY_FILLED", 4.0), (9, 9_200, 8, "PARTIALLY_FILLED", 3.0),
        (9, 9_300, 9, "PARTIALLY_FILLED", 50.0), (9, 9_400, 10, "CREATED", 4.0), (7, 30_000, 11, "ACKNOWLEDGED", 0.0), (9, 60_000, 12, "FILLED", 4.0),
    ]


WANT = {
    (7, 1_000, "SUBMITTED", "SUBMITTED", None), (7, 11_000, "EXPIRED", "EXPIRED", "stuck"), (7, 30_000, "ACKNOWLEDGED", "CREATED", "invalid transition"),
    (7, 40_000, "EXPIRED", "EXPIRED", "stuck"), (8, 1_500, "SUBMITTED", "SUBMITTED", None), (8, 2_000, "FILLED", "FILLED", None), (8, 2_100, "FILLED", "FILLED", None),
    (8, 2_200, "CANCELED", "FILLED", "after the end"), (9, 9_000, "SUBMITTED", "SUBMITTED", None), (9, 9_100, "PARTIALLY_FILLED", "PARTIALLY_FILLED", None),
    (9, 9_200, "PARTIALLY_FILLED", "PARTIALLY_FILLED", "filled decreased"), (9, 9_300, "PARTIALLY_FILLED", "PARTIALLY_FILLED", "overfilled"),
    (9, 9_400, "CREATED", "PARTIALLY_FILLED", "invalid transition"), (9, 19_400, "EXPIRED", "EXPIRED", "stuck"), (9, 60_000, "FILLED", "CREATED", "invalid transition"),
}


@pytest.mark.parametrize("cuts", [(), (3, 8, 11), tuple(range(1, 12))])
def test_stuck_orders_expire_whatever_the_micro_batches(spark, tmp_path, cuts):
    from pyspark.sql import functions as F

    schema = "order_id long, ts_ms long, seq long, state string, filled_qty double"
    rows, edges = order_rows(), [0, *cuts, 12]
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.parquet(str(tmp_path / f"in{i:02d}"))
        if len(cuts) > 3:
            time.sleep(0.02)  # files are taken in order of their time
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    s = s.withColumns({"ts": F.timestamp_millis("ts_ms"), "qty": F.lit(10.0)})
    got = sf.drain(sf.order_lifecycle(s, delay="1 second", stuck_ms=10_000, retain_ms=5_000), str(tmp_path / "out")).collect()
    assert len(got) == len(WANT)
    assert {(r.order_id, r.ts_ms, r.state, r.held, r.problem) for r in got} == WANT


def test_bar_features_by_column_are_those_row_by_row():
    rng = np.random.default_rng(2)
    price = 100 + rng.normal(0, 1, 70).cumsum()
    rows = [[p, p + 1.0, p - 1.0, p, float(v), float(f)] for p, v, f in zip(price.tolist(), rng.integers(0, 3, 70), rng.normal(0, 1, 70))]
    rows[4][3] = rows[50][5] = None
    one, want = None, []
    for r in rows:
        one, o = sf.feature_step(one, *r)
        want.append(o)
    two, got = None, []
    for a, b in ((0, 1), (1, 30), (30, 70)):
        two, o = sf.feature_rows(two, *zip(*rows[a:b], strict=True))
        got += o
    assert one == two and len(one) == 21 and got[4] == got[50] == (None,) * 8
    for x, y in zip(want, got, strict=True):
        assert x == y if None in y else x == pytest.approx(y, rel=1e-9, abs=1e-9)
    closes = np.array([r[3] for r in rows[30:50]])
    assert got[49][1] == pytest.approx(closes[-1] / closes[-2] - 1) and got[49][3] == pytest.approx(rows[49][4] / np.mean([r[4] for r in rows[30:50]]))
