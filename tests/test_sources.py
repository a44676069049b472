"""Partitioned bar store and batched logs: pruning, upserts, repeated batches, broken lines."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from barloom.operators import ledger as lg
from barloom.plans import source_queries as sq
from barloom.sources import tables as tb
from compare import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["bar_store_interval", "execution_log_round_trip", "trial_files_count", "income_phases"])
def test_round_trip_matches_sql(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = connect(SF).execute(entry.oracle_sql()[name]).fetchdf()
    d = differences(got, want)
    assert not d or d.startswith("~"), d


BARS = "symbol string, ts_ms long, close double, interval string"


def test_upsert_touches_only_its_partitions_and_scans_are_pruned(spark, tmp_path):
    path = str(tmp_path / "bars")
    first = spark.createDataFrame([("a", 1, 1.0, "1m"), ("a", 2, 2.0, "1m"), ("a", 1, 9.0, "1h")], BARS)
    tb.write_partitioned(first, path, "interval")
    hour = sorted(os.listdir(f"{path}/interval=1h"))
    batch = spark.createDataFrame([("a", 2, 3.0, "1m"), ("b", 2, 4.0, "1m")], BARS)
    for _ in range(2):
        tb.upsert_store(batch, path)
    got = tb.read_interval(spark, path, first.schema, "1m")
    assert sorted(map(tuple, got.collect())) == [("a", 1, 1.0, "1m"), ("a", 2, 3.0, "1m"), ("b", 2, 4.0, "1m")]
    assert sorted(os.listdir(f"{path}/interval=1h")) == hour
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(interval" in plan


def test_repeated_batch_replaces_itself_and_broken_lines_are_kept_apart(spark, tmp_path):
    path = str(tmp_path / "log")
    lines = [('{"order_id":1,"other":[1]}', 0), ('{"order_id":2', 0), ("", 0), ("   ", 0), ("nonsense", 1), ('{"order_id":3}', 1), (None, 1)]
    df = spark.createDataFrame(lines, "value string, batch int")
    tb.append_batch(df, path)
    tb.append_batch(df.where("batch = 1"), path)
    rows = tb.read_batches(spark, path, sq.LOG).select("batch", "order_id", "broken").collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(0, 1, None), (0, None, '{"order_id":2'), (1, None, "nonsense"), (1, 3, None)], key=str)


def test_empty_log_and_empty_upsert(spark, tmp_path):
    none = spark.createDataFrame([], "value string, batch int")
    tb.append_batch(none, str(tmp_path / "log"))
    assert tb.read_batches(spark, str(tmp_path / "log"), sq.LOG).count() == 0
    bars = spark.createDataFrame([("a", 1, 1.0, "1m")], BARS)
    tb.write_partitioned(bars, str(tmp_path / "bars"), "interval")
    tb.upsert_store(bars.where("false"), str(tmp_path / "bars"))
    assert tb.read_interval(spark, str(tmp_path / "bars"), bars.schema, "1m").count() == 1


def test_income_phases_take_types_from_the_data(spark):
    day = 86_400_000
    rows = [("fee", -1.0, 0), ("pnl", 5.0, day), (None, 2.0, 3 * day), ("fee", -2.0, 2 * day), ("deposit", 99.0, 2 * day), ("fee", None, 4 * day)]
    e = spark.createDataFrame(rows, "type string, amount double, ts_ms long")
    got = lg.income_phases(e, F.lit(2 * day), ~F.col("type").eqNullSafe("deposit")).collect()
    assert {tuple(r) for r in got} == {
        ("before", "fee", -1.0, 1, 0.0), ("before", "pnl", 5.0, 1, 0.0), ("before", "ALL", 4.0, 2, 1.0),
        ("after", "fee", -2.0, 2, 2.0), ("after", "NONE", 2.0, 1, 0.0), ("after", "ALL", 0.0, 3, 2.0),
    }
    assert lg.income_phases(e.where("false"), F.lit(0)).count() == 0
