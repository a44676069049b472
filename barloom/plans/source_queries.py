"""Round trips through files: the bar store by interval, the execution log, the trial log."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.plans.registry import bars_sql, out, query
from barloom.sources import tables as tb

BAR = ["symbol", "ts_ms", "open", "high", "low", "close", "volume", "tick_count", "ofi"]
WEEK = "(ts_ms // 604800000)"


def bar_store(spark, sf_dir) -> tuple[str, T.StructType]:
    """Week and month bars by interval: even weeks first, then a batch of odd weeks and of corrected ones."""
    path = tb.fresh_path(spark, "bars")
    bars = {g: tb.bucket_bars(spark, sf_dir, tb.BUCKETS[g]).select(*BAR).withColumn("interval", F.lit(g)) for g in ("week", "month")}
    number = F.floor(F.col("ts_ms") / tb.WEEK_MS)
    tb.write_partitioned(bars["week"].where(number % 2 == 0).unionByName(bars["month"]), path, "interval")
    batch = bars["week"].where((number % 2 == 1) | (number % 3 == 0)).withColumn("close", F.col("close") + 1.0)
    for _ in range(2):  # a repeated batch changes nothing
        tb.upsert_store(batch, path)
    return path, batch.schema


@query(
    "bar_store_interval",
    f"WITH {bars_sql('week')}, s AS (SELECT * REPLACE (close + CASE WHEN {WEEK}%2=1 OR {WEEK}%3=0 THEN 1 ELSE 0 END AS close), 'week' AS interval FROM bars) "
    + out("s", "symbol, ts_ms, tick_count, interval", "open, high, low, close, volume, ofi"),
)
def bar_store_interval(spark, sf_dir):
    """One interval of the partitioned store after an upsert."""
    path, schema = bar_store(spark, sf_dir)
    return tb.read_interval(spark, path, schema, "week")


LOG = T.StructType([T.StructField("timestamp_ms", T.LongType()), T.StructField("order_id", T.LongType()), T.StructField("gross_notional", T.DoubleType()), T.StructField("note", T.StringType())])


def log_lines(spark, sf_dir):
    """A log line for each order; every seventh is cut off, every eleventh blank, as a crash leaves them."""
    o = tb.read(spark, sf_dir, "orders")
    record = F.to_json(F.struct(
        tb.epoch_ms("o_orderdate").alias("timestamp_ms"), F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").cast("double").alias("gross_notional"),
        F.col("o_orderpriority").alias("note"), F.col("o_orderstatus").alias("later_field"),
    ))
    cut = F.substring(record, F.lit(1), F.floor(F.length(record) / 2).cast("int"))
    line = F.when(F.col("o_orderkey") % 11 == 0, F.lit("  ")).when(F.col("o_orderkey") % 7 == 0, cut).otherwise(record)
    return o.select(line.alias("value"), (F.col("o_custkey") % 4).cast("int").alias("batch"))


@query(
    "execution_log_round_trip",
    "WITH o AS (SELECT *, o_custkey%4 AS batch, o_orderkey%7=0 AS bad FROM orders WHERE o_orderkey%11<>0), "
    "g AS (SELECT batch, count(*) FILTER (NOT bad) AS n_records, count(*) FILTER (bad) AS n_broken, sum(o_totalprice) FILTER (NOT bad) AS gross_notional, "
    "min(epoch_ms(o_orderdate)) FILTER (NOT bad) AS first_ms, max(epoch_ms(o_orderdate)) FILTER (NOT bad) AS last_ms, "
    "count(DISTINCT o_orderpriority) FILTER (NOT bad) AS n_notes FROM o GROUP BY batch) "
    + out("g", "CAST(batch AS INT) AS batch, n_records, n_broken, first_ms, last_ms, n_notes", "gross_notional", 2),
    2,
)
def execution_log_round_trip(spark, sf_dir):
    """Batches appended twice, read tolerantly: records, broken lines and totals of each batch."""
    path, lines = tb.fresh_path(spark, "log"), log_lines(spark, sf_dir)
    tb.append_batch(lines.where("batch <= 2"), path)
    tb.append_batch(lines.where("batch >= 2"), path)  # batch 2 once more
    log = tb.read_batches(spark, path, LOG)
    good = F.col("broken").isNull()
    return log.groupBy("batch").agg(
        F.count_if(good).alias("n_records"), F.count_if(~good).alias("n_broken"),
        F.min(F.when(good, F.col("timestamp_ms"))).alias("first_ms"), F.max(F.when(good, F.col("timestamp_ms"))).alias("last_ms"),
        F.count_distinct(F.when(good, F.col("note"))).alias("n_notes"), F.sum(F.when(good, F.col("gross_notional"))).alias("gross_notional"),
    )


@query("trial_files_count", "SELECT count(*) FILTER (o_orderkey%11<>0) AS n_trials FROM orders")
def trial_files_count(spark, sf_dir):
    """Non-blank lines over all files of a trial log; a broken line is a trial that was started."""
    path = tb.fresh_path(spark, "trials")
    tb.append_batch(log_lines(spark, sf_dir), path)
    return tb.count_trials(spark, path)
