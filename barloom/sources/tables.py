"""Scans, sinks and the binding of the test tables to ticks, bars and panels."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.session import checkpoint_dir, pin_utc

DAY_MS = 86_400_000
WEEK_MS = 7 * DAY_MS

BAR_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
        T.StructField("tick_count", T.LongType()),
        T.StructField("ofi", T.DoubleType()),
    ]
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    pin_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(c) -> F.Column:
    return F.unix_millis(F.col(c).cast("timestamp"))


# --- ticks -----------------------------------------------------------------------

#: line number and part key packed below the order key: unique within one ship date
SEQ = (
    "(l_orderkey * 8 + l_linenumber) * 1048576 + l_partkey % 1048576"
)


def ticks_by_supplier(spark, sf_dir) -> DataFrame:
    """One tick per line item, keyed by supplier; no join needed."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("symbol"),
        epoch_ms("l_shipdate").alias("ts_ms"),
        F.expr(SEQ).alias("seq"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("volume"),
    )


def ticks_by_brand(spark, sf_dir, extra=()) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("p_brand").alias("symbol"),
        epoch_ms("l_shipdate").alias("ts_ms"),
        F.expr(SEQ).alias("seq"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("volume"),
        *extra,
    )


# --- bars and panels -------------------------------------------------------------

#: unit prices of the test lines span four decades and have no history; panels shift
#: them so that returns stay in a plausible range
PANEL_PRICE_BASE = 50_000.0

#: additive day measures carried through every resample
_FLOWS = ("volume", "tick_count", "buy_volume", "rate_sum", "n_a", "n_n", "n_r", "n_o", "n_f")


def day_bars(spark, sf_dir) -> DataFrame:
    """Brand x day bars: one map-side combined aggregate over fixed-width buffers."""
    n_if = lambda cond: F.count_if(F.expr(cond))
    t = ticks_by_brand(
        spark,
        sf_dir,
        extra=("l_returnflag", "l_linestatus", (F.col("l_discount") - F.col("l_tax")).alias("rate")),
    ).withColumn("price", F.col("price") + PANEL_PRICE_BASE)
    return t.groupBy("symbol", "ts_ms").agg(
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.sum("volume").alias("volume"),
        F.count("*").alias("tick_count"),
        F.sum(F.when(F.col("l_linestatus") == "O", F.col("volume")).otherwise(0.0)).alias("buy_volume"),
        F.sum("rate").alias("rate_sum"),
        n_if("l_returnflag = 'A'").alias("n_a"),
        n_if("l_returnflag = 'N'").alias("n_n"),
        n_if("l_returnflag = 'R'").alias("n_r"),
        n_if("l_linestatus = 'O'").alias("n_o"),
        n_if("l_linestatus = 'F'").alias("n_f"),
    )


def bucket_bars(spark, sf_dir, bucket) -> DataFrame:
    """Day bars merged into buckets; ``bucket`` maps ts_ms to the bucket's ts_ms."""
    d = day_bars(spark, sf_dir).withColumn("b", bucket(F.col("ts_ms")))
    g = d.groupBy("symbol", F.col("b").alias("bucket_ms")).agg(
        F.min_by("open", "ts_ms").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "ts_ms").alias("close"),
        *[F.sum(c).alias(c) for c in _FLOWS],
    )
    ratio = lambda a, b: (F.col(a) + 1.0) / (F.col(b) + 1.0)
    return g.select(
        "symbol",
        F.col("bucket_ms").alias("ts_ms"),
        "open", "high", "low", "close", "volume", "tick_count",
        ((2.0 * F.col("buy_volume") - F.col("volume")) / F.col("volume")).alias("ofi"),
        (F.col("rate_sum") / F.col("tick_count")).alias("funding"),
        (F.col("volume") * F.col("close")).alias("oi_value"),
        ratio("n_a", "n_n").alias("crowd_ratio"),
        ratio("n_a", "n_r").alias("smart_ratio"),
        ratio("n_n", "n_r").alias("smart_count_ratio"),
        ratio("n_o", "n_f").alias("taker_ratio"),
    )


def week_bucket(c):
    return F.floor(c / WEEK_MS) * WEEK_MS


def month_bucket(c):
    return F.unix_millis(F.date_trunc("month", F.timestamp_millis(c)))


def day_bucket(c):
    return c


BUCKETS = {"week": week_bucket, "month": month_bucket, "day": day_bucket}


def densify(bars: DataFrame) -> DataFrame:
    """Left-join bars on the dense grid (observed timestamps x symbols).

    The timestamp axis is one sorted array (its length is bounded by the calendar),
    fetched as a scalar subquery and exploded per symbol: no cross join, and the
    grid position ``ti`` comes with it instead of from a global window.
    """
    axis = (
        bars.select("ts_ms").distinct()
        .agg(F.sort_array(F.collect_list("ts_ms")).alias("axis"))
        .scalar()
    )
    grid = bars.select("symbol").distinct().select(
        "symbol", F.posexplode(axis).alias("ti", "ts_ms")
    )
    return grid.join(bars, ["symbol", "ts_ms"], "left")


def panel(spark, sf_dir, grid: str = "week") -> DataFrame:
    return densify(bucket_bars(spark, sf_dir, BUCKETS[grid]))


# --- sinks -----------------------------------------------------------------------


def keep_last(rows: DataFrame, keys, version: str) -> DataFrame:
    """Last version per key, as one combine-friendly aggregate instead of a sort."""
    vals = [c for c in rows.columns if c not in keys and c != version]
    return rows.groupBy(*keys).agg(
        F.max_by(F.struct(*vals), version).alias("_v")
    ).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in vals])


def upsert_bars(existing: DataFrame, new: DataFrame, keys=("symbol", "ts_ms")) -> DataFrame:
    """Append ``new`` to ``existing``; the later batch wins on equal keys."""
    both = existing.withColumn("_batch", F.lit(0)).unionByName(
        new.withColumn("_batch", F.lit(1))
    )
    return keep_last(both, list(keys), "_batch")


def write_partitioned(df: DataFrame, path: str, part_col: str) -> None:
    """Idempotent write: only the partitions present in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        part_col
    ).parquet(path)


def fresh_path(spark, what: str) -> str:
    """A new folder in the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def upsert_store(new: DataFrame, path: str, keys=("symbol", "ts_ms"), part_col: str = "interval") -> None:
    """Merge ``new`` into a table partitioned by ``part_col``; the new row wins on equal keys.

    Only the partitions that ``new`` has rows of are read and replaced, all of them when the job
    commits, so a repeated batch changes nothing. Keys are unique in ``new``.
    """
    spark = new.sparkSession
    touched = [r[0] for r in new.select(part_col).distinct().collect()]  # intervals, a handful
    old = spark.read.schema(new.schema).parquet(path).where(F.col(part_col).isin(touched))
    write_partitioned(upsert_bars(old, new, (*keys, part_col)).select(new.columns), path, part_col)


def read_interval(spark, path: str, schema: T.StructType, interval: str, part_col: str = "interval") -> DataFrame:
    """Rows of one interval; the others' files are not listed for the scan."""
    return spark.read.schema(schema).parquet(path).where(F.col(part_col) == interval)


def read_bars(spark, path: str, fmt: str | None = None) -> DataFrame:
    """Bars by file format; CSV needs the schema, parquet carries it."""
    fmt = fmt or ("csv" if path.rstrip("/").endswith(".csv") else "parquet")
    r = spark.read.schema(BAR_SCHEMA)
    return r.option("header", "true").csv(path) if fmt == "csv" else r.parquet(path)


EXECUTION_LOG_SCHEMA = T.StructType(
    [
        T.StructField("timestamp_ms", T.LongType()),
        T.StructField("equity", T.DoubleType()),
        T.StructField("n_targets", T.LongType()),
        T.StructField("n_orders", T.LongType()),
        T.StructField("gross_notional", T.DoubleType()),
        T.StructField("planned_notional", T.DoubleType()),
        T.StructField("maker_notional", T.DoubleType()),
        T.StructField("taker_notional", T.DoubleType()),
        T.StructField("unfilled_count", T.LongType()),
        T.StructField("net_exposure", T.DoubleType()),
        T.StructField("testnet", T.BooleanType()),
        T.StructField("note", T.StringType()),
    ]
)


def read_jsonl(spark, path: str, schema: T.StructType = EXECUTION_LOG_SCHEMA) -> DataFrame:
    """JSON lines; blank and malformed lines are dropped, unknown fields ignored."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_batch(lines: DataFrame, path: str, batch_col: str = "batch") -> None:
    """Append JSON lines (``value``) batch by batch; a batch that is written again replaces itself."""
    lines.select("value", batch_col).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(batch_col).text(path)


def read_batches(spark, path: str, schema: T.StructType, batch_col: str = "batch") -> DataFrame:
    """Records of a batched log, with the text of a line that is no record in ``broken``.

    Blank lines are no rows and fields that ``schema`` lacks are ignored.
    """
    full = T.StructType([*schema.fields, T.StructField("broken", T.StringType()), T.StructField(batch_col, T.IntegerType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def params_hash(*cols: str) -> F.Column:
    """sha256 of the JSON of the parameters, keys in sorted order."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(cols)])), 256)


def dedupe_last(df: DataFrame, keys, order) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def read_spreads(spark, path: str) -> DataFrame:
    """(symbol, spread_bps) from a JSON map of symbol to spread."""
    m = F.from_json("value", "map<string,double>")
    return spark.read.text(path, wholetext=True).select(F.explode(m).alias("symbol", "spread_bps"))


def export_segments(parts: dict[str, DataFrame], path: str, fmt: str = "csv") -> None:
    """Attribution tables with their segment label, one file set."""
    out = None
    for label, df in parts.items():
        d = df.withColumn("segment", F.lit(label))
        out = d if out is None else out.unionByName(d)
    w = out.write.mode("overwrite")
    w.option("header", "true").csv(path) if fmt == "csv" else w.parquet(path)


def count_trials(spark, folder: str) -> DataFrame:
    """Number of logged trials: non-blank lines over all files of a folder."""
    return spark.read.text(folder).filter(F.length(F.trim("value")) > 0).agg(F.count("*").alias("n_trials"))


def load_bars(spark, path: str | None, live: bool = False) -> DataFrame:
    """Bars of a file; a live mode refuses to run without one."""
    if path is None:
        if live:
            raise ValueError("live modes need a data file")
        raise ValueError("no data file given")
    return read_bars(spark, path)
