"""Order-dependent work on long per-key streams without one task per key.

A key may hold a third of all rows, so nothing here sorts a whole key in one task.
``positions`` numbers the rows of every key from counts of sampled ranges; rows are then cut
into blocks of a fixed number of rows. Row frames read a halo of the neighbouring
block (``blocked``), running values are carried over block summaries (``fill_forward``),
recursions whose blocks compose are carried by their products (``carried``), and others run
per block from the state the previous block ended in (``scan``).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.session import checkpoint_dir

BLOCK_ROWS = 1 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame) -> DataFrame:
    """Rows written once to the shared checkpoint folder, and read again.

    ``checkpoint`` would compute the last stage twice, to count it and to write it. Shuffle files
    of the write go with its end, not when the driver happens to collect garbage.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/rows-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def let_go(df: DataFrame) -> None:
    """Delete the folders of ``kept`` rows that ``df`` reads, once what was made of them is kept itself."""
    jvm = df.sparkSession._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if folder.rpartition("/")[2].startswith("rows-"):
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def positions(df: DataFrame, keys, order, name: str = "pos") -> DataFrame:
    """0-based position of each row within its key, in the order of the columns ``order``.

    Rows are dealt out by ranges of (keys, order), with bounds that Spark samples, so a key of
    any length is spread over tasks and no window holds it. A row's position is its place among
    the rows of its key in its range plus what earlier ranges hold of the key. Only the first key
    of a range may continue an earlier one, so that is one row a range.
    """
    keys = list(keys)
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_at", T.LongType())])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, done = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            at = runs_of(pa.Table.from_batches([b]), keys)
            place = np.arange(b.num_rows) - np.repeat(at[:-1], np.diff(at))
            if last is not None and runs_of(pa.Table.from_batches([last, b.slice(0, 1)]), keys)[1] == 2:
                place[: at[1]] += done
            last, done = b.slice(b.num_rows - 1), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(place)], names=schema.names)

    dealt = kept(dealt.mapInArrow(placed, schema))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_n")).withColumn("_off", F.sum("_n").over(before))
    names = [f"_k{i}" for i in range(len(keys))]
    ahead = sizes.filter("_off > 0").select(*keys, "_part", "_off").toDF(*names, "_p", "_off")
    same = F.col("_part") == F.col("_p")
    for k, n in zip(keys, names, strict=True):
        same = same & dealt[k].eqNullSafe(F.col(n))
    rows = dealt.join(F.broadcast(ahead), same, "left").withColumn(name, F.col("_at") + F.coalesce("_off", F.lit(0)))
    return rows.select(*[dealt[c] for c in df.columns], name)


def runs_of(table: pa.Table, names) -> np.ndarray:
    """First rows of the stretches of equal ``names`` in a sorted table, and its end."""
    head = np.zeros(table.num_rows, bool)
    head[:1] = True
    for n in names:
        code = pc.dictionary_encode(table.column(n).combine_chunks(), null_encoding="encode").indices.to_numpy()
        head[1:] |= code[1:] != code[:-1]
    return np.append(np.flatnonzero(head), table.num_rows)


def whole_runs(batches: Iterator[pa.RecordBatch], names, least: int = 1 << 17) -> Iterator[pa.Table]:
    """A sorted stream as tables of about ``least`` rows that cut no stretch of equal ``names``."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= least:
            table = pa.Table.from_batches(held).combine_chunks()
            cut = int(runs_of(table, names)[-2])
            if cut:
                yield table.slice(0, cut)
            held, rows = table.slice(cut).to_batches(), rows - cut
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def along(df: DataFrame, keys, part: str, pos: str, run: Callable, schema: T.StructType, names, ahead: str | None = None) -> DataFrame:
    """``run`` over tables that hold whole (keys, part) stretches in order of ``pos``.

    Of rows of equal ``pos``, those that have a value in ``ahead`` come first.
    """
    group = [*keys, part]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, group):
            yield from run(table).combine_chunks().to_batches()

    first = [F.col(ahead).isNull()] if ahead else []
    dealt = df.repartition(*group).sortWithinPartitions(*group, pos, *first)
    return dealt.select(*dict.fromkeys([*group, pos, *names])).mapInArrow(stream, schema)


def blocked(df: DataFrame, before: int, after: int = 0, block_rows: int = BLOCK_ROWS, pos: str = "pos") -> DataFrame:
    """Copy the edge rows of each block to its neighbours.

    Adds ``blk`` and ``own``; windows over (keys, blk) ordered by ``pos`` are exact for
    owned rows when their frames reach at most ``before`` / ``after`` rows.
    """
    if max(before, after) >= block_rows:
        raise ValueError("block_rows must exceed the frame")
    p, r = F.col(pos), F.col(pos) % block_rows
    home = F.floor(p / block_rows)
    copies = F.array_compact(
        F.array(
            home,
            F.when(r >= block_rows - before, home + 1) if before else F.lit(None).cast("bigint"),
            F.when((r < after) & (home > 0), home - 1) if after else F.lit(None).cast("bigint"),
        )
    )
    return df.withColumn("_home", home).withColumn("blk", F.explode(copies)).withColumn(
        "own", F.col("blk") == F.col("_home")
    ).drop("_home")


def fill_forward(df: DataFrame, keys, value: str, out: str, block_rows: int = BLOCK_ROWS, pos="pos") -> DataFrame:
    """Last non-null ``value`` at or before each row, carried across blocks."""
    keys = list(keys)
    d = df.withColumn("_blk", F.floor(F.col(pos) / block_rows))
    w = Window.partitionBy(*keys, "_blk").orderBy(pos)
    d = d.withColumn("_in", F.last(value, ignorenulls=True).over(w))
    ends = d.filter(F.col(value).isNotNull()).groupBy(*keys, "_blk").agg(
        F.max_by(value, pos).alias("_end")
    )
    blocks = d.select(*keys, "_blk").distinct().join(ends, keys + ["_blk"], "left")
    prev = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select(*keys, "_blk", F.last("_end", ignorenulls=True).over(prev).alias("_carry"))
    return (
        d.join(carry, keys + ["_blk"])
        .withColumn(out, F.coalesce("_in", "_carry"))
        .drop("_in", "_carry", "_blk")
    )


def dump_state(state) -> str:
    return json.dumps(state)


def longest_key(df: DataFrame, keys) -> int:
    """Rows of the longest key: a map-side combined count over the key columns."""
    top = df.groupBy(*keys).count().agg(F.max("count")).first()[0]
    return 0 if top is None else int(top)


def scan(
    df: DataFrame,
    keys,
    kernel: Callable,
    schema: T.StructType,
    initial,
    columns,
    pos: str = "pos",
    block_rows: int = BLOCK_ROWS,
    rows_per_key: int | None = None,
) -> DataFrame:
    """Run ``kernel(state, rows) -> (state, output)`` along every key.

    Each block first runs from the initial state, in parallel; a block whose
    predecessor ended in another state than the one it started from runs again, until
    nothing changes. Recursions that reset or forget settle in a few rounds, and any
    recursion settles after as many rounds as a key has blocks, so the result is the
    one of a single sequential pass. A key within one block needs no round at all.
    """
    keys = list(keys)
    cols = list(dict.fromkeys(keys + [pos] + list(columns)))
    out_names = [f.name for f in schema.fields]
    key_fields = [df.schema[k] for k in keys]
    blk_field = T.StructField("_blk", T.LongType())
    start = dump_state(initial)

    def run(state_text, pdf):
        return kernel(json.loads(state_text), pdf.sort_values(pos, kind="stable"))

    if rows_per_key is None:
        rows_per_key = longest_key(df, keys)
    if rows_per_key <= block_rows:

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            return run(start, pdf)[1][out_names]

        return df.select(*cols).groupBy(*keys).applyInPandas(whole, schema)

    checkpoint_dir(df.sparkSession)
    rows = df.select(*cols).withColumn("_blk", F.floor(F.col(pos) / block_rows)).checkpoint()
    group = keys + ["_blk"]
    end_schema = T.StructType(key_fields + [blk_field, T.StructField("_end", T.StringType())])

    def ends(k, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=[f.name for f in end_schema])
        state, _ = run(right["_start"].iloc[0], left)
        return pd.DataFrame([list(k) + [dump_state(state)]], columns=group + ["_end"])

    def beside(left: DataFrame, starts: DataFrame):
        """Blocks next to their start state (renamed: both come from the same rows)."""
        named = [f"_s{i}" for i in range(len(group))]
        right = starts.select(*group, "_start").toDF(*named, "_start")
        return left.groupBy(*group).cogroup(right.groupBy(*named))

    def run_blocks(starts: DataFrame) -> DataFrame:
        todo = rows.join(starts.select(*group), group, "left_semi")
        return beside(todo, starts).applyInPandas(ends, end_schema)

    starts = rows.select(*group).distinct().withColumn("_start", F.lit(start)).checkpoint()
    finished = run_blocks(starts).checkpoint()
    by_block = Window.partitionBy(*keys).orderBy("_blk")
    while True:
        want = (
            starts.join(finished, group)
            .withColumn("_want", F.coalesce(F.lag("_end").over(by_block), F.lit(start)))
            .checkpoint()
        )
        changed = want.filter(F.col("_want") != F.col("_start"))
        if changed.isEmpty():
            break
        again = run_blocks(changed.select(*group, F.col("_want").alias("_start"))).withColumnRenamed("_end", "_new")
        finished = (
            want.select(*group, "_end").join(again, group, "left")
            .select(*group, F.coalesce("_new", "_end").alias("_end")).checkpoint()
        )
        starts = want.select(*group, F.col("_want").alias("_start")).checkpoint()

    def final(k, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return run(right["_start"].iloc[0], left)[1][out_names]

    return beside(rows, starts).applyInPandas(final, schema)


def carried(blocks: DataFrame, keys, idx: str, elem: str, compose: Callable, fan: int = 1024) -> DataFrame:
    """``(keys, idx, before)``: the elements of all earlier blocks of a key, composed in order.

    ``elem`` is an array of doubles and ``compose(a, b)`` the associative product "first a, then
    b"; ``before`` is null for a key's first block. ``idx`` need not be dense. At most ``fan``
    neighbouring blocks meet in a task: their product stands for them one level up, and what
    precedes the group is handed down again, so the number of passes is the logarithm of the
    block numbers to the base ``fan``.
    """
    keys = list(keys)
    fields = [blocks.schema[k] for k in keys]
    doubles = T.ArrayType(T.DoubleType())
    down = T.StructType([*fields, T.StructField(idx, T.LongType()), T.StructField("before", doubles)])
    up = T.StructType([*fields, T.StructField(idx, T.LongType()), T.StructField(elem, doubles)])

    def running(pdf: pd.DataFrame, before) -> pd.DataFrame:
        pdf = pdf.sort_values(idx, kind="stable")
        out = []
        for e in pdf[elem]:
            out.append(before)
            before = e if before is None else compose(before, e)
        return pdf[[*keys, idx]].assign(before=out)[[f.name for f in down]]

    def fold(k, pdf: pd.DataFrame) -> pd.DataFrame:
        product = None
        for e in pdf.sort_values(idx, kind="stable")[elem]:
            product = e if product is None else compose(product, e)
        return pd.DataFrame([[*k, product]], columns=[*keys, idx, elem])

    def resume(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return running(left, right["before"].iloc[0]) if len(left) else left.assign(before=None)[[f.name for f in down]]

    mine = blocks.select(*keys, F.col(idx).cast("long").alias(idx), elem)
    top = mine.agg(F.max(idx)).first()[0]
    if top is None or top < fan:
        return mine.groupBy(*keys).applyInPandas(lambda pdf: running(pdf, None), down)
    checkpoint_dir(blocks.sparkSession)
    grouped = mine.withColumn("_g", F.floor(F.col(idx) / fan))
    folded = grouped.groupBy(*keys, "_g").applyInPandas(fold, up).checkpoint()
    above = carried(folded, keys, idx, elem, compose, fan)
    names = [f"_k{i}" for i in range(len(keys) + 1)]
    above = above.select(*keys, idx, "before").toDF(*names, "before")
    return grouped.groupBy(*keys, "_g").cogroup(above.groupBy(*names)).applyInPandas(resume, down)


def per_series(df: DataFrame, keys, kernel: Callable, schema, columns, order="ti") -> DataFrame:
    """Kernel over one whole series per key, for series with one row per timestamp.

    Only for inputs whose rows per key are bounded by the calendar (bars on a grid,
    portfolio periods); tick streams go through ``scan``.
    """
    out_names = [f.name for f in schema.fields]

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        return kernel(pdf.sort_values(order, kind="stable").reset_index(drop=True))[out_names]

    cols = list(dict.fromkeys(list(keys) + [order] + list(columns)))
    return df.select(*cols).groupBy(*keys).applyInPandas(whole, schema)


def asof_grid(grid: DataFrame, facts: DataFrame, keys, order: str, value: str) -> DataFrame:
    """Forward fill sparse facts onto a grid: last fact at or before each grid row.

    Grid and facts are per-calendar series, so a window per key is bounded.
    """
    keys = list(keys)
    g = grid.select(*keys, order).withColumns({"_v": F.lit(None).cast("double"), "_g": F.lit(1)})
    f = facts.select(*keys, order, F.col(value).cast("double").alias("_v"), F.lit(0).alias("_g"))
    w = Window.partitionBy(*keys).orderBy(order, "_g").rowsBetween(Window.unboundedPreceding, 0)
    return (
        g.unionByName(f)
        .withColumn(value, F.last("_v", ignorenulls=True).over(w))
        .filter("_g = 1")
        .select(*keys, order, value)
    )
