"""Shared helpers: tables, shared folders, Arrow batches of texts, links to components."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import checkpoint_dir

#: Stands for a missing id where ids are compared: a row without an id is never the smaller one.
NO_ID = 2**63 - 1


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new folder in the shared checkpoint folder of the cluster."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def staged(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, least: int = 1) -> DataFrame:
    """Deal a small table's rows out to all cores; costly per-row work follows."""
    n = max(least, shuffle_partitions(df.sparkSession))
    return df.repartition(n)


@functools.cache
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda keep: 0)  # only glibc has it


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on between tasks, beside its executor's heap."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


MAX_ROWS = 1 << 16


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of a slice hold about ``limit`` bytes; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size, dtype=np.int64)
        at, done = 0, 0
        while at < batch.num_rows:
            to = max(at + 1, min(at + MAX_ROWS, int(np.searchsorted(ends, done + limit, side="right"))))
            yield batch.slice(at, to - at)
            at, done = to, int(ends[to - 1])
    give_back()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the bounds of its rows; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def blobs(parts: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary column whose row i holds the bytes of ``parts[cuts[i]:cuts[i + 1]]``."""
    parts = np.ascontiguousarray(parts)
    offsets = (np.asarray(cuts, np.int64) * parts.itemsize).astype(np.int64)
    whole = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(parts.view(np.uint8))])
    return whole.cast(pa.binary())


def unblob(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    """The joined contents of a binary column."""
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), dtype)


def ids_or_last(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), NO_ID).to_numpy(zero_copy_only=False)


def own_exchange(key: str) -> F.Column:
    """A join key that no aggregation is partitioned by.

    Joined on it, both sides are exchanged anew, which lets adaptive execution split a hot key;
    a side that comes partitioned out of an aggregation could not be split.
    """
    return F.struct(key)


def _hang(edges: DataFrame, low: DataFrame) -> DataFrame:
    """Replace every edge ``u - v`` by ``v - m``, ``m`` being the smallest neighbour of ``u``."""
    low = low.select(own_exchange("u").alias("k"), "m")
    return edges.join(low, own_exchange("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest reachable id of every id that has a link, as ``(id, component)``.

    Alternates two steps on the edge table until nothing changes: every node's larger
    neighbours are hung on its smallest neighbour, then its smaller neighbours are. Each step
    is a grouped minimum and a join, so a node of any degree is spread by its partners; the
    number of steps grows with the logarithm of the longest chain.
    """
    edges = staged(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges"
    )
    last = None
    while True:
        # neighbours above a node go to the smallest of its neighbours and itself
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _hang(both.where("v > u"), low)
        large = staged(large.distinct(), "edges")
        # neighbours below a node go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _hang(large, low)
        small = small.union(low.select("u", F.col("m").alias("v"))).distinct()
        edges = staged(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == last:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            )
        last = tuple(now)
