"""Session settings the library relies on."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def local_session(cpus: int | str = 8, app: str = "barloom", **conf) -> SparkSession:
    """Local session for tests and bench; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_MEM", "8g"))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def pin_utc(spark: SparkSession) -> None:
    """Epoch arithmetic below casts zone-less timestamps; pin the zone once."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints: what ``spark.checkpoint.dir`` names, or was set on the context.

    Unset, it is set to a new folder below the session's warehouse, which every session has and
    a cluster shares; no folder of the driver's machine stands in for it.
    """
    have = spark.sparkContext.getCheckpointDir()
    if have:
        return have
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext.getCheckpointDir()


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, once per context.

    Kernels are pickled by reference; a driver started outside the package folder, or a
    cluster without an installed wheel, would not find them otherwise.
    """
    sc = spark.sparkContext
    if getattr(sc, "_barloom_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    archive = shutil.make_archive(
        os.path.join(folder, "barloom_pkg"), "zip", root_dir=os.path.dirname(package), base_dir=os.path.basename(package)
    )
    sc.addPyFile(archive)
    sc._barloom_shipped = True
