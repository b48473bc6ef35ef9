"""Shared scratch storage: cut a lineage by writing a table that every executor can read.

Tables go below the folder named in ``spark.checkpoint.dir``.  Losing an executor therefore never
loses them.  Only where that setting is absent (tests, notebooks) is a temporary folder used.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder, without a trailing slash."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="sightline-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        configured = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


#: Folders that hold what is written now, the innermost last.
_now = threading.local()
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def fresh_path(spark: SparkSession, name: str) -> str:
    folders = getattr(_now, "folders", [])
    return f"{folders[-1] if folders else shared_dir(spark) + '/sightline'}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared storage, if it is there."""
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(to, True)


@contextmanager
def tidy(spark: SparkSession):
    """Shuffle files of what runs in the block are removed as soon as each query ends."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back with its exact schema."""
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    with tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` returns, written; all that it wrote on the way is removed then."""
    path, folder = fresh_path(spark, name), fresh_path(spark, "scratch")
    outer = getattr(_now, "folders", [])
    _now.folders = [*outer, folder]
    try:
        return materialize(build(), name, path)
    finally:
        _now.folders = outer
        delete(spark, folder)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` with a hint that keeps a join from broadcasting it, however small the planner takes it for."""
    return df.hint("merge")


def bounded(df: DataFrame, name: str, rows: int = 1_000_000) -> DataFrame:
    """``df`` written once, with a broadcast hint if it has at most ``rows`` rows; beyond that, joins shuffle."""
    from pyspark.sql import functions as F

    kept = materialize(df, name)
    return F.broadcast(kept) if kept.count() <= rows else kept
