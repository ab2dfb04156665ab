"""Shared tables that cut lineage and survive lost executors.

A result several branches read is written once as parquet under the folder the
session names in ``spark.checkpoint.dir`` and read back: later readers get column
pruning and pushed filters, and a lost executor costs a re-read, not a recompute.
A session that names no folder gets one under its warehouse; on a cluster that must not be a
plain file path, so no machine-local folder is ever used there.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


class ScratchRun:
    """The scratch tables of one run; dropping them leaves those of other runs alone."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_session_run = ScratchRun()
_current: ContextVar[ScratchRun] = ContextVar("scratch_run", default=_session_run)
_own_roots: set[str] = set()


@contextmanager
def scratch_run() -> Iterator[ScratchRun]:
    """Tables written inside belong to the yielded run and are dropped with it alone."""
    run = ScratchRun()
    token = _current.set(run)
    try:
        yield run
    finally:
        _current.reset(token)


def scratch_root(spark: SparkSession) -> str:
    """The shared scratch folder of this session.

    On a cluster a warehouse on a plain file system is the driver's own folder unless someone shares it, so it is refused
    there: such a session must name a shared folder in ``spark.checkpoint.dir``.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/") + "/signals"
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    own_folder = warehouse.startswith(("file:", "/")) or ":" not in warehouse
    if own_folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; the warehouse {warehouse} may be local")
    root = warehouse + "/_scratch"
    if root not in _own_roots:
        _own_roots.add(root)
        atexit.register(_drop_all, spark)
    return root


def _drop_all(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:
        drop_scratch(spark)


def scratch_path(spark: SparkSession) -> str:
    """A new folder name for the current run; the caller writes it."""
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    _current.get().paths.append(path)
    return path


def write_once(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write a DataFrame to a new scratch table and return a reader of that table."""
    spark = df.sparkSession
    path = scratch_path(spark)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write inside go when it ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def drop_scratch(spark: SparkSession, run: ScratchRun | None = None) -> int:
    """Delete the tables of one run (by default those written outside any run); returns how many."""
    paths = (run or _session_run).paths
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    dropped = 0
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)
        dropped += 1
    return dropped
