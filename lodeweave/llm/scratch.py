"""Shared scratch tables: lineage is cut by writing Parquet where every executor can read it."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 1000  # rows of an Arrow batch where texts may be long
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())  # each thread has its own


def folder(spark: SparkSession, kept: bool = False) -> str:
    """A new folder under ``spark.checkpoint.dir``.

    Where that is unset one is made on a single machine (tests); a cluster must name one, for only its owner
    knows what all executors share. Inside ``scope`` the folder is deleted at its end, unless it is to be ``kept``.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/lodeweave-{uuid.uuid4().hex}"
    if _scopes.get() and not kept:
        _scopes.get()[-1].append(path)
    return path


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Folders made inside are deleted at the end; what is needed later must be saved in one made before or kept."""
    made: list[str] = []
    outer = _scopes.set((*_scopes.get(), made))
    try:
        yield
    finally:
        _scopes.reset(outer)
        for path in made:
            remove(spark, path)


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches hold ``BATCH_ROWS`` rows at most: executors hold a few of them at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def unused(columns: list[str], *names: str) -> list[str]:
    """These names, with underscores in front where ``columns`` has them, whatever their case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def hidden(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with all columns as _0, _1, ... and those ``used`` by name besides, so that names of working columns
    cannot clash; and what to select to have its columns back."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    return docs.select(*[c.alias(f"_{i}") for i, c in enumerate(names)], *used), [F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)]


def save(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to ``path`` and read it back: later stages start from files, not from lineage.

    The shuffle files of the write are removed when it ends, so disk use follows the largest step
    and not the sum of all steps.
    """
    spark = df.sparkSession
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of scratch tables that no later step reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release() -> None:
    """Give memory that this process has freed back to the system; where the C library has no such call it keeps its own."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def releasing(run: Callable) -> Callable:
    """``run``, a function of batches in a task, after which its worker gives memory back: workers wait for other tasks."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return released


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
