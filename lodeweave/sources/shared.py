"""Tables written between steps, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("shared", default=())  # each thread has its own


def folder(spark: SparkSession) -> str:
    """A new folder's name below ``spark.checkpoint.dir``; one is made only on a single machine where that is unset.

    Inside ``scope`` the folder is deleted at its end.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/graph-{uuid.uuid4().hex}"
    if _scopes.get():
        _scopes.get()[-1].append(path)
    return path


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end; what is needed later must go to a folder named before."""
    made: list[str] = []
    outer = _scopes.set((*_scopes.get(), made))
    try:
        yield
    finally:
        _scopes.reset(outer)
        for path in made:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` read back from Parquet in a folder that all executors share."""
    path = path or folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
