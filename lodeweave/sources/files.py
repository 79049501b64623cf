"""Source files as rows: paths, bytes decoded by the first encoding that fits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENCODINGS = ("utf-8", "gb2312", "gbk", "gb18030", "latin-1")  # fixed values: in the order in which they are tried


def decode(raw: bytes) -> tuple[str, str]:
    """The text of some bytes without carriage returns, and the encoding that fitted; the last one fits all."""
    for name in ENCODINGS:
        try:
            return raw.decode(name).replace("\r", ""), name
        except UnicodeDecodeError:
            continue
    raise AssertionError("the last encoding fits all bytes")


def decoded(rows: DataFrame, content: str = "content") -> DataFrame:
    """``rows`` with ``text`` and ``encoding`` instead of the bytes ``content``; null bytes give nulls, empty ones an empty text."""
    others = [c for c in rows.columns if c != content]
    schema = rows.select(*[F.col(f"`{c}`") for c in others], F.lit("").alias("text"), F.lit("").alias("encoding")).schema
    for field in schema:
        field.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(None, None) if raw is None else decode(raw) for raw in batch.column(content).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())], [*others, "text", "encoding"])

    return rows.mapInArrow(run, schema)


def read(spark: SparkSession, path: str, pattern: str = "*", most_bytes: int | None = None) -> DataFrame:
    """(path, length, text, encoding) of the files below ``path`` whose names match ``pattern``, recursively; files above
    ``most_bytes`` are left out before they are read, and Spark's reader leaves empty files out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    if most_bytes is not None:
        rows = rows.filter(F.col("length") <= most_bytes)
    return decoded(rows.select("path", "length", "content"))
