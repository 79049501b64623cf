"""Upserts and deletes of keyed rows, for batches and for streams of batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    last = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def upsert(stored: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` without the keys of ``changed``, and ``changed``."""
    return stored.join(changed, keys, "left_anti").unionByName(changed)


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without those of ``gone`` (node_id), and edges that touch none of them."""
    kept = nodes.join(gone, "node_id", "left_anti")
    rest = edges.join(gone.select(F.col("node_id").alias("src")), "src", "left_anti").join(gone.select(F.col("node_id").alias("dst")), "dst", "left_anti")
    return kept, rest


def apply_stream(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Run ``apply`` on every micro-batch that is there, then stop; the checkpoint says what was done."""
    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
