"""Stretches of equal outcomes in order, by the difference of two row numbers; no state is carried from row to row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def streaks(rows: DataFrame, key: str, order: list[Column], outcome: Column) -> DataFrame:
    """(key, outcome, first_pos, size): maximal stretches of rows of a key with the same outcome, null being one, in ``order``."""
    marked = rows.withColumn("_o", outcome)
    pos = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    own = F.row_number().over(Window.partitionBy(key, "_o").orderBy(*order))
    numbered = marked.withColumn("_p", pos).withColumn("_q", own)
    return numbered.groupBy(key, F.col("_o").alias("outcome"), (F.col("_p") - F.col("_q")).alias("_g")).agg(F.min("_p").cast("long").alias("first_pos"), F.count("*").alias("size")).drop("_g")


def broken(rows: DataFrame, key: str, order: list[Column], failed: Column, most: int) -> DataFrame:
    """``rows`` with ``skipped``: a breaker opens for good after ``most`` failures in a row, and all later rows of the key are
    skipped. A null ``failed`` is no failure."""
    failed = F.coalesce(failed, F.lit(False))
    marked = rows.withColumn("_f", failed).withColumn("_p", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    runs = streaks(rows, key, order, failed).filter(F.col("outcome") & (F.col("size") >= most))
    opened = runs.groupBy(F.col(key).alias("_key")).agg((F.min("first_pos") + most - 1).alias("_open"))
    out = marked.join(opened, F.col(key).eqNullSafe(F.col("_key")), "left")
    return out.withColumn("skipped", F.coalesce(F.col("_p") > F.col("_open"), F.lit(False))).select(*rows.columns, "skipped")
