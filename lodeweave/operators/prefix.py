"""Running totals, budgets and batches over any number of rows, without a window that one task must hold.

Rows are dealt by range, so each part holds a stretch of the order; totals of (part, group) give every part its offset,
and only inside a part rows are summed one after the other. A group of any size is split over as many parts as it fills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def running(rows: DataFrame, order: list[Column], value: str, into: str = "running", by: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` and ``into``: the sum of ``value`` over the rows of the same group (columns ``by``; none: all rows) up to
    and with this one in ``order``.

    A null value counts as 0, null groups are groups. ``order`` should tell rows apart: among full ties it is not said
    which comes first, and equal keys share a part. An empty table stays empty.
    """
    group = [F.col(c) for c in by]
    dealt = written(rows.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()))
    amount = F.coalesce(F.col(value), F.lit(0))
    totals = dealt.groupBy("_part", *by).agg(F.sum(amount).alias("_total"))  # a row for each part of a group
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_part").alias("_of"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    match = F.col("_part") == F.col("_of")
    for i, c in enumerate(by):
        match = match & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(offsets, match).withColumn(into, F.col("_offset") + F.sum(amount).over(inside))
    return out.select(*rows.columns, into)


def within_budget(rows: DataFrame, order: list[Column], text: str, budget: int, by: tuple[str, ...] = (), joint: int = 0) -> DataFrame:
    """The leading rows of each group whose texts fit into ``budget`` characters, ``joint`` more between two of them;
    the row that crosses the budget is cut to what is left and the rows behind it go. Column ``cut`` marks the cut one."""
    sized = rows.withColumn("_size", F.coalesce(F.char_length(text), F.lit(0)).cast("long") + F.lit(joint).cast("long"))
    left = F.lit(budget + joint) - (F.col("_upto") - F.col("_size"))  # for this row and its joint
    kept = running(sized, order, "_size", "_upto", by).withColumn("_left", left - F.lit(joint)).filter("_left > 0 or (_left = 0 and _size = 0)")
    cut = F.col("_upto") > F.lit(budget + joint)
    return kept.withColumn("cut", cut).withColumn(text, F.when(cut, F.substring(F.col(text), F.lit(1), F.col("_left").cast("int"))).otherwise(F.col(text))).select(*rows.columns, "cut")


def batches(rows: DataFrame, order: list[Column], size: int, by: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``batch`` and ``place``, both from 0: consecutive batches of ``size`` rows of each group, the last perhaps smaller."""
    counted = running(rows.withColumn("_one", F.lit(1).cast("long")), order, "_one", "_upto", by)
    return counted.withColumn("batch", F.floor((F.col("_upto") - 1) / size)).withColumn("place", (F.col("_upto") - 1) % size).select(*rows.columns, "batch", "place")
