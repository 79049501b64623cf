"""Dotted names as a tree of segments, numbered so that a subtree is a range of numbers.

Every prefix of a name is a node. Inside each first segment nodes are numbered in depth-first order, and ``last`` is the
number of a node's last descendant: descendants are the nodes from ``pre`` to ``last``, ancestors those whose range
holds ``pre``. Taking names away leaves all ranges right; new names only number their own first segment anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import prefix


def _prefixes(names: DataFrame) -> DataFrame:
    """(parts, whole): every prefix of every name, and how many names it is."""
    parts = F.split("name", r"\.", -1)
    rows = names.filter("name is not null").select("name").distinct().withColumn("all", parts)
    each = rows.select("all", F.explode(F.sequence(F.lit(1), F.size("all"))).alias("n"))
    return each.select(F.slice("all", F.lit(1), F.col("n")).alias("parts"), (F.col("n") == F.size("all")).cast("int").alias("whole"))


def number(names: DataFrame) -> DataFrame:
    """(top, pre, last, depth, name, is_name) for the distinct ``names`` (column name) and all their prefixes; numbers count from
    1 in each first segment (top), a node before its descendants, siblings in order of their segments."""
    nodes = _prefixes(names).groupBy("parts").agg(F.max("whole").alias("whole"), F.count("*").alias("names_below"))
    nodes = nodes.select(F.get("parts", F.lit(0)).alias("top"), "parts", "whole", F.lit(1).cast("long").alias("one"))
    counted = prefix.running(nodes, [F.col("parts")], "one", "pre", by=("top",))
    # a node is below each of its prefixes
    each = counted.select("parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("n"))
    below = each.groupBy(F.slice("parts", F.lit(1), F.col("n")).alias("_parts")).agg(F.count("*").alias("size"))
    out = counted.join(below, F.col("parts") == F.col("_parts"))
    return out.select("top", "pre", (F.col("pre") + F.col("size") - 1).alias("last"), F.size("parts").alias("depth"), F.array_join("parts", ".").alias("name"), (F.col("whole") == 1).alias("is_name"))


def subtree(nodes: DataFrame, name: str) -> DataFrame:
    """The names at and below ``name``, by a range of numbers."""
    root = nodes.filter(F.col("name") == name).select(F.col("top").alias("_top"), F.col("pre").alias("_pre"), F.col("last").alias("_last"))  # one row
    return nodes.join(F.broadcast(root), (F.col("top") == F.col("_top")) & F.col("pre").between(F.col("_pre"), F.col("_last"))).filter("is_name").select(nodes.columns)


def removed(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """Nodes without the names ``gone`` (column name) and the prefixes that no name is left under; no number changes."""
    left = nodes.join(gone.select("name", F.lit(True).alias("_gone")).distinct(), "name", "left").withColumn("is_name", F.col("is_name") & F.col("_gone").isNull()).drop("_gone")
    parts = F.split("name", r"\.", -1)
    kept = left.filter("is_name").select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))).alias("name")).distinct()
    return left.join(kept, "name", "left_semi").select(nodes.columns)


def added(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes with the names ``new`` (column name) besides; only first segments that get some are numbered anew."""
    tops = new.filter("name is not null").select(F.substring_index("name", ".", 1).alias("top")).distinct()
    stay = nodes.join(tops, "top", "left_anti")
    again = nodes.join(tops, "top", "left_semi").filter("is_name").select("name").unionAll(new.select("name"))
    return stay.select(nodes.columns).unionAll(number(again).select(nodes.columns))
