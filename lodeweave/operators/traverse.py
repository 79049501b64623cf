"""Bounded traversals: one equi-join a level, never a driver-side walk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import folder, scope, written


def levels(edges: DataFrame, start: DataFrame, max_depth: int) -> DataFrame:
    """(node, depth): nodes that reach a ``start`` node (column node) in at most ``max_depth`` steps, by least depth.

    Level n + 1 is what calls level n and was not seen before. Each frontier is written and deleted at the end, so that plans do not
    grow with the depth; an empty one ends the walk, and cycles end because seen nodes are left out.
    """
    spark = edges.sparkSession
    out = folder(spark)
    with scope(spark):
        step = written(edges.select(F.col("src").alias("next"), F.col("dst").alias("node")))
        frontier = seen = written(start.select("node").distinct().withColumn("depth", F.lit(0)))
        for depth in range(1, max_depth + 1):
            frontier = step.join(frontier.select("node"), "node").select(F.col("next").alias("node")).distinct()
            frontier = written(frontier.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
            if frontier.isEmpty():
                break
            seen = seen.unionAll(frontier)
        return written(seen, out)


def tree(edges: DataFrame, start: DataFrame, max_depth: int) -> DataFrame:
    """(parent, child, depth, expanded) below the start nodes (column node): every edge from a reached node once,
    at the node's least depth; only the first edge, by (depth, parent), that leads to a child expands it."""
    reached = levels(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start, max_depth - 1)
    rows = edges.join(reached, edges.src == reached.node).select(F.col("src").alias("parent"), F.col("dst").alias("child"), (F.col("depth") + 1).alias("depth"))
    first = rows.groupBy("child").agg(F.min(F.struct("depth", "parent")).alias("first"))
    start = start.select(F.col("node").alias("child"), F.lit(True).alias("is_start")).distinct()
    expands = (F.col("first.depth") == F.col("depth")) & (F.col("first.parent") == F.col("parent")) & F.col("is_start").isNull()
    return rows.join(first, "child").join(start, "child", "left").select("parent", "child", "depth", expands.alias("expanded"))


def paths(edges: DataFrame, start: DataFrame, max_depth: int) -> DataFrame:
    """(entry, depth, path, indirect): all simple paths of at most ``max_depth`` steps that end in a start node, and
    whether any of its steps is indirect (a column of the edges, else false)."""
    here = start.select("node").distinct().select(F.col("node").alias("entry"), F.array("node").alias("path"), F.lit(False).alias("indirect"))
    step = edges.select(F.col("src").alias("next"), F.col("dst").alias("entry"), (F.col("indirect") if "indirect" in edges.columns else F.lit(False)).alias("hop"))
    found = None
    for depth in range(1, max_depth + 1):
        here = step.join(here, "entry").filter(~F.array_contains("path", F.col("next"))).select(F.col("next").alias("entry"), F.array_prepend("path", F.col("next")).alias("path"), (F.col("indirect") | F.col("hop")).alias("indirect"))
        now = here.select("entry", F.lit(depth).alias("depth"), "path", "indirect")
        found = now if found is None else found.unionAll(now)
    return found


def by_entry(found: DataFrame, most: int) -> DataFrame:
    """(entry, depth, n_paths, indirect, truncated, paths): of each entry's paths (entry, depth, path, indirect) the
    first ``most`` by length and text, one a line, and whether that many were reached."""
    text = F.array_join(F.transform("path", lambda x: x.cast("string")), ">")
    order = Window.partitionBy("entry").orderBy("depth", "text")
    kept = found.select("entry", "depth", "indirect", text.alias("text")).withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= most)
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n")
    return kept.groupBy("entry").agg(F.min("depth").alias("depth"), F.count("*").alias("n_paths"), F.bool_or("indirect").alias("indirect"), (F.count("*") >= most).alias("truncated"), lines.alias("paths"))


def reach(edges: DataFrame, start: DataFrame, max_depth: int) -> DataFrame:
    """(node, depth) below the start nodes of a containment tree (parent, child)."""
    turned = edges.select(F.col("child").alias("src"), F.col("parent").alias("dst"))
    return levels(turned, start, max_depth)
