"""Call trees as text in depth-first order, however large: rows carry the key that sorts them, the text is sorted by range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import folder, scope, written

BAR, GAP, TEE, END, SEEN = "│  ", "   ", "├─ ", "└─ ", " *"


def tree(edges: DataFrame, start: DataFrame, max_depth: int) -> DataFrame:
    """(key, node, depth, expands, lasts) of the tree of ``edges`` (src, dst) below each row of ``start`` (node).

    ``key`` holds the nodes from the root down and sorts rows depth-first, children by node. A node is expanded once: where it
    is least deep, of equally deep places where the key is least. ``lasts`` says for each level whether the node there is
    the last child. One join a level; levels are written on the way.
    """
    spark = edges.sparkSession
    place = folder(spark)
    with scope(spark):
        step = written(edges.filter("src is not null and dst is not null").select("src", "dst").distinct())
        last = step.groupBy(F.col("src").alias("_src")).agg(F.max("dst").alias("_last"))
        level = written(start.select("node").distinct().select(F.array("node").alias("key"), "node", F.lit(0).alias("depth"), F.lit(True).alias("expands"), F.array().cast("array<boolean>").alias("lasts")))
        out, seen = level, level.select(F.col("node").alias("_seen"))
        for depth in range(1, max_depth + 1):
            above = level.filter("expands").select(F.col("node").alias("src"), "key", "lasts")
            rows = above.join(step, "src").join(last, F.col("src") == F.col("_src"))
            rows = rows.select(F.concat("key", F.array("dst")).alias("key"), F.col("dst").alias("node"), F.concat("lasts", F.array(F.col("dst") == F.col("_last"))).alias("lasts"))
            first = rows.groupBy(F.col("node").alias("_node")).agg(F.min("key").alias("_first")).join(seen, F.col("_node") == F.col("_seen"), "left_anti")
            rows = rows.join(first, F.col("node") == F.col("_node"), "left")
            level = written(rows.select("key", "node", F.lit(depth).alias("depth"), F.coalesce(F.col("key") == F.col("_first"), F.lit(False)).alias("expands"), "lasts"))
            if level.isEmpty():
                break
            out = out.unionAll(level)
            seen = seen.unionAll(level.filter("expands").select("node"))
        return written(out, place)


def lines(rows: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(key, line): each row of ``tree`` as a line with guides; names (node, name) replace nodes, those seen before are marked."""
    label = F.col("node").cast("string")
    if names is not None:
        rows = rows.join(names.select(F.col("node").alias("_of"), F.col("name").alias("_name")), F.col("node") == F.col("_of"), "left")
        label = F.coalesce("_name", label)
    guides = F.array_join(F.transform(F.slice("lasts", 1, F.greatest(F.size("lasts") - 1, F.lit(0))), lambda x: F.when(x, GAP).otherwise(BAR)), "")
    own = F.when(F.size("lasts") == 0, "").when(F.element_at("lasts", -1), END).otherwise(TEE)
    return rows.select("key", F.concat(guides, own, label, F.when(F.col("expands"), "").otherwise(SEEN)).alias("line"))


def write_text(rows: DataFrame, path: str) -> None:
    """The lines of (key, line) in depth-first order as text files whose names are in that order, too."""
    rows.orderBy("key").select("line").write.text(path)
