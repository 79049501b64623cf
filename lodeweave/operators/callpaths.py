"""The shortest simple call paths from entry points to targets, a bounded number for each, to any depth.

Walks backwards from the targets say from where a walk of exactly n steps leads to one. Paths then grow from each
entry point, for each length for which a walk exists, only along nodes from which the rest of that length can still be
walked, so nothing is made that leads nowhere but for cycles. At every step each (target, entry, length) keeps its
first paths in order; a path that was left behind is greater in order than every one that goes on. If fewer paths
than wanted arrive where some were left behind, that length is walked again with four times the room, until enough
arrive or nothing is left behind: the result is that of listing all paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import folder, scope, written


def distances(edges: DataFrame, targets: DataFrame, max_depth: int) -> DataFrame:
    """(target, node, walks): bit n of ``walks`` is set where a walk of n steps along ``edges`` (src, dst) leads from the node
    to the target (column node of ``targets``) without passing it before; n is at most ``max_depth``. The lowest bit is
    the least number of steps. Each frontier is written, an empty one ends the search. ``max_depth`` is 62 at most, a bit each."""
    if not 0 <= max_depth <= 62:
        raise ValueError("max_depth must be from 0 to 62")
    spark = edges.sparkSession
    place = folder(spark)
    with scope(spark):
        return written(_distances(edges, targets, max_depth), place)


def _distances(edges: DataFrame, targets: DataFrame, max_depth: int) -> DataFrame:
    step = written(edges.select("src", "dst").distinct())
    frontier = every = written(targets.select(F.col("node").alias("target"), "node").filter("node is not null").distinct().withColumn("n", F.lit(0)))
    for n in range(1, max_depth + 1):
        up = step.join(frontier.select("target", F.col("node").alias("dst")), "dst").filter(F.col("src") != F.col("target"))
        frontier = written(up.select("target", F.col("src").alias("node")).distinct().withColumn("n", F.lit(n)))
        if frontier.isEmpty():
            break
        every = every.unionAll(frontier)
    return every.groupBy("target", "node").agg(F.bit_or(F.expr("shiftleft(1L, n)")).alias("walks"))


def _least(walks: Column) -> Column:
    """The lowest bit set."""
    return F.length(F.bin(walks.bitwiseAND(-walks))) - 1


def entry_points(edges: DataFrame, reached: DataFrame, max_depth: int) -> DataFrame:
    """(target, entry, depth, at_limit) of the nodes that ``distances`` reached where a trace upwards ends: those that nothing
    calls, and those at ``max_depth`` whatever calls them."""
    called = edges.select(F.col("dst").alias("node")).distinct()
    up = reached.filter("node != target").withColumn("depth", _least(F.col("walks")))
    open_ = up.join(called, "node", "left_anti").unionByName(up.filter(F.col("depth") == max_depth)).dropDuplicates(["target", "node"])
    return open_.select("target", F.col("node").alias("entry"), "depth", (F.col("depth") == max_depth).alias("at_limit"))


def first_paths(edges: DataFrame, reached: DataFrame, entries: DataFrame, max_depth: int, most: int, room: int | None = None) -> DataFrame:
    """(target, entry, pos, depth, path): the first ``most`` simple paths of at most ``max_depth`` steps from each entry (target,
    entry) to its target, in order of length and then of their nodes, ``pos`` from 1.

    ``reached`` comes from ``distances`` with the same edges. A path is an array of nodes from the entry to the target.
    """
    spark = edges.sparkSession
    place = folder(spark)
    with scope(spark):
        return written(_first_paths(edges, reached, entries, max_depth, most, room), place)


def _first_paths(edges: DataFrame, reached: DataFrame, entries: DataFrame, max_depth: int, most: int, room: int | None) -> DataFrame:
    step = written(edges.select(F.col("src").alias("at"), F.col("dst").alias("next")).filter("src != dst").distinct())
    room = room or 2 * most
    lengths = F.filter(F.sequence(F.lit(1), F.lit(max_depth)), lambda n: F.getbit("walks", n.cast("int")) == 1)
    starts = entries.join(reached, (entries["entry"] == reached["node"]) & (entries["target"] == reached["target"])).select(entries["target"], "entry", F.explode(lengths).alias("length"))
    jobs = written(starts)
    sure = reached.select(F.col("target").alias("to"), F.col("node").alias("next_node"), "walks")
    arrived = None
    while True:
        here = jobs.select("target", "entry", "length", F.array("entry").alias("path"))
        ends, lost = [], []
        for n in range(1, max_depth + 1):
            last = F.element_at("path", -1)
            grown = here.withColumn("at", last).join(step, "at").filter(~F.array_contains("path", F.col("next")))
            grown = grown.join(sure, (F.col("target") == F.col("to")) & (F.col("next") == F.col("next_node"))).filter(F.getbit("walks", (F.col("length") - n).cast("int")) == 1)
            grown = grown.select("target", "entry", "length", F.concat("path", F.array("next")).alias("path"))
            order = Window.partitionBy("target", "entry", "length").orderBy("path")
            grown = written(grown.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= room + 1))
            lost.append(grown.filter(F.col("pos") > room).select("target", "entry", "length"))
            here = grown.filter(F.col("pos") <= room).drop("pos")
            ends.append(here.filter(F.col("length") == n))
            here = here.filter(F.col("length") > n)
            if here.isEmpty():
                break
        now, left = ends[0], lost[0]
        for more, away in zip(ends[1:], lost[1:], strict=True):
            now, left = now.unionAll(more), left.unionAll(away)
        redone = jobs.select("target", "entry", "length")
        arrived = now if arrived is None else arrived.join(redone, ["target", "entry", "length"], "left_anti").unionByName(now)
        arrived = written(arrived)
        # a length is done if enough paths of at most that length are known, or none of its own were left behind
        counts = arrived.groupBy("target", "entry", F.col("length").alias("l")).agg(F.count("*").alias("n"))
        left = left.distinct()
        enough = left.join(counts, ["target", "entry"], "left").groupBy("target", "entry", "length").agg(F.coalesce(F.sum(F.when(F.col("l") <= F.col("length"), F.col("n"))), F.lit(0)).alias("n"))
        jobs = written(enough.filter(F.col("n") < most).select("target", "entry", "length"))
        if jobs.isEmpty():
            break
        room *= 4
    first = Window.partitionBy("target", "entry").orderBy("length", "path")
    return arrived.withColumn("pos", F.row_number().over(first)).filter(F.col("pos") <= most).select("target", "entry", "pos", F.col("length").alias("depth"), "path")


def trace(edges: DataFrame, targets: DataFrame, max_depth: int = 10, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """The trace of callers upwards: entry points and their paths.

    Entry points: (target, entry, depth, at_limit, n_paths, truncated); ``truncated`` where ``most`` paths were reached.
    Paths: (target, entry, pos, depth, path, indirect); ``indirect`` where one of its edges is (a column of ``edges``, else
    false). A target that nothing calls has no rows. Cycles are walked around once; edges from a node to itself count
    as callers but lead nowhere; edges with a null end are ignored.
    """
    flag = F.col("indirect") if "indirect" in edges.columns else F.lit(False)
    # written once: five steps read it
    edges = written(edges.filter("src is not null and dst is not null").groupBy("src", "dst").agg(F.min(flag).alias("_indirect")))
    reached = distances(edges, targets, max_depth)
    entries = written(entry_points(edges, reached, max_depth))
    found = first_paths(edges, reached, entries, max_depth, most)
    hops = found.select("target", "entry", "pos", F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.get("path", i - 1).alias("src"), F.get("path", i).alias("dst")))).alias("e"))
    flags = hops.select("target", "entry", "pos", "e.*").join(edges, ["src", "dst"]).groupBy("target", "entry", "pos").agg(F.max("_indirect").alias("indirect"))
    paths = found.join(flags, ["target", "entry", "pos"])
    counts = found.groupBy("target", "entry").agg(F.count("*").alias("n_paths"))
    points = entries.join(counts, ["target", "entry"], "left").withColumn("n_paths", F.coalesce("n_paths", F.lit(0)).cast("long"))
    return points.withColumn("truncated", F.col("n_paths") >= most), paths
