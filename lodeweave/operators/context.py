"""What stands around functions and modules: callers and callees by any name, lists cut per group, paths filled in, overviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import dealt
from . import graph


def named(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(ask, node_id, qualified): for each name of ``asked`` (ask) the nodes with that qualified name; only where there is none
    those with that simple name. Names that nothing has give no row."""
    asked = asked.select("ask").filter("ask is not null").distinct()
    whole = asked.join(nodes.select("node_id", F.col("qualified_name").alias("ask")), "ask").withColumn("qualified", F.lit(True))
    rest = asked.join(whole.select("ask").distinct(), "ask", "left_anti")
    return whole.unionAll(rest.join(nodes.select("node_id", F.col("name").alias("ask")), "ask").withColumn("qualified", F.lit(False)))


def callers_of_names(nodes: DataFrame, edges: DataFrame, asked: DataFrame, tasks: int | None = None) -> DataFrame:
    """Distinct (ask, src): callers of every function whose qualified or simple name is asked for, told apart in ``tasks`` tasks."""
    asked = asked.select("ask").filter("ask is not null").distinct()
    either = nodes.select("node_id", F.col("qualified_name").alias("ask")).unionAll(nodes.select("node_id", F.col("name").alias("ask")))
    targets = dealt(asked.join(either, "ask").select("ask", F.col("node_id").alias("dst")), tasks, "ask", "dst").distinct()
    return dealt(targets.join(edges.select("src", "dst"), "dst").select("ask", "src"), tasks, "ask", "src").distinct()


def _first(rows: DataFrame, key: str, other: str, n: int) -> DataFrame:
    """(key, total, listed): the number of rows of each key and its first ``n`` by ``other``; lists are cut before they are collected."""
    cut = graph.first_n(rows.select(key, other), [key], [F.col(other)], n)
    listed = cut.groupBy(key).agg(F.sort_array(F.collect_list(other)).alias("listed"))
    return rows.groupBy(key).agg(F.count("*").alias("total")).join(listed, key)


def both_ways(nodes: DataFrame, edges: DataFrame, n: int = 5) -> DataFrame:
    """Every node with its numbers of distinct callers and callees and the first ``n`` of each by id; empty lists where there are none."""
    pairs = edges.select("src", "dst").distinct()
    callers = _first(pairs, "dst", "src", n).select(F.col("dst").alias("_d"), F.col("total").alias("n_callers"), F.col("listed").alias("callers"))
    callees = _first(pairs, "src", "dst", n).select(F.col("src").alias("_s"), F.col("total").alias("n_callees"), F.col("listed").alias("callees"))
    out = nodes.join(callers, F.col("node_id") == F.col("_d"), "left").join(callees, F.col("node_id") == F.col("_s"), "left").drop("_d", "_s")
    for side in ("callers", "callees"):
        out = out.withColumn(f"n_{side}", F.coalesce(f"n_{side}", F.lit(0))).withColumn(side, F.coalesce(side, F.array().cast("array<bigint>")))
    return out


def with_places(edges: DataFrame, definitions: DataFrame) -> DataFrame:
    """Edges (src, dst, path, start_line, end_line of the callee, perhaps unknown) with what is unknown taken from the callee's
    definition (node_id, path, start_line, end_line); known values stay, an empty path counts as unknown."""
    known = definitions.groupBy(F.col("node_id").alias("_id")).agg(F.min(F.struct("path", "start_line", "end_line")).alias("_k"))  # one place a function
    joined = edges.join(known, F.col("dst") == F.col("_id"), "left")
    unknown = F.coalesce(F.col("path"), F.lit("")) == ""

    def filled(name: str, missing: Column) -> Column:
        return F.when(missing, F.col(f"_k.{name}")).otherwise(F.col(name)).alias(name)

    places = [filled("path", unknown), filled("start_line", unknown & F.col("start_line").isNull()), filled("end_line", unknown & F.col("end_line").isNull())]
    return joined.select(*[c for c in edges.columns if c not in ("path", "start_line", "end_line")], *places)


def overview(nodes: DataFrame, edges: DataFrame, n: int = 5) -> DataFrame:
    """One row a module: functions, calls inside, modules it calls and is called by, and its ``n`` most called functions.

    (module_qn, n_functions, n_inner, calls_modules, called_by_modules, top); ``top`` holds (n_callers, node_id), most
    callers first, ties by id. Nodes without a module count as module ''.
    """
    nodes = nodes.select("node_id", F.coalesce("module_qn", F.lit("")).alias("module_qn"))
    pairs = edges.select("src", "dst").distinct()
    sides = pairs.join(nodes.select(F.col("node_id").alias("src"), F.col("module_qn").alias("a")), "src").join(nodes.select(F.col("node_id").alias("dst"), F.col("module_qn").alias("b")), "dst")
    between = sides.groupBy("a", "b").agg(F.count("*").alias("n"))  # a row for each pair of modules
    out = between.groupBy(F.col("a").alias("module_qn")).agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))).alias("n_inner"), F.count(F.when(F.col("a") != F.col("b"), 1)).alias("calls_modules"))
    into = between.filter("a != b").groupBy(F.col("b").alias("module_qn")).agg(F.count("*").alias("called_by_modules"))
    popular = nodes.join(pairs.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("n_callers")), "node_id")
    cut = graph.first_n(popular, ["module_qn"], [F.desc("n_callers"), F.col("node_id")], n)
    top = cut.groupBy("module_qn").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "n_callers", "node_id"))), lambda x: F.struct(x["n_callers"].alias("n_callers"), x["node_id"].alias("node_id"))).alias("top"))
    rows = nodes.groupBy("module_qn").agg(F.count("*").alias("n_functions"))
    rows = rows.join(out, "module_qn", "left").join(into, "module_qn", "left").join(top, "module_qn", "left")
    return rows.select("module_qn", "n_functions", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_inner", "calls_modules", "called_by_modules")], "top")


def hierarchy(links: DataFrame, n: int = 5) -> DataFrame:
    """Every node of (parent, child) links with its parents and the number and first ``n`` of its children, whatever their level."""
    links = links.filter("parent is not null and child is not null").select("parent", "child").distinct()
    every = links.select(F.col("parent").alias("node")).unionAll(links.select("child")).distinct()
    above = links.groupBy(F.col("child").alias("node")).agg(F.array_join(F.sort_array(F.collect_list("parent")), ",").alias("parents"))
    below = _first(links, "parent", "child", n).select(F.col("parent").alias("node"), F.col("total").alias("n_children"), F.array_join("listed", ",").alias("children"))
    return every.join(above, "node", "left").join(below, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
