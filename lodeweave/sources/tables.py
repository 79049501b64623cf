"""Parquet tables and the property-graph view over them.

Nodes: (label, key, qualified_name, name, kind, module_qn, start_line). Edges: (rel_type, src, dst,
indirect). Parts stand for functions, brands for modules; a part calls the next part of its order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TASK_ROWS = 250_000  # rows of lineitem that a task sorts or counts where there are many


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def functions(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each part: node_id, qualified_name, name, kind, module_qn, start_line."""
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("node_id"),
        F.concat_ws(".", "p_brand", F.col("p_partkey").cast("string")).alias("qualified_name"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("kind"),
        F.col("p_brand").alias("module_qn"),
        F.col("p_size").cast("long").alias("start_line"),
    )


def tasks(spark: SparkSession, folder: str) -> int | None:
    """Tasks among which rows that grow with lineitem are dealt, so that one's memory stays as it is; None: Spark's own number does."""
    n = -(-table(spark, folder, "lineitem").count() // TASK_ROWS)  # from the files' footers
    return n if n > spark.sparkContext.defaultParallelism else None


def dealt(rows: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """``rows`` by ``keys`` among ``n`` tasks; groups and windows by these keys need no other exchange."""
    return rows.repartition(n, *keys) if n else rows


def calls(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct (src, dst, indirect): a part calls the next one of its order; an edge is indirect if every such call is."""
    n = tasks(spark, folder)
    line = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_returnflag")
    # the return flag ends the order: full ties are then equal in all that is used
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    pairs = dealt(line, n, "l_orderkey").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"), (F.col("l_returnflag") == "R").alias("indirect"))
    return dealt(pairs.filter("dst is not null"), n, "src", "dst").groupBy("src", "dst").agg(F.min("indirect").alias("indirect"))


def later_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls to a function with a greater key than the caller's: they have entry points that nothing calls, and no cycles."""
    return calls(spark, folder).filter("src < dst")


def late_function(spark: SparkSession, folder: str) -> DataFrame:
    """One row (node): the function at three quarters of all keys."""
    return table(spark, folder, "part").agg(F.floor(F.max("p_partkey") * 3 / 4).alias("node"))


def containment(spark: SparkSession, folder: str) -> DataFrame:
    """(parent, child) keys: region, nation, customer."""
    nation, customer = table(spark, folder, "nation"), table(spark, folder, "customer")
    first = nation.select(F.concat(F.lit("region:"), F.col("n_regionkey")).alias("parent"), F.concat(F.lit("nation:"), F.col("n_nationkey")).alias("child"))
    second = customer.select(F.concat(F.lit("nation:"), F.col("c_nationkey")).alias("parent"), F.concat(F.lit("customer:"), F.col("c_custkey")).alias("child"))
    return first.unionAll(second)
