"""Graph look-ups, joins and aggregates as lazy DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, text


def by_name_or_suffix(nodes: DataFrame, name: str) -> DataFrame:
    """Nodes of that name; only if there are none, those whose name ends with it."""
    match = F.when(F.col("name") == name, 1).when(F.col("name").endswith(name), 2)
    ranked = nodes.withColumn("match", match).filter("match is not null")
    best = ranked.agg(F.min("match").alias("best"))  # one row
    return ranked.join(F.broadcast(best), F.col("match") == F.col("best")).drop("best")


def search(nodes: DataFrame, condition: Column, limit: int) -> DataFrame:
    """The first ``limit`` nodes, 1 to 200, by qualified name."""
    return nodes.filter(condition).orderBy("qualified_name").limit(max(1, min(limit, 200)))


def callers(nodes: DataFrame, edges: DataFrame, target: Column) -> DataFrame:
    """Distinct callers of the nodes that ``target`` selects."""
    wanted = nodes.filter(target).select(F.col("node_id").alias("dst"))
    found = edges.join(wanted, "dst", "left_semi").groupBy("src").agg(F.min("indirect").alias("indirect"))
    return nodes.join(found, nodes.node_id == found.src).drop("src")


def callees(nodes: DataFrame, edges: DataFrame, source: Column) -> DataFrame:
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "indirect")
    return callers(nodes, turned, source)


def callee_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every node with its number of distinct callees, and whether it is a leaf."""
    counts = edges.groupBy("src").agg(F.count("*").alias("n"))  # edges are distinct
    out = nodes.join(counts, nodes.node_id == counts.src, "left")
    return out.withColumn("n_callees", F.coalesce("n", F.lit(0))).withColumn("leaf", F.col("n_callees") == 0).drop("n", "src")


def adjacency(edges: DataFrame) -> DataFrame:
    """Callees and callers of each node as ordered strings."""
    def listed(key, other, name):
        return edges.groupBy(F.col(key).alias("node_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_set(other)), lambda x: x.cast("string")), ",").alias(name))

    return listed("src", "dst", "callees").join(listed("dst", "src", "callers"), "node_id", "full_outer")


def first_n(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """At most ``n`` rows of each group; Spark cuts groups before the shuffle."""
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("pos") <= n)


def resolve(calls: DataFrame, definitions: DataFrame, imports: DataFrame) -> DataFrame:
    """Call sites (call_id, module, name) to definitions (qn, module, name) by priority.

    1: in the same module; 2: in an imported module (module, target); 3: a name defined only once anywhere.
    Each step is an equi-join; the least (priority, qn) wins. Each (module, name) is resolved once, against the least
    definition of a name in a module, so no join grows with the sites or definitions that share them.
    """
    asked = calls.select("module", "name").distinct()
    d = definitions.groupBy(F.col("module").alias("d_module"), F.col("name").alias("d_name")).agg(F.min("qn").alias("qn"), F.count("*").alias("n"))
    own = asked.join(d, (asked.module == d.d_module) & (asked.name == d.d_name)).select(asked.module, asked.name, F.lit(1).alias("priority"), "qn")
    targets = imports.select(F.col("module").alias("i_module"), "target").distinct()
    imported = asked.join(targets, asked.module == targets.i_module).join(d, (F.col("target") == F.col("d_module")) & (F.col("name") == F.col("d_name"))).select(asked.module, asked.name, F.lit(2).alias("priority"), "qn")
    single = d.groupBy("d_name").agg(F.min("qn").alias("qn"), F.sum("n").alias("n")).filter("n = 1")
    unique = asked.join(single, asked.name == single.d_name).select(asked.module, asked.name, F.lit(3).alias("priority"), "qn")
    best = own.unionAll(imported).unionAll(unique).groupBy(F.col("module").alias("b_module"), F.col("name").alias("b_name")).agg(F.min(F.struct("priority", "qn")).alias("b"))
    found = calls.join(best, F.col("module").eqNullSafe(F.col("b_module")) & F.col("name").eqNullSafe(F.col("b_name")), "left")
    return found.select("call_id", F.col("b.qn").alias("qn"), F.col("b.priority").alias("priority"))


def resolve_includes(includes: DataFrame, files: DataFrame) -> DataFrame:
    """Includes (..., header) with ``module``, the dotted path of the file (path) that has the header's stem.

    Implementations go before headers, then the least path wins; one file a stem is joined. Null where none has it.
    """
    rank = F.when(paths.suffix(F.col("path")).isin("c", "cc", "cpp"), 0).otherwise(1)
    best = files.groupBy(paths.stem(F.col("path")).alias("_stem")).agg(F.min(F.struct(rank.alias("rank"), "path"))["path"].alias("_path"))
    found = includes.join(best, paths.stem(F.col("header")) == F.col("_stem"), "left")
    return found.withColumn("module", F.replace(F.regexp_replace("_path", r"\.[^./]*$", ""), F.lit("/"), F.lit("."))).drop("_stem", "_path")


def with_docs(hits: DataFrame, docs: DataFrame, edges: DataFrame) -> DataFrame:
    """Hits (node_id, qualified_name, ...) with the summary of their document (name, doc), found by its file name, and
    their number of callees; hits without a document or callees stay. Hits are few: documents and edges that no hit
    needs go before they are joined."""
    named = hits.withColumn("_name", paths.file_name(F.col("qualified_name")))
    wanted = docs.join(named.select(F.col("_name").alias("name")).distinct(), "name", "left_semi")
    attached = named.join(wanted.select(F.col("name").alias("_of"), text.doc_summary(F.col("doc")).alias("api_doc")), F.col("_name") == F.col("_of"), "left").drop("_name", "_of")
    counts = edges.join(hits.select(F.col("node_id").alias("src")), "src", "left_semi").groupBy("src").agg(F.count("*").alias("_n"))  # edges are distinct
    counted = attached.join(counts, F.col("node_id") == F.col("src"), "left").withColumn("n_callees", F.coalesce("_n", F.lit(0)))
    return counted.withColumn("leaf", F.col("n_callees") == 0).drop("src", "_n")
