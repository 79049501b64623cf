"""Queries that look up, join, order and maintain a property graph, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import callpaths, graph, ivf, traverse, vectors
from ..sources.tables import calls, functions, late_function, later_calls, table
from .queries import CALLS, FN, LATER, QUERY, TARGET

GONE = (3, 9, 27)
DEPTH = 10  # steps of a whole trace


def _listed(key: str, *parts, sep: str):
    """Text parts of a group, in the order of ``key`` and themselves, as one string."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, F.concat(*parts).alias("_t")))), lambda x: x["_t"]), sep)


def node_by_qn(spark, d):
    return functions(spark, d).filter(F.col("qualified_name") == "Brand#17.1").select("node_id", "kind", "start_line")


def prefix_suffix_search(spark, d):
    fn = functions(spark, d)
    return fn.filter(F.startswith("qualified_name", F.lit("Brand#2.")) | F.endswith("name", F.lit("ring"))).select("node_id", "qualified_name")


def registry_remove(spark, d):
    return functions(spark, d).filter(~F.startswith("qualified_name", F.lit("Brand#1"))).groupBy("module_qn").agg(F.count("*").alias("n"))


def prefix_subtree(spark, d):
    return functions(spark, d).filter(F.startswith("qualified_name", F.lit("Brand#1"))).groupBy("kind").agg(F.count("*").alias("n"), F.min("qualified_name").alias("first_qn"))


def types_any(spark, d):
    return functions(spark, d).filter(F.col("kind").isin("ECONOMY", "STANDARD")).groupBy("kind").agg(F.count("*").alias("n"))


def metadata_all_match(spark, d):
    return table(spark, d, "orders").filter((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 1000)).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def locate_by_name(spark, d):
    named = functions(spark, d).filter(F.endswith("name", F.lit("widget")))
    return named.select("node_id", "name", F.count("*").over(Window.partitionBy("name")).alias("n_same"))


def call_pairs(spark, d):
    fn, edges = functions(spark, d), calls(spark, d)
    named = edges.join(fn.select(F.col("node_id").alias("src"), F.col("kind").alias("caller")), "src").join(fn.select(F.col("node_id").alias("dst"), F.col("kind").alias("callee")), "dst")
    return named.select("caller", "callee").distinct()


def callers_with_props(spark, d):
    return graph.callers(functions(spark, d), calls(spark, d), F.col("name") == "red widget").select("node_id", "module_qn", "start_line", "indirect")


def edges_bound_endpoints(spark, d):
    fn, edges = functions(spark, d), calls(spark, d)
    ends = fn.filter("start_line < 10").select("node_id")
    bound = edges.join(ends.select(F.col("node_id").alias("src")), "src", "left_semi").join(ends.select(F.col("node_id").alias("dst")), "dst", "left_semi")
    return bound.select("src", "dst", "indirect")


def bind_edges_dedup(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    bound = line.join(table(spark, d, "part").select(F.col("p_partkey").alias("src")), "src", "left_semi").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("dst")), "dst", "left_semi")
    return bound.groupBy("src").agg(F.count("*").alias("n_targets"))


def functions_optional_module(spark, d):
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id"), "s_name")
    return functions(spark, d).join(names, "node_id", "left").select("node_id", F.coalesce("s_name", F.lit("none")).alias("owner"))


def caller_module_tag(spark, d):
    tags = functions(spark, d).filter("start_line > 5").select(F.col("node_id").alias("src"), "module_qn")
    tagged = calls(spark, d).join(tags, "src", "left").withColumn("module", F.coalesce("module_qn", F.lit("unknown")))
    return tagged.groupBy("module").agg(F.count("*").alias("n"))


def function_context(spark, d):
    fn = functions(spark, d)
    wanted = fn.filter("start_line = 7").select(F.col("node_id").alias("dst"))
    found = calls(spark, d).join(wanted, "dst", "left_semi").join(fn.select(F.col("node_id").alias("src"), "qualified_name"), "src")
    return found.groupBy(F.col("dst").alias("node_id")).agg(_listed("src", F.col("qualified_name"), sep="; ").alias("callers"))


def visibility_cascade(spark, d):
    homes = table(spark, d, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    level = F.when(F.col("n_name").isNull(), "external").when(F.col("s_acctbal") < 0, "private").when(F.col("s_acctbal") > 5000, "public").otherwise("static")
    return table(spark, d, "supplier").join(homes, "s_nationkey", "left").select("s_suppkey", level.alias("visibility"))


def ownership_hints(spark, d):
    hint = F.when(F.contains("name", F.lit("ring")), "caller frees").when(F.startswith("name", F.lit("small")), "borrowed").otherwise("unknown")
    return functions(spark, d).groupBy(hint.alias("hint")).agg(F.count("*").alias("n"))


def signature_text(spark, d):
    return functions(spark, d).select("node_id", F.concat(F.lower("kind"), F.lit(" "), "name", F.lit("(int "), F.col("start_line").cast("string"), F.lit(")")).alias("signature"))


def struct_signature(spark, d):
    return functions(spark, d).groupBy("module_qn").agg(F.concat(F.lit("struct {"), _listed("node_id", F.col("name"), sep="; "), F.lit("}")).alias("signature"))


def enclosing_interval(spark, d):
    nation = table(spark, d, "nation").select((F.col("n_nationkey") * 2).cast("long").alias("first"), (F.col("n_nationkey") * 2 + 6).cast("long").alias("last"), "n_name")
    points = functions(spark, d).select("start_line").distinct()
    # cells of eight lines make the range join an equi-join
    cells = nation.withColumn("cell", F.explode(F.sequence(F.floor(F.col("first") / 8), F.floor(F.col("last") / 8))))
    inside = points.withColumn("cell", F.floor(F.col("start_line") / 8)).join(cells, "cell").filter("start_line between first and last")
    return inside.groupBy("start_line").agg(F.max_by("n_name", "first").alias("innermost"), F.count("*").alias("depth"))


def nested_ancestors(spark, d):
    up = table(spark, d, "nation").join(table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    return table(spark, d, "customer").join(up, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat_ws("/", "r_name", "n_name", "c_name").alias("path"))


def names_difference(spark, d):
    small = functions(spark, d).filter("start_line < 5").select("name")
    return functions(spark, d).select("name").subtract(small)


def path_difference(spark, d):
    edges = calls(spark, d)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select("src", "dst").join(back, ["src", "dst"], "left_anti").groupBy("src").agg(F.count("*").alias("n_one_way"))


def concat_heterogeneous(spark, d):
    one = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    rows = one.unionByName(table(spark, d, "supplier").select(F.col("s_name").alias("name")), allowMissingColumns=True)
    return rows.groupBy("segment").agg(F.count("*").alias("n"), F.min("name").alias("first_name"))


def predicates_sorted(spark, d):
    order = Window.partitionBy("module_qn").orderBy(F.desc("start_line"), "node_id")
    return functions(spark, d).select("module_qn", "node_id", F.row_number().over(order).cast("long").alias("pos"))


def build_summary(spark, d):
    def status(x):
        return F.sum((F.col("o_orderstatus") == x).cast("long"))
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), status("F").alias("n_f"), status("O").alias("n_o"), F.count_distinct("o_custkey").alias("n_customers"))


def vector_stats(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.min(F.size("embedding")).cast("long").alias("least_size"), F.max(F.size("embedding")).cast("long").alias("most_size"))


def vector_node_join(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), "label").join(functions(spark, d), "node_id").select("node_id", "label", "qualified_name")


def store_delete_by_id(spark, d):
    return table(spark, d, "embeddings").filter(~F.col("vec_id").isin(*GONE)).groupBy("label").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))


def hits_enriched(spark, d):
    query = table(spark, d, "embeddings").filter("vec_id = 4").select(F.col("embedding").alias("q"))
    found = vectors.knn(table(spark, d, "embeddings"), query, 8)
    return found.join(functions(spark, d), found.vec_id == F.col("node_id"), "left").select("vec_id", "score", "qualified_name")


def knn_batch(spark, d):
    rows = table(spark, d, "embeddings")
    queries = rows.filter("vec_id < 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    # three query vectors go to all rows
    scored = rows.join(F.broadcast(queries), F.col("vec_id") != F.col("query_id")).withColumn("score", text.cosine(F.col("embedding"), F.col("q")))
    best = graph.first_n(scored.select("query_id", "vec_id", "score"), ["query_id"], [F.desc("score"), F.col("vec_id")], 4)
    return best.select("query_id", "vec_id", F.round("score", 4).alias("score"))


def knn_batch_whole(spark, d):
    """The four rows most like every twentieth vector, of all rows: blocks of queries go to the rows."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    return ivf.exact(rows, rows.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 4, others=True).select("query_id", "vec_id", F.round("score", 4).alias("score"))


def knn_cells(spark, d):
    """The ten rows most like every twentieth vector by an inverted file, cells that cannot hold a nearer row left out."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    found = ivf.search(ivf.build(rows, cells=16), rows.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 10, others=True)
    return found.select("query_id", F.col("pos").cast("long").alias("pos"), "vec_id", F.round("score", 4).alias("score"))


def hybrid_search(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    query = rows.filter("vec_id = 2").select(F.col("embedding").alias("q"))
    named = functions(spark, d).select(F.col("node_id").alias("vec_id"), F.concat_ws(" ", "name", "kind", "module_qn").alias("haystack"))
    return vectors.hybrid(rows.join(named, "vec_id"), query, QUERY, 10, F.col("label").isin(0, 1, 2)).select(F.col("vec_id").alias("node_id"), "score")


def call_tree_depth2(spark, d):
    edges = calls(spark, d).select("src", "dst")
    first = edges.filter(F.col("src") == TARGET).select(F.col("dst").alias("child"))
    return first.join(edges, first.child == edges.src).groupBy("child").agg(F.count("*").alias("n_grandchildren"))


def trace_entry_points(spark, d):
    """Where a trace of callers upwards ends: functions that nothing calls, or at the limit."""
    edges = later_calls(spark, d)
    found = callpaths.entry_points(edges, callpaths.distances(edges, late_function(spark, d), DEPTH), DEPTH)
    return found.select("entry", F.col("depth").cast("long").alias("depth"), "at_limit")


def trace_entry_points_whole(spark, d):
    edges = calls(spark, d).select("src", "dst")
    start = edges.groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst").limit(1).select(F.col("dst").alias("node"))
    reached = traverse.levels(edges, start, DEPTH).filter("depth > 0")
    called = edges.select(F.col("dst").alias("node"), F.lit(True).alias("called")).distinct()
    # nodes at the limit count as entry points even if they are called
    found = reached.join(called, "node", "left").filter(F.col("called").isNull() | (F.col("depth") == DEPTH))
    return found.select(F.col("node").alias("entry"), F.col("depth").cast("long").alias("depth"), (F.col("depth") == DEPTH).alias("at_limit"))


def trace_levels_whole(spark, d):
    start = functions(spark, d).filter(F.col("node_id") == TARGET).select(F.col("node_id").alias("node"))
    found = traverse.levels(calls(spark, d), start, DEPTH)
    return found.select("node", "depth", (F.col("depth") == DEPTH).alias("at_limit"))


def root_modules(spark, d):
    """Modules that import others and are imported by none."""
    imports = functions(spark, d).select("module_qn", F.concat(F.lit("Brand#"), (F.col("start_line") + 10).cast("string")).alias("target"))
    return imports.select("module_qn").distinct().join(imports.select(F.col("target").alias("module_qn")).distinct(), "module_qn", "left_anti")


def root_modules_whole(spark, d):
    fn = functions(spark, d)
    called = calls(spark, d).join(fn.select(F.col("node_id").alias("dst"), "module_qn"), "dst").select("module_qn").distinct()  # a row a module
    return fn.select("module_qn").distinct().join(called, "module_qn", "left_anti")


def coerce_node_props(spark, d):
    return table(spark, d, "labels").select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("")).alias("quality"), F.coalesce(F.col("toxic").cast("boolean"), F.lit(False)).alias("toxic"))


def export_nodes_json(spark, d):
    return functions(spark, d).select(F.to_json(F.struct("node_id", "qualified_name", "name", "start_line")).alias("node"))


def project_delete(spark, d):
    gone = table(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, d, "customer").join(gone, "c_nationkey", "left_anti").groupBy("c_nationkey").agg(F.count("*").alias("n"))


def doc_pages_module(spark, d):
    lines = _listed("node_id", F.lit("- "), F.col("name"), F.lit(" ("), F.col("qualified_name"), F.lit(")"), sep="\n")
    return functions(spark, d).groupBy("module_qn").agg(F.concat(F.lit("# "), F.col("module_qn"), F.lit("\n"), lines).alias("page"))


def doc_index(spark, d):
    return functions(spark, d).groupBy("module_qn").agg(F.count("*").alias("n")).select(F.concat(F.lit("| "), "module_qn", F.lit(" | "), F.col("n").cast("string"), F.lit(" |")).alias("line"))


def trace_page_names(spark, d):
    many = F.count("*").over(Window.partitionBy("name"))
    return functions(spark, d).select("node_id", F.when(many > 1, F.concat("name", F.lit("_"), F.substring(F.md5("qualified_name"), 1, 8))).otherwise(F.col("name")).alias("page"))


def snippet_default_end(spark, d):
    end = F.when(F.col("node_id") % 3 != 0, F.col("start_line") + 5)
    return functions(spark, d).select("node_id", "start_line", F.coalesce(end, F.col("start_line") + 50).alias("end_line"))


def mask_and_clock(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.concat(F.substring("c_name", 1, 4), F.lit("****"), F.expr("right(c_name, 2)")).alias("masked"), F.format_string("%02d:%02d", F.floor(F.col("c_custkey") / 60) % 24, F.col("c_custkey") % 60).alias("clock"))


QUERIES = {f.__name__: f for f in (node_by_qn, prefix_suffix_search, registry_remove, prefix_subtree, types_any, metadata_all_match, locate_by_name, call_pairs, callers_with_props, edges_bound_endpoints, bind_edges_dedup, functions_optional_module, caller_module_tag, function_context, visibility_cascade, ownership_hints, signature_text, struct_signature, enclosing_interval, nested_ancestors, root_modules, names_difference, path_difference, concat_heterogeneous, predicates_sorted, build_summary, vector_stats, vector_node_join, store_delete_by_id, hits_enriched, knn_batch, knn_batch_whole, hybrid_search, call_tree_depth2, trace_entry_points, trace_levels_whole, coerce_node_props, export_nodes_json, project_delete, doc_pages_module, doc_index, trace_page_names, snippet_default_end, mask_and_clock)}

QUERIES |= {f.__name__: f for f in (knn_cells, root_modules_whole, trace_entry_points_whole)}


def _like(query: int) -> str:
    return f"list_cosine_similarity(cast(embedding as double[]), (select cast(embedding as double[]) from embeddings where vec_id = {query}))"


ORACLES = {
    "node_by_qn": f"with {FN} select node_id, kind, start_line from fn where qualified_name = 'Brand#17.1'",
    "prefix_suffix_search": f"with {FN} select node_id, qualified_name from fn where starts_with(qualified_name, 'Brand#2.') or name like '%ring'",
    "registry_remove": f"with {FN} select module_qn, count(*) as n from fn where not starts_with(qualified_name, 'Brand#1') group by 1",
    "prefix_subtree": f"with {FN} select kind, count(*) as n, min(qualified_name) as first_qn from fn where starts_with(qualified_name, 'Brand#1') group by 1",
    "types_any": f"with {FN} select kind, count(*) as n from fn where kind in ('ECONOMY', 'STANDARD') group by 1",
    "metadata_all_match": "select o_orderpriority, count(*) as n from orders where o_orderstatus = 'F' and o_totalprice > 1000 group by 1",
    "locate_by_name": f"with {FN} select node_id, name, count(*) over (partition by name) as n_same from fn where name like '%widget'",
    "call_pairs": f"with {FN}, {CALLS} select distinct a.kind as caller, b.kind as callee from calls join fn a on src = a.node_id join fn b on dst = b.node_id",
    "callers_with_props": f"with {FN}, {CALLS} select fn.node_id, fn.module_qn, fn.start_line, bool_and(indirect) as indirect from calls join fn on src = fn.node_id where dst in (select node_id from fn where name = 'red widget') group by 1, 2, 3",
    "edges_bound_endpoints": f"with {FN}, {CALLS} select src, dst, indirect from calls join fn a on src = a.node_id join fn b on dst = b.node_id where a.start_line < 10 and b.start_line < 10",
    "bind_edges_dedup": "select l_partkey as src, count(distinct l_suppkey) as n_targets from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey group by 1",
    "functions_optional_module": "select p_partkey as node_id, coalesce(s_name, 'none') as owner from part left join supplier on p_partkey = s_suppkey",
    "caller_module_tag": f"with {FN}, {CALLS} select coalesce(module_qn, 'unknown') as module, count(*) as n from calls left join fn on src = node_id and start_line > 5 group by 1",
    "function_context": f"with {FN}, {CALLS} select t.node_id, string_agg(a.qualified_name, '; ' order by a.node_id) as callers from calls join fn t on dst = t.node_id join fn a on src = a.node_id where t.start_line = 7 group by 1",
    "visibility_cascade": "select s_suppkey, case when n_name is null then 'external' when s_acctbal < 0 then 'private' when s_acctbal > 5000 then 'public' else 'static' end as visibility from supplier left join nation on s_nationkey = n_nationkey and n_regionkey < 3",
    "ownership_hints": f"with {FN} select case when contains(name, 'ring') then 'caller frees' when starts_with(name, 'small') then 'borrowed' else 'unknown' end as hint, count(*) as n from fn group by 1",
    "signature_text": f"with {FN} select node_id, lower(kind) || ' ' || name || '(int ' || start_line || ')' as signature from fn",
    "struct_signature": f"with {FN} select module_qn, 'struct {{' || string_agg(name, '; ' order by node_id) || '}}' as signature from fn group by 1",
    "enclosing_interval": f"with {FN} select start_line, arg_max(n_name, n_nationkey) as innermost, count(*) as depth from (select distinct start_line from fn) join nation on start_line between n_nationkey * 2 and n_nationkey * 2 + 6 group by 1",
    "nested_ancestors": "select c_custkey, r_name || '/' || n_name || '/' || c_name as path from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey",
    "names_difference": f"with {FN} select name from fn except select name from fn where start_line < 5",
    "path_difference": f"with {CALLS} select src, count(*) as n_one_way from (select src, dst from calls except select dst, src from calls) group by 1",
    "concat_heterogeneous": "select segment, count(*) as n, min(name) as first_name from (select c_name as name, c_mktsegment as segment from customer union all by name select s_name as name from supplier) group by 1",
    "predicates_sorted": f"with {FN} select module_qn, node_id, row_number() over (partition by module_qn order by start_line desc, node_id) as pos from fn",
    "build_summary": "select o_orderpriority, count(*) as n, count(*) filter (o_orderstatus = 'F') as n_f, count(*) filter (o_orderstatus = 'O') as n_o, count(distinct o_custkey) as n_customers from orders group by 1",
    "vector_stats": "select label, count(*) as n, min(len(embedding)) as least_size, max(len(embedding)) as most_size from embeddings group by 1",
    "vector_node_join": f"with {FN} select node_id, label, qualified_name from embeddings join fn on vec_id = node_id",
    "store_delete_by_id": f"select label, count(*) as n, min(vec_id) as first_id from embeddings where vec_id not in {GONE} group by 1",
    "hits_enriched": f"with {FN}, h as (select vec_id, round({_like(4)}, 4) as score from embeddings order by {_like(4)} desc, vec_id limit 8) select vec_id, score, qualified_name from h left join fn on vec_id = node_id",
    "knn_batch": "select query_id, vec_id, round(score, 4) as score from (select q.vec_id as query_id, e.vec_id, list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[])) as score from embeddings e join embeddings q on q.vec_id < 3 and e.vec_id <> q.vec_id) qualify row_number() over (partition by query_id order by score desc, vec_id) <= 4",
    "hybrid_search": f"with {FN}, near as (select vec_id as node_id, {_like(2)} as likeness, lower(name || ' ' || kind || ' ' || module_qn) as haystack from embeddings join fn on vec_id = node_id where label in (0, 1, 2) order by likeness desc, vec_id limit 40), boosted as (select node_id, likeness + 0.05::double * (" + " + ".join(f"contains(haystack, '{w}')::int" for w in QUERY.split()) + ") as score from near) select node_id, round(score, 4) as score from boosted order by boosted.score desc, node_id limit 10",
    "call_tree_depth2": f"with {CALLS} select a.dst as child, count(*) as n_grandchildren from calls a join calls b on a.dst = b.src where a.src = {TARGET} group by 1",
    "trace_entry_points": f"with recursive {LATER}, up as (select node, 0 as depth from late union select src, depth + 1 from up join later on dst = node where depth < {DEPTH}), lv as (select node as entry, min(depth) as depth from up group by 1) select entry, cast(depth as bigint) as depth, depth = {DEPTH} as at_limit from lv where depth > 0 and (depth = {DEPTH} or entry not in (select dst from later))",
    "trace_entry_points_whole": f"with recursive {CALLS}, up as (select dst as node, 0 as depth from (select dst, count(*) as n from calls group by 1 order by n desc, dst limit 1) union select src, depth + 1 from up join calls on dst = node where depth < {DEPTH}), least as (select node, min(depth) as depth from up group by 1) select node as entry, cast(depth as bigint) as depth, depth = {DEPTH} as at_limit from least where depth > 0 and (depth = {DEPTH} or node not in (select dst from calls))",
    "trace_levels_whole": f"with recursive {CALLS}, up as (select cast({TARGET} as bigint) as node, 0 as depth union select src, depth + 1 from up join calls on dst = node where depth < {DEPTH}) select node, min(depth) as depth, min(depth) = {DEPTH} as at_limit from up group by node",
    "root_modules": f"with {FN} select distinct module_qn from fn where module_qn not in (select 'Brand#' || (start_line + 10) from fn)",
    "root_modules_whole": f"with {FN}, {CALLS} select distinct module_qn from fn where module_qn not in (select module_qn from calls join fn on dst = node_id)",
    "knn_batch_whole": "select query_id, vec_id, round(score, 4) as score from (select q.vec_id as query_id, e.vec_id, list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[])) as score from embeddings e join embeddings q on q.vec_id % 20 = 0 and e.vec_id <> q.vec_id) qualify row_number() over (partition by query_id order by score desc, vec_id) <= 4",
    "knn_cells": "select query_id, row_number() over (partition by query_id order by score desc, vec_id) as pos, vec_id, round(score, 4) as score from (select q.vec_id as query_id, e.vec_id, list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[])) as score from embeddings e join embeddings q on q.vec_id % 20 = 0 and e.vec_id <> q.vec_id) qualify pos <= 10",
    "coerce_node_props": "select doc_id, coalesce(cast(quality as varchar), '') as quality, coalesce(cast(toxic as boolean), false) as toxic from labels",
    "export_nodes_json": f"with {FN} select cast(to_json({{'node_id': node_id, 'qualified_name': qualified_name, 'name': name, 'start_line': start_line}}) as varchar) as node from fn",
    "project_delete": "select c_nationkey, count(*) as n from customer where c_nationkey not in (select n_nationkey from nation where n_regionkey = 1) group by 1",
    "doc_pages_module": f"with {FN} select module_qn, '# ' || module_qn || chr(10) || string_agg('- ' || name || ' (' || qualified_name || ')', chr(10) order by node_id) as page from fn group by 1",
    "doc_index": f"with {FN} select '| ' || module_qn || ' | ' || count(*) || ' |' as line from fn group by module_qn",
    "trace_page_names": f"with {FN} select node_id, case when count(*) over (partition by name) > 1 then name || '_' || substr(md5(qualified_name), 1, 8) else name end as page from fn",
    "snippet_default_end": f"with {FN} select node_id, start_line, start_line + case when node_id % 3 <> 0 then 5 else 50 end as end_line from fn",
    "mask_and_clock": "select c_custkey, substr(c_name, 1, 4) || '****' || right(c_name, 2) as masked, printf('%02d:%02d', c_custkey // 60 % 24, c_custkey % 60) as clock from customer",
}
