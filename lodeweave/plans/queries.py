"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph, traverse, vectors
from ..sources.tables import calls, containment, functions, table
from ..streaming import refresh

#: Views that the SQL of several queries starts with.
FN = "fn as (select p_partkey as node_id, p_brand || '.' || cast(p_partkey as varchar) as qualified_name, p_name as name, p_type as kind, p_brand as module_qn, cast(p_size as bigint) as start_line from part)"
CALLS = """pairs as (select l_partkey as src, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_returnflag) as dst, l_returnflag = 'R' as indirect from lineitem),
calls as (select src, dst, bool_and(indirect) as indirect from pairs where dst is not null group by src, dst)"""
LATER = CALLS + """,
later as (select * from calls where src < dst), late as (select max(p_partkey) * 3 // 4 as node from part)"""
TARGET = 7
QUERY = "small widget economy"


def graph_label_counts(spark, d):
    fn = functions(spark, d)
    one = fn.groupBy(F.lit("Function").alias("label")).agg(F.count("*").alias("n"))
    two = fn.select("module_qn").distinct().groupBy(F.lit("Module").alias("label")).agg(F.count("*").alias("n"))
    return one.unionAll(two).unionAll(table(spark, d, "region").groupBy(F.lit("Project").alias("label")).agg(F.count("*").alias("n")))


def graph_rel_type_counts(spark, d):
    one = calls(spark, d).groupBy(F.when(F.col("indirect"), "CALLS_INDIRECT").otherwise("CALLS").alias("rel_type")).agg(F.count("*").alias("n"))
    return one.unionAll(containment(spark, d).groupBy(F.lit("CONTAINS").alias("rel_type")).agg(F.count("*").alias("n")))


def nodes_by_ids(spark, d):
    return functions(spark, d).filter(F.col("node_id").isin(1, 5, TARGET, 100)).select("node_id", "qualified_name", "name")


def functions_by_name_fallback(spark, d):
    found = graph.by_name_or_suffix(functions(spark, d), "widget")
    return found.select("node_id", "name", F.col("match").cast("int").alias("match"))


def search_contains(spark, d):
    return graph.search(functions(spark, d), F.contains("name", F.lit("red")), 20).select("node_id", "qualified_name", "name")


def search_prefix(spark, d):
    return graph.search(functions(spark, d), F.startswith("qualified_name", F.lit("Brand#1")), 30).select("qualified_name", "kind")


def module_apis(spark, d):
    fn = functions(spark, d)
    return fn.groupBy("module_qn").agg(F.count("*").alias("n_functions"), F.min("start_line").alias("first_line"), F.countDistinct("kind").alias("n_kinds"))


def module_kind_counts(spark, d):
    fn = functions(spark, d)
    short, long = F.col("start_line") <= 10, F.col("start_line") > 40
    return fn.groupBy("module_qn").agg(F.sum(short.cast("long")).alias("n_short"), F.sum(long.cast("long")).alias("n_long"), F.sum((~short & ~long).cast("long")).alias("n_other"))


def callers_of(spark, d):
    fn = functions(spark, d)
    return graph.callers(fn, calls(spark, d), F.col("node_id") == TARGET).select("node_id", "qualified_name", "indirect")


def callees_of(spark, d):
    fn = functions(spark, d)
    return graph.callees(fn, calls(spark, d), F.col("node_id") == TARGET).select("node_id", "qualified_name", "indirect")


def leaf_flags(spark, d):
    return graph.callee_counts(functions(spark, d), calls(spark, d)).select("node_id", "n_callees", "leaf")


def adjacency_lists(spark, d):
    return graph.adjacency(calls(spark, d))


def first_n_callers(spark, d):
    return graph.first_n(calls(spark, d).select("src", "dst"), ["dst"], [F.col("src")], 5).select("dst", "src", F.col("pos").cast("long").alias("pos"))


def module_call_pairs(spark, d):
    fn = functions(spark, d)
    left, right = fn.select(F.col("node_id").alias("src"), F.col("module_qn").alias("caller_module")), fn.select(F.col("node_id").alias("dst"), F.col("module_qn").alias("callee_module"))
    return calls(spark, d).join(left, "src").join(right, "dst").groupBy("caller_module", "callee_module").agg(F.count("*").alias("n"))


def resolve_cascade(spark, d):
    # sites: a part name called from a supplier nation's module; imports: the region's nations
    part = functions(spark, d)
    sites = part.select(F.col("node_id").alias("call_id"), F.concat(F.lit("Brand#"), F.pmod("node_id", F.lit(60)).cast("string")).alias("module"), "name")
    known = part.select(F.col("qualified_name").alias("qn"), F.col("module_qn").alias("module"), "name")
    pairs = part.select(F.col("module_qn").alias("module"), F.concat(F.lit("Brand#"), (F.col("start_line") + 10).cast("string")).alias("target")).distinct()
    return graph.resolve(sites, known, pairs)


def trace_levels(spark, d):
    start = functions(spark, d).filter(F.col("node_id") == TARGET).select(F.col("node_id").alias("node"))
    return traverse.levels(calls(spark, d), start, 3)


def trace_paths(spark, d):
    start = functions(spark, d).filter(F.col("node_id") == TARGET).select(F.col("node_id").alias("node"))
    found = traverse.paths(calls(spark, d), start, 2)
    return found.select("entry", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


def containment_reach(spark, d):
    start = table(spark, d, "region").filter("r_regionkey = 1").select(F.concat(F.lit("region:"), F.col("r_regionkey")).alias("node"))
    return traverse.reach(containment(spark, d), start, 2)


def knn_cosine(spark, d):
    store = table(spark, d, "embeddings")
    query = store.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    return vectors.knn(store, query, 5).select("vec_id", "label", "score")


def knn_filtered(spark, d):
    store = table(spark, d, "embeddings")
    query = store.filter("vec_id = 1").select(F.col("embedding").alias("q"))
    return vectors.knn(store, query, 5, F.col("label") == 2).select("vec_id", "score")


def keyword_fallback(spark, d):
    docs = functions(spark, d).select("node_id", "name", F.col("kind").alias("content"))
    return vectors.keyword_scores(docs, QUERY).select("node_id", "score").orderBy(F.desc("score"), "node_id").limit(20)


def symbol_index(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.explode(text.symbols(F.col("text"))).alias("symbol"))
    return docs.groupBy("symbol").agg(F.countDistinct("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc"))


def language_stats(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n_files"), F.sum("n_chars").alias("n_chars"))


def resume_unprocessed(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


def upsert_last_wins(spark, d):
    events = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return refresh.last_wins(events, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


def dedup_keep_first(spark, d):
    fn = functions(spark, d)
    return fn.groupBy("name").agg(F.min_by("qualified_name", "node_id").alias("qualified_name"), F.count("*").alias("n"))


def delete_and_cascade(spark, d):
    gone = functions(spark, d).filter("kind like '%STEEL%' or module_qn = 'Brand#11'").select("node_id")
    nodes, edges = refresh.delete_nodes(functions(spark, d), calls(spark, d), gone)
    return nodes.groupBy(F.lit("nodes").alias("what")).agg(F.count("*").alias("n")).unionAll(edges.groupBy(F.lit("edges").alias("what")).agg(F.count("*").alias("n")))


def batches_of_25(spark, d):
    return functions(spark, d).groupBy(F.floor(F.col("node_id") / 25).alias("batch")).agg(F.count("*").alias("n"), F.min("node_id").alias("first_id"))


def link_extraction(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.explode(text.links(F.col("html"))).alias("href"))
    return pages.groupBy("page_id").agg(F.count("*").alias("n_links"), F.min("href").alias("first_href"))


def artifact_names(spark, d):
    return table(spark, d, "pages").select("page_id", text.artifact_name(F.col("url")).alias("artifact"))


def meaningful_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).filter(text.is_meaningful(F.col("line")))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.min("pos").cast("long").alias("first_pos"))


def conversation_chain(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role")
    after = F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn", "role"))
    return turns.withColumn("next_role", after).filter("next_role is not null").groupBy("role", "next_role").agg(F.count("*").alias("n"))


def events_tumbling(spark, d):
    events = table(spark, d, "events")
    return events.groupBy(F.date_trunc("day", "ts").cast("date").cast("string").alias("day"), "event_type").agg(F.count("*").alias("n"))


def label_rollup(spark, d):
    return functions(spark, d).rollup("module_qn", "kind").agg(F.count("*").alias("n"))


def totals_pair(spark, d):
    return functions(spark, d).agg(F.count("*").alias("n_nodes")).crossJoin(calls(spark, d).agg(F.count("*").alias("n_edges")))  # one row each


def descriptions_fill(spark, d):
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").cast("long").alias("known"))
    return table(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left").select("doc_id", F.coalesce("known", F.lit(-1)).alias("quality"))


def class_hierarchy(spark, d):
    nation = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("children"))
    return table(spark, d, "region").select("r_regionkey", "r_name").join(nation, "r_regionkey", "left")


def neighbours_both(spark, d):
    edges = calls(spark, d)
    up = edges.filter(F.col("dst") == TARGET).select(F.col("src").alias("node_id"))
    return up.unionAll(edges.filter(F.col("src") == TARGET).select(F.col("dst").alias("node_id"))).distinct()


def affected_callers(spark, d):
    changed = functions(spark, d).filter("start_line > 45").select(F.col("node_id").alias("dst"))
    return calls(spark, d).join(changed, "dst", "left_semi").select(F.col("src").alias("node_id")).distinct()


def pure_callers(spark, d):
    changed = functions(spark, d).filter("start_line > 45").select("node_id")
    return affected_callers(spark, d).join(changed, "node_id", "left_anti")


def events_dedup(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (graph_label_counts, graph_rel_type_counts, nodes_by_ids, functions_by_name_fallback, search_contains, search_prefix, module_apis, module_kind_counts, callers_of, callees_of, leaf_flags, adjacency_lists, first_n_callers, module_call_pairs, resolve_cascade, trace_levels, trace_paths, containment_reach, knn_cosine, knn_filtered, keyword_fallback, symbol_index, language_stats, resume_unprocessed, upsert_last_wins, dedup_keep_first, delete_and_cascade, batches_of_25, link_extraction, artifact_names, meaningful_lines, conversation_chain, events_tumbling, label_rollup, totals_pair, descriptions_fill, class_hierarchy, neighbours_both, affected_callers, pure_callers, events_dedup)}

_UP = f"""up as (select cast({TARGET} as bigint) as node, 0 as depth union select c.src, u.depth + 1 from up u join calls c on c.dst = u.node where u.depth < 3)"""

ORACLES = {
    "graph_label_counts": "select 'Function' as label, count(*) as n from part union all select 'Module', count(distinct p_brand) from part union all select 'Project', count(*) from region",
    "graph_rel_type_counts": f"with {CALLS} select case when indirect then 'CALLS_INDIRECT' else 'CALLS' end as rel_type, count(*) as n from calls group by 1 union all select 'CONTAINS', (select count(*) from nation) + (select count(*) from customer)",
    "nodes_by_ids": f"with {FN} select node_id, qualified_name, name from fn where node_id in (1, 5, {TARGET}, 100)",
    "functions_by_name_fallback": f"with {FN}, m as (select *, case when name = 'widget' then 1 else 2 end as match from fn where name like '%widget') select node_id, name, match from m where match = (select min(match) from m)",
    "search_contains": f"with {FN} select node_id, qualified_name, name from fn where contains(name, 'red') order by qualified_name limit 20",
    "search_prefix": f"with {FN} select qualified_name, kind from fn where starts_with(qualified_name, 'Brand#1') order by qualified_name limit 30",
    "module_apis": f"with {FN} select module_qn, count(*) as n_functions, min(start_line) as first_line, count(distinct kind) as n_kinds from fn group by 1",
    "module_kind_counts": f"with {FN} select module_qn, count(*) filter (start_line <= 10) as n_short, count(*) filter (start_line > 40) as n_long, count(*) filter (start_line > 10 and start_line <= 40) as n_other from fn group by 1",
    "callers_of": f"with {FN}, {CALLS} select node_id, qualified_name, indirect from fn join calls on src = node_id where dst = {TARGET}",
    "callees_of": f"with {FN}, {CALLS} select node_id, qualified_name, indirect from fn join calls on dst = node_id where src = {TARGET}",
    "leaf_flags": f"with {FN}, {CALLS} select node_id, count(dst) as n_callees, count(dst) = 0 as leaf from fn left join calls on src = node_id group by 1",
    "adjacency_lists": f"with {CALLS}, o as (select src as node_id, string_agg(cast(dst as varchar), ',' order by dst) as callees from calls group by 1), i as (select dst as node_id, string_agg(cast(src as varchar), ',' order by src) as callers from calls group by 1) select coalesce(o.node_id, i.node_id) as node_id, callees, callers from o full join i on o.node_id = i.node_id",
    "first_n_callers": f"with {CALLS}, r as (select dst, src, row_number() over (partition by dst order by src) as pos from calls) select dst, src, pos from r where pos <= 5",
    "module_call_pairs": f"with {FN}, {CALLS} select a.module_qn as caller_module, b.module_qn as callee_module, count(*) as n from calls join fn a on src = a.node_id join fn b on dst = b.node_id group by 1, 2",
    "resolve_cascade": f"""with {FN}, s as (select node_id as call_id, 'Brand#' || cast(node_id % 60 as varchar) as module, name from fn),
i as (select distinct module_qn as module, 'Brand#' || cast(start_line + 10 as varchar) as target from fn),
u as (select call_id, 1 as priority, qualified_name as qn from s join fn on s.module = fn.module_qn and s.name = fn.name
 union all select call_id, 2, qualified_name from s join i on s.module = i.module join fn on i.target = fn.module_qn and s.name = fn.name
 union all select call_id, 3, x.qn from s join (select name, min(qualified_name) as qn from fn group by name having count(*) = 1) x on s.name = x.name),
b as (select *, row_number() over (partition by call_id order by priority, qn) as n from u)
select s.call_id, b.qn, b.priority from s left join b on s.call_id = b.call_id and b.n = 1""",
    "trace_levels": f"with recursive {CALLS}, {_UP} select node, min(depth) as depth from up group by node",
    "trace_paths": f"with {CALLS} select src as entry, 1 as depth, cast(src as varchar) || '>{TARGET}' as path from calls where dst = {TARGET} and src <> {TARGET} union all select b.src, 2, cast(b.src as varchar) || '>' || cast(a.src as varchar) || '>{TARGET}' from calls a join calls b on b.dst = a.src where a.dst = {TARGET} and a.src <> {TARGET} and b.src not in (a.src, {TARGET})",
    "containment_reach": "select 'region:1' as node, 0 as depth union all select 'nation:' || cast(n_nationkey as varchar), 1 from nation where n_regionkey = 1 union all select 'customer:' || cast(c_custkey as varchar), 2 from customer join nation on c_nationkey = n_nationkey where n_regionkey = 1",
    "knn_cosine": "select vec_id, label, round(list_cosine_similarity(cast(embedding as double[]), (select cast(embedding as double[]) from embeddings where vec_id = 0)), 4) as score from embeddings order by list_cosine_similarity(cast(embedding as double[]), (select cast(embedding as double[]) from embeddings where vec_id = 0)) desc, vec_id limit 5",
    "knn_filtered": "select vec_id, round(list_cosine_similarity(cast(embedding as double[]), (select cast(embedding as double[]) from embeddings where vec_id = 1)), 4) as score from embeddings where label = 2 order by list_cosine_similarity(cast(embedding as double[]), (select cast(embedding as double[]) from embeddings where vec_id = 1)) desc, vec_id limit 5",
    "keyword_fallback": "select node_id, score from (select p_partkey as node_id, " + " + ".join(f"case when contains(lower(p_name), '{w}') then 1.0::double when contains(lower(p_type), '{w}') then 0.5::double else 0.0::double end" for w in sorted(QUERY.split())) + " as score from part) where score > 0 order by score desc, node_id limit 20",
    "symbol_index": r"select symbol, count(distinct doc_id) as n_docs, min(doc_id) as first_doc from (select doc_id, unnest(regexp_extract_all(replace(replace(text, chr(10), '  '), ' ', '  '), '(?:^|[ ])([A-Z][a-z]{3,})[ .,]', 1)) as symbol from documents) group by symbol",
    "language_stats": "select lang, count(*) as n_files, cast(sum(n_chars) as bigint) as n_chars from documents group by lang",
    "resume_unprocessed": "select doc_id, lang from documents where doc_id not in (select doc_id from labels)",
    "upsert_last_wins": "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1",
    "dedup_keep_first": f"with {FN} select name, arg_min(qualified_name, node_id) as qualified_name, count(*) as n from fn group by name",
    "delete_and_cascade": f"with {FN}, {CALLS}, gone as (select node_id from fn where kind like '%STEEL%' or module_qn = 'Brand#11') select 'nodes' as what, count(*) as n from fn where node_id not in (from gone) having count(*) > 0 union all select 'edges', count(*) from calls where src not in (from gone) and dst not in (from gone) having count(*) > 0",
    "batches_of_25": "select p_partkey // 25 as batch, count(*) as n, min(p_partkey) as first_id from part group by 1",
    "link_extraction": "select page_id, count(*) as n_links, min(href) as first_href from (select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as href from pages) group by page_id",
    "artifact_names": "select page_id, string_split(url, '/')[-1] || '_' || substr(md5(url), 1, 8) as artifact from pages",
    "meaningful_lines": r"select doc_id, count(*) as n_lines, min(pos) as first_pos from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents) where not regexp_matches(trim(line, ' '), '^(|[-=#*/]+)$') group by doc_id",
    "conversation_chain": "select role, next_role, count(*) as n from (select role, lead(role) over (partition by conv_id order by turn, role) as next_role from conversations) where next_role is not null group by 1, 2",
    "events_tumbling": "select cast(cast(ts as date) as varchar) as day, event_type, count(*) as n from events group by 1, 2",
    "label_rollup": f"with {FN} select module_qn, kind, count(*) as n from fn group by rollup (module_qn, kind)",
    "totals_pair": f"with {CALLS} select (select count(*) from part) as n_nodes, (select count(*) from calls) as n_edges",
    "descriptions_fill": "select d.doc_id, coalesce(known, -1) as quality from documents d left join (select doc_id, cast(max(quality) as bigint) as known from labels group by 1) l on d.doc_id = l.doc_id",
    "class_hierarchy": "select r_regionkey, r_name, (select string_agg(n_name, ',' order by n_name) from nation where n_regionkey = r_regionkey) as children from region",
    "neighbours_both": f"with {CALLS} select src as node_id from calls where dst = {TARGET} union select dst from calls where src = {TARGET}",
    "affected_callers": f"with {FN}, {CALLS} select distinct src as node_id from calls where dst in (select node_id from fn where start_line > 45)",
    "pure_callers": f"with {FN}, {CALLS} select distinct src as node_id from calls where dst in (select node_id from fn where start_line > 45) and src not in (select node_id from fn where start_line > 45)",
    "events_dedup": "select user_id, event_type, min(event_id) as first_event, count(*) as n from events group by 1, 2",
}
