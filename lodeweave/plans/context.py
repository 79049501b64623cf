"""Queries about what stands around functions and modules, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import context, streaks
from ..sources import files
from ..sources.tables import calls, containment, dealt, functions, table, tasks
from .queries import CALLS, FN


def _asked(spark, d):
    """Names asked for: all simple names, all qualified names, and names that nothing has."""
    fn = functions(spark, d)
    return fn.select(F.col("name").alias("ask")).unionAll(fn.select("qualified_name")).unionAll(fn.select(F.concat(F.lit("no "), "name")))


def functions_named(spark, d):
    found = context.named(functions(spark, d), _asked(spark, d))
    return found.groupBy("ask", "qualified").agg(F.count("*").alias("n"), F.min("node_id").alias("first_id"))


def callers_of_names(spark, d):
    found = context.callers_of_names(functions(spark, d), calls(spark, d), _asked(spark, d), tasks(spark, d))
    return found.groupBy("ask").agg(F.count("*").alias("n_callers"), F.min("src").alias("first_caller"))


def _text(column):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


def function_both_ways(spark, d):
    found = context.both_ways(functions(spark, d).select("node_id", "qualified_name"), calls(spark, d))
    return found.withColumn("callers", _text("callers")).withColumn("callees", _text("callees"))


def function_call_pairs(spark, d):
    """Distinct pairs of qualified names, caller and callee."""
    fn = functions(spark, d)
    left, right = fn.select(F.col("node_id").alias("src"), F.col("qualified_name").alias("caller")), fn.select(F.col("node_id").alias("dst"), F.col("qualified_name").alias("callee"))
    pairs = calls(spark, d).join(left, "src").join(right, "dst").select("caller", "callee")
    return dealt(pairs, tasks(spark, d), "caller", "callee").distinct()


def edges_with_places(spark, d):
    """Call edges whose places are known for direct calls only, filled in from the definitions."""
    fn = functions(spark, d).withColumn("path", F.concat(F.lit("src/"), "module_qn"))
    definitions = fn.filter("start_line <= 40").select("node_id", "path", "start_line", (F.col("start_line") + 9).alias("end_line"))
    edges = calls(spark, d).select("src", "dst", F.when(F.col("indirect"), "").otherwise(F.concat(F.lit("lib/"), F.col("dst").cast("string"))).alias("path"), F.when(~F.col("indirect"), F.lit(1)).cast("long").alias("start_line"), F.when(F.col("src") < F.col("dst"), F.lit(5)).cast("long").alias("end_line"))
    return context.with_places(edges, definitions)


def module_overviews(spark, d):
    found = context.overview(functions(spark, d), calls(spark, d))
    return found.withColumn("top", F.array_join(F.transform("top", lambda x: F.concat_ws(":", x["node_id"], x["n_callers"])), ","))


def hierarchy_both_sides(spark, d):
    return context.hierarchy(containment(spark, d))


def first_meaningful_lines(spark, d):
    """The first fifteen lines of each document that are neither blank nor rules."""
    lines = F.slice(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), text.is_meaningful), 1, 15)
    return table(spark, d, "documents").select("doc_id", F.size(lines).cast("long").alias("n"), F.md5(F.array_join(lines, "\n")).alias("digest"))


def decoded_documents(spark, d):
    """Documents as the bytes of files with carriage returns, decoded again."""
    raw = F.encode(F.replace("text", F.lit("\n"), F.lit("\r\n")), "UTF-8")
    found = files.decoded(table(spark, d, "documents").select("doc_id", raw.alias("content")))
    return found.select("doc_id", F.md5("text").alias("digest"), "encoding")


def event_streaks(spark, d):
    """Stretches of at least two events of one kind in a row, by user."""
    found = streaks.streaks(table(spark, d, "events"), "user_id", [F.col("ts"), F.col("event_id")], F.col("event_type"))
    return found.filter("size > 1").select("user_id", F.col("outcome").alias("event_type"), "first_pos", "size")


def breaker_skips(spark, d):
    """Events of each user that a breaker skips once three errors came in a row."""
    found = streaks.broken(table(spark, d, "events"), "user_id", [F.col("ts"), F.col("event_id")], F.col("event_type") == "error", 3)
    return found.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.col("skipped").cast("long")).alias("n_skipped"), F.min(F.when(F.col("skipped"), F.col("event_id"))).alias("first_skipped"))


QUERIES = {f.__name__: f for f in (functions_named, callers_of_names, function_both_ways, function_call_pairs, edges_with_places, module_overviews, hierarchy_both_sides, first_meaningful_lines, decoded_documents, event_streaks, breaker_skips)}

_ASK = f"{FN}, ask as (select distinct name as ask from fn union select qualified_name from fn union select 'no ' || name from fn)"

ORACLES = {
    "functions_named": f"with {_ASK}, h as (select ask, node_id, qualified_name = ask as qualified from ask join fn on qualified_name = ask or name = ask), b as (select ask, bool_or(qualified) as any_qualified from h group by 1) select ask, qualified, count(*) as n, min(node_id) as first_id from h join b using (ask) where qualified = any_qualified group by 1, 2",
    "callers_of_names": f"with {_ASK}, {CALLS} select ask, count(distinct src) as n_callers, min(src) as first_caller from ask join fn on qualified_name = ask or name = ask join calls on dst = node_id group by 1",
    "function_both_ways": f"""with {FN}, {CALLS}, e as (select distinct src, dst from calls) select node_id, qualified_name, (select count(*) from e where dst = node_id) as n_callers, (select count(*) from e where src = node_id) as n_callees,
array_to_string(coalesce((select list(src order by src)[:5] from e where dst = node_id), []), ',') as callers, array_to_string(coalesce((select list(dst order by dst)[:5] from e where src = node_id), []), ',') as callees from fn""",
    "function_call_pairs": f"with {FN}, {CALLS} select distinct a.qualified_name as caller, b.qualified_name as callee from calls join fn a on src = a.node_id join fn b on dst = b.node_id",
    "edges_with_places": f"with {FN}, {CALLS}, d as (select node_id, 'src/' || module_qn as path, start_line from fn where start_line <= 40) select src, dst, case when indirect then path else 'lib/' || dst end as path, case when indirect then start_line else 1 end as start_line, case when src < dst then 5 when indirect then start_line + 9 end as end_line from calls left join d on dst = node_id",
    "module_overviews": f"""with {FN}, {CALLS}, e as (select distinct src, dst from calls), m as (select a.module_qn as a, b.module_qn as b, dst from e join fn a on src = a.node_id join fn b on dst = b.node_id),
t as (select b, dst, count(*) as n, row_number() over (partition by b order by count(*) desc, dst) as pos from m group by 1, 2),
l as (select b, string_agg(dst || ':' || n, ',' order by pos) as top from t where pos <= 5 group by 1)
select module_qn, count(*) as n_functions, (select count(*) from m where a = module_qn and b = module_qn) as n_inner, (select count(distinct b) from m where a = module_qn and b <> module_qn) as calls_modules, (select count(distinct a) from m where b = module_qn and a <> module_qn) as called_by_modules, any_value(top) as top from fn left join l on l.b = module_qn group by module_qn""",
    "hierarchy_both_sides": """with e as (select 'region:' || n_regionkey as parent, 'nation:' || n_nationkey as child from nation union select 'nation:' || c_nationkey, 'customer:' || c_custkey from customer), n as (select parent as node from e union select child from e)
select node, (select string_agg(parent, ',' order by parent) from e where child = node) as parents, (select count(*) from e where parent = node) as n_children, (select array_to_string(list(child order by child)[:5], ',') from e where parent = node) as children from n""",
    "first_meaningful_lines": "with l as (select doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: not regexp_matches(trim(x, ' '), '^(|[-=#*/]+)$'))[:15] as lines from documents) select doc_id, len(lines) as n, md5(array_to_string(lines, chr(10))) as digest from l",
    "decoded_documents": "select doc_id, md5(replace(text, chr(13), '')) as digest, 'utf-8' as encoding from documents",
    "event_streaks": "with p as (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) as pos, row_number() over (partition by user_id, event_type order by ts, event_id) as own from events) select user_id, event_type, min(pos) as first_pos, count(*) as size from p group by user_id, event_type, pos - own having count(*) > 1",
    "breaker_skips": """with e as (select *, row_number() over w as pos, event_type = 'error' and lag(event_type, 1) over w = 'error' and lag(event_type, 2) over w = 'error' as third from events window w as (partition by user_id order by ts, event_id)),
o as (select user_id, min(pos) as opened from e where third group by 1) select e.user_id, count(*) as n, count(*) filter (pos > opened) as n_skipped, min(event_id) filter (pos > opened) as first_skipped from e left join o on o.user_id = e.user_id group by 1""",
}
