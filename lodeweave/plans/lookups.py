"""Queries that resolve, retrieve and refresh, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph, resolve
from ..sources.shared import folder, written
from ..sources.tables import calls, functions, table
from ..streaming import store
from .queries import CALLS, FN



def _members(fn):
    """Functions as members of classes and modules: node_id, start_line, t (top package), m (module), c (class), qn, adj, noun."""
    words, top = F.split("name", " "), F.lower("kind")
    rows = fn.select("node_id", "start_line", top.alias("t"), F.concat_ws(".", top, "module_qn").alias("m"), words[0].alias("adj"), words[1].alias("noun"))
    in_class = F.col("start_line") % 2 == 1
    return rows.withColumn("c", F.when(in_class, F.concat_ws(".", "m", "noun"))).withColumn("qn", F.concat_ws(".", F.coalesce("c", "m"), "adj"))


def resolve_steps(spark, d):
    """Every call, written in one of eight ways, to the definition that the six steps find."""
    own = _members(functions(spark, d))
    definitions = own.groupBy("qn").agg(F.min("node_id").alias("seq"))
    other = F.concat(F.col("t"), F.lit(".Brand#"), F.col("start_line").cast("string"))
    keys = F.array(
        F.struct(F.concat(F.lit("m"), (F.col("start_line") % 3).cast("string")).alias("key"), other.alias("target")),
        F.struct(F.col("adj").alias("key"), F.concat_ws(".", other, "adj").alias("target")),
        F.struct(F.concat(F.lit(resolve.INCLUDED), F.col("start_line").cast("string")).alias("key"), other.alias("target")),
    )
    imports = own.select(F.col("m").alias("module"), F.explode(keys).alias("k"), F.col("node_id").alias("seq")).select("module", "k.key", "k.target", "seq")
    fields = own.filter("start_line < 5").groupBy(F.concat("adj", F.lit("_cb")).alias("field")).agg(F.max_by("qn", "node_id").alias("qn"))
    called = own.select(F.col("node_id").alias("dst"), "qn", "adj", "noun", F.substring_index("qn", ".", -2).alias("pair"), F.concat(F.lit("m"), (F.col("start_line") % 3).cast("string"), F.lit("."), "adj").alias("via"))
    ways = [F.concat(F.lit("self."), "adj"), F.concat_ws(".", "noun", "adj"), F.col("via"), F.col("qn"), F.col("adj"), F.concat(F.lit("obj."), "adj", F.lit("_cb")), F.col("pair"), F.concat("noun", F.lit(" not"))]
    sites = calls(spark, d).select("src", "dst").join(own.select(F.col("node_id").alias("src"), "m", "c"), "src").join(called, "dst")
    sites = sites.select((F.col("src") * 10_000_000 + F.col("dst")).alias("call_id"), F.col("m").alias("module"), F.col("c").alias("class"), F.element_at(F.array(*ways), ((F.col("src") + F.col("dst")) % 8 + 1).cast("int")).alias("name"))
    return resolve.resolve(sites, definitions, imports, fields)


def _filed(spark, d):
    """Definitions (brand, file, name, qn) and sites (brand, file, name, site): a file for each kind of a brand."""
    fn = functions(spark, d).select("node_id", F.regexp_extract("module_qn", "[0-9]+", 0).cast("int").alias("brand"), F.concat_ws("/", F.lower("kind"), "module_qn").alias("file"), "name")
    definitions = fn.select("brand", "file", "name", F.concat_ws(".", "file", "name").alias("qn")).distinct()
    called = fn.select(F.col("node_id").alias("dst"), "name")
    sites = calls(spark, d).select("src", "dst").join(called, "dst").join(fn.select(F.col("node_id").alias("src"), "brand", "file"), "src")
    return definitions, sites.select("brand", "file", "name", (F.col("src") * 10_000_000 + F.col("dst")).alias("site"))


def incremental_equals_rebuild(spark, d):
    """Calls of a kept graph after three batches: an older state, files added, files changed and deleted; one comes twice.

    In the older state brands up to 5 are missing, those up to 10 have their names turned, and copies of those up to 15 lie in
    files of their own that go later. The SQL builds the last state from the tables alone.
    """
    definitions, sites = (written(rows) for rows in _filed(spark, d))  # three batches read them
    turned = F.when(F.col("brand") <= 10, F.concat_ws(" ", F.substring_index("name", " ", -1), F.substring_index("name", " ", 1))).otherwise(F.col("name"))
    later, copied = F.col("brand") <= 5, F.col("brand").between(11, 15)
    gone = F.concat(F.lit("gone/"), "file")

    def older(rows, qualified):
        old = rows.filter(~later).withColumn("name", turned)
        old = old.unionByName(rows.filter(copied).withColumn("file", gone))
        return old.withColumn("qn", F.concat_ws(".", "file", "name")) if qualified else old

    files = definitions.select("brand", "file").distinct()
    kept = store.Store(spark, folder(spark), buckets=8)
    kept.apply(0, files.filter(~later).unionByName(files.filter(copied).withColumn("file", gone)), older(definitions, True), older(sites, False))
    kept.apply(1, files.filter(later), definitions, sites)
    for _ in range(2):
        kept.apply(2, files.filter(F.col("brand").between(6, 10)).unionByName(files.filter(copied).withColumn("file", gone)), definitions, sites)
    return kept.read("calls").groupBy("file", "name", "qn").agg(F.count("*").alias("n"), F.min("site").alias("first_site"))


def refresh_high_water(spark, d):
    """Events after the last one taken in, which is the last of the day before the last."""
    events = table(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    mark = events.join(F.broadcast(events.agg(F.max("day").alias("last"))), F.col("day") < F.col("last")).agg(F.max("ts").alias("mark"))  # one row
    return events.join(F.broadcast(mark), F.col("ts") > F.col("mark")).groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


def any_label_in_paths(spark, d):
    """Nodes of every label below some modules."""
    wanted = F.col("path").isin("Brand#11", "Brand#12", "1", "3")
    one = functions(spark, d).select(F.lit("Function").alias("label"), F.col("module_qn").alias("path"), F.col("node_id").cast("string").alias("node"))
    two = table(spark, d, "customer").select(F.lit("Customer").alias("label"), F.col("c_nationkey").cast("string").alias("path"), F.col("c_custkey").cast("string").alias("node"))
    three = table(spark, d, "supplier").select(F.lit("Supplier").alias("label"), F.col("s_nationkey").cast("string").alias("path"), F.col("s_suppkey").cast("string").alias("node"))
    return one.unionAll(two).unionAll(three).filter(wanted)


def module_type_apis(spark, d):
    """Functions and types of each module, in the order of their lines."""
    fn = functions(spark, d)
    rows = fn.select("module_qn", F.lit("function").alias("what"), "name", "start_line", "node_id").unionAll(fn.filter("kind like '%STEEL%'").select("module_qn", F.lit("type").alias("what"), "kind", "start_line", "node_id"))
    return graph.first_n(rows, ["module_qn"], [F.col("what"), F.col("start_line"), F.col("node_id")], 50).select("module_qn", "what", "name", "start_line", F.col("pos").cast("long").alias("pos"))


def usage_snippet(spark, d):
    """Of each callee the first three usage examples: three lines on either side of where its caller's text names it."""
    words = functions(spark, d).filter("start_line = 7").select(F.col("node_id").alias("dst"), F.element_at(F.split("name", " "), 1).alias("token"))
    first = graph.first_n(calls(spark, d).select("src", "dst").join(words, "dst"), ["dst"], [F.col("src")], 3)
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("src"), "text")
    return first.join(texts, "src", "left").select("dst", "src", text.usage(F.col("text"), F.col("token"), 3).alias("usage"))


def rag_contexts(spark, d):
    """Retrieval contexts: five callers at most of each function that a keyword finds, with their modules."""
    fn = functions(spark, d)
    wanted = fn.filter(F.contains("name", F.lit("widget"))).select(F.col("node_id").alias("dst"), F.col("qualified_name").alias("entity"))
    near = graph.first_n(calls(spark, d).select("src", "dst").join(wanted, "dst"), ["dst"], [F.col("src")], 5)
    return near.join(fn.select(F.col("node_id").alias("src"), "qualified_name", "module_qn"), "src").select("entity", F.col("qualified_name").alias("related"), "module_qn")


def symbol_lookup(spark, d):
    """Documents that hold a symbol of a benchmark item, by an index of symbols."""
    index = table(spark, d, "documents").select("doc_id", "source", F.explode(text.symbols(F.col("text"))).alias("symbol"))
    asked = table(spark, d, "benchmark").select(F.explode(text.symbols(F.col("text"))).alias("symbol")).distinct()
    return index.join(asked, "symbol", "left_semi").select("symbol", "doc_id", "source")


def links_self_join(spark, d):
    """Link targets with the pages that link to them."""
    pages = table(spark, d, "pages").select("page_id", "url", text.links(F.col("html")).alias("links"))
    out = pages.select("page_id", F.explode("links").alias("target")).distinct()
    return out.groupBy("target").agg(F.count("*").alias("n_sources"), F.min("page_id").alias("first_source"))


def func_map_join(spark, d):
    hits = table(spark, d, "embeddings").filter("label = 2").select(F.col("vec_id").alias("node_id"))
    return hits.join(functions(spark, d), "node_id").groupBy("name").agg(F.min("qualified_name").alias("qualified_name"), F.count("*").alias("n_hits"))


def version_order(spark, d):
    version = F.concat(F.lit("v"), (F.col("p_size") % 12).cast("string"), F.lit("."), (F.col("p_partkey") % 13).cast("string"))
    rows = table(spark, d, "part").select(F.col("p_brand").alias("module"), version.alias("version"))
    return rows.groupBy("module").agg(F.max_by("version", text.version_key(F.col("version"))).alias("newest"))


def simple_names(spark, d):
    name = F.when(F.col("start_line") > 25, F.concat("name", F.lit("部件"))).otherwise(F.col("name"))
    return functions(spark, d).select(text.simple_name(F.col("qualified_name")).alias("simple"), "module_qn", text.has_cjk(name).alias("cjk"))


def fence_strip(spark, d):
    """Replies with a fence and a language, with a bare fence, or without one."""
    size, name = F.col("p_size"), F.col("p_name")
    reply = F.when(size < 15, F.concat(F.lit("```sql\n"), name, F.lit("\n```"))).when(size < 30, F.concat(F.lit("  ```\n"), name, F.lit(" ```x\n```\n"))).otherwise(F.concat(name, F.lit(" ")))
    return table(spark, d, "part").select("p_partkey", text.without_fence(reply).alias("query"))


def params_removed(spark, d):
    """Symbols of a text that its first line does not hold already."""
    own = text.symbols(F.substring_index("text", "\n", 1))
    return table(spark, d, "documents").select("doc_id", F.size(F.array_except(text.symbols(F.col("text")), own)).cast("long").alias("n_symbols")).filter("n_symbols > 0")


QUERIES = {f.__name__: f for f in (resolve_steps, incremental_equals_rebuild, refresh_high_water, any_label_in_paths, module_type_apis, usage_snippet, rag_contexts, symbol_lookup, links_self_join, func_map_join, version_order, simple_names, fence_strip, params_removed)}

_SYMBOLS = r"(select distinct doc_id, source, lang, unnest(regexp_extract_all(replace(replace(text, chr(10), '  '), ' ', '  '), '(?:^|[ ])([A-Z][a-z]{3,})[ .,]', 1)) as symbol from documents)"

ORACLES = {
    "resolve_steps": f"""with {FN}, {CALLS},
q as (select node_id, start_line, lower(kind) as t, lower(kind) || '.' || module_qn as m, split_part(name, ' ', 1) as adj, split_part(name, ' ', 2) as noun,
 case when start_line % 2 = 1 then lower(kind) || '.' || module_qn || '.' || split_part(name, ' ', 2) end as c, lower(kind) || '.' || module_qn || '.' || case when start_line % 2 = 1 then split_part(name, ' ', 2) || '.' else '' end || split_part(name, ' ', 1) as qn from fn),
d as (select qn, min(node_id) as seq from q group by 1),
s as (select src * 10000000 + dst as call_id, a.m, a.c, case (src + dst) % 8 when 0 then 'self.' || b.adj when 1 then b.noun || '.' || b.adj when 2 then 'm' || (b.start_line % 3) || '.' || b.adj when 3 then b.qn when 4 then b.adj
 when 5 then 'obj.' || b.adj || '_cb' when 6 then array_to_string(string_split(b.qn, '.')[-2:], '.') else b.noun || ' not' end as x from calls join q a on src = a.node_id join q b on dst = b.node_id),
i as (select m, 'm' || (start_line % 3) as key, arg_max(t || '.Brand#' || start_line, node_id) as target from q group by 1, 2 union all select m, adj, arg_max(t || '.Brand#' || start_line || '.' || adj, node_id) from q group by 1, 2),
n as (select m, t || '.Brand#' || start_line as target, min(node_id) as seq from q group by 1, 2),
f as (select adj || '_cb' as field, arg_max(qn, node_id) as target from q where start_line < 5 group by 1),
k as (select m, x, c is not null and starts_with(x, 'self.') as own, any_value(c) as c, strpos(x, '.') as dot from s group by m, x, c),
e as (select distinct x, m from k where not own),
u as (select k.m, k.c, k.x, 1 as step, 0 as rank, c || '.' || substr(x, 6) as qn from k where own
 union all select k.m, k.c, k.x, 2, 0, target || substr(x, dot) from k join i on i.m = k.m and dot > 0 and key = substr(x, 1, dot - 1) where not own
 union all select m, c, x, 2, 1, x from k where not own and dot > 0
 union all select k.m, k.c, k.x, 3, 0, target from k join i on i.m = k.m and key = x where not own
 union all select k.m, k.c, k.x, 3, seq, target || '.' || x from k join n on n.m = k.m where not own
 union all select m, c, x, 4, 0, m || '.' || x from k where not own),
v as (select u.* from u join d on d.qn = u.qn union all select k.m, k.c, k.x, 5, 0, target from k join f on field = string_split(x, '.')[-1] where not own and dot > 0
 union all select k.m, k.c, k.x, 6, z.rank, z.qn from k join (select e.m, e.x, d.qn, row_number() over (partition by e.m, e.x order by not starts_with(d.qn, split_part(e.m, '.', 1) || '.'), d.seq) as rank from e join d on ends_with(d.qn, '.' || e.x)) z on z.m = k.m and z.x = k.x where not own),
b as (select * from v qualify row_number() over (partition by m, c, x order by step, rank) = 1)
select s.call_id, b.qn, b.step from s left join b on b.m = s.m and b.x = s.x and b.c is not distinct from s.c""",
    "incremental_equals_rebuild": f"""with {FN}, {CALLS}, f as (select node_id, lower(kind) || '/' || module_qn as file, name from fn),
d as (select distinct file, name, file || '.' || name as qn from f), s as (select a.file, b.name, src * 10000000 + dst as site from calls join f a on src = a.node_id join f b on dst = b.node_id)
select s.file, s.name, coalesce(o.qn, l.qn) as qn, count(*) as n, min(site) as first_site from s left join d o on o.file = s.file and o.name = s.name left join (select name, min(qn) as qn from d group by 1) l on l.name = s.name group by 1, 2, 3""",
    "refresh_high_water": "with m as (select max(ts) as mark from events where cast(ts as date) < (select max(cast(ts as date)) from events)) select event_type, count(*) as n, min(event_id) as first_event from events, m where ts > mark group by 1",
    "any_label_in_paths": f"with {FN} select * from (select 'Function' as label, module_qn as path, cast(node_id as varchar) as node from fn union all select 'Customer', cast(c_nationkey as varchar), cast(c_custkey as varchar) from customer union all select 'Supplier', cast(s_nationkey as varchar), cast(s_suppkey as varchar) from supplier) where path in ('Brand#11', 'Brand#12', '1', '3')",
    "module_type_apis": f"with {FN}, r as (select module_qn, 'function' as what, name, start_line, node_id from fn union all select module_qn, 'type', kind, start_line, node_id from fn where kind like '%STEEL%') select module_qn, what, name, start_line, row_number() over (partition by module_qn order by what, start_line, node_id) as pos from r qualify pos <= 50",
    "usage_snippet": f"""with {FN}, {CALLS}, w as (select c.dst, c.src, string_split(name, ' ')[1] as token from calls c join fn on c.dst = node_id and start_line = 7 qualify row_number() over (partition by c.dst order by c.src) <= 3),
t as (select w.dst, w.src, token, string_split(text, chr(10)) as lines from w left join documents on src = doc_id),
p as (select *, list_position(list_transform(lines, lambda x: contains(x, token)), true) as hit from t)
select dst, src, case when hit > 0 then array_to_string(list_slice(lines, greatest(hit - 3, 1), hit + 3), chr(10)) end as usage from p""",
    "rag_contexts": f"with {FN}, {CALLS}, n as (select src, qualified_name as entity from calls join fn on dst = node_id and contains(name, 'widget') qualify row_number() over (partition by dst order by src) <= 5) select entity, qualified_name as related, module_qn from n join fn on src = node_id",
    "symbol_lookup": f"with s as {_SYMBOLS}, b as (select distinct unnest(regexp_extract_all(replace(replace(text, chr(10), '  '), ' ', '  '), '(?:^|[ ])([A-Z][a-z]{{3,}})[ .,]', 1)) as symbol from benchmark) select symbol, doc_id, source from s where symbol in (select symbol from b)",
    "links_self_join": "select target, count(*) as n_sources, min(page_id) as first_source from (select distinct page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as target from pages) group by 1",
    "func_map_join": f"with {FN} select name, min(qualified_name) as qualified_name, count(*) as n_hits from fn join embeddings on vec_id = node_id where label = 2 group by 1",
    "version_order": "select p_brand as module, arg_max('v' || (p_size % 12) || '.' || (p_partkey % 13), (p_size % 12) * 100 + p_partkey % 13) as newest from part group by 1",
    "simple_names": f"with {FN} select string_split(qualified_name, '.')[-1] as simple, module_qn, regexp_matches(case when start_line > 25 then name || '部件' else name end, '[一-鿿]') as cjk from fn",
    "fence_strip": "select p_partkey, case when p_size >= 15 and p_size < 30 then p_name || ' ```x' else p_name end as query from part",
    "params_removed": """with t as (select doc_id, text, split_part(text, chr(10), 1) as head from documents),
s as (select doc_id, unnest(regexp_extract_all(replace(replace(text, chr(10), '  '), ' ', '  '), '(?:^|[ ])([A-Z][a-z]{3,})[ .,]', 1)) as symbol from t),
h as (select doc_id, unnest(regexp_extract_all(replace(head, ' ', '  '), '(?:^|[ ])([A-Z][a-z]{3,})[ .,]', 1)) as symbol from t)
select doc_id, count(*) as n_symbols from (select doc_id, symbol from s except select doc_id, symbol from h) group by 1""",
}
