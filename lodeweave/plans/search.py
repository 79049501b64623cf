"""Queries that find functions with their documents, group traces and resolve includes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths
from ..operators import callpaths, graph, traverse, vectors
from ..sources.tables import calls, functions, late_function, later_calls, table
from .queries import CALLS, FN, LATER, QUERY
from .upkeep import DEPTH

ROOT = "Brand#12"  # the module whose includes are shown
MOST = 20  # paths of an entry point


def _includes(spark, d):
    """Modules and the modules they include."""
    return functions(spark, d).filter("start_line % 10 = 1").select(F.col("module_qn").alias("src"), F.concat(F.lit("Brand#"), (F.col("start_line") + 10).cast("string")).alias("dst")).distinct()


def _documents(spark, d):
    """A rendered document for each function that has a text: name, doc."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("node_id"), "text", "lang", "source").join(functions(spark, d), "node_id")
    doc = F.concat(F.lit("# "), "qualified_name", F.lit("\n\n> "), "lang", F.lit("\n## 实现 (1)\n"), "text", F.lit("\n## Callers\n- "), "source", F.lit("\n\n"))
    return docs.select(paths.file_name(F.col("qualified_name")).alias("name"), doc.alias("doc"))


def find_api(spark, d):
    """The best five functions for a query, with the summary of their document, callees and leaf flag."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    query = rows.filter("vec_id = 3").select(F.col("embedding").alias("q"))
    named = functions(spark, d).select(F.col("node_id").alias("vec_id"), "qualified_name", F.concat_ws(" ", "name", "kind", "module_qn").alias("haystack"))
    found = vectors.hybrid(rows.join(named, "vec_id"), query, QUERY, 5).select(F.col("vec_id").alias("node_id"), "qualified_name", "score")
    return graph.with_docs(found, _documents(spark, d), calls(spark, d).select("src", "dst"))


def paths_by_entry(spark, d):
    """Entry points whose calls reach a function in ten steps at most, each with its first twenty paths, the shortest first."""
    points, paths = callpaths.trace(later_calls(spark, d), late_function(spark, d), DEPTH, MOST)
    line = F.array_join(F.transform("path", lambda x: x.cast("string")), ">")
    points = points.select("target", "entry", "at_limit", "truncated")
    rows = paths.select("target", "entry", F.col("pos").cast("long").alias("pos"), F.col("depth").cast("long").alias("depth"), line.alias("path"), "indirect")
    return rows.join(points, ["target", "entry"]).drop("target")


def dependency_tree(spark, d):
    """Includes below a module; a module that was seen is not expanded again."""
    start = functions(spark, d).filter(F.col("module_qn") == ROOT).select(F.col("module_qn").alias("node")).distinct()
    rows = traverse.tree(_includes(spark, d), start, 3)
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- "), "child", F.when(F.col("expanded"), "").otherwise(" *"))
    return rows.select("parent", "child", F.col("depth").cast("long").alias("depth"), line.alias("line"))


def stem_join_preference(spark, d):
    """Includes resolved by the stem of the header, implementations before headers."""
    fn, word = functions(spark, d), F.split("name", " ")
    ending = F.element_at(F.array(F.lit(".h"), F.lit(".c"), F.lit(".hpp")), (F.col("start_line") % 3 + 1).cast("int"))
    files = fn.select(F.concat(F.lit("src/"), "module_qn", F.lit("/"), word[0], F.lit("_"), (F.col("node_id") % 50).cast("string"), ending).alias("path"))
    includes = fn.select("node_id", F.concat(F.lit("inc/"), word[0], F.lit("_"), (F.col("node_id") % 60).cast("string"), F.lit(".h")).alias("header"))
    return graph.resolve_includes(includes, files)


QUERIES = {f.__name__: f for f in (find_api, paths_by_entry, dependency_tree, stem_join_preference)}

_LIKE = "list_cosine_similarity(cast(embedding as double[]), (select cast(embedding as double[]) from embeddings where vec_id = 3))"
_HITS = " + ".join(f"contains(haystack, '{w}')::int" for w in QUERY.split())

ORACLES = {
    "find_api": f"""with {FN}, {CALLS},
near as (select vec_id as node_id, qualified_name, {_LIKE} as likeness, lower(name || ' ' || kind || ' ' || module_qn) as haystack from embeddings join fn on vec_id = node_id order by likeness desc, vec_id limit 20),
best as (select node_id, qualified_name, likeness + 0.05::double * ({_HITS}) as score from near order by score desc, node_id limit 5),
n as (select src, count(distinct dst) as n from calls group by 1)
select node_id, qualified_name, round(score, 4) as score, '# ' || qualified_name || chr(10) || chr(10) || '> ' || lang || chr(10) || '## Callers' || chr(10) || '- ' || source as api_doc, coalesce(n, 0) as n_callees, n is null as leaf
from best left join documents on doc_id = node_id left join n on src = node_id""",
    "paths_by_entry": f"""with recursive {LATER},
up as (select node, 0 as depth from late union select src, depth + 1 from up join later on dst = node where depth < {DEPTH}),
lv as (select node as entry, min(depth) as depth from up group by 1),
ep as (select entry, depth = {DEPTH} as at_limit from lv where depth > 0 and (depth = {DEPTH} or entry not in (select dst from later))),
p as (select node as entry, 0 as depth, [node] as path, false as indirect from late
 union all select c.src, depth + 1, list_prepend(c.src, path), p.indirect or c.indirect from p join later c on c.dst = p.entry where depth < {DEPTH} and not list_contains(path, c.src)),
r as (select p.*, at_limit, row_number() over (partition by p.entry order by depth, path) as pos, count(*) over (partition by p.entry) as n from p join ep on ep.entry = p.entry)
select entry, pos, cast(depth as bigint) as depth, array_to_string(path, '>') as path, indirect, at_limit, n >= {MOST} as truncated from r where pos <= {MOST}""",
    "dependency_tree": f"""with recursive {FN}, e as (select distinct module_qn as src, 'Brand#' || (start_line + 10) as dst from fn where start_line % 10 = 1),
down as (select distinct module_qn as node, 0 as depth from fn where module_qn = '{ROOT}' union select dst, depth + 1 from down join e on src = node where depth < 2),
least as (select node, min(depth) as depth from down group by 1),
r as (select src as parent, dst as child, least.depth + 1 as depth from e join least on src = node),
x as (select *, child <> '{ROOT}' and row_number() over (partition by child order by depth, parent) = 1 as expanded from r)
select parent, child, cast(depth as bigint) as depth, repeat('  ', depth) || '- ' || child || case when expanded then '' else ' *' end as line from x""",
    "stem_join_preference": f"""with {FN}, f as (select string_split(name, ' ')[1] || '_' || (node_id % 50) as stem, 'src/' || module_qn || '/' || string_split(name, ' ')[1] || '_' || (node_id % 50) as bare, ['.h', '.c', '.hpp'][start_line % 3 + 1] as ending from fn),
b as (select stem, bare from f qualify row_number() over (partition by stem order by ending <> '.c', bare || ending) = 1),
i as (select node_id, string_split(name, ' ')[1] || '_' || (node_id % 60) as stem from fn)
select node_id, 'inc/' || i.stem || '.h' as header, replace(bare, '/', '.') as module from i left join b on i.stem = b.stem""",
}
