"""Queries over spans, numbered names, trees in order, budgets and resumed passes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import source
from ..operators import intervals, prefix, rendering, trie
from ..sources.shared import folder
from ..sources.tables import functions, later_calls, table
from ..streaming import resume
from .queries import FN, LATER, TARGET

BUDGET = 20_000  # characters of a source's documents in a prompt
DEPTH = 3  # levels of a rendered call tree


def _names(spark, d):
    """Distinct names of four segments: kind, brand, and both words of a part's name."""
    words = F.split("name", " ")
    return functions(spark, d).select(F.concat_ws(".", F.lower("kind"), "module_qn", words[1], words[0]).alias("name")).distinct()


def enclosing_spans(spark, d):
    """Of every part on an order line: the innermost span of parts around it, and how many there are."""
    spans = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("start"), (F.col("p_partkey") + F.col("p_size") * 4).alias("end"))
    points = table(spark, d, "lineitem").select(F.col("l_partkey").alias("at"))
    return intervals.innermost(points, spans)


def trie_numbers(spark, d):
    return trie.number(_names(spark, d)).withColumn("depth", F.col("depth").cast("long"))


def trie_ancestors(spark, d):
    """Every node of the names' tree with the nodes above it, by the ranges of their numbers."""
    nodes = trie.number(_names(spark, d))
    spans = nodes.select("top", F.col("name").alias("id"), F.col("pre").alias("start"), F.col("last").alias("end"))
    # a lone child has its parent's last number: the lesser start is around it
    return intervals.ancestors(spans, ("top",)).select(F.col("id").alias("name"), "ancestor", "up")


def tree_text(spark, d):
    """The call tree below a function as text: depth first, with guides, each function expanded once."""
    start = functions(spark, d).filter(F.col("node_id") == TARGET).select(F.col("node_id").alias("node"))
    rows = rendering.lines(rendering.tree(later_calls(spark, d), start, DEPTH), functions(spark, d).select(F.col("node_id").alias("node"), F.col("qualified_name").alias("name")))
    numbered = prefix.running(rows.withColumn("one", F.lit(1).cast("long")), [F.col("key")], "one", "pos")
    return numbered.select("pos", "line")


def prompt_budget(spark, d):
    """The first documents of each source that fit into a budget of characters, the last one cut."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    kept = prefix.within_budget(docs, [F.col("doc_id")], "text", BUDGET, ("source",), joint=1)
    return kept.select("doc_id", "source", F.char_length("text").cast("long").alias("n"), F.md5("text").alias("digest"), "cut")


def batch_places(spark, d):
    """Documents of each source in batches of ten, all documents in batches of 25."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    small = prefix.batches(docs, [F.col("doc_id")], 10, ("source",)).select("doc_id", F.col("batch").alias("small_batch"), F.col("place").alias("small_place"))
    return small.join(prefix.batches(docs, [F.col("doc_id")], 25).select("doc_id", "batch", "place"), "doc_id")


def resumed_pass(spark, d):
    """A pass over all documents with a text of at least 30 characters that stops after two batches and is taken up again."""

    def work(rows):
        return rows.select("doc_id", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.conv(F.substring(F.md5("text"), i * 4 + 1, F.lit(4)), 16, 10).cast("long")).alias("vector"))

    docs = table(spark, d, "documents").select("doc_id", "text").filter(F.char_length("text") >= 30)
    size = max(1, docs.count() // 5)
    one = resume.Pass(spark, folder(spark), "doc_id")
    one.run(docs, work, size, most=2)
    one.run(docs, work, size)
    return one.results().select("doc_id", F.array_join(F.transform("vector", lambda x: x.cast("string")), ",").alias("vector"))


def source_globals(spark, d):
    """Globals that a part's function uses; marks of comments inside strings are none, names inside comments do not count."""
    a, b = F.split("name", " ")[0], F.split("name", " ")[1]
    code = F.concat(
        F.lit("static int run(const char *cur_"), b, F.lit(", int n) {\n  char *s = \"no // comment\"; nb_"), a, F.lit(" += n; // g_"), a, F.lit("_LEFT\n  "),
        a, F.lit("_state->size = MAX_"), F.upper(b), F.lit("; /* OLD_"), F.upper(a), F.lit("\n */\n  cur_"), b, F.lit(" = NULL;\n  total"), F.col("start_line").cast("string"), F.lit("++;\n  return n;\n}\n"),
    )
    found = source.referenced_globals(code, F.array(F.concat(F.lit("const char *cur_"), b), F.lit("int n")), F.lit(".C"))
    return functions(spark, d).select("node_id", F.array_join(found, ",").alias("globals"))


def module_table_rows(spark, d):
    """Function entries read back from each module's rendered document."""
    row = F.concat(F.lit("| ["), "name", F.lit("]("), F.col("node_id").cast("string"), F.lit(".md) | `int "), F.lower("kind"), F.lit("()` | "), F.when(F.col("start_line") > 25, F.concat(F.lit("size "), F.col("start_line").cast("string"))).otherwise("—"), F.lit(" |"))
    rows = functions(spark, d).select("module_qn", "node_id", row.alias("row"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node_id", "row"))), lambda x: x["row"]), "\n")
    docs = rows.groupBy("module_qn").agg(F.concat(F.lit("# "), F.first("module_qn"), F.lit("\n\n| Name | Signature | Text |\n|---|---|---|\n"), listed, F.lit("\n")).alias("doc"))
    entries = docs.select("module_qn", F.posexplode(source.module_functions(F.col("doc"))).alias("pos", "entry"))
    return entries.withColumn("pos", F.col("pos").cast("long"))


def tree_callees(spark, d):
    """Callees read back from call trees in text, and descriptions in two languages."""
    a, b = F.split("name", " ")[0], F.split("name", " ")[1]
    lines = F.concat(F.lit("Calls\n├── "), a, F.lit("\n│   └── "), b, F.lit("(x)\n- `lib."), a, F.lit("`\n├── "), a, F.lit("\n"))
    doc = F.when(F.col("start_line") % 3 == 0, F.concat(F.lit("中文：部件 "), a, F.lit("\nEnglish: part "), b)).when(F.col("start_line") % 3 == 1, F.concat(F.lit("A "), a, F.lit(" part. It is more."))).otherwise(F.concat(F.lit("no stop "), b))
    two = source.descriptions(doc)
    return functions(spark, d).select("node_id", F.array_join(source.callee_names(lines), ",").alias("callees"), two["chinese"].alias("chinese"), two["english"].alias("english"), two["first"].alias("first_sentence"))


QUERIES = {f.__name__: f for f in (enclosing_spans, trie_numbers, trie_ancestors, tree_text, prompt_budget, batch_places, resumed_pass, source_globals, module_table_rows, tree_callees)}

_TRIE = f"""{FN}, nm as (select distinct lower(kind) || '.' || module_qn || '.' || split_part(name, ' ', 2) || '.' || split_part(name, ' ', 1) as name from fn),
p as (select distinct string_split(name, '.')[:k] as parts from nm, (select unnest(range(1, 5)) as k)), n as (select parts, parts[1] as top, array_to_string(parts, '.') as name from p)"""

ORACLES = {
    "enclosing_spans": "select k as \"at\", arg_min(p_partkey, {'a': p_size * 4::bigint, 'b': -p_partkey, 'c': p_partkey}) as id, count(*) as n_spans from (select distinct l_partkey as k from lineitem) join part on k between p_partkey and p_partkey + p_size * 4 group by 1",
    "trie_numbers": f"with {_TRIE} select top, row_number() over (partition by top order by parts) as pre, row_number() over (partition by top order by parts) + (select count(*) from n m where starts_with(m.name, n.name || '.')) as last, len(parts) as depth, name, len(parts) = 4 as is_name from n",
    "trie_ancestors": f"with {_TRIE} select n.name, a.name as ancestor, len(n.parts) - len(a.parts) as up from n join n a on starts_with(n.name, a.name || '.')",
    "tree_text": f"""with {FN}, {LATER}, e as (select src, dst, dst = max(dst) over (partition by src) as last from later),
l0 as (select [{TARGET}::bigint] as key, {TARGET}::bigint as node, true as expands, []::boolean[] as lasts),
r1 as (select list_append(key, dst) as key, dst as node, list_append(lasts, last) as lasts from l0 join e on src = node where expands),
l1 as (select key, node, row_number() over (partition by node order by key) = 1 and node not in (select node from l0) as expands, lasts from r1),
r2 as (select list_append(key, dst) as key, dst as node, list_append(lasts, last) as lasts from l1 join e on src = node where expands),
l2 as (select key, node, row_number() over (partition by node order by key) = 1 and node not in (select node from l0 union all select node from l1) as expands, lasts from r2),
r3 as (select list_append(key, dst) as key, dst as node, list_append(lasts, last) as lasts from l2 join e on src = node where expands),
l3 as (select key, node, row_number() over (partition by node order by key) = 1 and node not in (select node from l0 union all select node from l1 union all select node from l2) as expands, lasts from r3),
a as (from l0 union all from l1 union all from l2 union all from l3)
select row_number() over (order by key) as pos, array_to_string(list_transform(lasts[:-2], lambda x: case when x then '   ' else '│  ' end), '') || case when len(lasts) = 0 then '' when lasts[-1] then '└─ ' else '├─ ' end || qualified_name || case when expands then '' else ' *' end as line from a join fn on node_id = node""",
    "prompt_budget": f"""with t as (select doc_id, source, text, length(text) as n, sum(length(text) + 1) over (partition by source order by doc_id) - length(text) - 1 as gone from documents)
select doc_id, source, least(n, {BUDGET} - gone)::bigint as n, md5(substr(text, 1, ({BUDGET} - gone)::bigint)) as digest, n > {BUDGET} - gone as cut from t where gone < {BUDGET}""",
    "batch_places": "select doc_id, (row_number() over (partition by source order by doc_id) - 1) // 10 as small_batch, (row_number() over (partition by source order by doc_id) - 1) % 10 as small_place, (row_number() over (order by doc_id) - 1) // 25 as batch, (row_number() over (order by doc_id) - 1) % 25 as place from documents",
    "resumed_pass": "select doc_id, array_to_string(list_transform([1, 5, 9, 13], lambda i: ('0x' || substr(md5(text), i, 4))::bigint), ',') as vector from documents where length(text) >= 30",
    "source_globals": f"with {FN} select node_id, array_to_string(list_sort(['nb_' || split_part(name, ' ', 1), split_part(name, ' ', 1) || '_state', 'MAX_' || upper(split_part(name, ' ', 2)), 'total' || start_line]), ',') as globals from fn",
    "module_table_rows": f"with {FN} select module_qn, row_number() over (partition by module_qn order by node_id) - 1 as pos, name || ': int ' || lower(kind) || '()' || case when start_line > 25 then ' — size ' || start_line else '' end as entry from fn",
    "tree_callees": f"with {FN}, w as (select node_id, start_line % 3 as k, split_part(name, ' ', 1) as a, split_part(name, ' ', 2) as b from fn) select node_id, a || ',lib.' || a as callees, case when k = 0 then '部件 ' || a end as chinese, case when k = 0 then 'part ' || b end as english, case k when 1 then 'A ' || a || ' part.' when 2 then 'no stop ' || b end as first_sentence from w",
}
