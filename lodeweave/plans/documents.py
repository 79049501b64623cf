"""Queries over pages, documents, conversations and events, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import paths, text
from ..sources.tables import table

SKIPPED = ("fr", "de")
LANGUAGES = (("html", "markup"), ("py", "python"), ("c", "c"), ("h", "c"))
_LINES = "(select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents)"
_BARE = r"regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/$', '')"


def _pages(spark, d):
    return table(spark, d, "pages")


def _lines(spark, d):
    """(doc_id, pos, line), pos from 1."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("doc_id", (F.col("at") + 1).cast("long").alias("pos"), "line")


def path_exclusion(spark, d):
    parts = F.split("url", "/")
    return _pages(spark, d).filter(~F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED)))).select("page_id", "url")


def directory_expansion(spark, d):
    folders = _pages(spark, d).select(F.explode(paths.folders(paths.bare(F.col("url")))).alias("folder"))
    return folders.groupBy("folder").agg(F.count("*").alias("n_files"))


def extension_language_join(spark, d):
    known = spark.createDataFrame(list(LANGUAGES), "extension string, language string")
    pages = _pages(spark, d).select(paths.extension(F.col("url")).alias("extension"))
    found = pages.join(F.broadcast(known), "extension", "left")  # one row a language
    return found.groupBy(F.coalesce("language", F.lit("plain")).alias("language")).agg(F.count("*").alias("n"))


def header_first_order(spark, d):
    first = F.when(paths.extension(F.col("url")) == "html", 0).otherwise(1)
    pages = _pages(spark, d).withColumn("host", F.element_at(F.split(paths.bare(F.col("url")), "/"), 1))
    return pages.select("host", "page_id", F.row_number().over(Window.partitionBy("host").orderBy(first, "url", "page_id")).cast("long").alias("pos"))


def file_nodes(spark, d):
    bare = paths.bare(F.col("url"))
    return _pages(spark, d).select(F.lit("File").alias("label"), bare.alias("path"), paths.parent(bare).alias("parent")).distinct()


def canonical_path(spark, d):
    return _pages(spark, d).select("page_id", paths.bare(F.col("url")).alias("path"))


def module_name_from_path(spark, d):
    return _pages(spark, d).select("page_id", paths.module_name(F.col("url")).alias("module"))


def safe_file_name(spark, d):
    return _pages(spark, d).select("page_id", paths.safe_name(F.col("url"), 40).alias("name"))


def tree_listing_limit(spark, d):
    return _pages(spark, d).select(paths.bare(F.col("url")).alias("path")).distinct().orderBy("path").limit(300)


def parameter_split(spark, d):
    query = F.regexp_extract("url", r"\?([^#]*)", 1)
    pairs = _pages(spark, d).filter(query != "").select(F.explode(F.split(query, "&")).alias("p")).select(F.split("p", "=").alias("p"))
    return pairs.groupBy(F.element_at("p", 1).alias("name")).agg(F.count("*").alias("n"), F.count_distinct(F.try_element_at("p", F.lit(2))).alias("n_values"))


def tag_extraction(spark, d):
    tags = _pages(spark, d).select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), 1)).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("n_pages"))


def pages_to_fields(spark, d):
    return _pages(spark, d).select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]*)"', 1).alias("lang"))


def reference_links(spark, d):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return _pages(spark, d).select("page_id", F.concat(F.lit("["), title, F.lit("]("), "url", F.lit(")")).alias("link"))


def todo_scan(spark, d):
    return _pages(spark, d).filter(F.contains("html", F.lit("<!-- ad "))).select("page_id", F.regexp_extract("html", "<!-- ad ([0-9]+) -->", 1).alias("mark"))


def comment_strip(spark, d):
    return _pages(spark, d).select("page_id", F.char_length(F.regexp_replace("html", "<!--.*?-->", "")).cast("long").alias("n_chars"))


def line_range_snippet(spark, d):
    return table(spark, d, "documents").select("doc_id", text.line_range(F.col("text"), 2, 4, 3000).alias("snippet"))


def definition_snippet(spark, d):
    return table(spark, d, "documents").select("doc_id", text.around(F.col("text"), "the ", 2, 20, 800).alias("snippet"))


def numbered_lines(spark, d):
    return _lines(spark, d).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: F.concat(x["pos"].cast("string"), F.lit(": "), x["line"])), "\n").alias("numbered"))


def macro_like_lines(spark, d):
    return _lines(spark, d).filter(F.col("line").rlike("^[A-Z][a-z]+ ")).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


def first_sentence(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_extract("text", "^([^.!?]*[.!?])", 1).alias("sentence"))


def strip_markdown(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace(F.regexp_replace("text", "[*`#]+", ""), r"\[([^\]]*)\]\([^)]*\)", "$1").alias("plain"))


def symbols_first_occurrence(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(text.symbols(F.col("text")), ",").alias("symbols")).filter("symbols <> ''")


def small_docs_skip(spark, d):
    return table(spark, d, "documents").filter(F.char_length("text") >= 30).groupBy("source").agg(F.count("*").alias("n")).filter("n >= 3")


def doc_by_level(spark, d):
    return table(spark, d, "documents").filter((F.col("lang") == "en") & (F.col("n_chars") > 2000)).select("doc_id", "source")


def not_null_projection(spark, d):
    return table(spark, d, "documents").filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang")


def files_changed_semi(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", "source")


def summarised_anti(spark, d):
    done = table(spark, d, "labels").filter("quality = 1").select("doc_id")
    return table(spark, d, "documents").join(done, "doc_id", "left_anti").select("doc_id", "source")


def priority_truncation(spark, d):
    running = F.sum("n_chars").over(Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, d, "documents").select("doc_id", "source", running.cast("long").alias("used")).filter("used <= 50000")


def doc_validation(spark, d):
    docs = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum((F.char_length("text") < 30).cast("long")).alias("n_small"), F.sum((F.col("n_chars") == F.char_length("text")).cast("long")).alias("n_exact"))
    return docs.withColumn("state", F.when(F.col("n_small") == 0, "ok").when(F.col("n_small") * 2 < F.col("n"), "partial").otherwise("bad"))


def metadata_permissive_json(spark, d):
    k = F.expr("try_cast(get_json_object(props, '$.k') as bigint)")
    return table(spark, d, "events").withColumn("k", k).filter("k is not null").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


def events_since_mark(spark, d):
    return table(spark, d, "events").filter(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")).groupBy("event_type").agg(F.count("*").alias("n"))


def events_session(spark, d):
    mine = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    opens = F.coalesce(F.col("ts") - F.lag("ts").over(mine) > F.expr("interval 30 minutes"), F.lit(True))
    return events.withColumn("opens", opens.cast("long")).groupBy("user_id").agg(F.sum("opens").alias("n_sessions"), F.count("*").alias("n_events"))


def snapshot_diff(spark, d):
    events = table(spark, d, "events").withColumn("day", F.col("ts").cast("date").cast("string"))
    old, new = (events.filter(F.col("day") == day).groupBy("user_id").agg(F.count("*").alias(name)) for day, name in (("2024-01-01", "n_old"), ("2024-01-02", "n_new")))
    state = F.when(F.col("n_old").isNull(), "added").when(F.col("n_new").isNull(), "removed").when(F.col("n_old") == F.col("n_new"), "same").otherwise("changed")
    return old.join(new, "user_id", "full_outer").select("user_id", state.alias("state"))


def iso_timestamps(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("last_seen"))


def guarded_block_flags(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.bool_or(F.contains("text", F.lit("<|"))).alias("control"), F.bool_or(F.col("text").rlike("[0-9]")).alias("digits"))


def chunks_per_file(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",").alias("roles"), F.count("*").alias("n"))


def prompt_text(spark, d):
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.md5(F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n")).alias("digest"))


def section_carry_forward(spark, d):
    order = Window.partitionBy("conv_id").orderBy("turn", "role")
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(order).alias("asked"))


QUERIES = {f.__name__: f for f in (path_exclusion, directory_expansion, extension_language_join, header_first_order, file_nodes, canonical_path, module_name_from_path, safe_file_name, tree_listing_limit, parameter_split, tag_extraction, pages_to_fields, reference_links, todo_scan, comment_strip, line_range_snippet, definition_snippet, numbered_lines, macro_like_lines, first_sentence, strip_markdown, symbols_first_occurrence, small_docs_skip, doc_by_level, not_null_projection, files_changed_semi, summarised_anti, priority_truncation, doc_validation, metadata_permissive_json, events_since_mark, events_session, snapshot_diff, iso_timestamps, guarded_block_flags, chunks_per_file, prompt_text, section_carry_forward)}

_EXT = r"regexp_extract(string_split(regexp_replace(url, '[?#].*$', ''), '/')[-1], '\.([a-z0-9]+)$', 1)"

ORACLES = {
    "path_exclusion": f"select page_id, url from pages where not list_has_any(string_split(url, '/'), {list(SKIPPED)})",
    "directory_expansion": f"select array_to_string(list_slice(p, 1, n), '/') as folder, count(*) as n_files from (select p, unnest(range(1, len(p))) as n from (select string_split({_BARE}, '/') as p from pages)) group by 1",
    "extension_language_join": f"select coalesce(l.language, 'plain') as language, count(*) as n from pages left join (values {', '.join(map(str, LANGUAGES))}) l(extension, language) on l.extension = {_EXT} group by 1",
    "header_first_order": f"select string_split({_BARE}, '/')[1] as host, page_id, row_number() over (partition by string_split({_BARE}, '/')[1] order by case when {_EXT} = 'html' then 0 else 1 end, url, page_id) as pos from pages",
    "file_nodes": f"select distinct 'File' as label, {_BARE} as path, regexp_replace({_BARE}, '/[^/]*$', '') as parent from pages",
    "canonical_path": f"select page_id, {_BARE} as path from pages",
    "module_name_from_path": rf"select page_id, replace(regexp_replace({_BARE}, '\.html$', ''), '/', '.') as module from pages",
    "safe_file_name": "select page_id, case when strlen(s) > 40 then substr(s, 1, 31) || '_' || substr(md5(url), 1, 8) else s end as name from (select page_id, url, regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g') as s from pages)",
    "tree_listing_limit": f"select distinct {_BARE} as path from pages order by path limit 300",
    "parameter_split": r"select string_split(p, '=')[1] as name, count(*) as n, count(distinct string_split(p, '=')[2]) as n_values from (select unnest(string_split(regexp_extract(url, '\?([^#]*)', 1), '&')) as p from pages where regexp_extract(url, '\?([^#]*)', 1) <> '') group by 1",
    "tag_extraction": "select tag, count(*) as n, count(distinct page_id) as n_pages from (select page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) as tag from pages) group by tag",
    "pages_to_fields": "select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, regexp_extract(html, '<html lang=\"([a-z]*)\"', 1) as lang from pages",
    "reference_links": "select page_id, '[' || regexp_extract(html, '<title>([^<]*)</title>', 1) || '](' || url || ')' as link from pages",
    "todo_scan": "select page_id, regexp_extract(html, '<!-- ad ([0-9]+) -->', 1) as mark from pages where contains(html, '<!-- ad ')",
    "comment_strip": "select page_id, length(regexp_replace(html, '<!--.*?-->', '', 'g')) as n_chars from pages",
    "line_range_snippet": "select doc_id, substr(array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)), 1, 3000) as snippet from documents",
    "definition_snippet": f"with f as (select doc_id, min(pos) as hit from {_LINES} where contains(line, 'the ') group by 1) select d.doc_id, case when hit is null then substr(text, 1, 800) else array_to_string(list_slice(string_split(text, chr(10)), greatest(hit - 2, 1), hit + 20), chr(10)) end as snippet from documents d left join f on d.doc_id = f.doc_id",
    "numbered_lines": f"select doc_id, string_agg(cast(pos as varchar) || ': ' || line, chr(10) order by pos, line) as numbered from {_LINES} group by 1",
    "macro_like_lines": f"select doc_id, count(*) as n, min(pos) as first_pos from {_LINES} where regexp_matches(line, '^[A-Z][a-z]+ ') group by 1",
    "first_sentence": "select doc_id, regexp_extract(text, '^([^.!?]*[.!?])', 1) as sentence from documents",
    "strip_markdown": r"select conv_id, turn, regexp_replace(regexp_replace(text, '[*`#]+', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g') as plain from conversations",
    "symbols_first_occurrence": r"select doc_id, string_agg(symbol, ',' order by place) as symbols from (select doc_id, symbol, min(place) as place from (select doc_id, unnest(s) as symbol, generate_subscripts(s, 1) as place from (select doc_id, regexp_extract_all(replace(replace(text, chr(10), '  '), ' ', '  '), '(?:^|[ ])([A-Z][a-z]{3,})[ .,]', 1) as s from documents)) group by 1, 2) group by 1",
    "small_docs_skip": "select source, count(*) as n from documents where length(text) >= 30 group by 1 having count(*) >= 3",
    "doc_by_level": "select doc_id, source from documents where lang = 'en' and n_chars > 2000",
    "not_null_projection": "select doc_id, lang from documents where lang is not null and text is not null",
    "files_changed_semi": "select doc_id, source from documents where doc_id in (select doc_id from labels)",
    "summarised_anti": "select doc_id, source from documents where doc_id not in (select doc_id from labels where quality = 1)",
    "priority_truncation": "select doc_id, source, used from (select doc_id, source, cast(sum(n_chars) over (partition by source order by doc_id rows unbounded preceding) as bigint) as used from documents) where used <= 50000",
    "doc_validation": "select *, case when n_small = 0 then 'ok' when n_small * 2 < n then 'partial' else 'bad' end as state from (select source, count(*) as n, count(*) filter (length(text) < 30) as n_small, count(*) filter (n_chars = length(text)) as n_exact from documents group by 1)",
    "metadata_permissive_json": "select event_type, count(*) as n, cast(sum(k) as bigint) as k from (select event_type, try_cast(case when json_valid(props) then json_extract_string(props, '$.k') end as bigint) as k from events) where k is not null group by 1",
    "events_since_mark": "select event_type, count(*) as n from events where ts >= timestamp '2024-01-10' group by 1",
    "events_session": "select user_id, cast(sum(opens) as bigint) as n_sessions, count(*) as n_events from (select user_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 30 minute then 0 else 1 end as opens from events) group by 1",
    "snapshot_diff": "with o as (select user_id, count(*) as n from events where cast(ts as date) = '2024-01-01' group by 1), w as (select user_id, count(*) as n from events where cast(ts as date) = '2024-01-02' group by 1) select coalesce(o.user_id, w.user_id) as user_id, case when o.n is null then 'added' when w.n is null then 'removed' when o.n = w.n then 'same' else 'changed' end as state from o full join w on o.user_id = w.user_id",
    "iso_timestamps": "select user_id, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') as last_seen from events group by 1",
    "guarded_block_flags": "select conv_id, bool_or(contains(text, '<|')) as control, bool_or(regexp_matches(text, '[0-9]')) as digits from conversations group by 1",
    "chunks_per_file": "select conv_id, string_agg(role, ',' order by turn, role) as roles, count(*) as n from conversations group by 1",
    "prompt_text": "select conv_id, md5(string_agg(role || ': ' || coalesce(text, ''), chr(10) order by turn, role, coalesce(text, ''))) as digest from conversations group by 1",
    "section_carry_forward": "select conv_id, turn, role, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn, role) as asked from conversations",
}
