"""Column functions over text and vectors; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in doubles; 0 where lengths differ or a norm is 0."""
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def query_tokens(query: Column) -> Column:
    """Lower-case pieces of at least two characters between white space and punctuation, ASCII or wide; full stops are kept."""
    return F.filter(F.split(F.lower(query), r"(?U)[\s,，。、；;:：!！?？()\[\]{}]+"), lambda t: F.char_length(t) >= 2)


def hits(tokens: Column, text: Column) -> Column:
    """How many of the tokens the text contains."""
    return F.size(F.filter(tokens, lambda t: F.contains(text, t)))


def symbols(text: Column) -> Column:
    """Distinct capitalised ASCII words of a text, after a blank and before a blank, full stop or comma."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?:^|[ \n])([A-Z][a-z]{3,})(?=[ \n.,])"), 1))


def artifact_name(path: Column) -> Column:
    """Last path segment and eight digits of the whole path's digest."""
    return F.concat(F.element_at(F.split(path, "/"), -1), F.lit("_"), F.substring(F.md5(path), 1, 8))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), 1)


def is_meaningful(line: Column) -> Column:
    """Neither blank nor a rule or a comment mark."""
    return ~F.trim(line).rlike(r"^(|[-=#*/]+)$")


def line_range(text: Column, first: int, last: int, most: int) -> Column:
    """Lines ``first`` to ``last``, counted from 1, at most ``most`` characters."""
    return F.substring(F.array_join(F.slice(F.split(text, "\n"), first, last - first + 1), "\n"), 1, most)


def around(text: Column, token: str, before: int, after: int, most: int) -> Column:
    """Lines around the first one that holds ``token``; where none does, the first ``most`` characters."""
    lines = F.split(text, "\n")
    at = F.array_position(F.transform(lines, lambda x: F.contains(x, F.lit(token))), True).cast("int")
    first = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.array_join(F.slice(lines, first, at + after - first + 1), "\n")).otherwise(F.substring(text, 1, most))


def usage(text: Column, token: Column, around_lines: int) -> Column:
    """The first line that holds ``token`` with as many lines before and after; null where none does."""
    lines = F.split(text, "\n")
    at = F.array_position(F.transform(lines, lambda x: F.contains(x, token)), True).cast("int")
    first = F.greatest(at - around_lines, F.lit(1))
    return F.when(at > 0, F.array_join(F.slice(lines, first, at + around_lines - first + 1), "\n"))


def without_fence(reply: Column) -> Column:
    """A reply without the code fence around it."""
    def stripped(x: Column) -> Column:
        return F.regexp_replace(x, r"^\s+|\s+$", "")

    return stripped(F.regexp_replace(F.regexp_replace(stripped(reply), "^```[a-z]*\n?", ""), "\n?```$", ""))


def has_cjk(text: Column) -> Column:
    return text.rlike("[\u4e00-\u9fff]")


def simple_name(qualified: Column) -> Column:
    return F.element_at(F.split(qualified, r"\."), -1)


def version_key(version: Column) -> Column:
    """Numbers of a version; arrays of them order as versions do."""
    return F.transform(F.split(F.regexp_replace(version, "^v", ""), r"\."), lambda x: x.cast("int"))


# fixed values: headings of the sections that a summary leaves out
HEAVY_SECTIONS = ["## 使用示例", "## 实现", "## 参数与内存", "## 描述"]


def doc_summary(doc: Column) -> Column:
    """A rendered document without its heavy sections and without blank lines at its end."""
    def light(section):
        found = F.lit(False)
        for heading in HEAVY_SECTIONS:
            found = found | F.startswith(section, F.lit(heading))
        return ~found

    kept = F.array_join(F.filter(F.split(doc, r"(?m)^(?=## )"), light), "")
    return F.regexp_replace(kept, r"(\n[ \t\r]*)+$", "")
