"""Column functions over paths and addresses; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bare(url: Column) -> Column:
    """Host and path, without scheme, parameters, fragment and a last slash."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "^[a-z]+://", ""), "[?#].*$", ""), "/$", "")


def folders(path: Column) -> Column:
    """All folders above a path, from the top."""
    parts = F.split(path, "/")
    return F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i > 0), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def extension(url: Column) -> Column:
    """Extension of the last path segment, empty if there is none."""
    return F.regexp_extract(F.element_at(F.split(F.regexp_replace(url, "[?#].*$", ""), "/"), -1), r"\.([a-z0-9]+)$", 1)


def module_name(url: Column) -> Column:
    """Path segments with dots between, without the page extension."""
    return F.replace(F.regexp_replace(bare(url), r"\.html$", ""), F.lit("/"), F.lit("."))


def safe_name(name: Column, most: int) -> Column:
    """A file name of at most ``most`` bytes: other characters become underscores, long names end in a digest."""
    safe = F.regexp_replace(name, "[^A-Za-z0-9_.-]+", "_")
    return F.when(F.octet_length(safe) > most, F.concat(F.substring(safe, 1, most - 9), F.lit("_"), F.substring(F.md5(name), 1, 8))).otherwise(safe)


def suffix(path: Column) -> Column:
    """Extension of a file's path, where # and ? are plain characters; lower-cased, empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def stem(path: Column) -> Column:
    """The last segment without its extension."""
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def file_name(qualified: Column) -> Column:
    """A file name for a qualified name: no separators; above 200 bytes the first 180 and eight digits of a digest."""
    safe = F.replace(F.regexp_replace(F.regexp_replace(qualified, r"[/\\]", "_"), "\n", " "), F.lit("\r"), F.lit(""))
    cut = F.make_valid_utf8(F.substring(F.encode(safe, "utf-8"), 1, 180).cast("string"))
    cut = F.rtrim(F.regexp_replace(cut, "\ufffd+$", ""))
    return F.when(F.octet_length(safe) <= 200, safe).otherwise(F.concat(cut, F.lit("_"), F.substring(F.md5(F.encode(qualified, "utf-8")), 1, 8)))
