"""Call sites to definitions: exact names by one equi-join of candidates, whole dotted suffixes by an index.

Definitions are (qn, seq): qualified names in the order in which they were registered. An import map is (module, key,
target, seq): a name or alias of a module to a qualified name; keys that start with ``INCLUDED`` stand for a whole
module whose definitions are seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

INCLUDED = "__c_module__"  # fixed value: the mark of included modules among import keys


def suffixes(qn: Column) -> Column:
    """What stands behind each dot of a qualified name, the longest first."""
    parts = F.split(qn, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "."))


def _entries(definitions: DataFrame) -> DataFrame:
    """(suffix, top, first): one row for each suffix of each definition."""
    parts = F.split("qn", r"\.", -1)
    dotted = definitions.filter(F.contains("qn", F.lit(".")))
    return dotted.select(parts[0].alias("top"), F.struct("seq", "qn").alias("first"), F.explode(F.slice(suffixes(F.col("qn")), F.lit(1), F.size(parts) - 1)).alias("suffix"))


def suffix_index(definitions: DataFrame) -> DataFrame:
    """(suffix, top, first): for every dotted suffix and every first part of names the definition (seq, qn) registered first.

    Names repeat once for each of their dots; only one row for each key is kept, so a suffix that a third of all names
    share has one row for each top package. Repeated definitions count once, names without dots have no suffix.
    """
    return _entries(definitions).groupBy("suffix", "top").agg(F.min("first").alias("first"))


def refreshed_index(index: DataFrame, left: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame:
    """The index after the definitions ``gone`` were removed, of which ``left`` remain, and ``new`` ones added.

    Only keys whose first definition went are looked up again, among the names of ``left`` that have such a suffix.
    """
    lost = _entries(gone).select("suffix", "top", F.col("first").alias("was"))
    touched = index.join(lost.groupBy("suffix", "top").agg(F.collect_set("was").alias("was")), ["suffix", "top"]).filter(F.array_contains("was", F.col("first"))).select("suffix", "top")
    again = _entries(left).join(touched, ["suffix", "top"], "left_semi")
    kept = index.join(touched, ["suffix", "top"], "left_anti")
    every = kept.unionByName(again).unionByName(_entries(new))
    return every.groupBy("suffix", "top").agg(F.min("first").alias("first"))


def resolve(sites: DataFrame, definitions: DataFrame, imports: DataFrame, fields: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Every site (call_id, module, class, name) with (qn, step): the definition that its call leads to, or nulls.

    1: ``self.x`` or ``this.x`` inside a class (its qualified name) is ``class.x``; found or not, the search ends there.
    2, dotted names: the part before the first dot by the import map, then the name as a whole qualified name.
    3: the whole name by the import map, then as a definition of an included module, in the map's order.
    4: a definition of the own module. 5, dotted names: the last part by ``fields`` (field, qn).
    6: the first registered name that ends with a dot and the whole name, names of the own top package before others.

    Null and empty names lead nowhere, null modules and classes are taken as empty. Each name is resolved once for a module, or
    for a class in step 1, so a call that a third of all sites make costs as much as a rare one; a module that is included
    many times counts once, where it comes first. All steps are equi-joins. Sites are written once and read back.
    """
    index = suffix_index(definitions) if index is None else index
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    keyed = sites.select("call_id", text("module").alias("m"), text("class").alias("c"), text("name").alias("x"))
    own = (F.col("c") != "") & (F.startswith("x", F.lit("self.")) | F.startswith("x", F.lit("this.")))
    # the first step heeds the class alone, the others the module alone
    keyed = keyed.select("call_id", F.when(own, "").otherwise(F.col("m")).alias("m"), F.when(own, F.col("c")).otherwise("").alias("c"), "x")
    keyed = written(keyed)
    asked = written(keyed.select("m", "c", "x").distinct().filter("x != ''"))  # nine steps read it
    dot = F.locate(".", F.col("x"))
    selfs = asked.filter(own)
    rest = asked.filter(~own)
    dotted = rest.filter(dot > 0)
    maps = imports.filter("module is not null and key is not null and target is not null").select(F.col("module").alias("m"), "key", "target", "seq")
    named = maps.filter(~F.startswith("key", F.lit(INCLUDED)))
    plain = named.groupBy("m", "key").agg(F.max_by("target", "seq").alias("target"))  # a later import of a key replaces it
    included = maps.filter(F.startswith("key", F.lit(INCLUDED))).groupBy("m", F.col("target").alias("im")).agg(F.min("seq").alias("seq"))

    def way(rows: DataFrame, step: int, qn: Column, rank: Column | int = 0, half: int = 0) -> DataFrame:
        """Candidates: the name that would be right, and how early it counts."""
        order = F.struct(F.lit(step).alias("step"), F.lit(half).alias("half"), (rank if isinstance(rank, Column) else F.lit(rank)).cast("long").alias("rank"))
        return rows.select("m", "c", "x", order.alias("o"), qn.alias("qn"))

    head, tail = F.substring("x", F.lit(1), dot - 1), F.substring(F.col("x"), dot + 1, F.length("x"))
    exact = [
        way(selfs, 1, F.concat("c", F.lit("."), F.substring("x", 6, 1_000_000_000))),
        way(dotted.withColumn("key", head).join(plain, ["m", "key"]), 2, F.concat("target", F.lit("."), tail)),
        way(dotted, 2, F.col("x"), half=1),
        way(rest.withColumn("key", F.col("x")).join(plain, ["m", "key"]), 3, F.col("target")),
        way(rest.join(included, "m"), 3, F.concat("im", F.lit("."), "x"), F.col("seq"), half=1),
        way(rest, 4, F.concat("m", F.lit("."), "x")),
    ]
    candidates = exact[0]
    for more in exact[1:]:
        candidates = candidates.unionAll(more)
    found = candidates.join(definitions.select("qn").distinct(), "qn", "left_semi").select("m", "c", "x", "o", "qn")
    last = F.element_at(F.split("x", r"\.", -1), -1)
    by_field = way(dotted.withColumn("field", last).join(fields.select("field", F.col("qn").alias("f_qn")), "field"), 5, F.col("f_qn"))
    top = F.substring_index("m", ".", 1)
    whole = rest.withColumn("suffix", F.col("x"))
    near = whole.withColumn("top", top).filter("top != ''").join(index, ["suffix", "top"])
    anywhere = index.groupBy("suffix").agg(F.min("first").alias("first"))
    found = found.unionAll(by_field).unionAll(way(near, 6, F.col("first.qn"))).unionAll(way(whole.join(anywhere, "suffix"), 6, F.col("first.qn"), half=1))
    best = found.groupBy("m", "c", "x").agg(F.min(F.struct("o", "qn")).alias("b"))
    return keyed.join(best, ["m", "c", "x"], "left").select("call_id", F.col("b.qn").alias("qn"), F.col("b.o.step").alias("step"))
