"""Spans that enclose points and other spans, found by equi-joins on dyadic cells.

A span of n positions is the union of at most 2 log2(n) cells (level, place), each 2**level positions long, that do not
overlap. A position lies in one cell of each level, so a join on (level, place) meets every span around it exactly
once, and a span that covers everything costs no more rows than a short one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cells(start: Column, end: Column) -> Column:
    """The cells (level, place) that make up the positions ``start`` to ``end``, both inside; none if the span is empty."""
    def at(level: Column) -> Column:
        width = F.pow(F.lit(2.0), level)
        low, high = F.ceil(start / width), F.floor((end + 1) / width)
        left = F.when((low < high) & (F.pmod(low, F.lit(2)) == 1), F.struct(level.alias("level"), low.alias("place")))
        right = F.when((low < high) & (F.pmod(high, F.lit(2)) == 1), F.struct(level.alias("level"), (high - 1).alias("place")))
        return F.filter(F.array(left, right), lambda x: x.isNotNull())

    levels = F.floor(F.log2(end - start + 1)).cast("int")
    return F.when(start <= end, F.flatten(F.transform(F.sequence(F.lit(0), levels), at)))


def around(points: DataFrame, spans: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of ``points`` (at, and ``by``) and the spans (id, start, end, and ``by``) that hold them, both ends inside.

    All columns of the points stay; the span's are id, start, end. Nulls lie nowhere; empty spans (end before start)
    hold nothing; repeated rows count each. Positions may be any whole numbers below 2**52.
    """
    spans = spans.filter("start <= end")
    longest = spans.agg(F.max(F.col("end") - F.col("start") + 1)).first()[0]
    top = (longest or 1).bit_length() - 1  # levels that any span uses
    pieces = spans.select(*[F.col(c).alias(f"_{c}") for c in by], "id", "start", "end", F.explode(cells(F.col("start"), F.col("end"))).alias("_c"))
    asked = points.withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(top)))).withColumn("_p", F.floor(F.col("at") / F.pow(F.lit(2.0), F.col("_l"))))
    match = (F.col("_l") == F.col("_c.level")) & (F.col("_p") == F.col("_c.place"))
    for c in by:
        match = match & (F.col(c) == F.col(f"_{c}"))
    return asked.join(pieces, match).select(*points.columns, "id", "start", "end")


def innermost(points: DataFrame, spans: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The distinct points (at, and ``by``) that lie in a span, with the shortest one around them (ties: the greatest start,
    then the least id) and the number of spans around them."""
    found = around(points.select(*by, "at").distinct(), spans, by)
    rank = F.struct((F.col("end") - F.col("start")).alias("size"), (-F.col("start")).alias("back"), "id")
    return found.groupBy(*by, "at").agg(F.min(rank)["id"].alias("id"), F.count("*").alias("n_spans"))


def ancestors(spans: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(``by``, id, ancestor, up): every span and each one around it, ``up`` 1 for the innermost. Of equal spans the one with the
    greater id is around the other; spans that only overlap are not related."""
    points = spans.select(*by, F.col("id").alias("own"), F.col("start").alias("at"), F.col("end").alias("until"))
    found = around(points, spans, by).filter((F.col("end") >= F.col("until")) & (F.col("id") != F.col("own")))
    same = (F.col("start") == F.col("at")) & (F.col("end") == F.col("until"))
    found = found.filter(~same | (F.col("id") > F.col("own")))
    order = F.struct((F.col("end") - F.col("start")).alias("size"), (-F.col("start")).alias("back"), F.col("id").alias("ancestor"))
    # as many rows a span as it is deep
    up = found.groupBy(*by, "own").agg(F.sort_array(F.collect_list(order)).alias("up"))
    return up.select(*by, F.col("own").alias("id"), F.posexplode(F.transform("up", lambda x: x["ancestor"])).alias("up", "ancestor")).withColumn("up", (F.col("up") + 1).cast("long"))
