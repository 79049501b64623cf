"""Connected components of links between 64-bit nodes, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, label): every linked node with the least node that it can reach.

    Links to oneself and links with a null count for nothing. Each round is written to shared scratch
    files; the number of rounds grows with the logarithm of the longest chain.
    """
    spark = links.sparkSession
    a, b = F.col("a"), F.col("b")
    edges = links.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    path = scratch.folder(spark)
    edges = scratch.save(edges, path)
    before = None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now[0] == 0 or now == before:
            break
        before = now
        # large star: a node's greater neighbours are linked to its least neighbour; rows are dealt by node once for both uses
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).repartition("u")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).repartition("u")
        # small star: a node and its lesser neighbours are linked to the least of them; what repeats goes here
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u != v").distinct()
        done, path = path, scratch.folder(spark)
        edges = scratch.save(small, path)
        scratch.remove(spark, done)
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(roots.select("node", F.col("node").alias("label")))
