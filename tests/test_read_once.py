"""Rows that cost much to make are made once."""

from pyspark.sql import functions as F

from lodeweave.operators import callpaths


def counted(spark, rows):
    """``rows``, and how many of them were made."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def seen(_):
        made.add(1)
        return True

    return rows.filter(seen.asNondeterministic()(F.col("src"))), made


def test_traces_read_edges_once(spark):
    pairs = [(i + 1, i, i % 3 == 0) for i in range(12)] + [(20, 5, True), (21, 20, False), (0, 3, False)]
    edges, made = counted(spark, spark.createDataFrame(pairs, "src long, dst long, indirect boolean"))
    points, paths = callpaths.trace(edges, spark.createDataFrame([(0,)], "node long"))
    assert {(r["entry"], r["depth"]) for r in points.collect()} == {(10, 10), (21, 7)}
    assert {tuple(r["path"]) for r in paths.collect()} == {tuple(range(10, -1, -1)), (21, 20, 5, 4, 3, 2, 1, 0)}
    assert made.value == len(pairs)
