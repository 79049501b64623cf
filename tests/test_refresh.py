"""Streams of changes: what a stream of batches leaves is what one batch leaves."""

from pyspark.sql import functions as F

from lodeweave.operators import traverse
from lodeweave.streaming import refresh


def test_stream_of_upserts_equals_one_batch(spark, tmp_path):
    first = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 1)], "key long, value string, at long")
    later = spark.createDataFrame([(2, "B", 2), (4, "d", 2), (2, "BB", 3)], "key long, value string, at long")
    first.write.parquet(str(tmp_path / "in"))
    later.write.mode("append").parquet(str(tmp_path / "in"))
    state = {"rows": spark.createDataFrame([], first.schema)}

    def apply(batch, _):
        changed = refresh.last_wins(batch, ["key"], [F.col("at")])
        state["rows"] = spark.createDataFrame(refresh.upsert(state["rows"], changed, ["key"]).collect(), first.schema)

    source = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    refresh.apply_stream(source, apply, str(tmp_path / "done")).awaitTermination()
    want = {(r["key"], r["value"]) for r in refresh.last_wins(first.unionAll(later), ["key"], [F.col("at")]).collect()}
    assert {(r["key"], r["value"]) for r in state["rows"].collect()} == want == {(1, "a"), (2, "BB"), (3, "c"), (4, "d")}
    state["rows"] = None  # nothing new: no batch is run
    refresh.apply_stream(source, apply, str(tmp_path / "done")).awaitTermination()
    assert state["rows"] is None


def test_tree_expands_a_node_once(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 1)], "src long, dst long")
    rows = traverse.tree(edges, spark.createDataFrame([(1,)], "node long"), 3).collect()
    assert {(r["parent"], r["child"], r["depth"], r["expanded"]) for r in rows} == {(1, 2, 1, True), (1, 3, 1, True), (2, 4, 2, True), (3, 4, 2, False), (4, 1, 3, False)}
