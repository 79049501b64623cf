import pytest

from compare import spark_rows, sql_rows
from lodeweave.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_same_rows_as_sql(spark, name):
    assert spark_rows(registry.QUERIES[name](spark, FOLDER)) == sql_rows(FOLDER, registry.ORACLES[name])


def test_whole_traces_and_batches(spark):
    from lodeweave.operators import traverse

    # a chain of twelve callers with a cycle; 10 is still called
    edges = spark.createDataFrame([(i + 1, i) for i in range(12)] + [(0, 3), (40, 2)], "src long, dst long")
    found = {r["node"]: r["depth"] for r in traverse.levels(edges, spark.createDataFrame([(0,)], "node long"), 10).collect()}
    assert found == {i: i for i in range(11)} | {40: 3}
    asked = registry.QUERIES["knn_batch_whole"](spark, FOLDER).select("query_id").distinct().count()
    assert asked == spark.read.parquet(f"{FOLDER}/embeddings.parquet").filter("vec_id % 20 = 0").count() > 3
    few, all_levels = (registry.QUERIES[x](spark, FOLDER) for x in ("trace_levels", "trace_levels_whole"))
    assert few.select("node").subtract(all_levels.select("node")).isEmpty()
