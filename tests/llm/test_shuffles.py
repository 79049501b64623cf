"""Steps of many small stages: the driver keeps something of every task."""

import pyarrow as pa
from pyspark.sql import functions as F

from lodeweave.llm import components, scratch


def test_rounds_of_components_deal_rows_once_for_each_star(spark, monkeypatch):
    dealt, save = [], scratch.save

    def counted(df, path):
        plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
        dealt.append(sum("Exchange hashpartitioning(" in line and "REPARTITION" not in line for line in plan))
        return save(df, path)

    monkeypatch.setattr(scratch, "save", counted)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
        found = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
    # of each round only the last distinct asks for an exchange; the others are made by key before, for both uses
    assert len(dealt) > 2 and all(n == 1 for n in dealt[1:]), dealt


def test_workers_give_memory_back(spark):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id")], ["id"])

    def broken(batches):
        yield next(iter(batches))
        raise ValueError("broken")

    assert spark.range(10).mapInArrow(scratch.releasing(run), "id long").agg(F.sum("id")).first()[0] == 45
    freed = []
    old, scratch.release = scratch.release, lambda: freed.append(1)
    try:
        rows = scratch.releasing(broken)(iter([1]))
        assert next(rows) == 1
        try:
            next(rows)
        except ValueError:
            freed.append(2)
    finally:
        scratch.release = old
    assert freed == [1, 2]
