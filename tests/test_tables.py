"""Calls dealt among tasks by their number."""

import pytest

from compare import spark_rows, sql_rows
from lodeweave.plans import registry
from lodeweave.sources import tables

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["function_call_pairs", "callers_of_names", "root_modules_whole"])
def test_same_rows_among_many_tasks(spark, monkeypatch, name):
    monkeypatch.setattr(tables, "TASK_ROWS", 500)
    lines = tables.table(spark, FOLDER, "lineitem").count()
    assert tables.calls(spark, FOLDER).rdd.getNumPartitions() == -(-lines // 500) > 4
    assert spark_rows(registry.QUERIES[name](spark, FOLDER)) == sql_rows(FOLDER, registry.ORACLES[name])


def test_few_rows_are_left_to_spark(spark):
    assert tables.tasks(spark, FOLDER) is None
