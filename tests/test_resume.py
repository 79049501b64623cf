"""Passes that stop and go on."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from lodeweave.streaming import resume


class Counted:
    """Work that notes its keys and may fail at a batch."""

    def __init__(self, fails_at=None):
        self.keys, self.calls, self.fails_at = [], 0, fails_at

    def __call__(self, rows):
        self.calls += 1
        if self.calls == self.fails_at:
            raise OSError("cut off")
        self.keys += [r["k"] for r in rows.collect()]
        return rows.select("k", (F.col("v") * 2).alias("double"))


def test_a_stopped_run_goes_on(spark, tmp_path):
    rows = spark.createDataFrame([(i, i * 3) for i in range(57)] + [(None, 1), (3, 99)], "k long, v long")
    job = resume.Pass(spark, str(tmp_path), "k")
    assert job.results() is None
    first = Counted(fails_at=4)
    with pytest.raises(OSError):
        job.run(rows, first, 10)
    assert len(first.keys) == 30 and job.results().count() == 30
    second = Counted()
    assert job.run(rows, second, 10) == 3
    assert sorted(first.keys + second.keys) == list(range(57))  # none twice
    assert {r["k"] for r in job.results().collect()} == set(range(57))
    assert job.run(rows, Counted(), 10) == 0
    more = spark.createDataFrame([(i, i) for i in range(50, 65)], "k long, v long")
    third = Counted()
    assert job.run(more, third, 100, most=1) == 1 and sorted(third.keys) == list(range(57, 65))
    assert job.run(rows.limit(0), Counted(), 5) == 0


def test_broken_entries_are_made_again(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").alias("k"), F.col("id").alias("v"))
    job = resume.Pass(spark, str(tmp_path), "k")
    job.run(rows, Counted(), 10)
    entries = sorted(glob.glob(f"{tmp_path}/ledger/*.json"))
    assert len(entries) == 4
    with open(entries[0], "w") as f:
        f.write("{ not an entry")
    os.remove(glob.glob(f"{tmp_path}/ledger/.{os.path.basename(entries[0])}.crc")[0]) if glob.glob(f"{tmp_path}/ledger/.{os.path.basename(entries[0])}.crc") else None
    again = Counted()
    assert job.results().count() == 30 and job.run(rows, again, 10) == 1 and len(again.keys) == 10
    assert sorted(r["k"] for r in job.results().collect()) == list(range(40))
    with pytest.raises(ValueError):
        job.run(spark.range(100, 103).select(F.col("id").alias("k"), F.col("id").alias("v")), lambda x: x.limit(1), 10)
    assert job.results().count() == 40
