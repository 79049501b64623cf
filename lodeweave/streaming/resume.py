"""Long passes over rows that are taken up where they stopped: batches with a ledger beside their results.

Every batch is a set of keys fixed when it begins, its result is a folder, and an entry of the ledger, renamed into place
when the result is whole, says where that is and what it holds. Whatever happens in between, a later run reads the
entries, takes those that cannot be read or do not fit their result as unfinished, and goes on with exactly the keys
that no finished batch has.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import prefix


class Pass:
    """A pass with its results and ledger under ``root``."""

    def __init__(self, spark: SparkSession, root: str, key: str):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _digest(self, rows: DataFrame) -> list[int]:
        """The number of keys and a sum that tells sets of keys apart."""
        found = rows.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64(self.key)), F.lit(0))).first()
        return [found[0], found[1]]

    def entries(self) -> list[dict]:
        """Entries of finished batches; one that cannot be read, or whose result is not what it says, is none."""
        fs, where = self._fs(), self._path("ledger")
        if not fs.exists(where):
            return []
        texts = self.spark.read.text(f"{self.root}/ledger", wholetext=True, pathGlobFilter="*.json").collect()  # an entry a batch
        out = []
        for (text,) in texts:
            try:
                entry = json.loads(text)
                rows = self.spark.read.parquet(f"{self.root}/{entry['folder']}")
                if self._digest(rows) == entry["digest"]:
                    out.append(entry)
            except Exception:  # noqa: S112, BLE001 - whatever is wrong with an entry, its batch is made again
                continue
        return out

    def results(self) -> DataFrame | None:
        """The rows of all finished batches, None before the first."""
        folders = [f"{self.root}/{e['folder']}" for e in self.entries()]
        return self.spark.read.parquet(*folders) if folders else None

    def run(self, rows: DataFrame, work: Callable[[DataFrame], DataFrame], size: int, most: int | None = None) -> int:
        """Apply ``work`` to all rows whose keys are in no finished batch, ``size`` rows at a time in order of the key, and return
        how many batches were made; ``most`` ends a run earlier.

        ``work`` gives one row for each row it gets, with its key. Keys must be distinct and not null: rows that repeat a key or
        have none are left out but for the first. An empty table needs no batch.
        """
        fs, made = self._fs(), 0
        rows = rows.filter(F.col(self.key).isNotNull()).dropDuplicates([self.key])
        finished = self.results()
        left = rows if finished is None else rows.join(finished.select(self.key), self.key, "left_anti")
        plan = f"plan/{uuid.uuid4().hex}"
        dealt = prefix.batches(left.select(self.key), [F.col(self.key)], size).select(self.key, "batch")
        dealt.write.parquet(f"{self.root}/{plan}")
        dealt = self.spark.read.schema(dealt.schema).parquet(f"{self.root}/{plan}")
        for batch in range((dealt.agg(F.max("batch")).first()[0] if not dealt.isEmpty() else -1) + 1):
            if made == most:
                break
            keys = dealt.filter(F.col("batch") == batch).select(self.key)
            folder = f"results/{uuid.uuid4().hex}"
            work(rows.join(keys, self.key, "left_semi")).write.parquet(f"{self.root}/{folder}")
            entry = {"folder": folder, "digest": self._digest(keys)}
            if self._digest(self.spark.read.parquet(f"{self.root}/{folder}")) != entry["digest"]:
                raise ValueError("the work must give each key once")
            fs.mkdirs(self._path("ledger"))
            draft = self._path(f"ledger/.{uuid.uuid4().hex}")
            out = fs.create(draft, False)
            out.write(bytearray(json.dumps(entry).encode()))
            out.close()
            fs.rename(draft, self._path(f"ledger/{uuid.uuid4().hex}.json"))
            made += 1
        fs.delete(self._path("plan"), True)
        return made
