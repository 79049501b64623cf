"""A graph kept in versioned tables and updated file by file, once for each batch.

Definitions, call sites and calls lie in buckets by name, and the names that each file uses in buckets by file. A batch
of changed files finds the names it touches, rewrites only the buckets that hold them and links only their sites anew.
New buckets are written beside the old ones; then a manifest with the next number names what the tables consist of,
the last batch and the high-water mark. It is renamed into place, which either happens or not: a run that is cut off
leaves the former version, a batch that comes again is known by its number, and of two writers one fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = {"names": "file", "definitions": "name", "sites": "name", "calls": "name"}
SPREAD = 16  # files that the rows of one bucket are written to, at most


def nearest(sites: DataFrame, definitions: DataFrame) -> DataFrame:
    """(name, file, site, qn): each site's definition of its name, in its own file if there is one, else the least anywhere;
    null where the name has none. One definition for each key is joined, however many share a name."""
    own = definitions.groupBy("name", "file").agg(F.min("qn").alias("own"))
    least = definitions.groupBy("name").agg(F.min("qn").alias("least"))
    found = sites.join(own, ["name", "file"], "left").join(least, "name", "left")
    return found.select("name", "file", "site", F.coalesce("own", "least").alias("qn"))


class Store:
    """Tables under ``root``: names (file, name), definitions (name, file, qn), sites (name, file, site), calls (name, file, site, qn).

    ``link`` makes calls of sites and definitions; what it gives for a site may depend only on definitions of its name.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, link: Callable[[DataFrame, DataFrame], DataFrame] = nearest):
        self.spark, self.root, self.buckets, self.link = spark, root.rstrip("/"), buckets, link

    # manifests

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of all versions, the last one is what readers see."""
        where = self._path("manifests")
        if not self._fs().exists(where):
            return []
        names = [f.getPath().getName() for f in self._fs().listStatus(where)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        """What a version (default: the last) consists of."""
        known = self.versions()
        if not known:
            return {"version": 0, "applied": -1, "mark": None, "tables": {}, "schemas": {}}
        text = self.spark.read.text(f"{self.root}/manifests/{known[-1] if version is None else version:09d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _publish(self, state: dict) -> None:
        """Make ``state`` the next version, or fail if another writer made one."""
        fs, place = self._fs(), self._path(f"manifests/{state['version']:09d}.json")
        fs.mkdirs(self._path("manifests"))
        draft = self._path(f"manifests/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if fs.exists(place) or not fs.rename(draft, place):
            fs.delete(draft, False)
            raise RuntimeError(f"version {state['version']} was made by another writer")

    # tables

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def read(self, name: str, buckets: list[int] | None = None, state: dict | None = None) -> DataFrame:
        """A table of the last version, or the buckets of it that may hold some keys."""
        state = state or self.manifest()
        parts = state["tables"].get(name, {})
        wanted = [p for b, p in parts.items() if buckets is None or int(b) in buckets]
        kinds = {"names": "file string, name string", "definitions": "name string, file string, qn string", "sites": "name string, file string, site long", "calls": "name string, file string, site long, qn string"}
        schema = T.StructType.fromJson(state["schemas"][name]) if name in state["schemas"] else kinds[name]
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in wanted]) if wanted else self.spark.createDataFrame([], schema)

    def _write(self, name: str, rows: DataFrame, touched: list[int], state: dict, folder: str) -> None:
        """Replace the touched buckets of a table in ``state``."""
        key = KEYS[name]
        place = f"{folder}/{name}"
        part = F.pmod(F.xxhash64("file", F.lit(1)), F.lit(SPREAD))  # rows of a name that many files use go to several files
        rows.withColumn("_b", self._bucket(key)).repartition(F.col("_b"), part).write.partitionBy("_b").parquet(f"{self.root}/{place}")
        made = {f.getPath().getName()[3:] for f in self._fs().listStatus(self._path(place)) if f.getPath().getName().startswith("_b=")}
        table = {b: p for b, p in state["tables"].get(name, {}).items() if int(b) not in touched}
        state["tables"][name] = table | {b: f"{place}/_b={b}" for b in made}
        state["schemas"][name] = json.loads(rows.schema.json())

    def _buckets_of(self, keys: DataFrame, key: str) -> list[int]:
        return sorted(r[0] for r in keys.select(self._bucket(key)).distinct().collect())  # at most ``buckets`` numbers

    def apply(self, batch: int, changed: DataFrame, definitions: DataFrame, sites: DataFrame, mark: str | None = None) -> bool:
        """Take in a batch: ``changed`` (file) lists files that were added, changed or deleted, and of these ``definitions``
        (file, name, qn) and ``sites`` (file, name, site) are what they hold now; rows of other files are ignored.

        Nodes of other files stay; their calls into changed files are linked anew, and those to names that are gone lead
        nowhere. False, and nothing done, for a batch that was applied. ``mark`` is the new high-water mark.
        """
        state = self.manifest()
        if batch <= state["applied"]:
            return False
        folder = f"data/{uuid.uuid4().hex}"

        def saved(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{self.root}/{folder}/step-{name}")
            return self.spark.read.schema(df.schema).parquet(f"{self.root}/{folder}/step-{name}")

        files = saved(changed.select("file").filter("file is not null").distinct(), "files")
        new = {"definitions": definitions.select("name", "file", "qn"), "sites": sites.select("name", "file", "site")}
        new = {k: saved(v.filter("name is not null").join(files, "file", "left_semi").select(*v.columns), k) for k, v in new.items()}
        new_names = new["definitions"].select("file", "name").unionAll(new["sites"].select("file", "name")).distinct()
        by_file = self._buckets_of(files, "file")
        names = self.read("names", by_file, state)
        touched = saved(names.join(files, "file", "left_semi").select("name").unionAll(new_names.select("name")).distinct(), "touched")
        by_name = self._buckets_of(touched, "name")
        # definitions and sites as they are now are written once, in their buckets; the former ones stay in ``before``
        before = state | {"tables": dict(state["tables"])}
        for k, v in new.items():
            now = self.read(k, by_name, before).join(files, "file", "left_anti").select(*v.columns).unionAll(v)
            self._write(k, now, by_name, state, folder)
        now = {k: self.read(k, by_name, state) for k in new}
        linked = self.link(*(now[k].join(touched, "name", "left_semi") for k in ("sites", "definitions"))).select("name", "file", "site", "qn")
        calls = self.read("calls", by_name, before).join(touched, "name", "left_anti").select("name", "file", "site", "qn").unionAll(linked)
        left = names.join(files, "file", "left_anti").select("file", "name").unionAll(new_names)
        for name, rows, buckets in (("names", left, by_file), ("calls", calls, by_name)):
            self._write(name, rows, buckets, state, folder)
        state |= {"version": state["version"] + 1, "applied": batch, "mark": mark if mark is not None else state["mark"]}
        self._publish(state)
        for name in ("files", "definitions", "sites", "touched"):
            self._fs().delete(self._path(f"{folder}/step-{name}"), True)
        return True

    def apply_stream(self, changes: DataFrame, load: Callable[[DataFrame], tuple[DataFrame, DataFrame]], checkpoint: str):
        """Apply every micro-batch of ``changes`` (file, mark) that is there; ``load`` gives definitions and sites of files.
        The manifest tells which batches were applied, so one that is delivered twice counts once."""

        def take(rows: DataFrame, batch: int) -> None:
            files = rows.select("file").distinct()
            self.apply(batch, files, *load(files), rows.agg(F.max("mark")).first()[0])

        return changes.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def vacuum(self, keep: int = 2) -> int:
        """Delete what no one of the last ``keep`` versions consists of, and return how many folders went. No batch may run."""
        fs, known = self._fs(), self.versions()
        used = {p.split("/")[1] for v in known[-keep:] for t in self.manifest(v)["tables"].values() for p in t.values()}
        for v in known[:-keep]:
            fs.delete(self._path(f"manifests/{v:09d}.json"), False)
        where = self._path("data")
        gone = [f.getPath() for f in fs.listStatus(where) if f.getPath().getName() not in used] if fs.exists(where) else []
        for path in gone:
            fs.delete(path, True)
        return len(gone)
