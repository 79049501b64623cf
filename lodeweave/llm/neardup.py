"""Near-duplicate groups by min-max hashing.

Each permutation of the shingle hashes gives two values, the least and the greatest, so 64 permutations
make a signature of 128 values; 32 bands of four values give candidates. Documents that share a band
form families. Inside a family signatures are compared first and full shingle sets decide. Small families
are compared in one task each. In large ones every member is first compared with a few well connected
members, which go to where the others are; then blocks of bounded size are compared as far as their
members are not linked yet. Full sets are made once for members of families only and travel only to the
blocks. Joins of texts by id have a filter of fixed size in front, so only texts that they may concern are dealt. All links between different sets are found up to the chance (1 - 0.8**4)**32 < 1e-7 that no band
of a pair at the threshold is shared, and up to ``LIKE_LEAST``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import scratch, vectext
from .components import components

PERMUTATIONS = 64
BAND = 4  # signature values in a band; 128 values make 32 bands
BLOCK = 512  # load of a family's members that one task compares with each other or with another block
LOAD = 4096  # shingles that count as one member more
STARS = 3  # members of a large family that all others are compared with first
FILTER_BITS = 1 << 26  # bits of the filter in front of joins by id, 8 MB at every size
SENT = 64_000_000  # bytes of such members that are broadcast; more are joined
LIKE_LEAST = 0.6  # estimated likeness below which full sets are not compared; 5 standard deviations under 0.8

_random = np.random.default_rng(20240229)
_ODD = (_random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """32-bit digests of the least and greatest value of each permutation, in pairs."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(hashes), 4096):
            x = hashes[i : i + 4096, None] * _ODD[None, :]
            np.minimum(low, x.min(0), out=low)
            np.maximum(high, x.max(0), out=high)
    return vectext.mix(np.stack([low, high], axis=1).reshape(-1)).astype(np.uint32)


def _set_hash(hashes: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        one = vectext.mix(hashes + np.uint64(0x51)).sum(dtype=np.uint64)
        two = vectext.mix(hashes ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)
    return int(np.int64(one.view(np.int64))), int(np.int64(two.view(np.int64)))


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    """The shingle set of each text."""
    data, offs = vectext.raw(batch.column("text"))
    for i, j in vectext.chunks(offs):
        hashed, first = vectext.words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield vectext.shingles(hashed[a:b], k)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_shingles, node, node2, sig); node and node2 identify the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, sigs = [], [], [], []
            for s in _sets(batch, k):
                n.append(len(s))
                a, b = _set_hash(s)
                one.append(a)
                two.append(b)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "node", "node2", "sig"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scratch.releasing(run), f"doc_id {kind}, n_shingles long, node long, node2 long, sig binary")


def _with_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``wanted`` (doc_id, node, family, load) with n, sig and the sorted shingle hashes of that document as set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, n, sigs, sets = [], [], [], []
            for i, (s, node) in enumerate(zip(_sets(batch, k), batch.column("node").to_pylist(), strict=True)):
                if len(s) and _set_hash(s)[0] == node:  # an id may be repeated with another text
                    keep.append(i)
                    n.append(len(s))
                    sigs.append(signature(s).tobytes())
                    sets.append(s.tobytes())
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(keep) for c in ("node", "family", "load")), pa.array(n, pa.int64()), pa.array(sigs, pa.binary()), pa.array(sets, pa.large_binary()).cast(pa.binary())], ["node", "family", "load", "n", "sig", "set"])

    rows = _marked(docs.select(F.col("doc_id").alias("of"), "text"), F.col("of"), wanted.select("doc_id"), "maybe").filter("maybe").select("of", "text")
    rows = rows.join(wanted, F.col("of").eqNullSafe(F.col("doc_id"))).select("text", "node", "family", "load")
    return rows.mapInArrow(scratch.releasing(run), "node long, family long, load long, n long, sig binary, set binary")


class _Groups:
    """Union of labels inside one block."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have ``percent`` of their union in common."""
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _compare(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links (a, b) among the members of a block, as far as they join groups that were not joined yet.

    Members with ``side`` 0 are compared with those of side 1, members of side 2 with all.
    """
    rows = rows.drop_duplicates("node").sort_values(["n", "node"])
    sig = np.stack([np.frombuffer(x, np.uint32) for x in rows["sig"]])
    sets = [np.frombuffer(x, np.uint64) for x in rows["set"]]
    size, node, group, side = (rows[c].to_numpy() for c in ("n", "node", "comp", "side"))
    groups, found = _Groups(), []
    for i in range(len(rows)):
        # sizes ascend: from the first that is too large on none can be alike
        to = int(np.searchsorted(size, size[i] * 100 // percent, "right"))
        if to <= i + 1:
            continue
        fits = (side[i + 1 : to] != side[i]) | (side[i] == 2)
        like = (sig[i + 1 : to] == sig[i]).sum(1) >= LIKE_LEAST * sig.shape[1]
        for j in (np.flatnonzero(like & fits) + i + 1).tolist():
            if groups.top(int(group[i])) != groups.top(int(group[j])) and _alike(sets[i], sets[j], percent):
                groups.join(int(group[i]), int(group[j]))
                found.append((int(node[i]), int(node[j])))
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def _in_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """Links of all blocks; ``rows`` has block, node, n, comp, side, sig and set."""
    return rows.groupBy("block").applyInPandas(lambda x: _compare(x, percent), "a long, b long")


def _star(members: DataFrame, centers: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between ``members`` and the centers of their families; members stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for node, center, sig, c_sig, own, other in zip(*(batch.column(c).to_pylist() for c in ("node", "center", "sig", "c_sig", "set", "c_set")), strict=True):
                like = (np.frombuffer(sig, np.uint32) == np.frombuffer(c_sig, np.uint32)).mean() >= LIKE_LEAST
                if node != center and like and _alike(np.frombuffer(own, np.uint64), np.frombuffer(other, np.uint64), percent):
                    found.append((node, center))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    sent = centers.select(F.col("node").alias("center"), F.col("family").alias("c_family"), F.col("sig").alias("c_sig"), F.col("set").alias("c_set"))
    size = sent.agg(F.coalesce(F.sum(F.octet_length("c_set") + 600), F.lit(0))).first()[0]
    sent = F.broadcast(sent) if size <= SENT else sent
    return members.join(sent, F.col("family") == F.col("c_family")).mapInArrow(run, "a long, b long")


def links(docs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """Verified links (a, b) that join all nodes with a chain of links between them.

    ``reps``: (node, doc_id, n_shingles, sig), one row for each distinct set.
    """
    spark = docs.sparkSession
    out = scratch.folder(spark)
    with scratch.scope(spark):
        return scratch.save(_links(docs, reps, k, percent), out)


def _links(docs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """The same, not saved."""
    spark = docs.sparkSession

    def saved(df: DataFrame) -> DataFrame:
        return scratch.save(df, scratch.folder(spark))

    n_bands = 2 * PERMUTATIONS // BAND
    bands = F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * 4 * BAND + 1, F.lit(4 * BAND))))
    keys = reps.select("node", F.explode(bands).alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("many")).filter("many > 1")
    pairs = saved(keys.join(shared, "key").groupBy("node", "first").agg(F.sum("many").alias("weight")))
    family = components(pairs.select(F.col("node").alias("a"), F.col("first").alias("b")))
    degree = pairs.groupBy("node").agg(F.sum("weight").alias("degree"))
    own = F.lit(1) + F.floor(F.col("n_shingles") / LOAD)
    known = family.select("node", F.col("label").alias("family")).join(degree, "node").join(reps.select("node", "doc_id", own.alias("own")), "node")
    known = saved(known)
    load = known.groupBy(F.col("family").alias("_family")).agg(F.sum("own").alias("load"), F.count("*").alias("size")).filter("size > 1")
    known = saved(known.join(load, F.col("family") == F.col("_family")).drop("_family"))
    members = saved(_with_sets(docs, known.select("doc_id", "node", "family", "load"), k))
    small = members.filter(F.col("load") <= BLOCK)
    found = saved(_in_blocks(small.select(F.struct("family", F.lit(0).alias("i"), F.lit(0).alias("j")).alias("block"), "node", "n", F.col("node").alias("comp"), F.lit(2).alias("side"), "sig", "set"), percent))
    known = known.filter(F.col("load") > BLOCK)
    if known.isEmpty():
        return found
    large, stars = members.filter(F.col("load") > BLOCK), None
    for _ in range(STARS):
        # the most connected member that no star has reached yet
        rest = known if stars is None else known.join(stars.select(F.col("a").alias("node")).unionAll(stars.select(F.col("b").alias("node"))).distinct(), "node", "left_anti")
        center = rest.groupBy("family").agg(F.max(F.struct("degree", F.col("node").alias("center"))).alias("c")).select("c.center")
        center = saved(large.join(center, F.col("node") == F.col("center")).drop("center").dropDuplicates(["node"]))
        more = saved(_star(large, center, percent))
        stars = more if stars is None else stars.unionAll(more)
    label = components(stars)
    known = known.join(label.select(F.col("node").alias("_node"), "label"), F.col("node") == F.col("_node"), "left")
    known = saved(known.select("node", "family", "own", "load", F.coalesce("label", "node").alias("comp")))
    # the largest group of a family is not compared with itself; all others with all
    counts = known.groupBy("family", "comp").agg(F.sum("own").alias("many"))
    main = counts.groupBy(F.col("family").alias("_family")).agg(F.max(F.struct("many", F.col("comp").alias("main"))).alias("m")).select("_family", "m.main", F.col("m.many").alias("many"))
    rows = known.join(main, F.col("family") == F.col("_family")).withColumn("rest", F.col("comp") != F.col("main"))
    rows = rows.withColumn("mains", F.ceil(F.col("many") / BLOCK).cast("int")).withColumn("rests", F.ceil((F.col("load") - F.col("many")) / BLOCK).cast("int"))
    rows = rows.filter("rests > 0")
    mine = F.when(F.col("rest"), F.pmod(F.xxhash64("node"), F.col("rests")) + F.col("mains")).otherwise(F.pmod(F.xxhash64("node"), F.col("mains"))).cast("int")
    rows = saved(rows.withColumn("c", mine).select("node", "comp", "rest", "mains", "rests", "c"))
    others = F.sequence(F.lit(0), F.col("mains") + F.col("rests") - 1)
    with_rest = F.when(F.col("rest"), others).otherwise(F.filter(others, lambda x: x >= F.col("mains")))
    both = F.transform(with_rest, lambda x: F.struct(F.least(x, F.col("c")).alias("i"), F.greatest(x, F.col("c")).alias("j")))
    rows = large.join(rows.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node")).withColumn("p", F.explode(both))
    side = F.when(F.col("p.i") == F.col("p.j"), 2).when(F.col("c") == F.col("p.i"), 0).otherwise(1)
    rows = rows.select(F.struct("family", "p.i", "p.j").alias("block"), "node", "n", "comp", side.alias("side"), "sig", "set")
    return found.unionAll(stars).unionAll(_in_blocks(rows, percent))


def groups(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Two rows are linked where 100 * common shingles >= percent * shingles of either. component_id is the
    least doc_id reachable, the own one included; null ids count only where a group has no other. Rows
    with equal doc_id are rows of their own; where they are the least of a group all are kept. Texts
    without words (null, empty, blank) have no shingles and no links. Very long texts count in blocks by
    their shingles, so that few of them make a block; one text's set must fit in a task. An empty table
    gives an empty result. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    rows = scratch.folder(spark)
    ids = scratch.folder(spark)
    with scratch.scope(spark):
        sigs = scratch.save(signatures(docs, k), scratch.folder(spark))
        full = sigs.filter("n_shingles > 0")
        reps = full.groupBy("node", "node2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
        reps = scratch.save(reps, scratch.folder(spark))
        sigs = scratch.save(sigs.select("doc_id", "n_shingles", "node"), rows)
        found = components(links(docs, reps.select("node", "doc_id", "n_shingles", "sig"), k, percent))
        least = reps.select("node", "doc_id", "copies").join(found.select(F.col("node").alias("_node"), "label"), F.col("node") == F.col("_node"), "left").drop("_node")
        least = least.withColumn("label", F.coalesce("label", "node"))
        first = least.groupBy(F.col("label").alias("_label")).agg(F.min("doc_id").alias("component_id"))
        # only sets that stand for several documents, or are linked, change anything
        least = least.join(first, F.col("label") == F.col("_label")).filter("copies > 1 or not (component_id <=> doc_id)")
        ids = scratch.save(least.select(F.col("node").alias("_node"), F.col("component_id").alias("_least")), ids)
    out = sigs.filter("n_shingles > 0").join(ids, F.col("node") == F.col("_node"), "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("_least", "doc_id").alias("component_id"))
    empty = sigs.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionAll(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _marked(rows: DataFrame, key: Column, ids: DataFrame, into: str) -> DataFrame:
    """``rows`` and whether ``key`` may be one of ``ids`` (one column): true for all that are, and for few others.

    One bit for each hash, in pieces of 4 KB; the more ids there are, the more bits are set, up to all.
    """
    def place(column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))

    (id_column,) = ids.columns
    piece, at, bits = scratch.unused([*rows.columns, into], "piece", "at", "bits")
    every = ids.select(place(F.col(f"`{id_column}`")).alias("at")).distinct()
    pieces = every.groupBy(F.floor(F.col("at") / 32768).alias(piece)).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias(bits))
    asked = rows.withColumn(at, place(key)).withColumn(piece, F.floor(F.col(at) / 32768))
    byte = F.conv(F.hex(F.substring(F.col(bits), ((F.col(at) % 32768) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (F.col(at) % 8).cast("int")) == 1, F.lit(False))
    # at most FILTER_BITS / 8 bytes are broadcast
    return asked.join(F.broadcast(pieces), piece, "left").withColumn(into, hit).select(*[F.col(f"`{c}`") for c in rows.columns], into)


def _sortable(column: Column, kind: T.DataType) -> Column:
    """A column that rows can be ordered by; maps and variants have no order, their JSON has."""
    text = kind.simpleString()
    return F.to_json(F.struct(column)) if "map<" in text or "variant" in text else column


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near duplicates: one row of each group stays, and all without words.

    Of rows that repeat a kept doc_id and have words the one with the least text stays, among equal texts
    the least by the other columns. All columns are kept, whatever their names and types. Null ids, very
    long texts and empty tables are as in ``groups``.
    """
    spark = docs.sparkSession
    of, n, most, row, keep, maybe, kind = scratch.unused(docs.columns, "of", "n", "most", "row", "keep", "maybe", "kind")
    found = groups(docs, k, percent).groupBy("doc_id").agg(F.bool_or("kept").alias(keep), F.count("*").alias("rows"), F.min(F.when(F.col("kept"), F.col("n_shingles"))).alias(n), F.max(F.when(F.col("kept"), F.col("n_shingles"))).alias(most))
    others = found.filter(~F.col(keep) | (F.col("rows") > 1)).select(F.col("doc_id").alias(of), keep, n, most)
    others = scratch.save(others, scratch.folder(spark))
    # ids that the filter does not know are kept and occur once: their rows stay where they are
    marked = _marked(docs, docs["doc_id"], others.select(of), maybe)
    sure = marked.filter(~F.col(maybe)).drop(maybe)
    rest = marked.filter(maybe).drop(maybe)
    rest = rest.join(others, rest["doc_id"].eqNullSafe(F.col(of)), "left").filter(F.col(keep).isNull() | F.col(keep))
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # 0: kept and single; 1: without words, all stay; 2: one of them stays; the rest goes
    rest = rest.withColumn(kind, F.when(F.col(keep).isNull(), 0).when(wordless & (F.col(n) == 0), 1).when(~wordless & (F.col(most) > 0), 2)).filter(F.col(kind).isNotNull())
    order = [_sortable(F.col(f"`{f.name}`"), f.dataType) for f in docs.schema if f.name not in ("doc_id", "text")]
    one = Window.partitionBy("doc_id", kind).orderBy("text", *order)
    rest = rest.withColumn(row, F.row_number().over(one)).filter((F.col(kind) < 2) | (F.col(row) == 1))
    return sure.unionAll(rest.select(*[F.col(f"`{c}`") for c in docs.columns]))


def op2_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 80)
