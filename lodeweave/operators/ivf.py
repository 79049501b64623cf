"""Nearest vectors by cosine: an inverted file of cells, probed by equi-joins, and an exact search in blocks.

Cells are those of centroids fitted on a bounded sample; every row is assigned to its nearest one. A search joins
queries with the cells nearest to them and scores whole vectors there, so scores are exact; with ``probes`` it is
approximate, without it more cells are joined until none that is left can hold a nearer row: a row of a cell is no
nearer than the distance to the centroid less the cell's radius. Large cells are split into parts, many queries into
chunks, so no task holds more than ``PART`` rows, ``CHUNK`` queries and ``SCORES`` scores at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

SAMPLE = 20_000  # rows that centroids are fitted on, at most
PART = 20_000  # rows of a cell that one task scores at once
CHUNK = 2_000  # queries that they are scored with in one task
SCORES = 2_000_000  # scores that a task holds at once, if a part has no more rows
ASKED = 500  # queries whose cells are listed at once
FIRST = 4  # cells probed first in an exact search
NOWHERE = -1  # the cell of rows without direction (null, zero, another length): their likeness to all is 0
DIGITS = 12  # decimals by which scores are told apart; ties go to the lesser id


@dataclass
class Index:
    """Centroids (unit rows), the radius of each cell, and rows (vec_id, unit, cell, part)."""

    centroids: np.ndarray
    radius: np.ndarray
    parts: dict[int, int]
    rows: DataFrame


def _units(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """Unit vectors of a list column; zeros where there is no direction."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.zeros((len(column), size))
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    good = np.flatnonzero(lengths == size)
    if len(good) and size:
        flat = column.take(pa.array(good)).flatten().cast(pa.float64()).fill_null(np.nan)
        out[good] = flat.to_numpy(zero_copy_only=False).reshape(len(good), size)
    norm = np.sqrt((out**2).sum(1))
    usable = np.isfinite(norm) & (norm > 0)
    out[~usable] = 0
    out[usable] /= norm[usable, None]
    return out


def _fit(units: np.ndarray, cells: int, rounds: int) -> np.ndarray:
    """Centroids by rounds of assignment and mean; the first rows of the sample begin."""
    units = units[(units != 0).any(1)]
    centers = np.unique(units[: 4 * cells], axis=0)
    centers = centers[np.random.default_rng(1).permutation(len(centers))[:cells]]
    for _ in range(rounds if len(centers) else 0):
        of = (units @ centers.T).argmax(1)
        total = np.zeros_like(centers)
        np.add.at(total, of, units)
        norm = np.sqrt((total**2).sum(1))
        some = norm > 0
        centers[some] = total[some] / norm[some, None]
    return centers


def build(store: DataFrame, cells: int = 64, sample: int = SAMPLE, rounds: int = 10) -> Index:
    """The index of all rows of ``store`` (vec_id, embedding).

    Centroids come from ``sample`` rows at most, in order of a hash of vec_id; the length of the vectors is the one most
    frequent in it. Rows are written by cell; null vectors, zero ones and those of another length lie in a cell of their own.
    """
    spark = store.sparkSession
    rows = store.select("vec_id", "embedding")
    some = rows.filter("embedding is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()  # at most ``sample`` rows
    lengths = some.column("embedding").combine_chunks().value_lengths().to_numpy(zero_copy_only=False) if len(some) else np.zeros(0, int)
    size = int(np.bincount(lengths).argmax()) if len(lengths) else 0
    centers = _fit(_units(some.column("embedding"), size), cells, rounds) if len(some) else np.zeros((0, 0))
    sent = spark.sparkContext.broadcast(centers)  # at most ``cells`` vectors

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = sent.value
        for batch in batches:
            units = _units(batch.column("embedding"), size)
            cell, away = np.full(len(units), NOWHERE), np.zeros(len(units))
            there = np.flatnonzero((units != 0).any(1))
            if len(there):
                like = units[there] @ centers.T
                cell[there] = like.argmax(1)
                away[there] = np.sqrt(np.maximum(0, 2 - 2 * like.max(1)))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(units) + 1) * size, pa.int32()), pa.array(units.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), flat, pa.array(cell, pa.int32()), pa.array(away, pa.float64())], ["vec_id", "unit", "cell", "away"])

    kind = store.schema["vec_id"].dataType.simpleString()
    placed = written(rows.mapInArrow(assign, f"vec_id {kind}, unit array<double>, cell int, away double"))
    found = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()  # a row a cell
    parts = {r["cell"]: -(-r["n"] // PART) for r in found}
    radius = np.zeros(len(centers))
    for r in found:
        if r["cell"] >= 0:
            radius[r["cell"]] = r["radius"]
    index = Index(centers, radius, parts, placed)
    dealt = placed.join(F.broadcast(_parts(index)), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("n_parts")).cast("int"))
    index.rows = dealt.drop("n_parts")
    return index


def _parts(index: Index) -> DataFrame:
    """(cell, n_parts): a row for each cell that has rows."""
    return index.rows.sparkSession.createDataFrame(list(index.parts.items()), "cell int, n_parts int")


def _nearest(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` greatest scores, ties by id; ``ids`` ascend."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.argsort(-scores[some], kind="stable")][:k]


def _score(rows: pd.DataFrame, queries: pd.DataFrame, k: int, others: bool) -> pd.DataFrame:
    """The best of some rows for some queries, of which so many are scored at once that there are ``SCORES`` scores at most."""
    which, best, found = [], [], []
    if len(rows) and len(queries):
        rows = rows.sort_values("vec_id", kind="stable")
        ids, units = rows["vec_id"].to_numpy(), np.stack(rows["unit"].to_numpy()).T
        step = max(1, SCORES // len(rows))
        for at in range(0, len(queries), step):
            some = queries.iloc[at : at + step]
            scores = np.stack(some["unit"].to_numpy()) @ units
            np.round(scores, DIGITS, out=scores)
            for i, (q, own) in enumerate(zip(some["query_id"].tolist(), scores, strict=True)):
                if others:
                    own[ids == q] = -np.inf
                near = _nearest(own, ids, k)
                near = near[own[near] > -np.inf]
                which.append(np.full(len(near), at + i))
                best.append(near)
                found.append(own[near])
    if not which:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    return pd.DataFrame({"query_id": queries["query_id"].iloc[np.concatenate(which)].reset_index(drop=True), "vec_id": ids[np.concatenate(best)], "score": np.concatenate(found)})


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= k)


def _probe(index: Index, asked: DataFrame, k: int, others: bool) -> DataFrame:
    """(query_id, vec_id, score): the best of each cell's part for ``asked`` (query_id, unit, cell)."""
    counts = asked.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))  # a row a cell
    asked = asked.join(F.broadcast(counts), "cell").withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int"))
    asked = asked.join(F.broadcast(_parts(index)), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1))).select("query_id", "unit", "cell", "part", "chunk")
    rows = index.rows.join(F.broadcast(counts), "cell").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("vec_id", "unit", "cell", "part", "chunk")
    keys = ["cell", "part", "chunk"]
    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, vec_id {rows.schema['vec_id'].dataType.simpleString()}, score double"
    return rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(lambda r, q: _score(r, q, k, others), kinds)


def search(index: Index, queries: DataFrame, k: int, probes: int | None = None, others: bool = False) -> DataFrame:
    """(query_id, vec_id, score, pos): the ``k`` rows most like each of ``queries`` (query_id, embedding), the best first.

    With ``probes`` only that many cells are looked into, and rows may be missed; without, the result is exact. Scores
    are told apart by 12 decimals, ties go to the lesser vec_id. With ``others`` a row is no answer to the query of its own
    id. Queries without direction are alike to nothing: their scores are 0. Null ids are ids like others.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    spark = queries.sparkSession
    size = index.centroids.shape[1]
    sent = spark.sparkContext.broadcast((index.centroids, index.radius))

    def cells_of(first: int | None):
        """The nearest cells of each query, or with a column ``reach`` all others within it."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centers, radius = sent.value
            for batch in (b.slice(at, ASKED) for b in batches for at in range(0, b.num_rows, ASKED)):
                units = _units(batch.column("embedding"), size)
                like = units @ centers.T
                order = np.argsort(-like, axis=1, kind="stable")
                take, cell = [], []
                for i in range(len(units)):
                    if first is not None:
                        own = [*order[i, :first].tolist(), NOWHERE]
                    else:
                        far = np.sqrt(np.maximum(0, 2 - 2 * like[i])) - radius
                        own = [c for c in order[i, FIRST:].tolist() if far[c] <= batch.column("reach")[i].as_py() + 1e-6]
                    take += [i] * len(own)
                    cell += own
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(take) + 1) * size, pa.int32()), pa.array(units[take].reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(take, pa.int64())), flat, pa.array(cell, pa.int32())], ["query_id", "unit", "cell"])

        return run

    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, unit array<double>, cell int"
    queries = queries.select("query_id", "embedding")
    asked = queries.mapInArrow(cells_of(FIRST if probes is None else probes), kinds)
    found = _probe(index, written(asked), k, others)
    if probes is not None or not len(index.centroids):
        return _best(found, k)
    found = written(_best(found, k).drop("pos"))
    # the distance at which the k-th row lies; without k rows none is too far
    reach = found.groupBy(F.col("query_id").alias("_q")).agg(F.when(F.count("*") >= k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.min("score")))).otherwise(F.lit(9.0)).alias("reach"))
    more = queries.join(reach, F.col("query_id").eqNullSafe(F.col("_q")), "left").select("query_id", "embedding", F.coalesce("reach", F.lit(9.0)).alias("reach"))
    more = written(more.mapInArrow(cells_of(None), kinds))
    return _best(found.unionByName(_probe(index, more, k, others)), k)


def exact(store: DataFrame, queries: DataFrame, k: int, others: bool = False, block: int = CHUNK) -> DataFrame:
    """The same result without an index: ``block`` queries at a time go to all rows, which stay where they are."""
    spark = store.sparkSession
    lengths = store.filter("embedding is not null").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    size = lengths["n"] if lengths else 0
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {store.schema['vec_id'].dataType.simpleString()}, score double"
    n_blocks = max(1, -(-queries.count() // block))
    asked = queries.select("query_id", "embedding").withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)))
    out = spark.createDataFrame([], kinds)
    for b in range(n_blocks):
        some = asked.filter(F.col("_b") == b).toArrow()  # about ``block`` vectors
        sent = spark.sparkContext.broadcast((some.column("query_id").to_pylist(), _units(some.column("embedding"), size) if len(some) else np.zeros((0, size))))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, units = sent.value
            for batch in batches:
                rows = pd.DataFrame({"vec_id": batch.column("vec_id").to_pandas(), "unit": list(_units(batch.column("embedding"), size))})
                best = _score(rows, pd.DataFrame({"query_id": ids, "unit": list(units)}), k, others)
                yield pa.RecordBatch.from_arrays([pa.array(best[c], t) for c, t in zip(("query_id", "vec_id", "score"), types, strict=True)], ["query_id", "vec_id", "score"])

        types = [pa.int64() if "bigint" in x else pa.int32() if x == "int" else pa.float64() if x == "double" else pa.string() for x in (queries.schema["query_id"].dataType.simpleString(), store.schema["vec_id"].dataType.simpleString(), "double")]
        out = out.unionAll(store.select("vec_id", "embedding").mapInArrow(run, kinds))
    return _best(out, k)


def probes_for(index: Index, queries: DataFrame, k: int, target: float = 0.95, sample: int = 200, others: bool = False) -> int:
    """How many cells to probe for a recall of ``target``: measured on ``sample`` of ``queries``, in order of a hash, by the places
    that the cells of their exact answers have in their order of cells, with half of what is left to 1 as a margin.

    Vectors with little structure need most cells; then an exact search costs hardly more.
    """
    some = written(queries.orderBy(F.xxhash64("query_id"), "query_id").limit(sample).select("query_id", "embedding"))
    answers = search(index, some, k, others=others).join(index.rows.select("vec_id", "cell"), "vec_id").filter(F.col("cell") >= 0).select("query_id", "cell").toPandas()  # ``sample`` times ``k`` rows
    asked = some.toArrow()
    units = _units(asked.column("embedding"), index.centroids.shape[1])
    order = np.argsort(-(units @ index.centroids.T), axis=1, kind="stable")
    row = {q: i for i, q in enumerate(asked.column("query_id").to_pylist())}
    places = sorted(int(np.flatnonzero(order[row[q]] == c)[0]) for q, c in answers.itertuples(index=False))
    wanted = (1 + target) / 2
    return places[min(len(places) - 1, int(np.ceil(wanted * len(places))) - 1)] + 1 if places else 1


def recall(found: DataFrame, truth: DataFrame) -> float:
    """The share of ``truth``'s pairs (query_id, vec_id) that ``found`` holds."""
    both = truth.select("query_id", "vec_id").join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count()
    return both / max(1, truth.count())
