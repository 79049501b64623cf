"""The inverted file against scoring all rows."""

import numpy as np
import pytest

from lodeweave.operators import ivf

FOLDER = "/root/testdata/sf0.1"


def plain(rows, queries, k, others):
    """(query, row, score to 9 decimals) by scoring everything."""
    out = set()
    for q, a in queries:
        scored = []
        for v, b in rows:
            good = a is not None and b is not None and len(a) == len(b) and np.linalg.norm(a) * np.linalg.norm(b) > 0
            if not (others and v == q):
                scored.append((-round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 12) if good else 0.0, v))
        out |= {(q, v, round(-s, 9) + 0.0) for s, v in sorted(scored)[:k]}
    return out


def same(df):
    return {(r["query_id"], r["vec_id"], round(r["score"], 9) + 0.0) for r in df.collect()}


@pytest.mark.parametrize("others", [False, True])
def test_exact_searches(spark, others, monkeypatch):
    draw = np.random.default_rng(2)
    centers = draw.normal(size=(6, 8)) * 3
    rows = [(i, (centers[i % 6] + draw.normal(size=8)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[i][1]) for i in range(40)] + [(2000, None), (2001, [0.0] * 8), (2002, [1.0, 2.0]), (2003, [])]
    queries = rows[:12] + [(2001, [0.0] * 8), (5000, [-x for x in rows[3][1]])]
    store = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    asked = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    floats = [(i, None if v is None else np.array(v, np.float32).astype(float)) for i, v in rows]
    want = plain(floats, [(q, np.array(v, np.float32).astype(float)) for q, v in queries], 9, others)
    monkeypatch.setattr(ivf, "PART", 30)
    monkeypatch.setattr(ivf, "CHUNK", 5)
    index = ivf.build(store, cells=10, sample=200)
    assert index.rows.count() == len(rows)  # every row is in it
    assert same(ivf.search(index, asked, 9, others=others)) == want
    assert same(ivf.exact(store, asked, 9, others=others, block=5)) == want
    assert ivf.search(index, asked, 0).count() == 0
    with pytest.raises(ValueError):
        ivf.search(index, asked, -1)
    empty = ivf.build(store.limit(0))
    assert ivf.search(empty, asked, 3).count() == 0 and ivf.exact(store.limit(0), asked, 3).count() == 0


def test_recall_and_plan(spark):
    store = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding")
    queries = store.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    truth = ivf.exact(store, queries, 10, others=True)
    index = ivf.build(store, cells=32)
    assert ivf.recall(ivf.search(index, queries, 10, others=True), truth) == 1.0
    probes = ivf.probes_for(index, queries, 10, 0.95, sample=60, others=True)
    near = ivf.search(index, queries, 10, probes=probes, others=True)
    assert probes < 32 and ivf.recall(near, truth) >= 0.95
    assert ivf.recall(ivf.search(index, queries, 10, probes=1, others=True), truth) < 0.95
    plan = near._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scores_are_bounded_whatever_a_task_gets():
    import tracemalloc

    import pandas as pd

    draw = np.random.default_rng(3)
    units = lambda n: list(draw.normal(size=(n, 4)).round(1))
    rows, queries = pd.DataFrame({"vec_id": draw.permutation(5000), "unit": units(5000)}), pd.DataFrame({"query_id": np.arange(2000), "unit": units(2000)})
    tracemalloc.start()
    got = ivf._score(rows, queries, 3, True)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    by_id = np.stack(rows.sort_values("vec_id")["unit"].to_numpy())
    scores = np.round(np.stack(queries["unit"].to_numpy()) @ by_id.T, ivf.DIGITS)
    scores[np.arange(2000), np.arange(2000)] = -np.inf
    want = np.argsort(-scores, axis=1, kind="stable")[:, :3]
    assert got["query_id"].tolist() == np.repeat(np.arange(2000), 3).tolist() and got["vec_id"].tolist() == want.reshape(-1).tolist()
    assert most < 40_000_000  # all scores would take 80,000,000 bytes
