"""Traces against listing every path."""

import random

import pytest

from lodeweave.operators import callpaths


def listed(edges, target, max_depth, most):
    """(entry points, paths) by walking back along every edge."""
    callers = {}
    for s, d in edges:
        callers.setdefault(d, set()).add(s)
    depth, frontier = {target: 0}, [target]
    for n in range(1, max_depth + 1):
        frontier = sorted({s for d in frontier for s in callers.get(d, ())} - depth.keys())
        depth.update(dict.fromkeys(frontier, n))
    entries = {v: n for v, n in depth.items() if v != target and (not callers.get(v) or n == max_depth)}
    paths, stack = {}, [(target,)]
    while stack:
        path = stack.pop()
        if path[0] in entries:
            paths.setdefault(path[0], []).append(path)
        if len(path) <= max_depth:
            stack += [(s, *path) for s in callers.get(path[0], ()) if s not in path]
    first = {e: sorted(p, key=lambda x: (len(x), x))[:most] for e, p in paths.items()}
    return {(target, e, n, n == max_depth, len(first.get(e, ())), len(first.get(e, ())) >= most) for e, n in entries.items()}, {(target, e, k + 1, len(p) - 1, p) for e, own in first.items() for k, p in enumerate(own)}


def traced(spark, edges, targets, max_depth, most):
    rows = spark.createDataFrame([(s, d, (s * 7 + d) % 5 == 0) for s, d in edges], "src long, dst long, indirect boolean")
    points, paths = callpaths.trace(rows, spark.createDataFrame([(t,) for t in targets], "node long"), max_depth, most)
    found = paths.collect()
    for r in found:
        assert r["indirect"] == any((a * 7 + b) % 5 == 0 for a, b in zip(r["path"], r["path"][1:]))
    return {tuple(r[c] for c in ("target", "entry", "depth", "at_limit", "n_paths", "truncated")) for r in points.collect()}, {(r["target"], r["entry"], r["pos"], r["depth"], tuple(r["path"])) for r in found}


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs_with_cycles_and_a_hub(spark, seed):
    draw = random.Random(seed)
    edges = {(draw.randrange(26), draw.randrange(26)) for _ in range(45)} | {(3, v) for v in range(8)} | {(v, 3) for v in range(20, 26)} | {(30, 3), (31, 30), (32, 20), (33, 33), (33, 5)}
    targets = [5, 11, 40]
    want = [listed(edges, t, 6, 4) for t in targets]
    got = traced(spark, sorted(edges), targets, 6, 4)
    assert got == (set().union(*(w[0] for w in want)), set().union(*(w[1] for w in want))) and got[1]


def test_paths_left_behind_are_found_again(spark, monkeypatch):
    """Walks that only cycles make possible crowd out the simple paths at first."""
    # from 0 many walks of six steps run into a two-node cycle and cannot end simply; the simple path comes last in order
    edges = [(0, i) for i in range(1, 30)] + [(i, 50) for i in range(1, 30)] + [(50, 51), (51, 50), (51, 52), (52, 50), (50, 99), (0, 60), (60, 61), (61, 62), (62, 63), (63, 64), (64, 99)]
    want = listed(set(edges), 99, 7, 2000)
    rows = spark.createDataFrame(edges, "src long, dst long")
    reached = callpaths.distances(rows, spark.createDataFrame([(99,)], "node long"), 7)
    entries = callpaths.entry_points(rows, reached, 7)
    found = callpaths.first_paths(rows, reached, entries, 7, 40, room=2).collect()
    assert {(99, r["entry"], r["pos"], r["depth"], tuple(r["path"])) for r in found} == {x for x in want[1] if x[2] <= 40}


def test_depth_ten_and_empty(spark):
    chain = [(i + 1, i) for i in range(14)] + [(4, 9), (20, 7)]
    for depth in (3, 10):
        assert traced(spark, chain, [0], depth, 20) == listed(set(chain), 0, depth, 20)
    points, paths = callpaths.trace(spark.createDataFrame([], "src long, dst long"), spark.createDataFrame([(1,)], "node long"))
    assert points.isEmpty() and paths.isEmpty()


def test_frontiers_are_deleted(spark):
    from lodeweave.operators import rendering, traverse
    from lodeweave.sources import shared

    place = spark.conf.get("spark.checkpoint.dir")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(place)
    count = lambda: len(fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(fs_path))
    edges, start = spark.createDataFrame([(i + 1, i) for i in range(6)], "src long, dst long"), spark.createDataFrame([(0,)], "node long")
    before = count()
    found = traverse.levels(edges, start, 4)
    rows = rendering.tree(edges, spark.createDataFrame([(6,)], "node long"), 3)
    reached = callpaths.distances(edges, start, 5)
    assert count() == before + 3 and found.count() == 5 and rows.count() == 4 and reached.count() == 6
    with shared.scope(spark):
        traverse.levels(edges, start, 2)
    assert count() == before + 3
