"""Interval cells, numbered names, trees in order and running totals, each against a plain computation."""

import random

import pytest
from pyspark.sql import functions as F

from lodeweave.operators import intervals, prefix, rendering, trie


def test_spans_around_points(spark):
    draw = random.Random(3)
    spans = [(i, "ab"[i % 2], a := draw.randrange(-50, 400), a + draw.choice([0, 0, 1, 7, 60, 255, 256, 257])) for i in range(150)] + [(900, "a", -10_000, 10_000), (901, "b", 5, 4), (902, None, 0, 9), (903, "a", None, 9), (904, "a", 0, 0), (904, "a", 0, 0)]
    points = [("ab"[draw.randrange(2)], draw.randrange(-80, 700)) for _ in range(120)] + [("a", 0), ("a", 0), ("b", None), (None, 3)]
    rows = spark.createDataFrame(spans, "id long, g string, start long, end long")
    asked = spark.createDataFrame(points, "g string, at long")
    holds = lambda p, s: p[0] is not None and p[0] == s[1] and p[1] is not None and s[2] is not None and s[2] <= p[1] <= s[3]
    got = sorted((r["g"], r["at"], r["id"]) for r in intervals.around(asked, rows, ("g",)).collect())
    assert got == sorted((*p, s[0]) for p in points for s in spans if holds(p, s))
    want = {}
    for p in set(points):
        own = sorted((s[3] - s[2], -s[2], s[0]) for s in spans if holds(p, s))
        if own:
            want[p] = (own[0][2], len(own))
    assert {(r["g"], r["at"]): (r["id"], r["n_spans"]) for r in intervals.innermost(asked, rows, ("g",)).collect()} == want
    assert intervals.around(asked, rows.limit(0), ("g",)).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_cells_cover_spans_once(spark, seed):
    draw = random.Random(seed)
    spans = [(a := draw.randrange(-70, 70), a + draw.randrange(0, 130)) for _ in range(200)] + [(3, 2)]
    rows = spark.createDataFrame(spans, "s long, e long").select("s", "e", intervals.cells(F.col("s"), F.col("e")).alias("c")).collect()
    for r in rows:
        held = [p for c in r["c"] or [] for p in range(c["place"] << c["level"], (c["place"] + 1) << c["level"])]
        assert sorted(held) == list(range(r["s"], r["e"] + 1)) and len(r["c"] or []) <= 2 * max(1, (r["e"] - r["s"] + 1).bit_length())


def test_ancestors_of_nested_spans(spark):
    draw = random.Random(5)
    spans, stack = [], [(0, 1023)]
    while stack and len(spans) < 120:
        a, b = stack.pop(draw.randrange(len(stack)))
        spans.append((len(spans), a, b))
        if b > a:
            mid = draw.randint(a, b)
            stack += [(a, mid), (mid + 1, b)] if mid < b else [(a, b)]
    spans.append((500, 1000, 1100))  # overlaps only
    rows = spark.createDataFrame(spans, "id long, start long, end long")
    want = set()
    for i, a, b in spans:
        up = [(d - c, -c, j) for j, c, d in spans if j != i and c <= a and b <= d and ((c, d) != (a, b) or j > i)]
        want |= {(i, x[2], n + 1) for n, x in enumerate(sorted(up))}
    assert {(r["id"], r["ancestor"], r["up"]) for r in intervals.ancestors(rows).collect()} == want


def plain_trie(names):
    nodes = {tuple(n.split(".")[:k]) for n in names for k in range(1, n.count(".") + 2)}
    out = {}
    for top in {n[0] for n in nodes}:
        own = sorted(n for n in nodes if n[0] == top)
        for i, n in enumerate(own):
            out[".".join(n)] = (top, i + 1, i + sum(m[: len(n)] == n for m in own), len(n), ".".join(n) in names)
    return out


def numbered(df):
    return {r["name"]: (r["top"], r["pre"], r["last"], r["depth"], r["is_name"]) for r in df.collect()}


def test_numbered_names(spark):
    draw = random.Random(1)
    name = lambda: ".".join(draw.choice(["a", "b", "ab", "a-", "Ä", ""]) for _ in range(draw.randint(1, 5)))
    names = {name() for _ in range(150)}
    nodes = trie.number(spark.createDataFrame([(n,) for n in names] + [(None,), (min(names),)], "name string")).cache()
    assert numbered(nodes) == plain_trie(names)
    for root in sorted(names)[::15]:
        assert {r["name"] for r in trie.subtree(nodes, root).collect()} == {n for n in names if n == root or n.startswith(root + ".")}
    gone = set(draw.sample(sorted(names), 60))
    left = trie.removed(nodes, spark.createDataFrame([(n,) for n in gone], "name string")).cache()
    kept = plain_trie(names - gone)
    assert {k: (v[0], v[3], v[4]) for k, v in numbered(left).items()} == {k: (v[0], v[3], v[4]) for k, v in kept.items()}
    before = numbered(nodes)
    assert all(v[1:3] == before[k][1:3] for k, v in numbered(left).items())
    root = max(kept, key=lambda k: kept[k][2] - kept[k][1])
    assert {r["name"] for r in trie.subtree(left, root).collect()} == {n for n in names - gone if n == root or n.startswith(root + ".")}
    new = {name() for _ in range(20)} | {"a.new.one"}
    more = numbered(trie.added(left, spark.createDataFrame([(n,) for n in new], "name string")))
    after, tops = plain_trie(names - gone | new), {n.split(".")[0] for n in new}
    assert {k: v for k, v in more.items() if v[0] in tops} == {k: v for k, v in after.items() if v[0] in tops} and more.keys() == after.keys()
    assert trie.number(nodes.limit(0).select("name")).count() == 0


def plain_tree(edges, roots, max_depth):
    children = {}
    for s, d in edges:
        children.setdefault(s, set()).add(d)
    rows, seen, level = [], set(roots), [((r,), ()) for r in sorted(set(roots))]
    rows += [(k, lasts, True) for k, lasts in level]
    for _ in range(max_depth):
        nxt = sorted(((*k, c), (*lasts, c == max(children[k[-1]]))) for k, lasts in level for c in children.get(k[-1], ()))
        level, new = [], set()
        for k, lasts in nxt:
            expands = k[-1] not in seen and k[-1] not in new
            new.add(k[-1])
            rows.append((k, lasts, expands))
            if expands:
                level.append((k, lasts))
        seen |= new
    return ["".join("   " if x else "│  " for x in lasts[:-1]) + ("" if not lasts else "└─ " if lasts[-1] else "├─ ") + f"f{k[-1]}" + ("" if e else " *") for k, lasts, e in sorted(rows)]


def test_trees_in_order(spark, tmp_path):
    draw = random.Random(2)
    edges = [(draw.randrange(25), draw.randrange(25)) for _ in range(70)] + [(0, i) for i in range(12)] + [(4, 4), (None, 3), (2, None)]
    names = spark.createDataFrame([(i, f"f{i}") for i in range(25)], "node long, name string")
    for roots, depth in (([0], 4), ([1, 2, 30], 2), ([5], 0)):
        rows = rendering.tree(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(r,) for r in roots], "node long"), depth)
        text = rendering.lines(rows, names)
        got = [r["line"] for r in text.orderBy("key").collect()]
        want = plain_tree([e for e in edges if None not in e], roots, depth)
        assert got == [x.replace("f30", "30") for x in want]
    rendering.write_text(text, str(tmp_path / "tree"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "tree")).collect()] == got


def test_running_totals_budgets_and_batches(spark):
    draw = random.Random(4)
    rows = [(draw.choice(["hot", "hot", "hot", "b", None]), i, draw.choice([None, 0, 1, 5, 30]), "é" * draw.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i long, v long, t string").repartition(7)
    for by in ((), ("g",)):
        key = lambda r: r[0] if by else ""  # noqa: B023, E731
        total, want = {}, {}
        for r in rows:
            total[key(r)] = total.get(key(r), 0) + (r[2] or 0)
            want[r[1]] = total[key(r)]
        assert {r["i"]: r["running"] for r in prefix.running(df, [F.col("i")], "v", by=by).collect()} == want
        place, seen = {}, {}
        for r in rows:
            seen[key(r)] = seen.get(key(r), -1) + 1
            place[r[1]] = (seen[key(r)] // 7, seen[key(r)] % 7)
        assert {r["i"]: (r["batch"], r["place"]) for r in prefix.batches(df, [F.col("i")], 7, by).collect()} == place
        for budget, joint in ((0, 0), (1, 0), (50, 0), (51, 2), (10_000, 1)):
            used, kept = {}, {}
            for r in rows:
                at = used.get(key(r), 0)
                room = budget - at
                if room > 0 or (room == 0 and not r[3] and not joint):
                    kept[r[1]] = (r[3][:room], len(r[3]) > room)
                used[key(r)] = at + len(r[3]) + joint
            got = {r["i"]: (r["t"], r["cut"]) for r in prefix.within_budget(df, [F.col("i")], "t", budget, by, joint).collect()}
            assert got == kept, (by, budget, joint)
    assert prefix.running(df.limit(0), [F.col("i")], "v").count() == 0
