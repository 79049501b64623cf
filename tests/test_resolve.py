"""Resolution against a literal cascade over a registry in order."""

import random

import pytest
from pyspark.sql import functions as F

from lodeweave.operators import graph, resolve
from measured import most_rows


def cascade(name, module, cls, registry, imports, fields):
    """One site, step by step."""
    if not name:
        return None, None
    if cls and name[:5] in ("self.", "this."):
        qn = f"{cls}.{name[5:]}"
        return (qn, 1) if qn in registry else (None, None)
    own = imports.get(module or "", {})
    if "." in name:
        head, rest = name.split(".", 1)
        if head in own and f"{own[head]}.{rest}" in registry:
            return f"{own[head]}.{rest}", 2
        if name in registry:
            return name, 2
    if own.get(name) in registry:
        return own[name], 3
    for key, target in own.items():
        if key.startswith(resolve.INCLUDED) and f"{target}.{name}" in registry:
            return f"{target}.{name}", 3
    if f"{module or ''}.{name}" in registry:
        return f"{module or ''}.{name}", 4
    if "." in name and name.rsplit(".", 1)[1] in fields:
        return fields[name.rsplit(".", 1)[1]], 5
    ends = [qn for qn in registry if qn.endswith("." + name)]
    top = (module or "").split(".")[0]
    for qn in ends:
        if top and qn.startswith(top + "."):
            return qn, 6
    return (ends[0], 6) if ends else (None, None)


def frames(spark, registry, imports, fields, sites):
    return (
        spark.createDataFrame([(i, *s) for i, s in enumerate(sites)], "call_id long, module string, class string, name string"),
        spark.createDataFrame(list(zip(registry, range(len(registry)))), "qn string, seq long"),
        spark.createDataFrame([(m, k, t, i) for m, own in imports.items() for i, (k, t) in enumerate(own.items())], "module string, key string, target string, seq long"),
        spark.createDataFrame(list(fields.items()), "field string, qn string"),
    )


def test_four_sites(spark):
    registry = ["a.m.f", "b.n.f", "a.k.C.run"]
    sites = [("a.m", None, "b.n.f"), ("a.k", "a.k.C", "self.f"), ("a.m", None, "obj.f"), ("a.k", None, "C.run"), ("b.n", None, "f"), ("z", None, "f"), ("z", None, None), (None, None, "m.f")]
    got = {r["call_id"]: (r["qn"], r["step"]) for r in resolve.resolve(*frames(spark, registry, {}, {}, sites)).collect()}
    assert got == dict(enumerate([("b.n.f", 2), (None, None), (None, None), ("a.k.C.run", 4), ("b.n.f", 4), ("a.m.f", 6), (None, None), ("a.m.f", 6)]))


@pytest.mark.parametrize("seed", range(4))
def test_random_registries(spark, seed):
    draw = random.Random(seed)
    part = lambda: draw.choice("abcde")
    dotted = lambda low, high: ".".join(part() for _ in range(draw.randint(low, high)))
    registry = list(dict.fromkeys(dotted(1, 5) for _ in range(120)))
    draw.shuffle(registry)
    modules = [dotted(1, 3) for _ in range(12)] + ["", None]
    imports = {m: {draw.choice([part(), dotted(1, 2), resolve.INCLUDED + part() + str(i)]): draw.choice([dotted(1, 3), draw.choice(registry)]) for i in range(5)} for m in modules if m is not None}
    fields = {part(): draw.choice([draw.choice(registry), "gone.away"]) for _ in range(2)}
    sites = [(draw.choice(modules), draw.choice([None, "", dotted(1, 3)]), draw.choice(["", draw.choice(["self.", "this."])]) + dotted(1, 4)) for _ in range(600)] + [("a", None, ""), ("a.b", None, "a.")]
    got = {r["call_id"]: (r["qn"], r["step"]) for r in resolve.resolve(*frames(spark, registry, imports, fields, sites)).collect()}
    order = dict.fromkeys(registry)
    want = {i: cascade(n, m, c, order, imports, fields) for i, (m, c, n) in enumerate(sites)}
    assert got == want
    assert {w[1] for w in want.values()} == {None, 1, 2, 3, 4, 5, 6}


def test_index_is_refreshed_like_rebuilt(spark):
    draw = random.Random(8)
    names = list(dict.fromkeys(".".join(draw.choice("abcd") for _ in range(draw.randint(1, 5))) for _ in range(300)))
    rows = spark.createDataFrame(list(zip(names, range(len(names)))), "qn string, seq long")
    old, gone, new = rows.filter("seq < 150"), rows.filter("seq < 150 and seq % 3 = 0"), rows.filter("seq >= 150")
    left = old.join(gone, "qn", "left_anti")
    got = resolve.refreshed_index(resolve.suffix_index(old), left, gone, new)
    flat = lambda df: sorted((r["suffix"], r["top"], tuple(r["first"])) for r in df.collect())
    assert flat(got) == flat(resolve.suffix_index(left.unionByName(new)))
    assert resolve.suffix_index(old.limit(0)).count() == 0 and resolve.suffix_index(spark.createDataFrame([("plain", 1)], "qn string, seq long")).isEmpty()
    assert [r[0] for r in spark.createDataFrame([("a.b..c",)], "q string").select(F.explode(resolve.suffixes(F.col("q")))).collect()][:3] == ["b..c", ".c", "c"]


def test_included_modules_that_repeat_count_once(spark):
    # one module includes two others 500 times each and calls 200 names of theirs, from 50 classes
    registry = [f"{m}.n{i}" for m in ("b.x", "b.y") for i in range(200)]
    sites = [("a.m", f"a.m.C{c}", f"n{i}") for c in range(50) for i in range(200)]
    calls, definitions, _, fields = frames(spark, registry, {}, {"none": "none"}, sites)
    rows = [("a.m", f"{resolve.INCLUDED}{i}", ("b.y", "b.x")[i % 2], i) for i in range(1000)]
    imports = spark.createDataFrame(rows, "module string, key string, target string, seq long")
    got, most = most_rows(resolve.resolve(calls, definitions, imports, fields))
    assert {r["call_id"]: (r["qn"], r["step"]) for r in got} == {i: (f"b.y.{n}", 3) for i, (_, _, n) in enumerate(sites)}
    assert most <= 2 * len(sites)


def test_priority_with_names_that_many_share(spark):
    # 300 sites and 300 definitions of one name in one module, which is imported 300 times
    definitions = [("m", "f", f"m.f{i:03}") for i in range(300)] + [("k", "g", "k.g"), ("k", "h", "k.h2"), ("k", "h", "k.h1"), (None, "z", "z"), ("m", None, "m.null")]
    sites = [("m", "f")] * 300 + [("o", "f")] * 300 + [("m", "g"), ("m", "h"), (None, "g"), (None, "h"), ("m", None), ("k", "h"), ("m", "z")]
    calls = spark.createDataFrame([(i, *s) for i, s in enumerate(sites)], "call_id long, module string, name string")
    known = spark.createDataFrame(definitions, "module string, name string, qn string")
    imports = spark.createDataFrame([("o", "m")] * 300, "module string, target string")
    got, most = most_rows(graph.resolve(calls, known, imports))
    last = [("k.g", 3), (None, None), ("k.g", 3), (None, None), (None, None), ("k.h1", 1), ("z", 3)]
    assert {r["call_id"]: (r["qn"], r["priority"]) for r in got} == dict(enumerate([("m.f000", 1)] * 300 + [("m.f000", 2)] * 300 + last))
    assert most <= len(sites)
