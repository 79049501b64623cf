import hashlib

from lodeweave.functions import paths, text
from lodeweave.operators import graph, traverse
from pyspark.sql import functions as F


def test_file_names_and_summaries(spark):
    long = "é" * 150
    names = ["a/b\\c\nd\re", "x" * 200, long, "y" * 179 + "é" + "z" * 30]
    rows = spark.createDataFrame(list(enumerate(names)), "i int, qn string").orderBy("i").select(paths.file_name(F.col("qn")).alias("n")).collect()
    digest = [hashlib.md5(x.encode()).hexdigest()[:8] for x in names]
    assert [r["n"] for r in rows] == ["a_b_c de", names[1], "é" * 90 + "_" + digest[2], "y" * 179 + "_" + digest[3]]
    doc = "# f\n\n> says\n## 实现 (3)\ncode\n### part\n## Callers (1)\n- g\n## 描述\nall\n"
    got = spark.createDataFrame([(doc,), ("",), (None,)], "d string").select(text.doc_summary(F.col("d")).alias("s")).collect()
    assert [r["s"] for r in got] == ["# f\n\n> says\n## Callers (1)\n- g", "", None]


def test_includes_prefer_implementations(spark):
    files = spark.createDataFrame([("s/a/x.h",), ("s/b/x.c",), ("s/a.d/y.hpp",), ("s#1/a/x.c",), ("s/Makefile",)], "path string")
    asked = spark.createDataFrame([(1, "inc/x.h"), (2, "y.h"), (3, "z.h"), (4, None)], "i int, header string")
    found = {r["i"]: r["module"] for r in graph.resolve_includes(asked, files).collect()}
    assert found == {1: "s#1.a.x", 2: "s.a.d.y", 3: None, 4: None}


def test_paths_of_an_entry_are_cut_and_flagged(spark):
    # 9 reaches 0 by 25 ways of two steps, one of them indirect, and by itself
    edges = [(9, 100 + i, i == 0) for i in range(25)] + [(100 + i, 0, False) for i in range(25)] + [(9, 0, False), (0, 9, False)]
    edges = spark.createDataFrame(edges, "src long, dst long, indirect boolean")
    rows = {r["entry"]: r for r in traverse.by_entry(traverse.paths(edges, spark.createDataFrame([(0,)], "node long"), 3), 20).collect()}
    assert rows[9]["n_paths"] == 20 and rows[9]["truncated"] and rows[9]["indirect"] and rows[9]["depth"] == 1
    assert rows[9]["paths"].split("\n")[:3] == ["9>0", "9>100>0", "9>101>0"]
    assert rows[105]["n_paths"] == 1 and not rows[105]["truncated"] and not rows[105]["indirect"]
    assert 0 not in rows
