"""Files of several encodings, and breakers row by row."""

import random

from pyspark.sql import functions as F

from lodeweave.operators import streaks
from lodeweave.sources import files


def test_files_are_decoded(spark, tmp_path):
    texts = {"a.py": ("x = 'é'\r\n", "utf-8"), "sub/b.c": ("中文 int", "gb2312"), "sub/c.c": ("镕基 x", "gbk"), "d.c": ("caf\xe9 \xff x", "latin-1"), "e.c": ("𠀀", "gb18030"), "f.txt": ("", "utf-8")}
    for name, (text, encoding) in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode(encoding))
    got = {r["path"].split(str(tmp_path))[1][1:]: (r["text"], r["encoding"]) for r in files.read(spark, str(tmp_path)).collect()}
    assert got == {k: (t.replace("\r", ""), e) for k, (t, e) in texts.items() if t}
    assert files.read(spark, str(tmp_path), "*.c").count() == 4 and files.read(spark, str(tmp_path), most_bytes=6).count() == 2
    rows = spark.createDataFrame([(1, None), (2, bytearray(b"a\r"))], "id long, content binary")
    assert [tuple(r) for r in files.decoded(rows).orderBy("id").collect()] == [(1, None, None), (2, "a", "utf-8")]
    assert files.decoded(rows.limit(0)).count() == 0


def test_breakers(spark):
    draw = random.Random(1)
    rows = [(draw.choice(["a", "b", None]), i, draw.choice([True, True, False, None])) for i in range(120)]
    got = {r["i"]: r["skipped"] for r in streaks.broken(spark.createDataFrame(rows, "k string, i long, bad boolean").repartition(5), "k", [F.col("i")], F.col("bad"), 4).collect()}
    run, open_, want = {}, set(), {}
    for k, i, bad in rows:
        want[i] = k in open_
        run[k] = run.get(k, 0) + 1 if bad else 0
        if run[k] >= 4:
            open_.add(k)
    assert got == want and any(want.values()) and not all(want.values())
