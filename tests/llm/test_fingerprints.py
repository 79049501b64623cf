"""Likeness, containment and merged sketches against exact shingle sets."""

import random
import re

from pyspark.sql import functions as F

from lodeweave.llm import fingerprints

FOLDER = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_likeness_of_the_whole_table(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    order = sorted(texts, reverse=True)
    after = dict(zip(order, order[1:] + order[:1]))
    off = []
    for r in fingerprints.op1_fingerprints(spark, FOLDER).collect():
        text, other = texts[r["doc_id"]], texts[after[r["doc_id"]]]
        third = len(text) // 3
        edited = text[: len(text) - third] + other[:third]
        for got, with_ in ((r["near_edited"], edited), (r["near_next"], other)):
            assert 0 <= got <= 1
            off.append(abs(got - jaccard(shingles(text), shingles(with_))))
    assert sum(off) / len(off) < 0.03 and max(off) < 0.25, (sum(off) / len(off), max(off))


def test_sketches_merge(spark):
    draw = random.Random(3)
    words = [f"w{draw.randrange(90_000)}" for _ in range(30_000)]
    cases = [(words[:9000], words[6000:20_000], words[3000:4000]), (words[:20], words[10:30], words[5:15]), (words[:3], [], words[:3]), ([], [], words[:9]), (words[:10], words[100:25_000], words[2:3000])]
    df = spark.createDataFrame([(i, *(" ".join(x) for x in c)) for i, c in enumerate(cases)], "i long, a string, b string, c string")
    a, b, c = (fingerprints.sketch(F.col(x)) for x in "abc")
    both = fingerprints.merge(a, b)
    rows = df.select("i", both.alias("m"), fingerprints.containment(c, both).alias("inside"), fingerprints.likeness(both, fingerprints.merge(b, a)).alias("same"), fingerprints.bound(a).alias("ba"), fingerprints.bound(b).alias("bb"), a.alias("sa"), b.alias("sb")).collect()
    for r in rows:
        x, y, z = (shingles(" ".join(w)) for w in cases[r["i"]])
        to = min(r["ba"], r["bb"])
        assert r["m"]["hashes"] == sorted({h for s in (r["sa"], r["sb"]) for h in s["hashes"] if h <= to})
        exact = len(x | y)
        assert abs(r["m"]["n"] - exact) <= 0.2 * exact and r["same"] == 1.0
        assert abs(r["inside"] - (len(z & (x | y)) / len(z) if z else 1.0)) < 0.2
    assert rows[1]["m"]["n"] == len(shingles(" ".join(words[:20])) | shingles(" ".join(words[10:30])))


def test_very_long_text(spark):
    df = spark.createDataFrame([("x y z " * 200_000, "x y z " * 100_000)], "a string, b string")
    assert df.select(fingerprints.likeness(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b")))).first()[0] == 1.0
