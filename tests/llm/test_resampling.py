"""Resampling against a plain reading of its rules."""

import hashlib
import math
import random
import re
import sys
import os
import zlib
from collections import Counter

import pyarrow as pa

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from compare import spark_rows, sql_rows  # noqa: E402
from lodeweave.llm import resampling, vectext  # noqa: E402

LOWER = {c: c + 32 for c in range(65, 91)}


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words, [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def expected(rows, target, share=5):
    """(doc_id, n_words, n_features, weight, score, rank) by the rules."""
    s, t = (Counter(bucket(f) for text in texts for f in features(text)[1]) for texts in ([r[1] for r in rows], target))
    total_s, total_t = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * total_s / ((s[b] + 1) * total_t))) for b in range(10000)}
    out = []
    for doc_id, text in rows:
        words, found = features(text)
        weight = sum(gain[bucket(f)] for f in found)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for k, r in enumerate(able[: share * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=str)


def test_buckets_of_words_of_all_lengths():
    draw = random.Random(1)
    texts = [" ".join("".join(draw.choice("abcXYZ09é-,") for _ in range(draw.choice([1, 3, 7, 8, 9, 16, 40, 63, 64, 65, 300]))) for _ in range(draw.randrange(9))) for _ in range(200)] + ["", "x" * 70_000 + " y"]
    found, has, first = resampling.buckets(*vectext.raw(pa.array(texts)))
    for i, text in enumerate(texts):
        words, _ = features(text)
        assert first[i + 1] - first[i] == len(words)
        for k in range(3):
            got = [int(b) for b, x in zip(found[k][first[i] : first[i + 1]], has[k][first[i] : first[i + 1]], strict=True) if x]
            assert got == [bucket(" ".join(words[j : j + k + 1])) for j in range(len(words) - k)]


def test_draw_with_odd_rows(spark):
    draw = random.Random(2)
    words = ["the", "of", "Zürich", "x9", "1", "don't", "a_b", "東京", "\x00nul", "tab\tbed"]
    rows = [(i, " ".join(draw.choice(words) for _ in range(draw.randrange(60)))) for i in range(300)]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (500, None), (501, ""), (None, "the of " * 30), (None, None), (502, "the of x9 " * 40_000)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, score int, n int, `rank` int")
    target = ["the of the of Zürich", None, "", "x9 x9 1 don't"]
    bench = spark.createDataFrame([(i, t, 5) for i, t in enumerate(target)], "item_id long, text string, score int")
    for share in (5, 60):
        got = sorted((tuple(r) for r in resampling.resample(docs, bench, share).collect()), key=str)
        assert got == expected(rows, target, share)
    drawn = [r[5] for r in got if r[5]]
    assert sorted(drawn) == list(range(1, len(drawn) + 1)) and drawn
    nothing = resampling.resample(docs, bench.limit(0)).collect()
    assert len(nothing) == len(rows)
    assert resampling.resample(docs.limit(0), bench).count() == 0
    few = resampling.resample(docs.filter("doc_id in (3, 500, 501)"), bench).collect()
    assert len(few) == 3 and all(r["rank"] is None for r in few)


def test_ties_go_to_the_smaller_id(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(resampling, "noise", lambda doc_id, seed: F.lit(0).cast("long"))
    docs = spark.createDataFrame([(i * 7 % 101, "same words " * 15) for i in range(100)], "doc_id long, text string")
    got = {r["doc_id"]: r["rank"] for r in resampling.resample(docs, docs, 10).collect()}
    assert {k: v for k, v in got.items() if v} == {x: i + 1 for i, x in enumerate(sorted(got)[:10])}


def test_same_rows_as_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert spark_rows(resampling.op12_resample(spark, folder)) == sql_rows(folder, resampling.OP12_SQL)
