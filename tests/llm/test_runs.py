"""Periodic runs against a search of every period."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from lodeweave.llm import runs


def brute(seq, least, exponent):
    found = {}
    for p in range(1, len(seq) // exponent + 1):
        i = 0
        while i + p < len(seq):
            if seq[i] != seq[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(seq) and seq[j] == seq[j + p]:
                j += 1
            if j + p - i >= max(least, exponent * p):
                found.setdefault((i, j + p), p)
            i = j
    return sorted((a, b - a, p) for (a, b), p in found.items())


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_random_sequences(seed):
    draw = random.Random(seed)
    for _ in range(800):
        k = draw.choice([1, 2, 2, 3, 4])
        seq = [draw.randrange(k) for _ in range(draw.randrange(60))]
        if draw.random() < 0.5:
            unit = [draw.randrange(k) for _ in range(draw.randrange(1, 6))] * draw.randrange(2, 6)
            seq = seq[:10] + unit + seq[10:20] + unit[1:] + seq[20:] + seq[5:25]
        for least, exponent in ((1, 2), (1, 3), (6, 3), (24, 3), (8, 4)):
            assert runs.runs(seq, least, exponent) == brute(seq, least, exponent)


def test_factors_occur_earlier_and_are_longest():
    draw = random.Random(9)
    for _ in range(300):
        seq = [draw.randrange(3) for _ in range(draw.randrange(1, 40))]
        at = 0
        for start, end, source in runs.factors(seq):
            assert start == at
            earlier = lambda n: any(seq[x : x + n] == seq[start : start + n] for x in range(start))  # noqa: B023, E731
            if source < 0:
                assert end == start + 1 and seq[start] not in seq[:start]
            else:
                assert source < start and seq[source : source + end - start] == seq[start:end]
                assert end == len(seq) or not earlier(end - start + 1)
            at = end
        assert at == len(seq)


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def collapse(words, found):
    drop = {i for a, n, p in found for i in range(a + p, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def test_texts_with_runs(spark):
    draw = random.Random(4)
    rows = []
    for i in range(400):
        words = [draw.choice("ab,é Ä".replace(" ", "")) + str(draw.randrange(40)) for _ in range(draw.randrange(120))]
        for _ in range(draw.randrange(3)):
            at, p = draw.randrange(len(words) + 1), draw.randrange(1, 20)
            words[at:at] = ([draw.choice("xyzXYZ") for _ in range(p)] * 9)[: draw.randrange(20, 90)]
        rows.append((i, draw.choice([" ", "\n", " \t ", "\x0b"]).join(words) + draw.choice(["", " "])))
    rows += [(1000, None), (1001, ""), (1002, " \n "), (1003, "w " * 200_000), (1004, ("a b c d e " * 2000) + " " + " f" * 30), (None, "x y " * 12), (1, rows[1][1]), (1, rows[1][1])]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, runs int, collapsed string").repartition(3)
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.find_runs(docs).collect()), key=str)
    want = []
    for doc_id, text in rows:
        words = words_of(text)
        found = [(0, len(words), 1)] if doc_id == 1003 else brute(words, 24, 3)
        want.append((doc_id, len(words), found, collapse(words, found)))
    assert got == sorted(want, key=str)
    assert runs.find_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.find_runs(docs, exponent=2)


def expected(doc_id, text):
    words = words_of(text)
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words, 24, 3)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else None
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest("".join(f"{a},{n},{p}\n" for a, n, p in found)), digest(collapse(words, found))


def test_query_over_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in runs.op13_runs(spark, folder).collect())
    assert got == sorted(expected(*r) for r in rows) and sum(r[1] for r in got) > 20
