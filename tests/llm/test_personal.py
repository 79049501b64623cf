"""Personal data: patterns against a plain reading, the field against all ways to tag, and held-out spellings."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from lodeweave.llm import personal

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain_luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(digits[::-1])) % 10 == 0


def plain(text):
    out = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = [True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(digits) <= 19 and plain_luhn(digits), 9 <= len(digits) <= 15][k]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_patterns(seed):
    draw = random.Random(seed)
    for _ in range(4000):
        text = "".join(draw.choice(draw.choice(["0123456789", "19.", "a@.-", "+1 ()-", "é@x.y", "45 - 39"])) for _ in range(draw.randrange(60)))
        assert personal.base_spans(text) == plain(text), text


def test_patterns_in_long_texts_take_linear_time():
    for text in ("7" * 2_000_000, "a" * 1_000_000 + "@" * 1000, "1." * 500_000, "+1" + "(" * 1_000_000, "4" * 5000 + ".1.1.1"):
        assert personal.base_spans(text) == ([] if text[0] != "1" else [(i, 1, i + 7) for i in range(0, 999_993, 8)])


def some_field(draw, n_tags):
    return draw.normal(size=(n_tags + 1, n_tags)) * 2


def ways(first, scores, pairs):
    """Every tagging of a stretch with its score."""
    for tags in itertools.product(range(scores.shape[1]), repeat=len(scores)):
        chain = (len(personal.TAGS), *tags)
        yield tags, sum(scores[i, t] for i, t in enumerate(tags)) + sum((pairs + personal._BARRED)[a, b] for a, b in zip(chain, chain[1:]))


def test_viterbi_and_likelihood_against_all_ways():
    draw = np.random.default_rng(3)
    first = np.array([0, 3, 4, 8, 8][:4])
    scores, pairs = draw.normal(size=(8, len(personal.TAGS))) * 2, some_field(draw, len(personal.TAGS))
    got = personal.viterbi(scores, first, pairs)
    tags, whole, own = [], 0.0, 0.0
    for a, b in zip(first[:-1], first[1:]):
        found = list(ways(None, scores[a:b], pairs))
        tags += max(found, key=lambda x: x[1])[0]
        whole += np.logaddexp.reduce([x[1] for x in found])
        own += max(x[1] for x in found)
    assert got.tolist() == tags
    value, d_scores, d_pairs = personal.likelihood(scores, first, pairs, np.array(tags))
    assert abs(value - (own - whole)) < 1e-6
    for x, slope, place in [(scores, d_scores, (2, 1)), (scores, d_scores, (7, 0)), (pairs, d_pairs, (0, 3)), (pairs, d_pairs, (9, 1)), (pairs, d_pairs, (1, 2))]:
        values = []
        for step in (1e-5, -1e-5):
            x[place] += step
            values.append(personal.likelihood(scores, first, pairs, np.array(tags))[0])
            x[place] -= step
        assert abs((values[0] - values[1]) / 2e-5 - slope[place]) < 1e-4


@pytest.fixture(scope="module")
def field(spark):
    return personal.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_held_out_spellings(spark, field):
    """Values of another table in spellings that no pattern knows are found; their neighbours are left alone."""
    rows = personal.labelled(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id > 2000"), 1500, 600)
    draw = np.random.default_rng(1)
    texts, want = [], []
    for text, spans in rows:
        if len(spans) == 1:
            (a, kind, b) = spans[0]
            value = personal._rewritten(kind, text[a:b], draw)[0]
            whole = text[:a] + value + text[b:]
            if not plain(whole):
                texts.append(whole)
                want.append((personal.KINDS[kind], a, a + len(value)))
    assert len(texts) > 150
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: [(x["kind"], x["start"], x["end"]) for x in r["spans"]] for r in personal.find_personal(docs, field).collect()}
    # an opening bracket may go with a value or not
    near = lambda x, y: x[0] == y[0] and abs(x[1] - y[1]) <= 1 and x[2] == y[2]
    hits = sum(any(near(x, w) for x in found[i]) for i, w in enumerate(want))
    extra = sum(len(found[i]) - any(near(x, w) for x in found[i]) for i, w in enumerate(want))
    assert hits >= 0.9 * len(want) and extra <= 0.03 * len(want), (hits, extra, len(want))


def test_odd_rows(spark, field):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a.b@c.de é 10.0.0.1, +1 (743) 555-3824 4539578763621486"), (4, "a.b@c.de é 10.0.0.1, +1 (743) 555-3824 4539578763621486"), (None, "é" * 50 + " x@y.z"), (5, "99 " * 100_000 + "call (743) 555-3824 now"), (6, "w" * 300_000 + "@" + "v.w" * 1000)]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, spans string, kind int")
    got = {}
    for r in personal.find_personal(docs, field).collect():
        got.setdefault(r["doc_id"], []).append([(x["kind"], x["start"], x["end"]) for x in r["spans"] if x["base"]])
    assert got.pop(4) == [[(personal.KINDS[k], a, b) for a, k, b in plain(rows[3][1])]] * 2
    assert got == {1: [[]], 2: [[]], 3: [[]], None: [[("email", 51, 56)]], 5: [[]], 6: [[("email", 0, 300_001 + 3000)]]}
    assert personal.find_personal(docs.limit(0), field).count() == 0
    nothing = personal.fit(docs.filter("doc_id < 4"))
    assert all(x["base"] for r in personal.find_personal(docs, nothing).collect() for x in r["spans"])
    assert personal.fit(docs.limit(0)).names == {}


def test_query_over_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = personal.op11_personal(spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        base = [f"{personal.KINDS[k]}:{a}:{b}" for a, k, b in plain(texts[r["doc_id"]] or "")]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        spans = [x for x in r["spans"].split(",") if x]
        assert set(base) <= set(spans)
        assert [r[f"n_{k}"] for k in personal.KINDS] == [sum(x.startswith(k + ":") for x in spans) for k in personal.KINDS]
