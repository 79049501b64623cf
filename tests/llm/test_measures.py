"""Estimates and recall against exact answers."""

import random

from pyspark.sql import functions as F

from lodeweave.llm import decontaminate, fingerprints


def test_op1_containment_of_unequal_documents(spark):
    draw = random.Random(11)
    words = [f"w{draw.randrange(50_000)}" for _ in range(20_000)]
    small, half = words[3000:5000], words[:1000] + [f"x{i}" for i in range(1000)]
    rows = spark.createDataFrame([(" ".join(small), " ".join(words)), (" ".join(half), " ".join(words)), (None, "a b"), ("a b", "a b")], "a string, b string")
    got = [r[0] for r in rows.select(fingerprints.containment(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b")))).collect()]
    assert got[0] > 0.99 and abs(got[1] - 996 / 1996) < 0.15 and got[2:] == [1.0, 1.0]


def edits_in(item, text):
    """Least word edits between the item and some run of the text."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            last, row[j] = row[j], min(last + (w != t), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_op8_recall_and_edits(spark):
    draw = random.Random(5)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [[draw.choice(vocabulary) for _ in range(draw.randint(12, 45))] for _ in range(120)]
    texts = []
    for item in items:
        edited = list(item)
        for _ in range(draw.randint(0, len(item) // 4)):
            at = draw.randrange(len(edited))
            edited[at : at + 1] = draw.choice([[], [draw.choice(vocabulary)], [edited[at], draw.choice(vocabulary)]])
        texts.append([draw.choice(vocabulary) for _ in range(30)] + edited + [draw.choice(vocabulary) for _ in range(30)])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(500, " ".join(items[0])), (501, ""), (502, None)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.find_leaks(docs, bench).collect()}
    want = {i: n for i in range(120) if (n := edits_in(items[i], texts[i])) <= len(items[i]) // 4}
    assert sum((i, i) in found for i in want) >= 0.95 * len(want)
    assert all(n == edits_in(items[i % 500], texts[d]) <= len(items[i % 500]) // 4 for (d, i), n in found.items())
    assert ((0, 500) in found) == ((0, 0) in found)  # copies of an item are found alike


def edited_at(draw, vocabulary, item, n):
    """``n`` edits at different places."""
    out = list(item)
    for at in sorted(draw.sample(range(len(item)), n), reverse=True):
        out[at : at + 1] = draw.choice([[], [draw.choice(vocabulary)], [item[at], draw.choice(vocabulary)]])
    return out


def row_edits(item, text):
    """``edits_in`` for long texts, a row at a time."""
    import numpy as np

    row, steps = np.zeros(len(text) + 1, np.int64), np.arange(len(text) + 1)
    text = np.array(text)
    for i, w in enumerate(item, 1):
        best = np.concatenate([[i], np.minimum(row[:-1] + (text != w), row[1:] + 1)])
        row = np.minimum.accumulate(best - steps) + steps
    return int(row.min())


def test_op8_recall_by_length(spark):
    """Items of every length with 20 to 25 % of their words edited are found, with the least edits."""
    draw = random.Random(17)
    vocabulary = [f"v{i}" for i in range(4000)]
    rows, items = [], []
    for n, many in ((12, 60), (31, 60), (32, 60), (60, 60), (200, 60), (800, 40), (3000, 20)):
        for _ in range(many):
            item = [draw.choice(vocabulary) for _ in range(n)]
            text = [draw.choice(vocabulary) for _ in range(40)] + edited_at(draw, vocabulary, item, draw.randint(n // 5, n // 4)) + [draw.choice(vocabulary) for _ in range(40)]
            items.append((len(items), n, item))
            rows.append((len(rows), text))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, _, t in items], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.find_leaks(docs, bench).collect()}
    assert all(d == i for d, i in found)
    for length in {n for _, n, _ in items}:
        own = [i for i, n, _ in items if n == length]
        assert sum((i, i) in found for i in own) >= 0.95 * len(own), length
    for i, n, item in items:
        if (i, i) in found and n >= 60:
            assert found[i, i] == row_edits(item, rows[i][1])


def test_op8_memory_does_not_grow_with_pairs():
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np

    size, pairs = 1500, 4096
    one = SimpleNamespace(size=np.full(1, size), most=np.full(1, size // 4), words=np.arange(1, size + 1, dtype=np.uint64), first=np.zeros(1, np.int64))
    calls = []
    edits = decontaminate.edit_distances

    def noted(index, item, *rest):
        calls.append(len(item))
        return edits(index, item, *rest) if len(calls) == 1 else (np.zeros(len(item), np.int64), np.zeros(len(item), np.int64))

    decontaminate.edit_distances = noted
    tracemalloc.start()
    try:
        zeros = np.zeros(pairs, np.int64)
        decontaminate._distances(one, zeros, one.words, zeros, zeros, np.full(pairs, size))
        assert tracemalloc.get_traced_memory()[1] < 100_000_000
    finally:
        decontaminate.edit_distances = edits
        tracemalloc.stop()
    assert sum(calls) == pairs and max(calls) * 2 * size < 2 * decontaminate.CELLS


def test_op8_long_documents_and_blocks(spark, monkeypatch):
    """A very long text, and items over several blocks."""
    draw = random.Random(23)
    vocabulary = [f"v{i}" for i in range(9000)]
    items = [[draw.choice(vocabulary) for _ in range(draw.choice([10, 40, 90]))] for _ in range(30)]
    long = []
    for item in items:
        long += [draw.choice(vocabulary) for _ in range(20_000)] + item
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 200)
    docs = spark.createDataFrame([(1, " ".join(long)), (2, "none of it"), (3, None)], "doc_id long, text string")
    found = decontaminate.find_leaks(docs, spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["edits"]) for r in found) == [(1, i, 0) for i in range(30)]
