"""The class model against its definition."""

import zlib

import numpy as np
import pytest

from lodeweave.llm import lm, vectext

FOLDER = "/root/testdata/sf0.001"


def tokens_of(text):
    import pyarrow as pa

    data, offs = vectext.raw(pa.array([text], pa.string()))
    hashed, pool, _ = lm._tokens(data, offs)
    return hashed, pool


def test_scores_from_counts_by_hand(spark, monkeypatch):
    monkeypatch.setattr(lm, "WORDS", 300)  # so that many words are assigned in passes
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    learn = docs.filter(~lm.held_out(docs.doc_id))
    model, _ = lm.train(learn)
    texts = {r["doc_id"]: tokens_of(r["text"]) for r in docs.collect()}
    training = [texts[i] for i in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    counts, pool_of, grid = {}, {}, np.zeros((lm.CLASSES, lm.CLASSES))
    klass = dict(zip(model.words.tolist(), model.klass.tolist(), strict=True))
    for hashed, pool in training:
        for w, p in zip(hashed.tolist(), pool.tolist(), strict=True):
            counts[w] = counts.get(w, 0) + 1
            pool_of[w] = p

    def class_of(w, p):
        return lm.CLASSES - 1 if w == int(lm.END) else klass.get(w, int(model.pools[p]))

    for hashed, pool in training:
        before = lm.CLASSES - 1
        for w, p in zip(hashed.tolist(), pool.tolist(), strict=True):
            grid[before, class_of(w, p)] += 1
            before = class_of(w, p)
    end = int(lm.END)
    assert set(klass) == {w for w, n in counts.items() if n >= lm.MIN} | {end}
    pool_n, pool_kinds = np.zeros(lm.POOLS), np.zeros(lm.POOLS)
    for w, n in counts.items():
        if w not in klass:
            pool_n[pool_of[w]] += n
            pool_kinds[pool_of[w]] += 1
    total = np.zeros(lm.CLASSES)
    for w, k in klass.items():
        total[k] += counts[w] + 0.5
    for p in range(lm.POOLS):
        total[model.pools[p]] += pool_n[p] + 0.5
    share = (grid.sum(0) + 1) / (grid.sum() + lm.CLASSES)
    move = (grid + lm.CLASSES * share) / (grid.sum(1)[:, None] + lm.CLASSES)
    assert np.allclose(move.sum(1), 1)  # from every class all classes together are certain
    got = {r["doc_id"]: r for r in lm.score_documents(docs).collect()}
    for i, (hashed, pool) in texts.items():
        before, want = lm.CLASSES - 1, 0.0
        for w, p in zip(hashed.tolist(), pool.tolist(), strict=True):
            k = class_of(w, p)
            want += np.log10(move[before, k])
            if w in klass:
                want += np.log10((counts[w] + 0.5) / total[k])
            else:
                want += np.log10((pool_n[p] + 0.5) / total[k] * (counts.get(w, 0) + 1) / (pool_n[p] + pool_kinds[p] + 1))
            before = k
        assert got[i]["score"] == pytest.approx(want, rel=1e-9)
    import pyspark.sql.functions as F

    rows = lm.score_documents(docs)
    held = {r["held_out"]: r for r in lm.perplexity(rows, "held_out").collect()}[True]
    mine = [got[i] for i in got if got[i]["held_out"]]
    assert held["perplexity"] == pytest.approx(10 ** (-sum(r["score"] for r in mine) / sum(r["n_tokens"] for r in mine)))
    assert held["perplexity"] < held["base_perplexity"]
    assert rows.filter(F.col("score") > 0).count() == 0


def test_one_training_text(spark):
    learn = next(i for i in range(40) if zlib.crc32(str(i).encode()) % 7 != 2)
    rows = lm.score_documents(spark.createDataFrame([(learn, "a b a")], "doc_id long, text string")).collect()
    assert (rows[0]["n_tokens"], rows[0]["n_known"], rows[0]["train_tokens"]) == (4, 4, 4)
    assert rows[0]["base_score"] == pytest.approx(2 * np.log10(3 / 8) + 2 * np.log10(2 / 8))


def test_exchange_takes_the_best_move(monkeypatch):
    """Moves one by one give the class bigrams that counting anew gives, and never less likely ones."""
    monkeypatch.setattr(lm, "CLASSES", 6)
    random = np.random.default_rng(2)
    n = 25
    pairs = random.poisson(1.5, (n, n)) * (random.random((n, n)) < 0.4)
    klass = np.append(random.integers(0, 5, n - 1), 5)

    def around(klass):
        one = np.eye(6)[klass]
        return (pairs @ one).astype(float), (pairs.T @ one).astype(float)

    def value(klass):
        one = np.eye(6)[klass]
        return lm.likelihood(one.T @ pairs @ one)

    for i in range(n - 1):
        after, before = around(klass)
        tried = []
        for k in range(5):
            other = klass.copy()
            other[i] = k
            tried.append(value(other))
        now = klass.copy()
        lm.exchange(now, after, before, np.diag(pairs).astype(float), np.array([i]))
        assert value(now) == pytest.approx(max(tried)) and (np.delete(now, i) == np.delete(klass, i)).all()
        klass = now


def test_rounds_read_few_rows(spark, monkeypatch):
    """The bigrams that every round reads lie packed in rows, and all of them are there; small limits change no score."""
    from lodeweave.llm import lm, scratch

    texts = [(i, " ".join(f"w{(i * j * 7 + j) % 97}" for j in range(60))) for i in range(200)]
    docs, tables, save = spark.createDataFrame(texts, "doc_id long, text string"), [], scratch.save

    def seen(df, path):
        tables.append(save(df, path))
        return tables[-1]

    monkeypatch.setattr(scratch, "save", seen)

    def scores():
        return sorted((r["doc_id"], r["n_tokens"], round(r["score"], 6)) for r in lm.score_documents(docs).collect())

    whole = scores()
    (pairs,) = [t for t in tables if t.columns == ["a", "b", "n"]]
    rows = pairs.collect()
    total = sum(int.from_bytes(r["n"][i : i + 8], "little") for r in rows for i in range(0, len(r["n"]), 8))
    assert len(rows) <= 4 and total == 61 * docs.filter(~lm.held_out(docs["doc_id"])).count()
    monkeypatch.setattr(lm, "PAIRS", 50)
    monkeypatch.setattr(lm, "AT_ONCE", 70)
    monkeypatch.setattr(lm, "KEYS", 300)
    monkeypatch.setattr(lm, "ROWS", 7)
    monkeypatch.setattr(lm, "WORDS", 40)
    less = scores()
    monkeypatch.undo()
    monkeypatch.setattr(lm, "WORDS", 40)
    assert less == scores() and [x[:2] for x in less] == [x[:2] for x in whole]


def test_texts_are_read_twice(spark, monkeypatch):
    """Words are counted and codes written from the texts; bigrams, passes and scores come from the codes, which tell all of the texts."""
    monkeypatch.setattr(lm, "WORDS", 300)  # so that many words are assigned in passes
    docs, read = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text"), spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    counted = docs.mapInArrow(seen, docs.schema)
    whole = sorted(tuple(r) for r in lm.score_documents(counted).collect())
    assert read.value == 2 * len(whole)
    known, _ = lm.vocabulary(docs)
    coded = {r["doc_id"]: r for r in lm.encode(docs, known.words).collect()}
    place = {w: i for i, w in enumerate(known.words.tolist())} | {int(lm.END): len(known.words) + lm.POOLS}
    for i, text in docs.collect():
        hashed, pool = tokens_of(text)
        assert np.frombuffer(coded[i]["codes"], "<i4").tolist() == [place.get(w, len(known.words) + p) for w, p in zip(hashed.tolist(), pool.tolist(), strict=True)]
        assert [w % 2**64 for w in coded[i]["rare"]] == [w for w in hashed.tolist() if w not in place]
    # words lie in stretches; small ones, added up often, change no score
    monkeypatch.setattr(lm, "BUCKET", 64)
    monkeypatch.setattr(lm, "KEYS", 5000)
    monkeypatch.setattr(lm, "AT_ONCE", 100)
    assert sorted(tuple(r) for r in lm.score_documents(docs).collect()) == whole


def test_places_of_hashes(monkeypatch):
    """Places are those of a search, for hashes that are as good as random and for such as are not."""
    random = np.random.default_rng(4)
    for keys in (random.integers(0, 2**64, 5000, dtype=np.uint64), np.arange(3000, dtype=np.uint64), np.full(1, 2**64 - 1, np.uint64), np.zeros(0, np.uint64)):
        keys = np.unique(keys)
        asked = np.concatenate([keys, keys + np.uint64(1), random.integers(0, 2**64, 2000, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        for steps in (16, 1):
            monkeypatch.setattr(vectext, "STEPS", steps)
            at, there = vectext.Places(keys).find(asked)
            assert (there == np.isin(asked, keys)).all() and (keys[at[there]] == asked[there]).all()
