"""Operators against brute force, round trips and held-out accuracy, on small fixtures."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from compare import spark_rows, sql_rows
from lodeweave.llm import chat, counting, decontaminate, fingerprints, idfiles, lm, mixing, neardup, registry, repeats, scratch, toxicity

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string, size int"


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls, empty and long texts, repeated rows, near copies and names that clash."""
    random.seed(5)
    vocabulary = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 6))) for _ in range(300)]
    base = [" ".join(random.choice(vocabulary) for _ in range(n)) for n in (3, 40, 120, 400, 5000)]
    rows = [(i, t, "en", f"s{i % 3}", len(t), "x", 1) for i, t in enumerate(base)]
    near = base[2].split()
    near[5] = "other"
    rows += [(10, " ".join(near), "en", "s1", 1, None, None), (11, base[3], None, None, None, None, None), (12, None, "de", "s0", None, "y", 2), (13, "", "de", None, 0, "y", 2), (14, " \n\t", "de", "s0", 3, "y", 2)]
    rows += [(15, "É <|endoftext|> it's 12 ok", "fr", "s2", 5, "", 0), (None, base[1] + " end", "fr", "s2", 5, "", 0), (16, base[1], "fr", "s2", 5, "", 0), (16, base[1], "fr", "s2", 5, "", 0)]
    return rows


def test_op1_equal_texts_and_empty_table(spark, odd_rows):
    docs = spark.createDataFrame(odd_rows, SCHEMA)
    rows = fingerprints.compare_edited(docs).collect()
    assert len(rows) == len(odd_rows)
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert by_id[3][0]["fingerprint"] == by_id[11][0]["fingerprint"]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    text = {r[0]: r[1] or "" for r in odd_rows}
    third = len(text[3]) // 3
    edited = text[3][: len(text[3]) - third] + text[2][:third]
    assert by_id[3][0]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert fingerprints.compare_edited(docs.limit(0)).count() == 0


def test_op2_brute_force(spark, odd_rows):
    docs = spark.createDataFrame([r for r in odd_rows], SCHEMA)
    sets = []
    for r in odd_rows:
        w = words_of(r[1])
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    label = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    least = {}
    for i, r in enumerate(odd_rows):
        if r[0] is not None:
            least[label[i]] = min(least.get(label[i], r[0]), r[0])
    want = sorted((str(r[0]), len(s), str(least.get(label[i]) if s else r[0])) for i, (r, s) in enumerate(zip(odd_rows, sets, strict=True)))
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in neardup.groups(docs, 4, 80).collect())
    assert got == want
    assert neardup.groups(docs.limit(0), 4, 80).count() == 0
    kept = neardup.deduplicate(docs, 4, 80)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["0", "1", "12", "13", "14", "15", "2", "3", "4"]


@pytest.mark.parametrize(("block", "load"), [(512, 4096), (40, 50)])
def test_op2_large_family(spark, monkeypatch, block, load):
    """More near copies than a block holds: chains are found across blocks, in few large ones and in many small ones."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "LOAD", load)
    random.seed(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(600):
        w = list(base)
        for p in random.sample(range(120), random.choice([0, 1, 2, 3, 5, 9])):
            w[p] = f"x{i}_{p}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(t.split()[k : k + 4]) for k in range(117)} for _, t in rows]
    up = list(range(600))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(600):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r["component_id"] for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()}
    assert got == {i: top(i) for i in range(600)} and len(set(got.values())) > 1


def test_op2_keeps_columns_of_any_name_and_type(spark):
    rows = [(2, "a b c d e f g", {"k": 1}, 5, "x"), (1, "a b c d e f g", {"k": 2}, 6, "y"), (1, "a b c d e f g", {"k": 0}, 6, "y"), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, n int, kept_id string")
    docs = docs.withColumn("_n", docs.n).withColumn("row", docs.n).withColumn("most", docs.n).withColumn("component_id", docs.n)
    out = neardup.deduplicate(docs)
    assert out.columns == docs.columns
    assert [(r["doc_id"], r["m"], r["n"], r["kept_id"]) for r in out.orderBy("doc_id").collect()] == [(1, {"k": 0}, 6, "y"), (3, None, None, None)]


@pytest.mark.parametrize("heavy", [1, 1500])
def test_op3_brute_force(spark, odd_rows, heavy, monkeypatch):
    monkeypatch.setattr(repeats, "HEAVY", heavy)
    line = "the same license line in many documents, which is longer than one hundred bytes so that it counts as a repeat. "
    rows = [(r[0], r[1]) for r in odd_rows if r[0] not in (None, 16)] + [(100 + i, f"doc {i} " * (i % 4) + line + f"tail {i * i}") for i in range(12)] + [(200, "ab" * 300)]
    rows.sort()
    seen, want = set(), {}
    for doc_id, text in rows:
        body = (text or "").encode()
        gone = [False] * len(body)
        for s in range(len(body) - 99):
            if body[s : s + 100] in seen:
                gone[s : s + 100] = [True] * 100
            seen.add(body[s : s + 100])
        kept = bytes(b for b, g in zip(body, gone, strict=True) if not g)
        want[doc_id] = (len(body), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), kept)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeats.remove_repeats(docs).collect()}
    assert got == want
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("heavy", [1, 1500])
def test_op3_repeated_and_null_ids(spark, odd_rows, heavy, monkeypatch):
    monkeypatch.setattr(repeats, "HEAVY", heavy)
    line = "the same license line in many documents, which is longer than one hundred bytes so that it counts as a repeat. "
    rows = [(r[0], r[1]) for r in odd_rows] + [(100 + i, f"doc {i} " * (i % 4) + line + f"tail {i * i}") for i in range(12)]
    rows += [(100, line + "tail 0")] * 2 + [(50, "one " + line + "two " + line), (50, "one " + line + "two " + line), (50, line + "three"), (50, "x" + line + "y" + line + "z"), (None, line), (None, line + line)]
    low = {}
    for doc_id, text in rows:
        body = (text or "").encode()
        for s in range(len(body) - 99):
            w, d = body[s : s + 100], repeats.LAST if doc_id is None else doc_id
            low[w] = min(low.get(w, d), d)
    want = []
    for doc_id, text in rows:
        body, seen = (text or "").encode(), set()
        gone = [False] * len(body)
        for s in range(len(body) - 99):
            w = body[s : s + 100]
            if w in seen or (repeats.LAST if doc_id is None else doc_id) > low[w]:
                gone[s : s + 100] = [True] * 100
            seen.add(w)
        want.append((str(doc_id), bytes(b for b, g in zip(body, gone, strict=True) if not g), len(body), sum(gone)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(str(r["doc_id"]), bytes(r["kept"]), r["n_bytes"], r["n_removed"]) for r in repeats.remove_repeats(docs).collect()]
    assert sorted(got) == sorted(want)


def test_op3_common_prefixes():
    random.seed(3)
    text = np.array([random.choice([1, 2, 3]) for _ in range(400)] + [0], np.int64)
    text[100:130] = text[300:330]
    order, shared = repeats.repeated(text, 12)
    suffixes = sorted(range(len(text)), key=lambda i: text[i:].tolist())
    assert order.tolist() == suffixes
    for row in range(1, len(order)):
        a, b = text[order[row - 1] :][:12].tolist(), text[order[row] :][:12].tolist()
        if len(a) == len(b) == 12 and 0 not in a + b:
            assert shared[row] == (a == b)


def test_op4_round_trip(spark, odd_rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    docs = spark.createDataFrame(odd_rows, SCHEMA)
    folder = scratch.folder(spark)
    idfiles.write_documents(docs, path, folder)
    want, start = [], 0
    for r in sorted(odd_rows, key=lambda r: (r[0] is None, r[0])):
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [2]
        want.append((r[0], start, ids))
        start += len(ids)
    assert sorted(((r["doc_id"], r["start"], list(r["ids"])) for r in idfiles.read_ids(spark, folder).collect()), key=lambda r: r[1]) == want
    for r in idfiles.summaries(spark, folder).collect():
        ids = next(w[2] for w in want if w[1] == r["start"])
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    empty = scratch.folder(spark)
    idfiles.write_documents(docs.limit(0), path, empty)
    assert idfiles.read_ids(spark, empty).count() == 0


def test_op4_code_is_limited_and_complete():
    counts = np.array([2**i for i in range(30)] + [0, 5], np.int64)
    lengths = idfiles.code_lengths(counts, 8)
    assert lengths.max() <= 8 and lengths[30] == 0
    assert sum(2.0 ** -int(x) for x in lengths if x) == 1
    ids = np.random.default_rng(1).choice(np.flatnonzero(lengths), 1000).astype(np.uint32)
    codes = idfiles.canonical(lengths)
    stream, offsets = idfiles.pack(ids, codes, lengths)
    assert (idfiles.unpack(stream, offsets, 1000, *idfiles.table(codes, lengths)) == ids).all()


def test_op5_takes_near_target(spark, odd_rows):
    docs = spark.createDataFrame(odd_rows, SCHEMA)
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r["mix"]["copies"] <= 2 for r in rows)
    assert sorted(map(str, (tuple(r)[:-1] for r in rows))) == sorted(map(str, odd_rows))  # a column size of its own stays as it is
    assert mixing.mix(docs.limit(0)).count() == 0
    sizes = {(r["doc_id"], r["mix"]["size"]) for r in rows}
    assert sizes == {(r[0], len(words_of(r[1]))) for r in odd_rows}  # null text: 0
    assert len({r["mix"]["copies"] for r in rows if r["doc_id"] == 16}) == 1  # repeated rows are taken alike
    assert len({r["mix"]["target"] for r in rows if r["source"] is None}) == 1


def test_op6_base_scores_and_gain(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r["doc_id"]: r for r in lm.score_documents(docs).collect()}
    texts = {r["doc_id"]: words_of(r["text"]) + ["\0"] for r in docs.collect()}
    counts = {}
    for i, w in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for x in w:
                counts[x] = counts.get(x, 0) + 1
    total = sum(counts.values())
    for i, w in texts.items():
        base = sum(np.log10((counts.get(x, 0) + 1) / (total + len(counts) + 1)) for x in w)
        assert rows[i]["base_score"] == pytest.approx(base) and rows[i]["train_tokens"] == total
        assert (rows[i]["n_tokens"], rows[i]["n_known"]) == (len(w), sum(x in counts for x in w))
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_op6_odd_rows(spark, odd_rows):
    docs = spark.createDataFrame(odd_rows, SCHEMA)
    assert lm.score_documents(docs).count() == len(odd_rows)
    assert lm.score_documents(docs.limit(0)).count() == 0


def test_op7_learns_planted_words(spark, odd_rows):
    random.seed(1)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(900):
        w = [random.choice(vocabulary) for _ in range(random.randint(5, 80))]
        y = i % 5 == 0
        if y:
            w[random.randrange(len(w))] = "vile" + random.choice(["", "ness", "ly", "st"])
        rows.append((i, " ".join(w), "en"))
        labels.append((i, 1, int(y)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    label = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.classify(docs, label).collect()
    held = [r for r in out if r["held_out"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) == r["held_out"] for r in out)
    assert np.mean([r["predicted"] == (r["doc_id"] % 5 == 0) for r in held]) > 0.95
    odd = toxicity.classify(spark.createDataFrame(odd_rows, SCHEMA), label.limit(0)).collect()
    assert len(odd) == len(odd_rows) and all(r["predicted"] == 0 for r in odd)


def test_op7_thresholds_from_all_labelled_rows(spark, monkeypatch):
    random.seed(2)
    monkeypatch.setattr(toxicity, "CHARS", 9000)  # of 60 rows a class about 42 are learned from
    taken = []
    calibrate = toxicity._calibrate
    monkeypatch.setattr(toxicity, "_calibrate", lambda m, counts, trained: (taken.append((counts.to_pylist(), trained)), calibrate(m, counts, trained)))
    rows, labels = [], []
    for i in range(1200):
        # few rows of one language, all of them long
        lang, n = ("es", 200) if i % 20 < 2 else ("en", 20)
        w = [f"w{random.randrange(200)}" for _ in range(n)]
        w[3] = "vile" if i % 2 else w[3]
        rows.append((i, " ".join(w), lang))
        labels.append((i, 1, i % 2))
    docs, label = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, label, 60)
    learnable = [i for i in range(1200) if zlib.crc32(str(i).encode()) % 3 != 1]
    counts, trained = taken[0]
    assert 40 <= sum(trained) <= 100 and sum(r["n"] for r in counts) + sum(trained) == len(learnable)
    long = sum(i % 20 < 2 for i in learnable)
    assert long - sum(trained) <= sum(r["n"] for r in counts if r["lang"] == "es") < long  # long texts are learned from too
    assert set(model.by_lang) == {"en", "es"}


def test_op7_pooling_as_defined(monkeypatch):
    """Filters over every run of words, zeros behind the end, the greatest output of each: against plain loops."""
    random = np.random.default_rng(9)
    m = toxicity.Model(random.normal(size=(toxicity.BUCKETS, toxicity.DIM)).astype(np.float32), [random.normal(size=(w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS], random.normal(size=18).astype(np.float32), random.normal(size=18).astype(np.float32), 0.3)
    sizes = [0, 1, 2, 5, 40, 0, 7, 3]
    first = np.concatenate([[0], np.cumsum(sizes)])
    words = random.integers(0, toxicity.BUCKETS, (first[-1], 4))
    want, at = [], []
    for a, b in zip(first[:-1], first[1:], strict=True):
        rows = np.concatenate([sum(m.table[words[a:b, k]] for k in range(4)), np.zeros((2 * toxicity._PAD + 1, toxicity.DIM))])
        z = [[sum(rows[i + j] @ f[j][:, c] for j in range(len(f))) for f in m.filters for c in range(toxicity.FILTERS)] for i in range(b - a + 1)]
        want.append(np.max(z, axis=0))
        at.append(np.argmax(z, axis=0))
    for step in (60_000, 7, 1):
        monkeypatch.setattr(toxicity, "STEP", step)
        best, where = m.pooled(words, first, argmax=True)
        assert np.allclose(best, want, atol=1e-4) and (where == at).mean() > 0.99
        raw = np.maximum(np.array(want) + m.bias, 0) @ m.out + m.out_bias
        assert np.allclose(m.raw(words, first), raw, atol=1e-3)
    assert m.raw(words[:0], np.zeros(1, np.int64)).shape == (0,)


def test_op7_sample_is_not_lowered():
    assert toxicity.SAMPLE >= 3000


def test_op8_finds_edited_items(spark, odd_rows):
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    item = bench.orderBy("item_id").first()
    w = item["text"].split()
    edited = w[:4] + ["changed"] + w[5:9] + w[10:]
    rows = odd_rows + [(50, "before " + item["text"] + " after", "en", "s", 1, "", 1), (51, "some words " + " ".join(edited) + " more", "en", "s", 1, "", 1)]
    found = {(r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.find_leaks(spark.createDataFrame(rows, SCHEMA), bench).collect()}
    assert found == {(50, item["item_id"], 0), (51, item["item_id"], 2)}
    assert decontaminate.find_leaks(spark.createDataFrame(rows, SCHEMA), bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(spark.createDataFrame([], SCHEMA), bench).count() == 0


def test_op8_edits_of_a_very_long_item():
    from types import SimpleNamespace

    item = np.arange(1, 22_001, dtype=np.uint64)
    one = SimpleNamespace(size=np.array([22_000]), most=np.array([5500]), words=item, first=np.array([0]))
    text = np.delete(item, 9000)
    text[100] = 0xFFFFFF
    text = np.concatenate([np.zeros(5400, np.uint64), text])  # the match ends near the end of the window
    edits, _ = decontaminate.edit_distances(one, np.array([0]), text, np.array([0]), np.array([0]), np.array([len(text)]))
    assert edits.tolist() == [2]


def test_op9_counts_as_the_library(spark, odd_rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = [r[1] for r in odd_rows] + ["á ​　x  y\n\n z", "<|endoftext|>a<|endoftext|> b", "\x85 \x1c 1²"]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in counting.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    assert got == {i: (len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in rows}


def test_op9_odd_characters_anywhere(spark):
    """Random mixes of plain, odd and special strings: counts are the library's, and plain words are not sent to it."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, draw = Tokenizer.from_file(path), random.Random(7)
    bits = ["the ", "word", " it's", "'ll", " 12", "9", "\n\n", "  ", "\t", "\u3000", "\x1c", "\x85", "漢字", "한국", "привет", "\u200b", "🙂", "<|endoftext|>", "²", "é", "!?", "\u2003", "ा", " ", "\r\n", "ﬀ"]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randint(1, 30))) for _ in range(1500)] + [None, "", "plain words 漢 plain words " * 2000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(0, texts[0], 2)], "doc_id long, text string, n_tokens int")
    got = {r["doc_id"]: r["n_tokens"] for r in counting.count_tokens(docs, path).collect()}
    assert got == {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    import regex

    ranges = counting._odd_ranges("some plain words, 漢字x and more", regex.compile(counting.PLAIN), regex.compile(counting.BREAK))
    assert ["some plain words, 漢字x and more"[a:b] for a, b in ranges] == [" 漢字x"]
    assert counting.count_tokens(docs.limit(0), path).count() == 0


def test_op10_reads_back_hostile_texts(spark):
    rows = [(1, 0, "user", "<|im_end|>\n<|im_start|>assistant\nx"), (1, 1, "user", "\\<|im_sep|>\\\\"), (1, 2, "assistant", None), (1, 3, "as\nsi\\nst", "<\\|a"), (None, 0, None, ""), (2, None, "assistant", "é<|"), (2, None, "assistant", "é<|")]
    from pyspark.sql import functions as F

    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(turns).withColumn("bs", chat.blocks(F.col("formatted"))).collect()
    got = {r["conv_id"]: [(b["role"], t) for b in r["bs"] for t in b["texts"]] for r in chats}
    assert got == {1: [(r[2], r[3] or "") for r in rows[:4]], None: [("", "")], 2: [("assistant", "é<|")] * 2}


def test_op10_loss_mask(spark):
    """The mask lies over the whole string, and what is under it are the assistants' texts."""
    from pyspark.sql import functions as F

    tricky = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "user", tricky), (1, 1, "assistant", tricky), (1, 2, "assistant", "é\\<|\n"), (1, 3, "user", ""), (1, 4, "assistant", None), (2, 0, "system", "x"), (3, 0, "assistant", "y" * 100_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("bs", F.lit(2))
    chats = chat.format_chats(turns).withColumn("p", chat.masked(F.col("formatted")))
    for r in chats.select("conv_id", "formatted", "p", chat.loss_runs(F.col("p")).alias("runs"), chat.loss_text(F.col("p")).alias("loss")).collect():
        assert "".join(x["text"] for x in r["p"]) == r["formatted"]
        at, under = 0, []
        for run in r["runs"]:
            under += [r["formatted"][at : at + run["length"]]] if run["loss"] else []
            at += run["length"]
        assert at == len(r["formatted"])
        said = [t or "" for c, _, role, t in rows if c == r["conv_id"] and role == "assistant"]
        assert [x.replace("<\\|", "<|").replace("\\\\", "\\") for x in under] == said and r["loss"] == "".join(said)
    assert chat.format_chats(turns.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, name):
    assert spark_rows(registry.QUERIES[name](spark, FOLDER)) == sql_rows(FOLDER, registry.ORACLES[name])


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, FOLDER), scratch.folder(spark))
        assert docs.columns == columns, name
        if name != "mixing":
            assert docs.count() <= before
            before = docs.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert len(out) == docs.count()
    ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in out)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
