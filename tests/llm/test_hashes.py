"""Hash collisions that once gave wrong rows, and long texts."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from lodeweave.llm import decontaminate, idfiles, lm, neardup, repeats, vectext

WINDOW = bytes.fromhex("43507077265c6f7050662a7c4a743e65614373384a58546a45263c6c387768564d49646c3d374e242b27632f3622363e724d336d3d2b602c517a6a665948772a273c7757762c483f274350375b464d415f764f624a3c593a5950433b67654f7175213040")


def twin_words(n):
    """A word over a and b that repeats nothing three times, and the word with both letters swapped."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048, 4096, 8192])
def test_twin_words_have_hashes_of_their_own(n):
    one, two = twin_words(n)
    data, offs = vectext.raw(pa.array([one, two, one]))
    hashed, _ = vectext.words(data, offs)
    assert hashed[0] == hashed[2] != hashed[1]
    assert vectext.same(data, offs[[0, 0]], offs[[1, 1]], data, offs[[1, 2]], offs[[2, 3]]).tolist() == [False, True]


@pytest.mark.parametrize("n", [1024, 4096])
def test_twin_words_in_the_operators(spark, n):
    import public_tokenizers
    from tokenizers import Tokenizer

    one, two = twin_words(n)
    docs = spark.createDataFrame([(1, one), (2, two), (3, one + " end"), (4, two + " end")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in neardup.groups(docs, 4, 80).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, encoder = Tokenizer.from_file(path), idfiles.UnitIds(path)
    for _ in range(2):  # from the library, then from the cache
        ids, sizes = encoder.encode(*vectext.raw(pa.array([one, two])))
        want = [tok.encode(x, add_special_tokens=False).ids for x in (one, two)]
        assert ids.tolist() == want[0] + want[1] and sizes.tolist() == [len(x) for x in want]
    bench = spark.createDataFrame([(7, one + " x y z"), (8, "nothing of it")], "item_id long, text string")
    texts = spark.createDataFrame([(1, one + " x y z"), (2, two + " q r s")], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(texts, bench).collect()] == [(1, 7)]
    learn = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 != 2][:3]
    rows = lm.score_documents(spark.createDataFrame([(learn[0], one), (learn[1], one), (learn[2], two)], "doc_id long, text string")).collect()
    base = {r["doc_id"]: r["base_score"] for r in rows}
    total = 6 + 3 + 1  # tokens, distinct ones and one more
    assert base[learn[0]] == pytest.approx(np.log10(3 / total) + np.log10(4 / total))
    assert base[learn[2]] == pytest.approx(np.log10(2 / total) + np.log10(4 / total))


def test_equal_hashes_of_different_units(monkeypatch):
    """With a hash that tells nothing, ids still are the library's."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, encoder = Tokenizer.from_file(path), idfiles.UnitIds(path)
    monkeypatch.setattr(vectext, "span_hash", lambda data, s, e, seed=0: (e - s).astype(np.uint64) % 3)
    texts = ["some words of the same size", "Some WORDS of <|endoftext|> it's", "", "other texts with other words 12 345"]
    for _ in range(2):
        ids, _ = encoder.encode(*vectext.raw(pa.array(texts)))
        assert ids.tolist() == [i for t in texts for i in tok.encode(t, add_special_tokens=False).ids]


def test_units_come_again(monkeypatch):
    """A worker that has seen too many units keeps those that came again; words of Latin letters go to the model at once. Ids are the library's."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, encoder = Tokenizer.from_file(path), idfiles.UnitIds(path)
    monkeypatch.setattr(idfiles, "CACHE", 120)
    learned, ids_of = [], encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda strings: learned.extend(strings) or ids_of(strings))
    calls = []

    class Library:
        model = tok.model

        def encode(self, x, **other):
            calls.append(x)
            return tok.encode(x, **other)

    encoder.tok = Library()
    letters = [chr(c) for c in range(0xC0, 0x100) if chr(c).isalpha()]
    common = ["Straße", "ÉTÉ", "naïve", "the", "42", "".join(letters), "it's", "ªº", "e\u0301"]
    for i in range(60):
        text = " ".join([*common, *(f"{chr(97 + i % 26)}{'q' * (i // 26)}{a}{letters[i]}" for a in "abcdefghijklmnopqrst")])
        ids, sizes = encoder.encode(*vectext.raw(pa.array([text[:30], "", text])))
        want = [tok.encode(x, add_special_tokens=False).ids for x in (text[:30], "", text)]
        assert ids.tolist() == sum(want, []) and sizes.tolist() == [len(x) for x in want]
    assert all(learned.count(x) == 1 for x in common) and len(encoder.keys) <= 120
    assert not set(calls) & {"Straße", "ÉTÉ", "naïve", "the", "".join(letters)}


def test_op3_window_in_a_short_and_a_very_long_text(spark):
    random = np.random.default_rng(3)
    noise = random.integers(33, 127, 12_000_000, dtype=np.uint8).tobytes()
    text = (WINDOW + noise[:6_000_000] + WINDOW + noise[6_000_000:]).decode()
    again = noise[5_000_000:5_000_300].decode()
    docs = spark.createDataFrame([(1, WINDOW.decode()), (2, text), (3, again)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], r["n_bytes"]) for r in repeats.remove_repeats(docs).drop("kept").collect()}
    assert got == {1: (0, 0, 100), 2: (200, 2, len(text)), 3: (300, 1, 300)}


def test_op3_pieces_of_a_long_text(monkeypatch):
    random = np.random.default_rng(4)
    data = random.integers(97, 100, 5000, dtype=np.uint8)
    offs = np.array([0, 5000])
    whole = repeats.segments(data, offs)
    monkeypatch.setattr(repeats, "PIECE", 700)
    cut = repeats.segments(data, offs)

    def windows(found):
        a, _, _, start, many = found
        return sorted((s + k, h) for h, s, m in zip(a.tolist(), start.tolist(), many.tolist(), strict=True) for k in range(m))

    assert windows(whole) == windows(cut) and len(windows(whole)) == 4901


def test_op3_first_least_place():
    random = np.random.default_rng(5)
    hashed = random.integers(0, 9, 400, dtype=np.uint64)
    for span in (1, 2, 7, 77, 128):
        assert repeats.least_of(hashed, span).tolist() == [int(hashed[i : i + span].argmin()) for i in range(400 - span + 1)]
