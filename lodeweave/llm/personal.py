"""Personal data in texts: exact patterns, and a linear-chain conditional random field over the shapes of words.

The patterns give the base spans of every text, in time linear in its length. The field is trained from a small
labelled table (words, tags): stretches of words from a bounded sample of the documents, tagged by the patterns, and
the same values written in ways that no pattern knows. It labels the words around every digit, at-sign and its
substitutes; what it finds is added where it passes a check of its kind and no base span lies. Features of a word are
its shape, digits, checks and short spellings, each with weights for the word itself, the one before and the one
behind. Stretches of a batch are decoded together by Viterbi in numpy.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext

KINDS = ["email", "ip", "card", "phone"]
TAGS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
SAMPLE_DOCS = 2000  # documents that the labelled table comes from
SAMPLE = 1500  # stretches of the labelled table, before they are written in other ways
CHARS = 8_000_000  # characters at which the sample of documents ends
AROUND = 2  # words on either side of one that holds a digit or an at-sign
ROUNDS = 80  # steps of training
DECAY = 1e-3  # weight of the squared weights in training
CACHE = 200_000  # words remembered by a task with their features

# fixed values: the patterns of the contract; possessive where that changes no match
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a later start in the same digits would need the same rest
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    """Whether a string of ASCII digits passes the check of card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _octets(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the patterns' matches, in code points, by start and kind."""
    out = []
    at, low = text.find("@"), 0
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        low = at + 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, 0, m.end()))
            low = m.end()
        at = text.find("@", low)
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _octets(m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(out)


# features of words

_SHAPE = bytearray(b"u" * 256)
_SHAPE[:128] = bytes(range(128))
_SHAPE[0x30:0x3A] = b"9" * 10
_SHAPE[0x41:0x5B] = b"X" * 26
_SHAPE[0x61:0x7B] = b"x" * 26
_SHAPE = bytes(_SHAPE)
_OUTER = b"!\"#$%&'*,-./:;<=>?\\^_`{|}~"  # punctuation that may stand around a value
_AGAIN = re.compile(rb"(.)\1+", re.S)
_NOT_DIGIT = bytes(c for c in range(256) if not 0x30 <= c <= 0x39)
_HEXES = re.compile(rb"[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}")


def _bucket(n: int) -> int:
    return n if n < 5 else 5 if n < 9 else 9 if n < 12 else 12 if n < 20 else 20


def features(word: bytes) -> list[str]:
    """Names of a word's features."""
    core = word.strip(_OUTER)
    shape = core.translate(_SHAPE)
    digits = core.translate(None, _NOT_DIGIT)
    out = ["any", f"shape {_AGAIN.sub(rb'\1', shape)[:32].decode()}", f"digits {_bucket(len(digits))}", f"ends {word[:1].translate(_SHAPE).decode()}{word[-1:].translate(_SHAPE).decode()}"]
    if digits and len(digits) == len(core):
        out.append(f"number {min(len(digits), 20)}")
    if b"@" in core:
        out.append("at-sign")
    if core[:1] == b"+":
        out.append("plus")
    if 12 <= len(digits) <= 19:
        out.append(f"luhn {luhn(digits.decode())}")
    if core.count(b".") == 3 and len(digits) + 3 == len(core):
        out.append(f"octets {all(core.split(b'.')) and _octets([p.decode() for p in core.split(b'.')])}")
    if core.count(b":") >= 2 and _HEXES.fullmatch(core):
        out.append(f"groups {_bucket(core.count(b':') + 1)}")
    if not digits and len(core) <= 6:
        out.append(f"word {core.lower().decode(errors='replace')}")
    return out


# the field


@dataclass
class Field:
    """Weights of features (feature, place: before, itself, behind; tag) and of tag pairs."""

    names: dict[str, int]
    weights: np.ndarray
    pairs: np.ndarray

    def emissions(self, words: list[bytes], cache: dict[bytes, list[int]]) -> np.ndarray:
        """For each word its share (place, tag) in the scores of the word behind, of itself and of the word before."""
        ids, sizes = [], []
        for w in words:
            known = cache.get(w)
            if known is None:
                known = [self.names[f] for f in features(w) if f in self.names]
                if len(w) <= 64:
                    cache[w] = known
            ids.extend(known)
            sizes.append(len(known))
        out = np.zeros((len(words), *self.weights.shape[1:]))
        sizes = np.array(sizes, np.int64)
        some = np.flatnonzero(sizes)
        if len(some):
            out[some] = np.add.reduceat(self.weights[np.array(ids, np.int64)], (np.cumsum(sizes) - sizes)[some], axis=0)
        return out


def _allowed() -> np.ndarray:
    """Which tag may follow which: an inner tag only its own kind; the last row is the start."""
    out = np.ones((len(TAGS) + 1, len(TAGS)), bool)
    for j, tag in enumerate(TAGS):
        if tag[0] == "I":
            out[:, j] = [t[1:] == tag[1:] for t in TAGS] + [False]
    return out


_BARRED = np.where(_allowed(), 0.0, -1e9)


def _scores(shares: np.ndarray, word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Tag scores of every word of all stretches from the shares of different words; ``first`` has each stretch's start and the end."""
    out = shares[word, 1].copy()
    inner = np.ones(len(word), bool)
    inner[first[:-1]] = False  # has a word before
    at = np.flatnonzero(inner)
    out[at] += shares[word[at - 1], 0]
    out[at - 1] += shares[word[at], 2]
    return out


def _packed(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches by falling length, and how many of them have a word at each step."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    steps = np.arange(int(size.max()) if len(size) else 0)
    return order, np.searchsorted(-size[order], -steps - 0.5, "right")


def viterbi(scores: np.ndarray, first: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The best tag of every word; all stretches that are long enough take a step together."""
    order, active = _packed(first)
    start = first[:-1][order]
    table = pairs + _BARRED
    back = np.zeros(scores.shape, np.int8)
    last = np.zeros((len(order), len(TAGS)))
    for t, k in enumerate(active.tolist()):
        row = start[:k] + t
        if t == 0:
            last[:k] = scores[row] + table[-1]
        else:
            all_ways = last[:k, :, None] + table[None, :-1]
            best = all_ways.argmax(1)
            back[row] = best
            last[:k] = np.take_along_axis(all_ways, best[:, None], 1)[:, 0] + scores[row]
    out = np.zeros(len(scores), np.int8)
    tag = last.argmax(1).astype(np.int8)
    for t in range(len(active) - 1, -1, -1):
        k = int(active[t])
        row = start[:k] + t
        out[row] = tag[:k]
        tag[:k] = back[row, tag[:k]]
    return out


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def likelihood(scores: np.ndarray, first: np.ndarray, pairs: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of the tags of all stretches, and its slopes by scores and by pairs (forward and backward sums)."""
    order, active = _packed(first)
    start = first[:-1][order]
    table = pairs + _BARRED
    ahead = np.zeros(scores.shape)
    for t, k in enumerate(active.tolist()):
        row = start[:k] + t
        ahead[row] = scores[row] + (table[-1] if t == 0 else _sum_exp(ahead[row - 1][:, :, None] + table[None, :-1], 1))
    size = np.diff(first)[order]
    whole = _sum_exp(ahead[start + size - 1], 1)
    behind = np.zeros(scores.shape)
    d_pairs = np.zeros(pairs.shape)
    for t in range(len(active) - 1, 0, -1):
        k = int(active[t])
        row = start[:k] + t
        ways = table[None, :-1] + (scores[row] + behind[row])[:, None, :]
        behind[row - 1] = _sum_exp(ways, 2)
        d_pairs[:-1] -= np.exp(ahead[row - 1][:, :, None] + ways - whole[:k, None, None]).sum(0)
    of = np.empty(len(scores))
    for j, s in enumerate(start.tolist()):
        of[s : s + size[j]] = whole[j]
    odds = np.exp(ahead + behind - of[:, None])
    d_scores = -odds
    d_scores[np.arange(len(tags)), tags] += 1
    d_pairs[-1] -= odds[start].sum(0)
    np.add.at(d_pairs[-1], tags[start], 1)
    inner = np.ones(len(tags), bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    np.add.at(d_pairs, (tags[at - 1], tags[at]), 1)
    value = scores[np.arange(len(tags)), tags].sum() + table[-1, tags[start]].sum() + table[tags[at - 1], tags[at]].sum() - whole.sum()
    return float(value), d_scores, d_pairs


def train(stretches: list[tuple[list[str], list[str]]], rounds: int = ROUNDS, decay: float = DECAY) -> Field:
    """The field that makes a small labelled table (words, tags) likeliest, by ``rounds`` steps of Adam; without stretches all is O."""
    stretches = [(w, t) for w, t in stretches if w]
    places: dict[bytes, int] = {}
    word = np.array([places.setdefault(w.encode(), len(places)) for words, _ in stretches for w in words], np.int64)
    tags = np.array([TAGS.index(t) for _, ts in stretches for t in ts], np.int64)
    first = np.concatenate([[0], np.cumsum([len(w) for w, _ in stretches])]).astype(np.int64)
    names: dict[str, int] = {}
    lists = [[names.setdefault(f, len(names)) for f in features(w)] for w in places]
    field = Field(names, np.zeros((max(1, len(names)), 3, len(TAGS))), np.zeros((len(TAGS) + 1, len(TAGS))))
    if not len(word):
        field.pairs[:, 0] = 1.0
        return field
    ids, sizes = np.array([i for x in lists for i in x]), np.array([len(x) for x in lists])
    begins = np.cumsum(sizes) - sizes
    moments = [np.zeros(field.weights.shape), np.zeros(field.weights.shape), np.zeros(field.pairs.shape), np.zeros(field.pairs.shape)]
    n = len(stretches)
    for step in range(1, rounds + 1):
        shares = np.add.reduceat(field.weights[ids], begins, axis=0)
        _, d_scores, d_pairs = likelihood(_scores(shares, word, first), first, field.pairs, tags)
        d_shares = np.zeros(shares.shape)
        inner = np.ones(len(word), bool)
        inner[first[:-1]] = False
        at = np.flatnonzero(inner)
        np.add.at(d_shares[:, 1], word, d_scores)
        np.add.at(d_shares[:, 0], word[at - 1], d_scores[at])
        np.add.at(d_shares[:, 2], word[at], d_scores[at - 1])
        d_weights = np.zeros(field.weights.shape)
        np.add.at(d_weights, ids, np.repeat(d_shares, sizes, axis=0))
        for k, (x, slope) in enumerate(((field.weights, d_weights / n - decay * field.weights), (field.pairs, d_pairs / n - decay * field.pairs))):
            mean, square = moments[2 * k], moments[2 * k + 1]
            mean += 0.1 * (slope - mean)
            square += 0.01 * (slope**2 - square)
            x += 0.2 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return field


# the labelled table

# fixed values: lines without personal data
_PLAIN_LINES = [
    "on 2021-05-03 at 10:22:33 the job ended", "version 2.0.17 of 3.4.5.6.7 was", "price 1,234.56 or 12.50 each", "page 12 of 350 in 1998",
    "order 20210503-000123 of lot 77", "see section 4.2 and figure 3", "room 101 at 9 o'clock", "id 00000000000000 and 123456789012",
    "between 1914 and 1918 about 20 000 000", "@home and @user12 said", "a@b and x@ y", "size 1920x1080 at 60fps", "ISBN 978-3-16-148410-0 and 0-306-40615-2",
    "sum 3.14159265358979 over 2.718281828", "hash d41d8cd98f00b204e9800998ecf8427e ok", "300.301.302.303 and 1.2.3", "lines 10:20:30 and 5::7 of it",
]


def _rewritten(kind: int, value: str, draw: np.random.Generator) -> list[str]:
    """Ways to write a value that its pattern doesn't match."""
    digits = re.sub(r"[^0-9]", "", value)
    if kind == 0:
        local, host = value.split("@")
        if draw.integers(2):
            local, host = (re.sub(r"\W*[0-9]+", "", x) or "me" for x in (local, host))
            host = host if "." in host else f"{host}.org"
        name, top = host.rsplit(".", 1)
        return [f"{local}(at){host}", f"{local} (at) {host}", f"{local} [at] {host}", f"{local}[at]{name}[dot]{top}", f"{local} [at] {name} [dot] {top}", f"{local} @ {host}"]
    if kind == 1:
        groups = [f"{x:x}" for x in draw.integers(1, 65536, 8)]
        return [":".join(groups), ":".join(groups[:4]) + "::" + groups[4], "fe80::" + ":".join(groups[:4])]
    if kind == 2:
        fours = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return [".".join(fours), "/".join(fours), "_".join(fours), "  ".join(fours), " - ".join(fours)]
    rest = digits[-10:]
    return [f"({rest[:3]}) {rest[3:6]}-{rest[6:]}", f"{rest[:3]}-{rest[3:6]}-{rest[6:]}", f"{rest[:3]}.{rest[3:6]}.{rest[6:]}", f"00{digits[:-10]} {rest[:3]} {rest[3:6]} {rest[6:]}", f"+{digits[:-10]}/{rest[:3]}/{rest[3:]}"]


def _tagged(pieces: list[tuple[str, int | None]]) -> tuple[list[str], list[str]]:
    """Words and tags of pieces of text, each with its kind or None."""
    words, tags = [], []
    for text, kind in pieces:
        own = text.split()
        words += own
        tags += ["O"] * len(own) if kind is None else [f"{'I' if i else 'B'}-{KINDS[kind]}" for i in range(len(own))]
    return words, tags


def enlarged(stretches: list[tuple[str, list[tuple[int, int, int]]]], seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """The labelled table of stretches (text, spans as start, kind, end): as they are, with values written in other ways, cards
    with a wrong digit, and lines without personal data. A word is tagged where a span lies in it."""
    draw = np.random.default_rng(seed)
    out = [_tagged([(line, None)]) for line in _PLAIN_LINES]
    out += [_tagged([("number " + "".join(map(str, draw.integers(1, 10, n))) + " of it", None)]) for n in range(5, 25)]
    for text, spans in stretches:
        clear, end = [], -1
        for start, kind, stop in spans:
            if start >= end and (end < 0 or re.search(r"\s", text[end:start])):  # one in a word
                clear.append((start, kind, stop))
                end = stop
        for way in range(3 if clear else 1):
            pieces, at, wrong = [], 0, False
            for start, kind, stop in clear:
                # what sticks to the value goes with it
                a, b = start, stop
                while a > at and not text[a - 1].isspace():
                    a -= 1
                while b < len(text) and not text[b].isspace():
                    b += 1
                value, k = text[start:stop], kind
                if way:
                    ways = _rewritten(kind, value, draw)
                    value = ways[int(draw.integers(len(ways)))]
                    if kind == 2 and way == 2:
                        value, k, wrong = value[:-1] + str((int(value[-1]) + 1) % 10), None, True
                pieces += [(text[at:a], None), (text[a:start] + value + text[stop:b], k)]
                at = b
            pieces.append((text[at:], None))
            words, tags = _tagged(pieces)
            if words and (way or wrong or len(words) <= 64):
                out.append((words, tags))
    return out


_SPACES = " \t\n\x0b\x0c\r"
_MARK = re.compile(r"[0-9@]|[(\[][aA][tT][)\]]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def stretches_of(text: str) -> list[tuple[int, int]]:
    """Ranges of code points around words with a digit, an at-sign or a substitute, ``AROUND`` words on each side."""
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    out: list[list[int]] = []
    for i, (a, b) in enumerate(words):
        if _MARK.search(text, a, b):
            low, high = max(0, i - AROUND), min(len(words) - 1, i + AROUND)
            if out and low <= out[-1][1] + 1:
                out[-1][1] = high
            else:
                out.append([low, high])
    return [(words[x][0], words[y][1]) for x, y in out]


def labelled(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample: int = SAMPLE) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """At most ``sample`` stretches (text, base spans) of at most 64 words, from ``sample_docs`` documents that hold digits or
    at-signs, in order of a hash of doc_id until ``CHARS`` characters; those with spans first."""
    order = F.xxhash64(F.lit(11), "doc_id")
    ids = docs.filter(F.col("doc_id").isNotNull() & F.col("text").rlike("[0-9@]")).select("doc_id", F.char_length("text").alias("n")).orderBy(order, "doc_id").limit(sample_docs).toArrow()
    if not len(ids):
        return []
    before = np.cumsum(ids.column("n").to_numpy()) - ids.column("n").to_numpy()
    kept = ids.select(["doc_id"]).filter(pa.array(before < CHARS)).group_by("doc_id").aggregate([])
    chosen = docs.sparkSession.createDataFrame(kept, docs.select("doc_id").schema)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most sample_docs ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                spans = base_spans(text or "")
                for a, b in stretches_of(text or ""):
                    inside = [(s - a, k, e - a) for s, k, e in spans if a <= s and e <= b]
                    if len(text[a:b].split()) <= 64:
                        rows.append({"text": text[a:b], "spans": [list(x) for x in inside]})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("text", pa.string()), ("spans", pa.list_(pa.list_(pa.int32())))]))

    found = texts.mapInArrow(cut, "text string, spans array<array<int>>").distinct()
    rows = found.orderBy(F.size("spans") == 0, F.xxhash64("text"), "text").limit(sample).collect()  # at most ``sample`` short stretches
    return [(r["text"], [tuple(x) for x in r["spans"]]) for r in rows]


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample: int = SAMPLE) -> Field:
    """The field of the documents' own labelled table; without base spans in it nothing is added to any document."""
    rows = labelled(docs, sample_docs, sample)
    return train(enlarged(rows) if any(spans for _, spans in rows) else [])


# finding

_AT = re.compile(r"[A-Za-z0-9](?:\s*@\s*|\s*[(\[][aA][tT][)\]]\s*)[A-Za-z0-9]")
_HEX = re.compile(r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=(?:[^:]*:){3})(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?")


def _checked(text: str, start: int, kind: int, end: int) -> tuple[int, int, int] | None:
    """The span without punctuation around it, if it passes the check of its kind."""
    first = "+(" if kind == 3 else ""
    while start < end and not (text[start].isalnum() or text[start] in first):
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    value = text[start:end]
    digits = [c for c in value if "0" <= c <= "9"]
    good = (
        bool(_AT.search(value)) if kind == 0
        else bool(_HEX.fullmatch(value)) if kind == 1
        else 12 <= len(digits) <= 19 and luhn("".join(digits)) and not re.search(r"[^0-9\s./_-]", value) if kind == 2
        else 9 <= len(digits) <= 15 and len(digits) < len(value) and not re.search(r"[^0-9\s()./+-]", value)
    )
    return (start, kind, end) if good else None


_WORDY = np.zeros(256, bool)
_WORDY[0x30:0x3A] = True
_WORDY[0x40] = True


def _marked(data: np.ndarray) -> np.ndarray:
    """Places of digits, at-signs and their substitutes."""
    mark = _WORDY[data]
    open_ = np.flatnonzero((data == 0x28) | (data == 0x5B))
    open_ = open_[open_ + 3 < len(data)]
    at = (data[open_ + 1] | 0x20 == 0x61) & (data[open_ + 2] | 0x20 == 0x74) & ((data[open_ + 3] == 0x29) | (data[open_ + 3] == 0x5D))
    mark[open_[at] + 1] = True
    return np.flatnonzero(mark)


def _added(field: Field, cache: dict, data: np.ndarray, offs: np.ndarray, marks: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """document -> (first byte, kind, last byte) of stretches of words that the field labels, in bytes of the chunk."""
    s, e, first = vectext.spans(data, offs)
    hit = np.unique(np.searchsorted(s, marks, "right") - 1)
    doc = np.searchsorted(first, hit, "right") - 1
    low, high = np.maximum(hit - AROUND, first[doc]), np.minimum(hit + AROUND + 1, first[doc + 1])
    inside = np.zeros(len(s) + 1, np.int64)
    np.add.at(inside, low, 1)
    np.add.at(inside, high, -1)
    chosen = np.cumsum(inside[:-1]) > 0
    word = np.flatnonzero(chosen)
    new = np.ones(len(word), bool)
    of = np.searchsorted(first, word, "right") - 1
    new[1:] = (word[1:] != word[:-1] + 1) | (of[1:] != of[:-1])
    begin = np.concatenate([np.flatnonzero(new), [len(word)]])
    _, where, back = np.unique(vectext.span_hash(data, s[word], e[word]), return_index=True, return_inverse=True)
    own = word[where]
    shares = field.emissions([data[x:y].tobytes() for x, y in zip(s[own].tolist(), e[own].tolist(), strict=True)], cache)
    tags = viterbi(_scores(shares, back.reshape(-1), begin), begin, field.pairs)
    out: dict[int, list] = {}
    starts = np.flatnonzero(tags % 2 == 1)
    for i in starts.tolist():
        j = i + 1
        while j < len(tags) and tags[j] == tags[i] + 1 and not new[j]:
            j += 1
        out.setdefault(int(of[i]), []).append((int(s[word[i]]), int(tags[i]) // 2, int(e[word[j - 1]])))
    return out


def find_personal(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, spans): personal data of each whole text, an array of (kind, start, end, base) by start and kind, in code
    points, the end exclusive; ``base`` says whether a pattern found it.

    Null, empty and wordless texts hold none. Rows are independent: repeated rows repeat, an empty table gives none, other
    columns are ignored. A span that the field adds overlaps no base span and no added one before it. A text of any
    length is searched whole, in one task.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)  # bounded by the labelled table

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, cache = sent.value, {}
        for batch in batches:
            data, offs = vectext.raw(batch.column("text"))
            for i, j in vectext.chunks(offs):
                part, ends = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                marks = _marked(part)
                rows: list[list] = [[] for _ in range(j - i)]
                if len(marks):
                    added = _added(field, cache, part, ends, marks)
                    for d in np.unique(np.searchsorted(ends, marks, "right") - 1).tolist():
                        text = part[ends[d] : ends[d + 1]].tobytes().decode()
                        found = [(*x, True) for x in base_spans(text)]
                        if d in added:
                            found += _free(text, part[ends[d] : ends[d + 1]], found, [(a - int(ends[d]), k, b - int(ends[d])) for a, k, b in added[d]])
                        rows[d] = [{"kind": KINDS[k], "start": a, "end": b, "base": base} for a, k, b, base in sorted(found)]
                    if len(cache) > CACHE:
                        cache.clear()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(rows, _SPANS)], ["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(search, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def _free(text: str, raw: np.ndarray, found: list[tuple], added: list[tuple[int, int, int]]) -> list[tuple]:
    """Spans, in bytes, that pass their check and overlap none of those found, in code points."""
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    starts, last = [x[0] for x in found], list(accumulate((x[2] for x in found), max))
    out, end = [], 0
    for a, kind, b in added:
        span = _checked(text, int(points[a]), kind, int(points[b]))
        if span and span[0] >= end:
            before = bisect_left(starts, span[2])
            if not before or last[before - 1] <= span[0]:
                out.append((*span, False))
                end = span[2]
    return out


def op11_personal(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_personal(docs, fit(docs))
    line = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    base = F.array_join(F.transform(F.filter("spans", lambda x: x["base"]), line), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("spans", line), ",").alias("spans"))
