"""Periodic runs of words: maximal stretches in which words a period apart are identical.

A text's words are cut into Lempel-Ziv factors with a suffix automaton (each factor is the longest piece that also
starts earlier, or a new word). Runs that touch or cross the start of a factor are found from common extensions on
both sides of it (Main's algorithm); all others lie strictly inside a factor and are copied from where it occurred
before (Kolpakov and Kucherov). With exponent x, a run that ends in a factor starts less than |previous| +
(|previous| + |factor|) / (x - 1) words before it, so all work is linear in the number of words but for dictionaries.

Before that, arrays of hashes tell where a run can be at all: with at least ``least`` words and three periods every
``least // 3`` words of a run occur in it a second time, so only stretches covered by repeated groups of that many
words are factorised. That loses no run; equal words are told by their bytes, not by hashes.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext

LEAST = 24  # words of a run
EXPONENT = 3  # periods of a run


class Automaton:
    """Suffix automaton of a sequence of numbers; ``ends[state]`` is where its strings end for the first time.

    Most states have one way out, which is kept in arrays; others go to a dictionary.
    """

    def __init__(self, seq: list[int]):
        self.link, self.size, self.ends = array("q", [-1]), array("q", [0]), array("q", [-1])
        self.symbol, self.to, self.more = array("q", [-1]), array("q", [-1]), {}
        link, size, symbol, to, more, go = self.link, self.size, self.symbol, self.to, self.more, self.go
        last = 0
        for i, c in enumerate(seq):
            new = self._state(size[last] + 1, 0, i)
            at = last
            while at >= 0 and go(at, c) < 0:
                if symbol[at] < 0:
                    symbol[at], to[at] = c, new
                else:
                    more.setdefault(at, {})[c] = new
                at = link[at]
            if at >= 0:
                old = go(at, c)
                if size[old] == size[at] + 1:
                    link[new] = old
                else:
                    copy = self._state(size[at] + 1, link[old], self.ends[old])
                    symbol[copy], to[copy] = symbol[old], to[old]
                    if old in more:
                        more[copy] = dict(more[old])
                    while at >= 0 and go(at, c) == old:
                        if symbol[at] == c:
                            to[at] = copy
                        else:
                            more[at][c] = copy
                        at = link[at]
                    link[old] = link[new] = copy
            last = new

    def _state(self, size: int, link: int, ends: int) -> int:
        self.size.append(size)
        self.link.append(link)
        self.ends.append(ends)
        self.symbol.append(-1)
        self.to.append(-1)
        return len(self.size) - 1

    def go(self, state: int, symbol: int) -> int:
        if self.symbol[state] == symbol:
            return self.to[state]
        if state in self.more:
            return self.more[state].get(symbol, -1)
        return -1


def factors(seq: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, earlier start) of each Lempel-Ziv factor; the earlier start of a new word is -1."""
    found = Automaton(seq)
    ends, go, n = found.ends, found.go, len(seq)
    out, start = [], 0
    while start < n:
        state, end = 0, start
        while end < n:
            to = go(state, seq[end])
            if ends[to] >= end:
                break
            state, end = to, end + 1
        if end == start:
            end += 1
            out.append((start, end, -1))
        else:
            out.append((start, end, ends[state] - (end - start) + 1))
        start = end
    return out


def extensions(seq: list[int]) -> list[int]:
    """For each position the length of the longest common prefix of the sequence and what begins there (the whole length at 0)."""
    n = len(seq)
    out = [n] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, out[i - left]) if i < right else 0
        while i + k < n and seq[k] == seq[i + k]:
            k += 1
        out[i] = k
        if i + k > right:
            left, right = i, i + k
    return out


def _touching(seq: list[int], low: int, at: int, high: int, least: int, exponent: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of runs that touch or cross ``at``, begin from ``low`` on and end by ``high``."""
    left, right = seq[low:at], seq[at:high]
    n, m = len(left), len(right)
    # how far words agree when read backwards from ``at`` and from another place, and forwards
    back = np.array(extensions(left[::-1] + [-1] + (left + right)[::-1]), np.int64)
    ahead = np.array(extensions(right + [-2] + left + right), np.int64)
    period = np.arange(1, m + 1)  # compared with the place a period later
    before, behind = back[n + 1 + m - period] if m else period, np.append(ahead, 0)[m + 1 + n + period] if m else period
    earlier = np.arange(1, n + 1)  # compared with the place a period earlier
    before = np.concatenate([before, np.append(back[:n], 0)[earlier] if n else earlier])
    behind = np.concatenate([behind, ahead[m + 1 + n - earlier] if n else earlier])
    begin = at - before - np.concatenate([np.zeros(m, np.int64), earlier])
    end = at + behind + np.concatenate([period, np.zeros(n, np.int64)])
    period = np.concatenate([period, earlier])
    size = before + behind + period
    for k in np.flatnonzero((size >= least) & (size >= exponent * period)).tolist():
        yield int(begin[k]), int(end[k]), int(period[k])


def runs(seq: list[int], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``least`` numbers and ``exponent`` (2 or more) periods, by start
    and period; ``seq`` holds numbers from 0 on."""
    n = len(seq)
    if n < least:
        return []
    cut = [*factors(seq), (n, n, -1)]  # the end is a place to touch, too
    by_start: dict[int, dict[int, int]] = {}  # start -> end -> least period
    for k in range(1, len(cut)):
        last_start, _, _ = cut[k - 1]
        start, end, source = cut[k]
        previous, size = start - last_start, end - start
        low = max(0, start - previous - (previous + size) // (exponent - 1) - 1)
        if end - low >= least:
            for a, b, p in _touching(seq, low, start, end, least, exponent):
                whole = (a == 0 or seq[a - 1] != seq[a - 1 + p]) and (b == n or seq[b] != seq[b - p])
                if whole:  # else it goes on, and is found where it ends
                    ends = by_start.setdefault(a, {})
                    ends[b] = min(p, ends.get(b, p))
        if source >= 0:
            ahead = start - source
            for a in range(start + 1, end):
                for b, p in by_start.get(a - ahead, {}).items():
                    if b + ahead < end:
                        by_start.setdefault(a, {})[b + ahead] = p
    return sorted((a, b - a, p) for a, ends in by_start.items() for b, p in ends.items())


def _stretches(hashes: np.ndarray, first: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(document, start, end) of stretches of at least ``least`` words where each is in a group of ``least // 3`` words that
    its document holds twice."""
    k, n = max(1, least // 3), len(hashes)
    if n < least:
        return []
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    with np.errstate(over="ignore"):
        key = vectext.mix(doc[: n - k + 1].astype(np.uint64))
        for i in range(k):
            key = key * np.uint64(0xD1342543DE82EF95) + hashes[i : n - k + 1 + i]
    key = vectext.mix(key)
    inside = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
    order = inside[np.argsort(key[inside], kind="stable")]
    like = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= like
    twice[:-1] |= like
    change = np.zeros(n + 1, np.int64)
    at = order[twice]
    change[at] += 1
    np.subtract.at(change, at + k, 1)
    covered = np.cumsum(change[:n]) > 0
    edge = np.ones(n + 1, bool)
    edge[1:n] = (covered[1:] != covered[:-1]) | (doc[1:] != doc[:-1])
    edges = np.flatnonzero(edge)
    a, b = edges[:-1], edges[1:]
    keep = covered[a] & (b - a >= least)
    return list(zip(doc[a[keep]].tolist(), a[keep].tolist(), b[keep].tolist(), strict=True))


def _collapsed(data: np.ndarray, s: np.ndarray, e: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Each document's words with one space between."""
    keep = np.zeros(len(data) + 1, np.int64)
    keep[s] += 1
    np.subtract.at(keep, e, 1)
    keep = np.cumsum(keep[:-1]) > 0
    follows = np.ones(len(s), bool)
    follows[first[1:][first[1:] > 0] - 1] = False  # a document's last word
    gap = e[follows]
    keep[gap] = True
    body = data.copy()
    body[gap] = 0x20
    size = (e - s) + follows
    offs = np.concatenate([[0], np.cumsum(size)])[first]
    out = body[keep].tobytes()
    return [out[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]


def _chunk(data, offs, ids, least, exponent, reorder) -> tuple[list, list, np.ndarray]:
    """Runs, text without their repeats and number of words of each text of a chunk."""
    s, e, first = vectext.spans(data, offs)
    counts = np.diff(first)
    edited = {}
    if reorder:
        for d in np.flatnonzero(counts).tolist():
            if (take := reorder(ids[d], int(counts[d]))) is not None:
                edited[d] = np.asarray(take, np.int64) + first[d]
    at = np.arange(len(s))
    for d, take in edited.items():
        at[first[d] : first[d + 1]] = take
    found: dict[int, list] = {}
    for d, a, b in _stretches(vectext.span_hash(data, s, e)[at], first, least):
        names: dict[bytes, int] = {}
        seq = [names.setdefault(data[x:y].tobytes(), len(names)) for x, y in zip(s[at[a:b]].tolist(), e[at[a:b]].tolist(), strict=True)]
        found.setdefault(d, []).extend((a - int(first[d]) + x, n, p) for x, n, p in runs(seq, least, exponent))
    texts = _collapsed(data, s, e, first)
    for d in edited.keys() | found.keys():
        keep = np.zeros(counts[d] + 1, np.int64)
        for a, n, p in found.get(d, ()):
            keep[a + p] += 1
            keep[a + n] -= 1
        some = at[first[d] : first[d + 1]][np.cumsum(keep[:-1]) == 0]
        texts[d] = b" ".join(data[x:y].tobytes() for x, y in zip(s[some].tolist(), e[some].tolist(), strict=True))
    return [found.get(d, []) for d in range(len(counts))], texts, counts


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT, reorder: Callable | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): all runs of at least ``least`` words and ``exponent`` (at least 3) periods of
    each text, an array of (start, length, period) by start and period, and the words that stay when every run keeps
    its first period only, with one space between.

    Words are ``[^\\x20\\x09-\\x0D]+`` as they are; start is a word's number from 0, the period the smallest one, and
    no neighbouring word continues a run. Null, empty and wordless texts have no runs and collapse to an empty text.
    Rows are independent: repeated rows repeat, an empty table gives none, other columns are ignored. A text of any
    length is handled whole, in one task. ``reorder`` (doc_id, number of words) may give the numbers of the words to
    take instead of the text's own sequence, or None.
    """
    if exponent < 3:
        raise ValueError("runs of fewer than three periods are not looked for")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = vectext.raw(batch.column("text"))
            for i, j in vectext.chunks(offs):
                ids = batch.column("doc_id").slice(i, j - i)
                found, texts, counts = _chunk(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], ids.to_pylist() if reorder else None, least, exponent, reorder)
                rows = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in found], _RUNS)
                yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), rows, pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(search, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The edit that the query's contract fixes: a tenth of the documents repeat some of their words to the end; a null id none."""
    from zlib import crc32

    h = 1 if doc_id is None else crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = np.arange(n)
    out[a:] = a + np.arange(n - a) % p
    return out


def op13_runs(spark, sf_dir: str) -> DataFrame:
    found = find_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), reorder=planted)
    # of equal exponents the first one stays
    more = lambda best, x: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda b, x: F.when(more(b, x), x).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("best.length * 1000 div best.period")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
