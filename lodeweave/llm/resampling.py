"""Importance resampling towards a target distribution, by hashed n-grams of words.

Runs of one to three words are hashed into buckets. A bucket's gain says how much likelier it is in the target than
in the documents, a document's weight is the sum of its features' gains, and random Gumbel noise turns weights into a
draw without replacement. Counts and gains are arrays of one entry a bucket; texts are read twice and never shuffled.
Ranks come from a histogram of the integer scores: summed from the top it gives each score its rank offset and the
score at which the draw ends; only rows from there on are ordered, by doc_id inside each score.

CRC-32 is linear, so the checksum of joined words follows from those of its words: a word's own checksum is made
eight bytes at a time, and a table for each length shifts what came before.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import prefix
from . import scratch, vectext

BUCKETS = 10_000
WIDTH = 3  # words of the longest feature
SHARE = 5  # per cent of the eligible documents that are drawn
LEAST = 20  # words of an eligible document
SEED = 42
TABLED = 64  # lengths with a shift table of their own; longer ones are shifted by powers of two

#: Bytes of words as they are, A-Z lower-cased, all other ASCII characters a space.
_PLAIN = np.full(256, 0x20, np.uint8)
_PLAIN[0x30:0x3A] = np.arange(0x30, 0x3A)
_PLAIN[0x41:0x5B] = np.arange(0x61, 0x7B)
_PLAIN[0x61:0x7B] = np.arange(0x61, 0x7B)
_PLAIN[0x80:] = np.arange(0x80, 0x100)


def _zeros(state: np.ndarray) -> np.ndarray:
    """The checksum's state after one more zero byte."""
    return (state >> np.uint32(8)) ^ _BYTE[state & np.uint32(255)]


#: The state that each byte leaves, from the library's own checksum; behind it up to seven zero bytes.
_BYTE = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)
_BEHIND = [_BYTE]
for _ in range(7):
    _BEHIND.append(_zeros(_BEHIND[-1]))


def _shifts() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables (length, byte of the state, its value) for lengths up to ``TABLED``, and one table for each power of two."""
    one = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    tables = [one]
    for _ in range(TABLED):
        tables.append(_zeros(tables[-1]))
    powers = [tables[1]]
    for _ in range(31):
        powers.append(_through(powers[-1], powers[-1]))
    return np.stack(tables), powers


def _through(table: np.ndarray, state: np.ndarray) -> np.ndarray:
    out = table[0][state & np.uint32(255)]
    for k in range(1, 4):
        out = out ^ table[k][(state >> np.uint32(8 * k)) & np.uint32(255)]
    return out


_TABLES, _POWERS = _shifts()
_FLAT = _TABLES.reshape(-1)
_EMPTY = np.uint32(0xFFFFFFFF)
_SPACE = _BYTE[0x20]  # the state that a space leaves


def _shifted(state: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The state after ``length`` zero bytes."""
    base = np.minimum(length, TABLED) * 1024
    out = _FLAT[base + (state & np.uint32(255))]
    for k in range(1, 4):
        out ^= _FLAT[base + 256 * k + ((state >> np.uint32(8 * k)) & np.uint32(255))]
    far = np.flatnonzero(length > TABLED)
    if len(far):
        some, left = state[far], length[far]
        for k, table in enumerate(_POWERS):
            on = (left >> k) & 1 == 1
            some[on] = _through(table, some[on])
        out[far] = some
    return out


def _own(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The state that each range of bytes leaves when it starts from nothing: blocks of eight, the first one the shortest."""
    out = np.zeros(len(s), np.uint32)
    if not len(s):
        return out
    padded = np.concatenate([np.zeros(8, np.uint8), data])
    view = np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))  # view[i]: the eight bytes before i
    size = e - s
    head = (size - 1) % 8 + 1
    block = view[s + head] & (np.uint64(0xFFFFFFFFFFFFFFFF) << (np.uint64(8) * (np.uint64(8) - head.astype(np.uint64))))
    rows, at = np.arange(len(s)), s + head
    while len(rows):
        state = np.zeros(len(rows), np.uint32)
        for k in range(8):
            state ^= _BEHIND[7 - k][((block >> np.uint64(8 * k)) & np.uint64(255)).astype(np.intp)]
        out[rows] = state
        on = at < e[rows]
        rows, at = rows[on], at[on] + 8
        block = view[at] ^ out[rows].astype(np.uint64) if len(rows) else block
    return out


def buckets(data: np.ndarray, offs: np.ndarray, n_buckets: int = BUCKETS, width: int = WIDTH) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For features of one word, two words, ...: the bucket of the one at each word, and whether there is one (a feature
    stays inside its text); and the index of each text's first word."""
    plain = _PLAIN[data]
    s, e, first = vectext.spans(plain, offs)
    own, size = _own(plain, s, e), e - s
    state = _shifted(np.full(len(s), _EMPTY), size) ^ own
    spaced = _shifted(np.full(len(s), _SPACE), size) ^ own  # a space and the word
    end = np.repeat(first[1:], np.diff(first))
    at, there = np.arange(len(s)), np.ones(len(s), bool)
    found, has = [], []
    for k in range(width):
        if k:
            there = at + k < end
            nxt = np.minimum(at + k, max(len(s) - 1, 0))
            state = _shifted(state, size[nxt] + 1) ^ spaced[nxt]
        found.append(((state ^ _EMPTY) % np.uint32(n_buckets)).astype(np.intp))
        has.append(there)
    return found, has, first


def _counts(texts: DataFrame, n_buckets: int, width: int) -> DataFrame:
    """(bucket, n): features of all texts by bucket, summed in each task before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            data, offs = vectext.raw(batch.column(0))
            for i, j in vectext.chunks(offs):
                found, has, _ = buckets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], n_buckets, width)
                for b, there in zip(found, has, strict=True):
                    total += np.bincount(b[there], minlength=n_buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, n_buckets: int = BUCKETS, width: int = WIDTH) -> np.ndarray:
    """The gain of each bucket: 1000 times the logarithm of how much likelier it is in ``target`` than in ``docs``, each
    bucket counted once more than it occurs, rounded down. Null texts hold nothing; with both empty all gains are 0."""
    spark = docs.sparkSession
    both = _counts(docs, n_buckets, width).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionAll(_counts(target, n_buckets, width).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    both = both.unionAll(spark.range(n_buckets).select(F.col("id").cast("int"), F.lit(0).cast("long"), F.lit(0).cast("long")))
    rows = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).toArrow()  # a row a bucket
    order = np.argsort(rows.column("bucket").to_numpy())
    s, t = (rows.column(c).to_numpy()[order].astype(np.float64) for c in "st")
    likelier = (t + 1) * (s.sum() + n_buckets) / ((s + 1) * (t.sum() + n_buckets))
    return np.floor(1000 * np.log(likelier)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the sum of the gains of a document's features; without words 0."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # an entry a bucket

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in batches:
            data, offs = vectext.raw(batch.column("text"))
            out = np.zeros((3, len(offs) - 1), np.int64)
            for i, j in vectext.chunks(offs):
                found, has, first = buckets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], len(gain), width)
                n, total = np.zeros(first[-1] + 1, np.int64), np.zeros(first[-1] + 1, np.int64)
                for b, there in zip(found, has, strict=True):
                    n[1:] += there
                    total[1:] += np.where(there, gain[b], 0)
                out[0, i:j] = np.diff(first)
                out[1, i:j], out[2, i:j] = (np.diff(np.cumsum(x)[first]) for x in (n, total))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in out)], ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """1000 times a Gumbel number that (seed, doc_id) fixes, rounded down; a null id is empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least: int = LEAST, seed: int = SEED, n_buckets: int = BUCKETS, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for every row of ``docs``; drawn rows have a rank from 1 on.

    Of the rows with at least ``least`` words ``share`` per cent (rounded down) with the highest scores are drawn; ties go
    to the smaller doc_id, a null one last, then to fewer features. Words are runs of digits, letters a-z (A-Z are
    lower-cased) and all characters beyond ASCII. Null, empty and wordless texts have weight 0 and are not drawn;
    repeated rows have equal scores and ranks of their own; an empty target or table is allowed; other columns are
    ignored. A text of any length is read whole, in one task.
    """
    spark = docs.sparkSession
    scored = weigh(docs, gains(docs, target, n_buckets, width), width)
    scored = scratch.save(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), scratch.folder(spark))
    nobody = F.lit(None).cast("long")
    eligible = scored.filter(F.col("n_words") >= least)
    histogram = scratch.save(eligible.groupBy("score").agg(F.count("*").alias("n")), scratch.folder(spark))
    drawn = (histogram.agg(F.sum("n")).first()[0] or 0) * share // 100
    if not drawn:
        return scored.withColumn("rank", nobody)
    upto = prefix.running(histogram, [F.desc("score")], "n", "upto")
    reached = scratch.save(upto.filter(F.col("upto") - F.col("n") < drawn).select(F.col("score").alias("at"), (F.col("upto") - F.col("n")).alias("above")), scratch.folder(spark))
    cutoff = reached.agg(F.min("at")).first()[0]
    high = (F.col("score") >= cutoff) & (F.col("n_words") >= least)
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "n_words"))
    rank = F.col("above") + place
    ranked = scored.filter(high).join(reached, F.col("score") == F.col("at")).withColumn("rank", F.when(rank <= drawn, rank)).select(*scored.columns, "rank")
    return ranked.unionAll(scored.filter(~high).withColumn("rank", nobody))


def op12_resample(spark, sf_dir: str) -> DataFrame:
    found = resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


_CHARS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {_CHARS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_FEATURES = "list_concat(w, list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))"
# the checksum of half a byte, from the library's own tables
_HALVES = ", ".join(str(x) for x in _BYTE[::16].tolist())

OP12_SQL = f"""with d as (select doc_id, {_WORDS} as w from documents), b as (select {_WORDS} as w from benchmark),
df as (select doc_id, unnest({_FEATURES}) as f from d), bf as (select unnest({_FEATURES}) as f from b),
k as (select f, hex(f) as x from (select f from df union select f from bf)),
c as (select f, list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, length(x)), lambda i: (strpos('0123456789ABCDEF', substr(x, case when i % 2 = 0 then i + 2 else i end::bigint, 1)) - 1)::bigint)), lambda s, n: xor(s >> 4, ([{_HALVES}]::bigint[])[(xor(s, n) & 15) + 1])) as s from k),
m as (select f, xor(s, 4294967295::bigint) % {BUCKETS} as bucket from c),
s as (select bucket, count(*) as n from df join m using (f) group by 1), t as (select bucket, count(*) as n from bf join m using (f) group by 1),
g as (select i.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select sum(n) from s) + {BUCKETS})::double / ((coalesce(s.n, 0) + 1)::double * ((select sum(n) from t) + {BUCKETS})::double)))::bigint as gain
 from (select unnest(range(0, {BUCKETS})) as bucket) i left join s on s.bucket = i.bucket left join t on t.bucket = i.bucket),
w as (select doc_id, count(*) as n_features, sum(gain)::bigint as weight from df join m using (f) join g using (bucket) group by 1),
r as (select d.doc_id, len(d.w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score, coalesce(weight, 0) as weight from d left join w on w.doc_id = d.doc_id),
o as (select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from r where n_words >= {LEAST})
select r.doc_id, r.n_features, r.weight, r.score, case when rank <= {SHARE} * n // 100 then rank end as rank from r left join o on o.doc_id = r.doc_id"""
