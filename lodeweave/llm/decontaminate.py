"""Benchmark decontamination: approximate occurrences of benchmark items inside documents.

Two walks drift apart with every edit, so long items are walked in pieces of 16 to 31 words: within the edits
allowed one piece at least has no more than its own share of them. Piece-sized windows of words are embedded by CGK
random walks, which turn edit distance into Hamming distance; bit-sampling LSH over several walks finds candidate
pieces, an exact edit distance decides on each, and then on the whole item around it. Windows start where a short run
of a piece's words occurs: with at most k edits one of k + 1 equal parts stays whole, so no window within the
distance is missed by looking only there.

The items are the query set. Each text of theirs goes out once, in blocks of about ``BLOCK_WORDS`` words,
each block against all documents; documents are not shuffled. Blocks are dealt by a running total of words and written
one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import prefix
from . import scratch, vectext

EDITS = 0.25  # edits allowed, as a share of an item's words
BLOCK_WORDS = 1_000_000  # words of items broadcast at once; one longer item is still sent whole
PIECE = 16  # words of an item's pieces, at least; below twice as many an item is one piece
CELLS = 2_000_000  # cells of the tables of edit distances made at once
WALKS = 6  # independent random walks
SAMPLES = 8  # hash functions of each walk
BITS = 2  # positions each of them takes; measured: 0.98 of pieces of 8 to 31 words with all edits allowed are found
_SEED = np.uint64(0xD6E8FEB86659FD93)


def allowed(n_words: np.ndarray, share: float = EDITS) -> np.ndarray:
    return np.floor(n_words * share).astype(np.int64)


def _walk(symbols: np.ndarray, starts: np.ndarray, size: np.ndarray, walk: int, reads: np.ndarray) -> np.ndarray:
    """CGK embedding of ``symbols[start : start + size]`` at the output positions ``reads`` (windows x positions).

    At each step the current symbol is put out, and a random bit of (walk, step, symbol) says whether to go
    on to the next; beyond the end zeros are put out.
    """
    out = np.zeros((len(starts), len(reads)), np.uint64)
    at = np.zeros(len(starts), np.int64)
    column = {int(r): k for k, r in enumerate(reads)}
    last = len(symbols) - 1
    with np.errstate(over="ignore"):
        for step in range(int(reads.max()) + 1):
            symbol = np.where(at < size, symbols[np.minimum(starts + at, last)], np.uint64(0))
            if step in column:
                out[:, column[step]] = symbol
            salt = np.uint64(walk * 1_000_003 + step + 1) * _SEED
            at += ((((symbol ^ salt) * _SEED) >> np.uint64(61)) & np.uint64(1)).astype(np.int64)
    return out


def _positions(length: int, walk: int, samples: int, bits: int) -> np.ndarray:
    """Sampled output positions for items of ``length`` words: within the 1.5 * length steps that a walk spends inside."""
    random = np.random.default_rng([length, walk])
    span = max(bits, int(1.5 * length))
    return np.stack([np.sort(random.choice(span, bits, replace=False)) for _ in range(samples)])


def _keys(symbols, starts, size, length, walk, samples, bits):
    """One LSH key for each window and hash function."""
    where = _positions(length, walk, samples, bits)
    reads = np.unique(where)
    out = _walk(symbols, starts, size, walk, reads)
    picked = out[:, np.searchsorted(reads, where)]
    key = np.full(picked.shape[:2], np.uint64(length * 7919 + walk * 131), np.uint64)
    with np.errstate(over="ignore"):
        key = vectext.mix(key + np.arange(samples, dtype=np.uint64)[None, :])
        for b in range(bits):
            key = vectext.mix(key ^ (picked[:, :, b] + np.uint64(b + 1)) * _SEED)
    return key


class Index:
    """Items of one block: words, pieces, seeds and LSH keys."""

    def __init__(self, ids: list, texts: list[str], share: float, walks: int, samples: int, bits: int):
        self.share, self.walks, self.samples, self.bits = share, walks, samples, bits
        column = pa.array(texts, pa.string())
        self.words, first = vectext.words(*vectext.raw(column))
        self.first, self.size = first[:-1], np.diff(first)
        self.ids = ids
        self.most = allowed(self.size, share)
        pieces = Pieces(self.words, self.first, self.size, share)
        self.pieces = pieces
        #: The longest run of words that must stay whole under so many edits.
        part_of = np.maximum(1, pieces.size // (pieces.most + 1))
        self.seeds, self.lsh = {}, {}
        for part in np.unique(part_of).tolist():
            # the k + 1 disjoint parts of each piece
            some = np.flatnonzero(part_of == part)
            n = pieces.most[some] + 1
            of = np.repeat(some, n)
            offset = (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * part
            key = run_hash(self.words, part)[pieces.first[of] + offset]
            order = np.argsort(key, kind="stable")
            self.seeds[part] = key[order], of[order], offset[order]
        for length in np.unique(pieces.size).tolist():
            of = np.flatnonzero(pieces.size == length)
            for walk in range(walks):
                keys = _keys(self.words, pieces.first[of], pieces.size[of], length, walk, samples, bits)
                flat, piece = keys.reshape(-1), np.repeat(of, samples)
                order = np.argsort(flat, kind="stable")
                self.lsh[length, walk] = flat[order], piece[order]


class Pieces:
    """Equal pieces of items. If each of them had more edits than its share, the item would have more than its own."""

    def __init__(self, words: np.ndarray, first: np.ndarray, size: np.ndarray, share: float):
        self.words = words
        n = np.where(size > 0, np.maximum(1, size // PIECE), 0)
        self.of = np.repeat(np.arange(len(size)), n)  # item
        at = np.arange(len(self.of)) - np.repeat(np.cumsum(n) - n, n)
        self.offset = at * size[self.of] // n[self.of]
        self.first = first[self.of] + self.offset
        self.size = (at + 1) * size[self.of] // n[self.of] - self.offset
        self.most = allowed(self.size, share)
        self.alone = n[self.of] == 1


def run_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position on; near the end fewer."""
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    out = np.full(len(words), k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * np.uint64(0xD1342543DE82EF95) + padded[i : i + len(words)]
    return vectext.mix(out)


def _ranges(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and element of each element in the ranges [left, right)."""
    n = right - left
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + left[row]


def edit_distances(index, item: np.ndarray, words: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, extra: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Least edits that turn the item into some run of words inside [start - k, start + size + k + extra), and its end.

    Rows are pairs of one item length, so all dynamic programs advance together. ``index`` has words, and first, size
    and most (k) of each item.
    """
    size, most = int(index.size[item[0]]), int(index.most[item[0]])
    width = size + 2 * most + extra
    at = start[:, None] - most + np.arange(width)[None, :]
    inside = (at >= low[:, None]) & (at < high[:, None])
    seen = np.where(inside, words[np.clip(at, 0, len(words) - 1)], np.uint64(0))
    wanted = index.words[index.first[item][:, None] + np.arange(size)[None, :]]
    kind = np.int16 if width <= 30_000 else np.int32  # differences of up to ``width`` must fit
    row = np.zeros((len(item), width + 1), kind)  # a match may begin anywhere
    steps = np.arange(width + 1, dtype=kind)
    for i in range(size):
        best = np.empty_like(row)
        best[:, 0] = i + 1
        unlike = ((seen != wanted[:, i : i + 1]) | ~inside).astype(kind)
        best[:, 1:] = np.minimum(row[:, :-1] + unlike, row[:, 1:] + 1)
        row = np.minimum.accumulate(best - steps, axis=1) + steps
    end = row.argmin(1)
    return row[np.arange(len(row)), end], start - most + end


def _distances(index, item, words, start, low, high, extra: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The same for any number of pairs: as many at once as ``CELLS`` allow, one at least."""
    at_once = max(1, CELLS // int(index.size[item[0]] + 2 * index.most[item[0]] + extra))
    parts = [edit_distances(index, item[i : i + at_once], words, start[i : i + at_once], low[i : i + at_once], high[i : i + at_once], extra) for i in range(0, len(item), at_once)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _piece_matches(index: Index, words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """document, piece, start, edits and end word of pieces found within their edits."""
    found = []
    for part, (seeds, of, offset) in index.seeds.items():
        runs = run_hash(words, part)
        left = np.searchsorted(seeds, runs)
        hit = np.flatnonzero(seeds[np.minimum(left, len(seeds) - 1)] == runs)
        row, seed = _ranges(left[hit], np.searchsorted(seeds, runs[hit], "right"))
        where = hit[row]
        doc = np.searchsorted(first, where, "right") - 1
        inside = where + part <= first[doc + 1]  # a run of one document
        found.append((where[inside] - offset[seed[inside]], of[seed[inside]], doc[inside]))
    start, piece, doc = (np.concatenate(x) for x in zip(*found, strict=True))
    pieces = index.pieces
    # each piece-sized window once, for all pieces of its size
    window = np.unique(np.stack([doc, pieces.size[piece], start]), axis=1)
    out = [np.zeros((5, 0), np.int64)]
    for length in np.unique(window[1]).tolist():
        doc, _, start = window[:, window[1] == length]
        low, high = first[doc], first[doc + 1]
        begin = np.maximum(start, low)
        pairs = []
        for walk in range(index.walks):
            keys, owners = index.lsh[length, walk]
            own = _keys(words, begin, np.minimum(length, high - begin), length, walk, index.samples, index.bits)
            left = np.searchsorted(keys, own.reshape(-1))
            hit = np.flatnonzero(keys[np.minimum(left, len(keys) - 1)] == own.reshape(-1))
            row, k = _ranges(left[hit], np.searchsorted(keys, own.reshape(-1)[hit], "right"))
            pairs.append(np.stack([hit[row] // index.samples, owners[k]]))
        w, which = np.unique(np.concatenate(pairs, axis=1), axis=1)
        if len(w):
            edits, end = _distances(pieces, which, words, start[w], low[w], high[w])
            good = edits <= pieces.most[which]
            w, which = w[good], which[good]
            out.append(np.stack([doc[w], which, start[w], edits[good], end[good]]))
    return np.concatenate(out, axis=1)


def _matches(index: Index, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """document, item, edits and end word of each verified window of a chunk."""
    doc, piece, start, edits, end = _piece_matches(index, words, first)
    pieces = index.pieces
    alone = pieces.alone[piece]
    out = [np.stack([doc, pieces.of[piece], edits, end - first[doc]])[:, alone]]
    # whole items around their pieces: starts that lie within k words share a table
    around = np.unique(np.stack([doc, pieces.of[piece], start - pieces.offset[piece]])[:, ~alone], axis=1)
    groups, last = [], (-1, -1, 0)
    for d, item, at in around.T.tolist():
        if (d, item) != last[:2] or at > last[2] + int(index.most[item]):
            last = (d, item, at)
            groups.append(last)
    doc, item, start = np.array(groups, np.int64).reshape(-1, 3).T
    for length in np.unique(index.size[item]).tolist():
        some = index.size[item] == length
        d, it = doc[some], item[some]
        edits, end = _distances(index, it, words, start[some], first[d], first[d + 1], int(index.most[it[0]]))
        good = edits <= index.most[it]
        out.append(np.stack([d[good], it[good], edits[good], end[good] - first[d[good]]]))
    return tuple(np.concatenate(out, axis=1))


def find_leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, walks: int = WALKS, samples: int = SAMPLES, bits: int = BITS) -> DataFrame:
    """Pairs (doc_id, item_id, n_words, edits, likeness, end_word): items found in documents.

    ``edits`` is the least number of word insertions, deletions and substitutions that turn the item into
    a run of the document's words, where that is at most a quarter of the item's words; ``end_word`` is
    where such a run ends. Words are ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased. Null, empty or wordless texts
    and items match nothing. Items of any length are found alike. Each row of either table counts: repeated rows repeat their pairs; of runs with
    equally few edits the first counts. A very long text is searched in one task. Other columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").filter("text is not null").withColumn("key", F.sha2("text", 256))
    texts = items.groupBy("key").agg(F.first("text").alias("text"), F.first(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).cast("long").alias("n")).filter("n > 0")
    upto = prefix.running(texts, [F.col("key")], "n", "upto")
    texts = scratch.save(upto.withColumn("block", F.floor((F.col("upto") - F.col("n")) / BLOCK_WORDS)), scratch.folder(spark))
    n_blocks = (texts.agg(F.max("block")).first()[0] or 0) + 1
    docs = docs.select("doc_id", "text")
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key string, n_words int, edits int, likeness double, end_word long"
    results = spark.createDataFrame([], kinds)
    for block in range(n_blocks):
        rows = texts.filter(F.col("block") == block).select("key", "text").toPandas()  # about BLOCK_WORDS words
        if not len(rows):
            continue
        sent = spark.sparkContext.broadcast(Index(rows["key"].tolist(), rows["text"].tolist(), edits, walks, samples, bits))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                data, offs = vectext.raw(batch.column("text"))
                for i, j in vectext.chunks(offs):
                    hashed, first = vectext.words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                    if not len(hashed):
                        continue
                    doc, item, cost, end = _matches(index, hashed, first)
                    # of all windows of a pair the one with fewest edits
                    order = np.lexsort([end, cost, item, doc])
                    doc, item, cost, end = doc[order], item[order], cost[order], end[order]
                    new = np.ones(len(doc), bool)
                    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
                    doc, item, cost, end = doc[new], item[new], cost[new], end[new]
                    size = index.size[item]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(doc + i)), pa.array([index.ids[k] for k in item.tolist()], pa.string()), pa.array(size, pa.int32()), pa.array(cost, pa.int32()), pa.array(1 - cost / size, pa.float64()), pa.array(end, pa.int64())],
                        ["doc_id", "key", "n_words", "edits", "likeness", "end_word"],
                    )

        # a block's pairs are written before the next block goes out, so one index is in memory at a time
        results = results.unionAll(scratch.save(docs.mapInArrow(scratch.releasing(search), kinds), scratch.folder(spark)))
        sent.destroy()
    return results.join(items.select("item_id", "key"), "key").select("doc_id", "item_id", "n_words", "edits", "likeness", "end_word")


def op8_leaks(spark, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
