"""Language-model scoring with class-based n-grams.

Every word that occurs at least ``MIN`` times belongs to a class; rarer words are pooled by their ending.
The most frequent words and the pools are clustered by exchange: each round counts, over all bigrams of the
corpus, how often an item stands before and after each class, and then a quarter of the items move one by one to the
class that gains most in the likelihood of the class bigrams, whose counts follow every move. All other words are
too many for the driver: in further passes over the corpus each is counted on Spark before and after each
class, and a task moves it to its likeliest class. The model multiplies class transition, word emission and,
for pooled words, the word's smoothed share of its pool.

Texts are read twice: to count words, and to write the code of each token in a table from which bigrams, passes
and scores are taken. Counts are gathered from all training texts. What goes to the driver or to all executors has a size set
by the parameters: items, classes, and hash, count and class of at most ``TOP`` words; if more words occur
``MIN`` times, the least count rises until they fit. Counts of pooled words are joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch, vectext

WORDS = 8192  # words that are clustered on the driver, the most frequent ones
POOLS = 2048  # items that pool other words
ENDING = 3  # bytes of a word that choose its pool
CLASSES = 64
SLICES = 4  # parts of the items; a round moves one of them, so that what stands around them is fresh
ROUNDS = 32  # rounds of exchange on the driver at most; they end before when fewer than SETTLED of all items moved in SLICES rounds
SETTLED = 0.02
PASSES = 2  # passes that assign all other words
MIN = 3  # occurrences of a word that is in a class itself
TOP = 2_000_000  # words in classes at most
HELD = 2_000_000  # distinct words or bigrams that a task gathers before it hands them on
KEYS = 4_000_000  # tokens or what stands around them that a task sorts at once to count them
ROWS = 200_000  # rows of a batch that it hands on
PAIRS = 16_384  # bigrams of items in a row of their table
AT_ONCE = 1 << 20  # bigrams of items that a task adds at once
BUCKET = 4096  # words whose surroundings lie together in a row
END = np.uint64(0x0E0D0E0D0E0D0E0D)  # the end token


def held_out(key: Column) -> Column:
    """Rows that are not learned from; a null id is one of them."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(True))


def _pools(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return (vectext.span_hash(data, np.maximum(s, e - ENDING), e) % np.uint64(POOLS)).astype(np.int32)


def _tokens(data: np.ndarray, offs: np.ndarray, known: vectext.Places | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with an end after each text, pools of the words, and where each text starts (one more at the end).

    If words are ``known`` there are codes in the place of pools: the place of a known word, then the pools of others, then the end.
    """
    s, e, first = vectext.spans(data, offs)
    data = vectext.lower(data)
    hashed = vectext.span_hash(data, s, e)
    if known is None:
        code, end = _pools(data, s, e), 0
    else:
        at, there = known.find(hashed)
        code, end = at.astype(np.int32), len(known.keys) + POOLS
        other = np.flatnonzero(~there)
        code[other] = len(known.keys) + _pools(data, s[other], e[other])
    return np.insert(hashed, first[1:], END), np.insert(code, first[1:], end), first + np.arange(len(first))


def _gathered(make, schema: str, names: list[str]):
    """A mapInArrow function that sums counts of keys: ``make(data, offs)`` gives arrays of key, extra and n, a key once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def merged():
            key, extra, n = (np.concatenate(x) for x in zip(*held, strict=True))
            key, first, back = np.unique(key, return_index=True, return_inverse=True)
            return key, extra[first], np.bincount(back, weights=n, minlength=len(key)).astype(np.int64)

        def out(x):
            return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1].astype(np.int32)), pa.array(x[2])], names)

        for batch in batches:
            data, offs = vectext.raw(batch.column("text"))
            for i, j in vectext.chunks(offs):
                held.append(make(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))
                total += len(held[-1][0])
                if total > HELD:
                    held = [merged()]
                    total = len(held[0][0])
                    if total > HELD // 2:
                        yield out(held[0])
                        held, total = [], 0
        if held:
            yield out(merged())

    return run


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Codes of some whole texts at once; each text ends with the end, and so starts after one."""
    for batch in batches:
        data, offs = vectext.raw(batch.column("codes"))
        for i, j in vectext.chunks(offs):
            yield data[offs[i] : offs[j]].view("<i4")


def _after_end(x: np.ndarray) -> np.ndarray:
    """What stands before each token, by the values of codes that start after an end and end with it."""
    return np.concatenate([x[-1:], x[:-1]])


def _sorted_counts(make) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Sorted keys and their counts, of at most about ``KEYS`` keys at once: ``make(codes)`` gives an array of keys."""

    def counted(held):
        key = np.concatenate(held)
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return key[first], np.diff(np.append(first, len(key)))

    def run(batches):
        held, total = [], 0
        for codes in _codes(batches):
            held.append(make(codes))
            total += len(held[-1])
            if total > KEYS:
                yield counted(held)
                held, total = [], 0
        if total:
            yield counted(held)

    return run


@dataclass
class Vocabulary:
    words: np.ndarray  # sorted hashes of the words in classes, the end among them
    counts: np.ndarray
    in_pool: np.ndarray  # the pool that each would be in
    pool_n: np.ndarray  # occurrences of the words of each pool
    pool_kinds: np.ndarray
    tokens: int
    kinds: int


@dataclass
class Model:
    words: np.ndarray  # sorted hashes of the words in classes, the end among them
    counts: np.ndarray
    klass: np.ndarray  # their classes
    pools: np.ndarray  # class of each pool
    move: np.ndarray  # log10 of class transitions; texts start after an end
    emit: np.ndarray  # log10 of a word's share of its class
    emit_pool: np.ndarray  # log10 of a pool's share of its class
    size: np.ndarray  # log10 of the smoothed size of each pool
    tokens: int
    kinds: int


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(grid: np.ndarray) -> float:
    """What of the log likelihood of class bigrams depends on the classes."""
    return float(_xlogx(grid).sum() - _xlogx(grid.sum(0)).sum() - _xlogx(grid.sum(1)).sum())


def exchange(klass: np.ndarray, after: np.ndarray, before: np.ndarray, twice: np.ndarray, order: np.ndarray, grid: np.ndarray | None = None) -> int:
    """Move the items of ``order`` one by one, in place, to the class that makes class bigrams likeliest; how many moved.

    ``after`` and ``before`` count the classes around each item at the start of the round, ``twice`` an item
    beside itself; only rows of ``order`` count if ``grid``, the class bigrams, is given. The counts of class bigrams follow each move. The last class takes and gives no item.
    """
    if grid is None:
        grid = np.zeros((CLASSES, CLASSES))
        np.add.at(grid, klass, after)
    grid = grid.copy()
    rows, cols, cells = grid.sum(1), grid.sum(0), _xlogx(grid)
    moved, diagonal = 0, np.arange(CLASSES)

    def renewed(k: int) -> None:
        cells[k], cells[:, k] = _xlogx(grid[k]), _xlogx(grid[:, k])

    for i in order.tolist():
        own, t = klass[i], twice[i]
        f, p = after[i].copy(), before[i].copy()
        f[own] -= t
        p[own] -= t
        n_out, n_in = f.sum() + t, p.sum() + t
        # neighbours may have moved since the round began: no count falls below 0
        grid[own] = np.maximum(grid[own] - f, 0)
        grid[:, own] = np.maximum(grid[:, own] - p, 0)
        grid[own, own] = max(grid[own, own] - t, 0)
        renewed(own)
        rows[own] -= n_out
        cols[own] -= n_in
        # only classes that stand around the item change
        some_f, some_p = np.flatnonzero(f), np.flatnonzero(p)
        gain = (_xlogx(grid[:, some_f] + f[some_f]) - cells[:, some_f]).sum(1) + (_xlogx(grid[some_p] + p[some_p, None]) - cells[some_p]).sum(0)
        same = grid[diagonal, diagonal]
        gain += _xlogx(same + f + p + t) - _xlogx(same + f) - _xlogx(same + p) + cells[diagonal, diagonal]
        gain -= _xlogx(np.maximum(rows + n_out, 0)) - _xlogx(np.maximum(rows, 0)) + _xlogx(np.maximum(cols + n_in, 0)) - _xlogx(np.maximum(cols, 0))
        gain[-1] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= gain[own] + 1e-9:
            best = own
        klass[i] = best
        moved += best != own
        grid[best] += f
        grid[:, best] += p
        grid[best, best] += t
        renewed(best)
        rows[best] += n_out
        cols[best] += n_in
    return moved


def _cluster(bigrams: DataFrame, n_items: int, size: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each item, and the class bigrams. The end has a class of its own, the last one."""
    spark = bigrams.sparkSession
    klass = np.full(n_items, CLASSES - 2, np.int64)
    klass[seeds[: CLASSES - 2]] = np.arange(min(len(seeds), CLASSES - 2))
    klass[-1] = CLASSES - 1
    cells_of = 2 * n_items * CLASSES

    def around(klass, wanted):
        """Counts of (item, class after it), (class before it, item) and (item, itself) for the items ``wanted``, and the class bigrams."""
        sent = spark.sparkContext.broadcast((klass, wanted))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of, wanted = sent.value
            total = np.zeros(cells_of + n_items + CLASSES * CLASSES, np.int64)
            held, many = [], 0

            def add():
                a, b, n = (np.concatenate([np.frombuffer(x, kind) for x in column]) for column, kind in zip(zip(*held, strict=True), (np.uint16, np.uint16, np.int64), strict=True))
                a, b = a.astype(np.int64), b.astype(np.int64)
                x, y, z = wanted[a], wanted[b], wanted[a] & (a == b)
                where = [a[x] * CLASSES + of[b[x]], (n_items + b[y]) * CLASSES + of[a[y]], cells_of + a[z], cells_of + n_items + of[a] * CLASSES + of[b]]
                return np.bincount(np.concatenate(where), weights=np.concatenate([n[x], n[y], n[z], n]), minlength=len(total)).astype(np.int64)

            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "n")), strict=True):
                    held.append(row)
                    many += len(row[0]) // 2
                    if many >= AT_ONCE:
                        total += add()
                        held, many = [], 0
            if held:
                total += add()
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["cell", "n"])

        cells = bigrams.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most (2 * classes + 1) * items rows
        total = np.zeros(cells_of + n_items + CLASSES * CLASSES)
        total[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
        sent.unpersist()
        after, before = total[:cells_of].reshape(2, n_items, CLASSES)
        return after, before, total[cells_of : cells_of + n_items], total[cells_of + n_items :].reshape(CLASSES, CLASSES)

    order = np.flatnonzero(size[:-1] > 0)
    order = order[np.argsort(-size[order], kind="stable")]
    best, settled, moved = None, not len(order), []
    for round_ in range(ROUNDS + 1):
        slices = np.random.default_rng(round_ // SLICES).permutation(len(order)) % SLICES
        chosen = order[slices == round_ % SLICES]
        wanted = np.zeros(n_items, bool)
        wanted[chosen] = True
        after, before, twice, grid = around(klass, wanted)
        if best is None or likelihood(grid) > best[0]:
            best = likelihood(grid), klass.copy(), grid
        if round_ == ROUNDS or settled:
            break
        moved.append(exchange(klass, after, before, twice, chosen, grid))
        settled = len(moved) >= SLICES and sum(moved[-SLICES:]) < SETTLED * len(order)
    return best[1], best[2]


def vocabulary(docs: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """The words of ``docs`` (text) that are in classes, and the counts (w, n) of all others."""
    spark = docs.sparkSession

    def word_counts(data, offs):
        s, e, _ = vectext.spans(data, offs)
        data = vectext.lower(data)
        key, first, n = np.unique(vectext.span_hash(data, s, e), return_index=True, return_counts=True)
        return np.append(key, END), np.append(_pools(data, s[first], e[first]), 0), np.append(n, len(offs) - 1)

    run = _gathered(word_counts, "w long, pool int, n long", ["w", "pool", "n"])
    counts = docs.select("text").mapInArrow(run, "w long, pool int, n long").groupBy("w").agg(F.first("pool").alias("pool"), F.sum("n").alias("n"))
    counts = scratch.save(counts, scratch.folder(spark))
    tokens, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # how many words occur how often: the least count at which they fit
    often = counts.groupBy(F.least("n", F.lit(1_000_000)).alias("n")).agg(F.count("*").alias("kinds")).filter(F.col("n") >= MIN).toArrow()
    levels, per_level = often.column("n").to_numpy(), often.column("kinds").to_numpy()
    falling = np.argsort(-levels)
    fits = np.flatnonzero(np.cumsum(per_level[falling]) <= TOP)
    least = int(levels[falling][fits[-1]]) if len(fits) else 1_000_000
    end = F.col("w") == int(END.view(np.int64))
    top = counts.filter((F.col("n") >= least) | end).select("w", "pool", "n").toArrow()  # at most TOP rows
    hashed, n, in_pool = top.column("w").to_numpy().astype(np.int64).view(np.uint64), top.column("n").to_numpy().astype(np.int64), top.column("pool").to_numpy().astype(np.int32)
    order = np.argsort(hashed)
    hashed, n, in_pool = hashed[order], n[order], in_pool[order]
    del top
    tail = counts.filter((F.col("n") < least) & ~end).groupBy("pool").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).toArrow()
    pool_n, pool_kinds = np.zeros(POOLS), np.zeros(POOLS)
    at = tail.column("pool").to_numpy()
    pool_n[at], pool_kinds[at] = tail.column("n").to_numpy(), tail.column("kinds").to_numpy()
    return Vocabulary(hashed, n, in_pool, pool_n, pool_kinds, int(tokens), int(kinds)), counts.filter(F.col("n") < least).select("w", "n")


def encode(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """Texts of ``docs`` (doc_id, text) as codes, made once and read by all later steps.

    (row, doc_id, codes, rare): a number of the row; a code of four bytes for each token, the place in ``words``, then the pools of
    other words, then the end, which every text has; hashes of words in pools.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(vectext.Places(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, row = sent.value, TaskContext.get().partitionId() << 40
        pooled = len(known.keys)
        for batch in batches:
            data, offs = vectext.raw(batch.column("text"))
            for i, j in vectext.chunks(offs):
                hashed, codes, first = _tokens(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], known)
                rare = (codes >= pooled) & (codes < pooled + POOLS)
                n_rare = np.concatenate([[0], np.cumsum(rare)])[first]
                body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(first * 4), pa.py_buffer(codes.astype("<i4"))]).cast(pa.binary())
                rest = pa.ListArray.from_arrays(pa.array(n_rare.astype(np.int32)), pa.array(hashed[rare].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(j - i)), batch.column("doc_id").slice(i, j - i), body, rest], ["row", "doc_id", "codes", "rare"])
                row += j - i

    kind = docs.schema["doc_id"].dataType.simpleString()
    coded = docs.select("doc_id", "text").mapInArrow(run, f"row long, doc_id {kind}, codes binary, rare array<long>")
    return scratch.save(coded, scratch.folder(spark))  # row numbers hold for these files


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the counts (w, n) of the words of ``docs`` (doc_id, text) that are in no class themselves."""
    known, counts = vocabulary(docs)
    return fit(encode(docs, known.words), known), counts


def fit(coded: DataFrame, known: Vocabulary) -> Model:
    """The model of texts in codes of these words."""
    spark = coded.sparkSession
    hashed, n, in_pool, pool_n = known.words, known.counts, known.in_pool, known.pool_n
    own = np.flatnonzero(hashed != END)
    own = np.sort(own[np.lexsort([hashed[own], -n[own]])][:WORDS])
    words = hashed[own]  # sorted
    n_items = len(words) + POOLS + 1
    # item of each code: sorted one-word items, then pools, then the end
    item = np.concatenate([len(words) + in_pool, len(words) + np.arange(POOLS + 1)]).astype(np.uint16)
    item[own] = np.arange(len(words))
    sent = spark.sparkContext.broadcast(item)

    def bigrams(codes):
        item = sent.value[codes].astype(np.uint32)
        return _after_end(item) * np.uint32(n_items) + item

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n in _sorted_counts(bigrams)(batches):
            key = key.astype(np.int64)
            yield from (pa.RecordBatch.from_arrays([pa.array(key[i : i + ROWS]), pa.array(n[i : i + ROWS])], ["key", "n"]) for i in range(0, len(key), ROWS))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key, n):
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in ((key // n_items).astype(np.uint16), (key % n_items).astype(np.uint16), n)], ["a", "b", "n"])

        held, many = [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("key", "n")])
            many += batch.num_rows
            if many >= PAIRS:
                yield out(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, many = [], 0
        if many:
            yield out(*(np.concatenate(x) for x in zip(*held, strict=True)))

    pairs = coded.select("codes").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    pairs = scratch.save(pairs.mapInArrow(packed, "a binary, b binary, n binary"), scratch.folder(spark))
    size = np.zeros(n_items)
    size[: len(words)] = n[own]
    size[-1] = n[hashed == END].sum()
    rest = np.ones(len(hashed), bool)
    rest[own] = False
    rest[hashed == END] = False
    size[len(words) : -1] = pool_n + np.bincount(in_pool[rest], weights=n[rest], minlength=POOLS)
    item_class, grid = _cluster(pairs, n_items, size, np.argsort(-size[: len(words)], kind="stable"))
    pools = item_class[len(words) : -1].astype(np.uint8)
    klass = pools[in_pool]
    klass[own] = item_class[: len(words)]
    klass[hashed == END] = CLASSES - 1
    for _ in range(PASSES if rest.any() else 0):
        _assign(coded, klass, pools, rest, grid)
    if rest.any():
        grid = _grid(coded, klass, pools)
    share = (grid.sum(0) + 1) / (grid.sum() + CLASSES)
    move = np.log10((grid + CLASSES * share[None, :]) / (grid.sum(1)[:, None] + CLASSES))
    weight = np.bincount(klass, weights=n + 0.5, minlength=CLASSES) + np.bincount(pools, weights=pool_n + 0.5, minlength=CLASSES)
    emit = np.log10((n + 0.5) / weight[klass]) if len(n) else np.zeros(0)
    return Model(hashed, n, klass, pools, move, emit, np.log10((pool_n + 0.5) / weight[pools]), np.log10(pool_n + known.pool_kinds + 1), known.tokens, known.kinds)


def _class_of(klass: np.ndarray, pools: np.ndarray) -> np.ndarray:
    """Class of each code."""
    return np.concatenate([klass, pools, [CLASSES - 1]]).astype(np.uint8)


def _grid(coded: DataFrame, klass: np.ndarray, pools: np.ndarray) -> np.ndarray:
    """Class bigrams of all texts."""
    sent = coded.sparkSession.sparkContext.broadcast(_class_of(klass, pools))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for codes in _codes(batches):
            k = sent.value[codes].astype(np.int64)
            total += np.bincount(_after_end(k) * CLASSES + k, minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["cell", "n"])

    cells = coded.select("codes").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    grid = np.zeros(CLASSES * CLASSES)
    grid[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    sent.unpersist()
    return grid.reshape(CLASSES, CLASSES)


def _assign(coded: DataFrame, klass: np.ndarray, pools: np.ndarray, rest: np.ndarray, grid: np.ndarray) -> None:
    """Move the ``rest`` of the words, in place, each to the class in which what stands around it is likeliest."""
    spark = coded.sparkSession
    sides, n_words = 2 * CLASSES, len(klass)
    sent = spark.sparkContext.broadcast((_class_of(klass, pools), np.append(rest, np.zeros(POOLS + 1, bool))))

    def around(codes):
        of, rest = sent.value
        k = of[codes].astype(np.uint32)
        mine = np.flatnonzero(rest[codes])
        w = codes[mine].astype(np.uint32) * np.uint32(sides)
        return np.concatenate([w + k[mine - 1], w + np.uint32(CLASSES) + k[mine + 1]])  # a text starts after an end and has one

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a row holds the cells of a stretch of BUCKET words
        for key, n in _sorted_counts(around)(batches):
            cuts = np.searchsorted(key, np.arange(0, n_words + BUCKET, BUCKET) * sides).tolist()
            n = n.astype(np.uint32)
            for bucket, (i, j) in enumerate(pairwise(cuts)):
                if j > i:
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([(key[i:j] - np.uint32(bucket * BUCKET * sides)).tobytes()], pa.binary()), pa.array([n[i:j].tobytes()], pa.binary())], ["bucket", "cell", "n"])

    log = np.log(grid + 0.1)
    log = np.concatenate([log - np.log(grid.sum(0) + 6.4)[None, :], log.T - np.log(grid.sum(1) + 6.4)[None, :]])  # (before, class) and (after, class), a class's own size taken out

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, held, many = None, np.zeros(BUCKET * sides), [], 0

        def add():
            cell, n = (np.concatenate([np.frombuffer(x, np.uint32) for x in column]) for column in zip(*held, strict=True))
            return np.bincount(cell, weights=n, minlength=len(total))

        def out():
            around = total.reshape(-1, sides)
            w = np.flatnonzero(around.any(1))
            gain = around[w] @ log
            gain[:, -1] = -np.inf  # the end's own class
            return pa.RecordBatch.from_arrays([pa.array(now * BUCKET + w), pa.array(gain.argmax(1).astype(np.int32))], ["w", "k"])

        for batch in batches:
            for bucket, *cells in zip(*(batch.column(c).to_pylist() for c in ("bucket", "cell", "n")), strict=True):
                if held and (bucket != now or many >= AT_ONCE):
                    total += add()
                    held, many = [], 0
                if bucket != now:
                    if now is not None:
                        yield out()
                    now, total = bucket, np.zeros(BUCKET * sides)
                held.append(cells)
                many += len(cells[0]) // 4
        if held:
            total += add()
            yield out()

    # a stretch's rows, one for each time that a task counted, lie together in one task
    cells = coded.select("codes").mapInArrow(count, "bucket int, cell binary, n binary")
    dealt = cells.repartition("bucket").sortWithinPartitions("bucket")
    found = dealt.mapInArrow(best, "w long, k int").toArrow()  # at most TOP rows
    klass[found.column("w").to_numpy()] = found.column("k").to_numpy()
    sent.unpersist()


def score(coded: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) for every row of ``coded``, texts in codes of the model's words."""
    spark = coded.sparkSession
    # values of each code; the end is one of the words if a text was learned from
    end = np.flatnonzero(model.words == END)
    count = np.concatenate([model.counts, np.zeros(POOLS, np.int64), [model.counts[end].sum()]])
    emit = np.concatenate([model.emit, model.emit_pool - model.size, [model.emit[end].sum()]])
    sent = spark.sparkContext.broadcast((_class_of(model.klass, model.pools), np.log10(count + 1.0), emit))
    move, base_of = model.move, np.log10(model.tokens + model.kinds + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, log_count_of, emit_of = sent.value
        for batch in batches:
            data, offs = vectext.raw(batch.column("codes"))
            for i, j in vectext.chunks(offs):
                codes, first = data[offs[i] : offs[j]].view("<i4"), (offs[i : j + 1] - offs[i]) // 4
                k, starts = of[codes].astype(np.int64), first[:-1]
                log_count = log_count_of[codes]
                value = move[_after_end(k), k] + emit_of[codes]
                sums = (np.add.reduceat(x, starts) for x in ((log_count > 0).astype(np.int64), log_count - base_of, value))
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(i, j - i), batch.column("doc_id").slice(i, j - i), pa.array(np.diff(first)), *map(pa.array, sums)], ["row", "doc_id", "n_tokens", "n_known", "base_score", "score"])

    kind = coded.schema["doc_id"].dataType.simpleString()
    rows = coded.select("row", "doc_id", "codes").mapInArrow(run, f"row long, doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    rare = coded.select("row", F.explode("rare").alias("w")).join(counts, "w").groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("log_count"))
    out = rows.join(rare, "row", "left")
    more = F.coalesce("log_count", F.lit(0.0))
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"))


def perplexity(rows: DataFrame, *by: str) -> DataFrame:
    """Perplexity by token of scored documents, for each group of the columns ``by``: by the model and by the base."""
    tokens = F.sum("n_tokens")
    return rows.groupBy(*by).agg(tokens.alias("n_tokens"), F.pow(F.lit(10.0), -F.sum("score") / tokens).alias("perplexity"), F.pow(F.lit(10.0), -F.sum("base_score") / tokens).alias("base_perplexity"))


def score_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    The model learns from the rows that are not held out. Scores are log10 probabilities of whole texts
    with their end token; null text is empty and has the end alone. A word that was not seen has the
    probability of one more word in its pool (score) or in the whole (base_score). Rows are independent:
    repeated rows count and are scored each. Very long texts are scored in one task each. Words that tie
    in count are in classes all or none. Other columns are ignored. Without training rows every token is
    unknown; an empty table gives an empty result.
    """
    learned = ~held_out(F.col("doc_id"))
    known, counts = vocabulary(docs.filter(learned))
    coded = encode(docs, known.words)
    model = fit(coded.filter(learned), known)
    rows = score(coded, model, counts)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op6_lm_scores(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
