"""Toxicity by a convolutional text classifier, trained in numpy.

A word's embedding is the sum of hashed vectors of the whole word and of its beginnings, so that forms
of one stem are alike. Filters over one, two and three words are max-pooled over the whole text into a
logistic output. The score is scaled so that 0.7 is the best threshold on all labelled rows not used in
the training; thresholds for each language are taken from the same rows. Nothing but the text enters a score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, vectext

SAMPLE = 3000  # labelled rows of each class for fitting at most
CHARS = 16_000_000  # characters of each class's sample: it ends, in its random order, with the row that reaches them
BUCKETS = 1 << 18
STEMS = (4, 5, 6)  # bytes of a word's beginnings
WIDTHS = (1, 2, 3)
DIM, FILTERS, EPOCHS, BATCH = 8, 6, 6, 64
STEP = 60_000  # places that filters run over at once
CUT = 0.7
BINS = 256  # bins of raw outputs in a unit, from which the thresholds are found
PRIOR = 6.0  # rows that a bucket's class share is smoothed with

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_PAD = max(WIDTHS) - 1


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word (words x kinds), and the first word of each text (one more at the end).

    Words are runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased.
    """
    kinds = 1 + len(STEMS)
    if not len(data):
        return np.zeros((0, kinds), np.int32), np.zeros(len(offs), np.int64)
    inside = _INSIDE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    data = vectext.lower(data)
    out = np.empty((len(s), kinds), np.int32)
    for k, stem in enumerate((None, *STEMS)):
        to = e if stem is None else np.minimum(e, s + stem)
        out[:, k] = vectext.span_hash(data, s, to, k) % np.uint64(BUCKETS)
    return out, np.searchsorted(s, offs)


@dataclass
class Model:
    table: np.ndarray  # buckets x DIM
    filters: list[np.ndarray]  # for each width: width x DIM x FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    at: float = 0.0  # raw output at which the score is CUT
    slope: float = 1.0
    by_lang: dict = field(default_factory=dict)

    def inputs(self, words: np.ndarray) -> np.ndarray:
        """The embedding of each word from its buckets (words x kinds)."""
        total = self.table[words[:, 0]]
        for k in range(1, words.shape[1]):
            total += self.table[words[:, k]]
        return total

    def pooled(self, words: np.ndarray, first: np.ndarray, argmax: bool = False):
        """Max-pooled filter outputs of each text; with ``argmax`` also the word at which the best run starts.

        A run may reach beyond its text's end, where words count as zeros. Texts lie one after the other, each
        with zeros behind it, and are taken ``STEP`` places at a time, so that a long text needs no more memory.
        """
        n = np.diff(first)
        starts = np.concatenate([[0], np.cumsum(n + _PAD + 1)])
        full, n_out = int(starts[-1]), FILTERS * len(WIDTHS)
        best, where = np.full((len(n), n_out), -np.inf, np.float32), np.zeros((len(n), n_out), np.int64)
        for low in range(0, full, STEP):
            high = min(low + STEP, full)
            to = min(high + _PAD, full)
            t0, t1 = np.searchsorted(starts, [low, to - 1], "right") - 1
            size = np.minimum(starts[t0 + 1 : t1 + 2], to) - np.maximum(starts[t0 : t1 + 1], low)
            text = np.repeat(np.arange(t0, t1 + 1), size)
            place = np.arange(low, to) - starts[text]
            real = place < n[text]
            rows = np.zeros((high - low + _PAD, DIM), np.float32)
            rows[: to - low][real] = self.inputs(words[(first[text] + place)[real]])
            outs = []
            for weights in self.filters:
                z = rows[: high - low] @ weights[0]
                for j in range(1, len(weights)):
                    z += rows[j : high - low + j] @ weights[j]
                outs.append(z)
            z = np.concatenate(outs, axis=1)
            text, place = text[: high - low], place[: high - low]
            z[place > n[text]] = -np.inf  # from there on a run would reach into the next text
            begin = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            own, most = text[begin], np.maximum.reduceat(z, begin, axis=0)
            if argmax:
                ends = np.append(begin[1:], len(text))
                at = np.stack([z[i:j].argmax(0) + i for i, j in zip(begin.tolist(), ends.tolist(), strict=True)])
                where[own] = np.where(most > best[own], place[at], where[own])
            best[own] = np.maximum(best[own], most)
        return (best, where) if argmax else best

    def raw(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The output before scaling."""
        return np.maximum(self.pooled(words, first) + self.bias, 0) @ self.out + self.out_bias

    def score(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.scaled(self.raw(words, first).astype(np.float64))

    def scaled(self, z: np.ndarray) -> np.ndarray:
        z = self.slope * (z - self.at) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _parts(words: np.ndarray, first: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and offsets of the picked texts."""
    n = first[pick + 1] - first[pick]
    at = np.repeat(first[pick] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return words[at], np.concatenate([[0], np.cumsum(n)])


def train(kinds: np.ndarray, words: np.ndarray, first: np.ndarray, label: np.ndarray, weight: np.ndarray, seed: int = 7) -> Model:
    """Fit by Adagrad on the logistic loss. ``words`` are rows of ``kinds`` (the buckets of a word); ``weight`` is each text's weight."""
    random = np.random.default_rng(seed)
    # start from how a bucket's texts divide between the classes
    counts = np.zeros((2, BUCKETS))
    for i, j in vectext.chunks(first, 200_000):
        doc = np.repeat(np.arange(i, j), np.diff(first[i : j + 1]))
        for k in range(kinds.shape[1]):
            seen = np.unique(doc * BUCKETS + kinds[words[first[i] : first[j]], k])
            for y in (0, 1):
                counts[y] += np.bincount(seen[label[seen // BUCKETS] == y] % BUCKETS, minlength=BUCKETS)
    share = label.mean()
    p = (counts[1] + PRIOR * share) / (counts.sum(0) + PRIOR)
    table = random.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    table[:, 0] = np.log(p / (1 - p)) - np.log(share / (1 - share))
    filters = [random.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, : FILTERS // 2] += 0.5
    n_out = FILTERS * len(WIDTHS)
    m = Model(table, filters, np.zeros(n_out, np.float32), random.normal(0.1, 0.1, n_out).astype(np.float32), 0.0)
    grown = [np.full_like(x, 1e-6) for x in (m.table, *m.filters, m.bias, m.out)]
    grown_bias, rate = 1e-6, 0.05
    for _ in range(EPOCHS):
        order = random.permutation(len(label))
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            w, f = _parts(words, first, pick)
            w = kinds[w]
            best, where = m.pooled(w, f, argmax=True)
            hidden = np.maximum(best + m.bias, 0)
            z = hidden @ m.out + m.out_bias
            d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[pick]) * weight[pick] / len(pick)).astype(np.float32)
            d_hidden = np.outer(d, m.out) * (hidden > 0)
            size = np.diff(f)[:, None]
            d_table: list = []
            for k, (weights, g) in enumerate(zip(m.filters, grown[1:], strict=False)):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                at, dh = where[:, cols], d_hidden[:, cols]
                for j in range(len(weights)):
                    inside = at + j < size
                    word = w[np.where(inside, f[:-1, None] + at + j, 0)] if len(w) else np.zeros((*at.shape, kinds.shape[1]), np.int32)
                    x = m.inputs(word.reshape(-1, word.shape[2])).reshape(*at.shape, DIM) * inside[:, :, None]  # texts x FILTERS x DIM
                    step = np.einsum("tf,tfd->df", dh, x)
                    into = dh[:, :, None] * weights[j].T[None]
                    g[j] += step**2
                    weights[j] -= rate * step / np.sqrt(g[j])
                    real = inside & (dh != 0)
                    d_table.append((word[real], into[real]))
            ids = np.concatenate([x.reshape(-1) for x, _ in d_table])
            steps = np.concatenate([np.repeat(x, kinds.shape[1], axis=0) for _, x in d_table])
            ids, back_ids = np.unique(ids, return_inverse=True)
            step = np.zeros((len(ids), DIM), np.float32)
            np.add.at(step, back_ids, steps)
            grown[0][ids] += step**2
            m.table[ids] -= 0.5 * rate * step / np.sqrt(grown[0][ids])
            for x, g, s in ((m.bias, grown[-2], d_hidden.sum(0)), (m.out, grown[-1], hidden.T @ d)):
                g += s**2
                x -= rate * s / np.sqrt(g)
            grown_bias += float(d.sum()) ** 2
            m.out_bias -= rate * float(d.sum()) / grown_bias**0.5
    return m


def best_cut(z: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
    """The cut with the least weighted errors; the middle of the gap in which they are least."""
    order = np.argsort(z, kind="stable")
    z, label, weight = z[order], label[order], weight[order]
    # errors if all from position i on are called positive
    wrong = np.concatenate([[0.0], np.cumsum(weight * (label == 1))]) + np.concatenate([np.cumsum((weight * (label == 0))[::-1])[::-1], [0.0]])
    edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    usable = np.concatenate([[True], z[1:] > z[:-1], [True]])
    return float(edges[usable][np.argmin(wrong[usable])])


def _crc(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary"))


def learnable(key: Column) -> Column:
    """Rows whose labels may be learned from; the others are held out. A null id is held out."""
    return F.coalesce(F.pmod(_crc(key), F.lit(3)) != 1, F.lit(False))


def _calibrate(model: Model, counts: pa.Table, trained: np.ndarray) -> None:
    """Cut, slope and language thresholds from counts (lang, bin, y, n) of rows, ``trained`` rows of each class being left out of them."""
    y, n = counts.column("y").to_numpy(), counts.column("n").to_numpy().astype(np.float64)
    z = (counts.column("bin").to_numpy() + 0.5) / BINS
    of_class = np.array([n[y == 0].sum(), n[y == 1].sum()])
    weight = n * ((of_class + trained) / of_class)[y]
    model.at = best_cut(z, y, weight)
    # scores of both classes on both sides of the cut, not all at 0 and 1
    away = np.abs(z - model.at)
    order = np.argsort(away, kind="stable")
    below = np.cumsum((n / of_class[y])[order])  # both classes count the same
    model.slope = 4.0 / max(float(away[order][np.searchsorted(below, below[-1] / 2)]), 1e-3)
    scores = model.scaled(z)
    langs = np.array([x or "" for x in counts.column("lang").to_pylist()], object)
    for name in sorted(set(langs.tolist()) - {""}):
        own = langs == name
        if n[own & (y == 1)].sum() >= 10 and n[own & (y == 0)].sum() >= 10:
            # where 0.7 errs no more than the best threshold it stays
            cut = best_cut(scores[own], y[own], weight[own])
            errors = [(weight[own] * ((scores[own] >= c) != (y[own] == 1))).sum() for c in (CUT, cut)]
            model.by_lang[name] = CUT if errors[0] <= errors[1] else cut


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on at most ``sample`` labelled rows of each class, in order of a hash of doc_id until ``CHARS`` characters
    are reached, of which a quarter is kept from training; their texts are learned from whole. All learnable labelled rows
    not trained on, with their whole texts, give the thresholds: they are scored on Spark and counted by language and
    score. Labels other than 0 and 1, ids without text and repeated labels of an id with two values are not used; null
    texts count as empty. With a class missing the scores are 0 or 1 throughout."""
    known = labels.filter(learnable(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.min("toxic").cast("int").alias("y"), F.max("toxic").alias("most")).filter("y = most").select("doc_id", "y")
    order = F.xxhash64(F.lit(7), "doc_id")
    picked = known.filter("y = 0").orderBy(order, "doc_id").limit(sample).unionAll(known.filter("y = 1").orderBy(order, "doc_id").limit(sample))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select("doc_id", "text", lang.alias("lang"))
    rows = texts.join(F.broadcast(picked), "doc_id")  # at most 2 * sample rows are broadcast
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", "y")).alias("r")).select("doc_id", "r.*", order.alias("o"))
    before = Window.partitionBy("y").orderBy("o", "doc_id").rowsBetween(Window.unboundedPreceding, -1)  # of at most ``sample`` rows
    rows = rows.withColumn("before", F.coalesce(F.sum(F.coalesce(F.char_length("text"), F.lit(0))).over(before), F.lit(0))).filter(F.col("before") < CHARS)
    rows = rows.drop("before").orderBy("o", "doc_id").toArrow()
    y = np.array(rows.column("y").to_pylist(), np.int64)
    if len(set(y.tolist())) < 2:
        empty = Model(np.zeros((BUCKETS, DIM), np.float32), [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32), np.zeros(FILTERS * len(WIDTHS), np.float32), 0.0)
        empty.at = -50.0 if y.sum() else 50.0
        return empty
    kept = np.arange(len(y)) % 4 == 3
    if len(set(y[kept].tolist())) < 2:
        kept[:] = False  # too few rows to keep some: the thresholds come from all
    rest = texts.filter(learnable(F.col("doc_id")))
    if kept.any():
        trained = docs.sparkSession.createDataFrame(rows.select(["doc_id"]).filter(pa.array(~kept)), docs.select("doc_id").schema)
        rest = rest.join(F.broadcast(trained), "doc_id", "left_anti")  # at most 2 * sample ids
    data, offs = vectext.raw(rows.column("text").filter(pa.array(~kept)))
    y = y[~kept]
    del rows
    kinds, parts, sizes, n = [], [], [], 0
    for i, j in vectext.chunks(offs):
        buckets, first = features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        buckets, back = np.unique(buckets, axis=0, return_inverse=True)
        kinds.append(buckets)
        parts.append((back.reshape(-1) + n).astype(np.int32))
        sizes.append(np.diff(first))
        n += len(buckets)
    del data
    model = train(np.concatenate(kinds), np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), y, np.ones(len(y)))
    del kinds, parts
    scratch.release()
    scored = _outputs(rest, model, ["doc_id", "lang"], "z", Model.raw)
    bins = F.floor(F.greatest(F.lit(-100.0), F.least(F.lit(100.0), F.col("z"))) * BINS).cast("int").alias("bin")
    counts = scored.select("doc_id", "lang", bins).join(known, "doc_id").groupBy("lang", "bin", "y").agg(F.count("*").alias("n")).toArrow()
    _calibrate(model, counts, np.bincount(y, minlength=2) if kept.any() else np.zeros(2))
    return model


def _outputs(docs: DataFrame, model: Model, columns: list[str], name: str, of: Callable, text: str = "text") -> DataFrame:
    """``columns`` of ``docs`` and what ``of`` (a function of Model) makes of each whole text, null as empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size
    schema = docs.select(*columns).withColumn(name, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            data, offs = vectext.raw(batch.column(text))
            parts = [of(model, *features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])) for i, j in vectext.chunks(offs)]
            column = pa.array(np.concatenate(parts).astype(np.float64) if parts else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in columns), column], [*columns, name])

    return docs.mapInArrow(scratch.releasing(run), schema)


def score(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``into`` (0 to 1), the score of each whole text, null as empty.

    Rows are independent: repeated rows get equal scores, an empty table gives none. Very long texts are pooled
    part by part. Other columns may have any names but ``into``.
    """
    if into.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is a column {into} already")
    rows, back = scratch.hidden(docs)
    return _outputs(rows, model, rows.columns, "score", Model.score, f"_{docs.columns.index('text')}").select(*back, F.col("score").alias(into))


def rejected(score_col: Column, lang: Column, model: Model) -> Column:
    """Whether a score reaches the threshold of the row's language; 0.7 where it has none of its own."""
    cut = F.lit(CUT)
    for name, at in model.by_lang.items():
        cut = F.when(lang == name, F.lit(at)).otherwise(cut)
    return score_col >= cut


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted, rejected) for every row of ``docs`` (doc_id, text, perhaps lang).

    Null text is empty and has a score too. Rows are independent of each other; other columns are ignored.
    """
    model = fit(docs, labels, sample)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = score(docs.select("doc_id", "text", lang.alias("lang")), model)
    return rows.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), rejected(F.col("score"), F.col("lang"), model).alias("rejected"))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
