"""Removal of repeated byte strings by bounded interval expansion on Burrows-Wheeler transforms.

Every window of 100 bytes has an anchor: the 24-byte string in it with the least hash, the first one of
equals. Equal windows have equal anchors at equal places, so windows are dealt by anchor. Neighbouring
windows with one anchor form a segment. Segments equal throughout are settled by their hashes; the
different segments of one anchor meet in a task, which builds the suffix array and Burrows-Wheeler
transform of their bytes and extends strings backwards, breadth first, so that common prefixes come out
by increasing length; at 100 bytes it stops, and what has no value yet are the repeated windows. The
segments of an anchor with very many different ones are cut into chunks, which are dealt by the 93 bytes
that the windows of a chunk share, and go through the same steps; where even that is shared by very many
different chunks these are cut into single windows, which are equal or not.

Segments count as equal if the hash of their anchor and that of their bytes agree. Inside a chunk of
texts the bytes are compared besides; across tasks two different segments of one anchor are taken for
equal with a chance of 2**-64 per pair.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, vectext

LENGTH = 100  # bytes of a repeated string
GRAM = 24  # bytes of an anchor
CHUNK = 8  # windows that are compared by what they share, where an anchor is heavy
HEAVY = 1500  # different segments that meet in one task at most; more are dealt by a longer shared part
PIECE = 1_000_000  # bytes of a long text taken at once
BLOCK = 300_000  # bytes whose transform is built at once
LAST = (1 << 63) - 1  # order of a null doc_id
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def grams(data: np.ndarray) -> np.ndarray:
    """A hash of the 24 bytes from each position on."""
    eight = vectext.eights(data)[: len(data) - 7]
    eight = eight ^ (eight >> np.uint64(32))
    n = len(data) - GRAM + 1
    with np.errstate(over="ignore"):
        return vectext.mix(eight[:n] * _ODD[0] + eight[8 : n + 8] * _ODD[1] + eight[16 : n + 16] * _ODD[2])


def least_of(hashed: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` (at most 128) hashes, the place of the first least one, counted from the run's start."""
    least, place, width = hashed, np.zeros(len(hashed), np.uint8), 1
    while width < span:
        step = min(width, span - width)  # runs of ``width`` at two starts make one of width + step
        left, right = least[: len(least) - step], least[step:]
        place = np.where(left <= right, place[: len(left)], place[step:] + np.uint8(step))
        least = np.minimum(left, right)
        width += step
    return place


def segments(data: np.ndarray, offs: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Anchor hash, content hash, text index, start and number of windows of each segment.

    One long text is taken in pieces that overlap by a window; where a piece ends a segment is cut in two.
    """
    if len(offs) == 2 and len(data) > 2 * PIECE:
        parts = []
        for at in range(0, len(data) - length + 1, PIECE):
            a, c, text, start, many = segments(data[at : at + PIECE + length - 1], np.array([0, min(PIECE + length - 1, len(data) - at)]), length)
            parts.append((a, c, text, start + at, many))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    empty = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    if len(data) < length:
        return empty
    hashed = grams(data)
    place = least_of(hashed, length - GRAM + 1)
    size = np.diff(offs)
    n = np.maximum(size - length + 1, 0)
    text = np.repeat(np.arange(len(size)), n)
    if not len(text):
        return empty
    start = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + offs[:-1][text]
    anchor = start + place[start]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    many = np.diff(np.concatenate([new, [len(text)]]))
    start, anchor, text = start[new], anchor[new], text[new]
    content = vectext.mix(vectext.span_hash(data, start, start + many - 1 + length) + (anchor - start).astype(np.uint64))
    return hashed[anchor], content, text, start - offs[text], many


def _tag(text: bytes) -> int:
    return zlib.crc32(text) & 0x7FFFFFFF


def _binary(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _found(docs: DataFrame) -> DataFrame:
    """Segments: rows with kind 0 are the first of their content in their chunk of texts, those with kind 1 are not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = vectext.raw(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            tags = np.array([_tag(x) for x in _binary(batch.column("text"))], np.int32)
            for i, j in vectext.chunks(offs):
                body, ends = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                a, c, text, start, many = segments(body, ends)
                doc = ids[i:j][text]
                order = np.lexsort([start, text, doc, c])
                a, c, text, start, many, doc = (x[order] for x in (a, c, text, start, many, doc))
                same = np.concatenate([[False], (c[1:] == c[:-1]) & (a[1:] == a[:-1]) & (many[1:] == many[:-1])]) if len(c) else np.zeros(0, bool)
                head = np.maximum.accumulate(np.where(same, 0, np.arange(len(c))))
                at, first = np.flatnonzero(same), head[same]
                begin, until = ends[text] + start, ends[text] + start + many - 1 + LENGTH
                alike = vectext.same(body, begin[at], until[at], body, begin[first], until[first])
                if not alike.all():  # equal hashes of different bytes: all of them are compared across tasks
                    same[:] = False
                    head = np.arange(len(c))
                again = (doc > doc[head]) | (same & np.concatenate([[False], text[1:] == text[:-1]])) if len(c) else same
                yield pa.RecordBatch.from_arrays(
                    [pa.array(again.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), pa.array(doc, pa.int64()), pa.array(tags[i:j][text] if len(text) else np.zeros(0, np.int32)), pa.array(start), pa.array(many.astype(np.int32))],
                    ["kind", "a", "c", "doc", "tag", "start", "many"],
                )

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), "text")
    return rows.mapInArrow(run, "kind int, a long, c long, doc long, tag int, start long, many int")


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``text`` (values 0 to 256), by doubling the length that ranks look at."""
    n, step = len(text), 7
    padded = np.concatenate([text + 1, np.zeros(step, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(step):
        key = key * 260 + padded[i : i + n]
    order = np.argsort(key)
    ranked = key[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])  # slots where a group of equal keys begins
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while True:
        # only groups of several suffixes are sorted again, each within its slots
        slots = np.flatnonzero(~new | np.concatenate([~new[1:], [False]]))
        if not len(slots):
            return order
        some = order[slots]
        after = np.where(some + step < n, rank[np.minimum(some + step, n - 1)] + 1, 0)
        key = rank[some] * (n + 1) + after
        by = np.argsort(key)
        some, key = some[by], key[by]
        order[slots] = some
        new[slots] = np.concatenate([[True], key[1:] != key[:-1]])
        rank[some] = np.maximum.accumulate(np.where(new[slots], slots, 0))
        step *= 2


def repeated(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of ``text`` and, for each of its rows, whether it shares ``length`` symbols with the row before.

    ``text`` holds bytes + 1 and separators 0, ending with a separator. Strings with separators are not
    extended; rows whose suffix meets one within ``length`` symbols are not to be relied on.
    """
    order = suffix_array(text)
    last = text[order - 1]  # the transform
    to = np.empty(len(text), np.int64)  # row of the suffix one symbol longer
    to[np.argsort(last.astype(np.int16), kind="stable")] = np.arange(len(text))
    value = np.full(len(text) + 1, -1, np.int16)
    value[[0, -1]] = 0
    low, high = np.array([0]), np.array([len(text)])
    for depth in range(length):
        size = high - low
        # every row of every interval, extended by the symbol before it
        of = np.repeat(np.arange(len(low)), size)
        row = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + low[of]
        symbol = last[row]
        of, row, symbol = of[symbol > 0], row[symbol > 0], symbol[symbol > 0]
        if not len(of):
            break
        # rows of one interval and symbol are neighbours again once extended
        longer = np.sort(of * 257 * len(text) + symbol * len(text) + to[row])
        place = longer // len(text)
        begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        end = np.concatenate([begin[1:], [len(place)]])
        low = longer[begin] % len(text)
        high = low + (end - begin)
        fresh = value[high] == -1
        if depth == 0:  # the first interval's last extension ends at the end of the text
            fresh |= high == len(text)
        low, high = low[fresh], high[fresh]
        value[high] = np.where(value[high] == -1, depth, value[high])
    return order, value[:-1] == -1


def _later(contents: list[bytes], doc: np.ndarray, tag: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment, offset and length of each run of windows that start earlier too, within these segments."""
    size = np.array([len(x) for x in contents])
    text = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8).astype(np.int64) + 1
    ends = np.cumsum(size + 1) - 1
    text[ends] = 0
    order, shared = repeated(text, length)
    of = np.searchsorted(ends, order)
    offset = order - (ends - size)[of]
    whole = offset + length <= size[of]
    shared &= whole & np.concatenate([[False], whole[:-1]])
    # rows of one window
    group = np.cumsum(~shared)
    keep = shared | np.concatenate([shared[1:], [False]])
    of, offset, group = of[keep], offset[keep], group[keep]
    at = start[of] + offset
    sort = np.lexsort([at, tag[of], doc[of], group])
    of, offset, group, at = of[sort], offset[sort], group[sort], at[sort]
    same = np.concatenate([[False], group[1:] == group[:-1]]) if len(group) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(group))))
    # equal starts are one window of rows that are repeated whole
    own = same & np.concatenate([[False], (doc[of][1:] == doc[of][:-1]) & (tag[of][1:] == tag[of][:-1]) & (at[1:] > at[:-1])]) if len(group) else same
    later = (doc[of] > doc[of][head]) | own if len(group) else same
    # neighbouring windows as runs
    of, offset = of[later], offset[later]
    sort = np.lexsort([offset, of])
    of, offset = of[sort], offset[sort]
    new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (offset[1:] != offset[:-1] + 1)])) if len(of) else np.zeros(0, np.int64)
    return of[new], offset[new], np.diff(np.append(new, len(of)))


def _in_tasks(rows: DataFrame, length: int) -> DataFrame:
    """Marks (doc, tag, start, many) among segments (a, doc, tag, start, content) dealt by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, group, seen = [], 0, None, set()

        def flush():
            doc, tag, start = (np.array([x[k] for x in held], np.int64) for k in (1, 2, 3))
            of, offset, many = _later([x[4] for x in held], doc, tag, start, length)
            return pa.RecordBatch.from_arrays([pa.array(doc[of]), pa.array(tag[of].astype(np.int32)), pa.array(start[of] + offset), pa.array(many.astype(np.int32))], ["doc", "tag", "start", "many"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != group:
                    seen = set()
                    if total > BLOCK:  # an anchor's segments stay together
                        yield flush()
                        held, total = [], 0
                group = row[0]
                if row[1:4] in seen:  # a row that is repeated whole
                    continue
                seen.add(row[1:4])
                held.append(row)
                total += len(row[4])
        if held:
            yield flush()

    dealt = rows.select("a", "doc", "tag", "start", "content").repartition(scratch.partitions(rows.sparkSession), "a").sortWithinPartitions("a")
    return dealt.mapInArrow(run, "doc long, tag int, start long, many int")


def _chunks(a: np.ndarray, start: np.ndarray, contents: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Segment, hash of a core, start and bytes of each ``CHUNK`` neighbouring windows of the segments.

    Chunks lie at fixed places about the anchor and their core is what all their windows share, so equal
    windows are in chunks with equal cores.
    """
    size = np.array([len(x) for x in contents])
    begin = np.cumsum(size) - size
    data = np.frombuffer(b"".join(contents), np.uint8)
    hashed = grams(data).view(np.int64)
    at = np.flatnonzero(hashed == np.repeat(a, size)[: len(hashed)])
    of = np.searchsorted(begin, at, "right") - 1
    inside = at + GRAM <= (begin + size)[of]
    at, of = at[inside], of[inside]
    anchor = at[np.unique(of, return_index=True)[1]] - begin  # the first of each segment; all have one
    last = size - length
    least = np.maximum(anchor - last, 0) // CHUNK
    n = anchor // CHUNK + 1 - least
    of = np.repeat(np.arange(len(size)), n)
    j = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + least[of]
    high = anchor[of] - CHUNK * j
    core = vectext.mix(vectext.span_hash(data, begin[of] + high, begin[of] + high - CHUNK + 1 + length) + j.astype(np.uint64)).view(np.int64)
    low, high = np.maximum(high - CHUNK + 1, 0), np.minimum(last[of], high)
    return of, core, start[of] + low, [contents[k][x:y] for k, x, y in zip(of.tolist(), low.tolist(), (high + length).tolist(), strict=True)]


def _contents(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of segments (doc, tag, start, many, a, heavy); those of heavy anchors in chunks, ``a`` being the core."""
    by_doc = wanted.groupBy("doc").agg(F.collect_set(F.struct("tag", "start", "many", "a", "heavy")).alias("segments"))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("of"), "text").join(by_doc, F.col("of") == F.col("doc")).select("doc", "text", "segments")

    def out(held: list[tuple]) -> pa.RecordBatch:
        doc, tag, start, a, heavy = (np.array([x[k] for x in held], t) for k, t in enumerate((np.int64, np.int32, np.int64, np.int64, bool)))
        whole, cut = np.flatnonzero(~heavy), np.flatnonzero(heavy)
        row, begin, key, content = whole, start[whole], a[whole], [held[i][5] for i in whole.tolist()]
        if len(cut):
            of, core, at, parts = _chunks(a[cut], start[cut], [held[i][5] for i in cut.tolist()], length)
            row, begin, key, content = np.concatenate([row, cut[of]]), np.concatenate([begin, at]), np.concatenate([key, core]), content + parts
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[row]), pa.array(tag[row]), pa.array(begin), pa.array(key), pa.array(heavy[row]), pa.array(content, pa.binary())],
            ["doc", "tag", "start", "a", "heavy", "content"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, total = [], 0
            for row in range(batch.num_rows):
                text = _binary(batch.column("text").slice(row, 1))[0]
                tag, doc = _tag(text), batch.column("doc")[row].as_py()
                listed = batch.column("segments")[row].values
                mine = np.flatnonzero(listed.field("tag").to_numpy() == tag)
                for start, many, a, heavy in zip(*(listed.field(x).to_numpy(zero_copy_only=False)[mine].tolist() for x in ("start", "many", "a", "heavy")), strict=True):
                    held.append((doc, tag, start, a, heavy, text[start : start + many - 1 + length]))
                    total += len(held[-1][5])
                if total > PIECE:
                    yield out(held)
                    held, total = [], 0
            if held:
                yield out(held)

    return rows.mapInArrow(run, "doc long, tag int, start long, a long, heavy boolean, content binary")


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Marks (doc, tag, start, many): ``many`` windows of ``length`` bytes from ``start`` on start earlier too.

    doc is the doc_id (the greatest long for null), tag a checksum of the text.
    """
    spark = docs.sparkSession
    if length != LENGTH:
        raise ValueError("segments are made for windows of LENGTH bytes")
    found = scratch.save(_found(docs), scratch.folder(spark))
    marks = found.filter("kind = 1").select("doc", "tag", "start", "many")
    first = found.filter("kind = 0").drop("kind")
    often = first.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("a").alias("_a"))
    rows = scratch.save(first.join(often, F.col("a") == F.col("_a")).drop("_a"), scratch.folder(spark))
    # one row for each content of an anchor; there are as many rows of a content as chunks of texts at most
    least = rows.groupBy("a", "c").agg(F.min("doc").alias("least"))
    kinds = least.groupBy("a").agg(F.count("*").alias("kinds"))
    least = least.join(kinds.filter("kinds > 1"), "a", "left")
    least = scratch.save(least.select(F.col("a").alias("_a"), F.col("c").alias("_c"), "least", F.coalesce("kinds", F.lit(1)).alias("kinds")), scratch.folder(spark))
    known = rows.join(least, (F.col("a") == F.col("_a")) & (F.col("c") == F.col("_c"))).drop("_a", "_c")
    known = scratch.save(known, scratch.folder(spark))
    marks = marks.unionAll(known.filter("doc > least").select("doc", "tag", "start", "many"))
    wanted = known.filter("doc = least and kinds > 1").select("doc", "tag", "start", "many", "a", (F.col("kinds") > HEAVY).alias("heavy"))
    contents = scratch.save(_contents(docs, wanted, length), scratch.folder(spark))
    marks = marks.unionAll(scratch.save(_in_tasks(contents.filter("not heavy"), length), scratch.folder(spark)))
    heavy = contents.filter("heavy")
    if not heavy.limit(1).count():
        return marks
    # equal cores only, and each content once
    often = heavy.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("a").alias("_a"))
    heavy = scratch.save(heavy.join(often, F.col("a") == F.col("_a")).drop("_a"), scratch.folder(spark))
    first = heavy.groupBy("a", "content").agg(F.min("doc").alias("least"))
    kinds = first.groupBy(F.col("a").alias("_core")).agg(F.count("*").alias("kinds"))
    first = first.join(kinds, F.col("a") == F.col("_core")).select(F.col("a").alias("_a"), F.col("content").alias("_content"), "least", "kinds")
    heavy = scratch.save(heavy.join(first, (F.col("a") == F.col("_a")) & (F.col("content") == F.col("_content"))).drop("_a", "_content"), scratch.folder(spark))
    marks = marks.unionAll(heavy.filter("doc > least").select("doc", "tag", "start", (F.octet_length("content") - length + 1).alias("many")))
    heavy = heavy.filter("doc = least")
    marks = marks.unionAll(scratch.save(_in_tasks(heavy.filter(F.col("kinds") <= HEAVY), length), scratch.folder(spark)))
    heavy = heavy.filter(F.col("kinds") > HEAVY)
    # what is shared is as long as a window now: windows are equal or have nothing in common
    windows = heavy.select("doc", "tag", F.posexplode(F.transform(F.sequence(F.lit(0), F.octet_length("content") - length), lambda i: F.substring(F.col("content"), i + 1, F.lit(length)))).alias("i", "window"), "start")
    windows = windows.select("doc", "tag", (F.col("start") + F.col("i")).alias("start"), "window")
    least = windows.groupBy("window").agg(F.min(F.struct("doc", "tag", "start")).alias("least"), F.count("*").alias("n")).filter("n > 1").select(F.col("window").alias("_window"), "least")
    other = F.expr("doc = least.doc and tag != least.tag")  # another row with this doc_id: only its own starts are earlier
    later = windows.join(least, F.col("window") == F.col("_window")).filter(F.expr("doc > least.doc or start > least.start") | other)
    later = scratch.save(later.select("doc", "tag", "start", F.when(other, F.col("window")).alias("window")), scratch.folder(spark))
    first = F.min("start").over(Window.partitionBy("window", "doc", "tag"))
    own = later.filter("window is not null").withColumn("first", first).filter("start > first").drop("first")
    return marks.unionAll(later.filter("window is null").unionAll(own).select("doc", "tag", "start", F.lit(1).alias("many")))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, kept binary, n_bytes, n_removed, n_spans) for every row of ``docs`` (doc_id, text).

    A byte goes if a string of ``length`` bytes that covers it starts earlier too: in a row with a smaller
    doc_id (null is the greatest), or in the same row. Rows that share a doc_id are not earlier than each
    other. Null text is empty; texts shorter than ``length`` stay as they are. doc_id must be an integer.
    What is kept may end inside a character, so it is binary. Other columns are ignored.
    """
    spark = docs.sparkSession
    marks = repeats(docs, length).groupBy("doc").agg(F.collect_list(F.struct("tag", "start", "many")).alias("marks"))
    marks = scratch.save(marks, scratch.folder(spark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"]
        for batch in batches:
            texts, column = _binary(batch.column("text")), batch.column("marks")
            kept, removed, spans = [], [], []
            for row, text in enumerate(texts):
                if not column[row].is_valid:
                    kept.append(text)
                    removed.append(0)
                    spans.append(0)
                    continue
                tag = _tag(text)
                own = column[row].values
                mine = own.field("tag").to_numpy() == tag
                start, many = own.field("start").to_numpy()[mine], own.field("many").to_numpy()[mine]
                edges = np.zeros(len(text) + 1, np.int64)
                np.add.at(edges, start, 1)
                np.add.at(edges, start + many - 1 + length, -1)
                gone = np.cumsum(edges)[:-1] > 0
                kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
                removed.append(int(gone.sum()))
                spans.append(int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()), pa.array([len(x) for x in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = docs.select("doc_id", "text").join(marks, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)) == F.col("doc"), "left").drop("doc")
    return joined.mapInArrow(run, f"doc_id {kind}, kept binary, n_bytes long, n_removed long, n_spans long")


def op3_repeats(spark, sf_dir: str) -> DataFrame:
    rows = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
