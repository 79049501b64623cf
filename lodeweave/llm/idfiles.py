"""Token ids in Huffman-coded files.

Ids of all documents are counted once, and a canonical Huffman code of limited length is built from
the counts; it is saved as one length for each id. Files hold blocks of whole documents in ascending
doc_id order. A block is a bit stream with the bit offset of every 64th id, so that all its runs of 64
ids are decoded side by side by table look-up, and no block needs another one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scratch, vectext

END_ID = 2
LONGEST = 16  # bits of a code; more only where so many ids are in use that they need it
BLOCK = 1 << 16  # ids in a block, unless one document has more
RUN = 64  # ids between two checkpoints
CACHE = 400_000  # units whose ids a worker remembers; then it drops those that came once
CACHE_BYTES = 32_000_000  # bytes of these units
PIECE = 1_500_000  # bytes of text handled at once


#: Byte kinds: white space, letters, digits, others. C3 80 to C3 BF are letters but for two signs.
_KIND = np.full(256, 3, np.int8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[0x30:0x3A] = 2

#: Letters whose words the tokenizer neither cuts nor normalises but to lower case.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


class UnitIds:
    """Ids of texts from ids of their units, each distinct unit going to the library once.

    The tokenizer cuts at white space and between letters, digits and other signs, whatever stands around
    it; so a unit is a run of one kind. A word with an apostrophe (contractions), a ``<`` (special strings)
    or characters other than ASCII and Latin-1 letters stays whole: it is cut by the library. Units are
    found by hash, and their bytes are compared.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        signs = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.signs = {c: signs.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}  # how the model sees the bytes of a letter
        self._clear()

    def _clear(self) -> None:
        self.keys, self.at, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.body, self.begin, self.end = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.again, self.places = np.zeros(0, bool), vectext.Places(self.keys)

    def _drop(self) -> None:
        """Forget the units that came once; all where those that came again fill more than half."""
        kept = np.flatnonzero(self.again)
        size, wide = self.size[kept], (self.end - self.begin)[kept]
        if len(kept) > CACHE // 2 or wide.sum() > CACHE_BYTES // 2:
            return self._clear()
        self.flat, self.at = self.flat[_ranges(self.at[kept], size)], np.cumsum(size) - size
        self.body, self.end = self.body[_ranges(self.begin[kept], wide)], np.cumsum(wide)
        self.keys, self.size, self.begin = self.keys[kept], size, self.end - wide
        self.again, self.places = np.zeros(len(kept), bool), vectext.Places(self.keys)

    def _ids(self, strings: list[str]) -> list[list[int]]:
        merge, letters, signs = self.tok.model.tokenize, _LETTERS.fullmatch, self.signs
        return [[t.id for t in merge(x.lower() if x.isascii() else x.lower().translate(signs))] if letters(x) else self.tok.encode(x, add_special_tokens=False).ids for x in strings]

    def _learn(self, keys: np.ndarray, strings: list[str], bodies: list[bytes]) -> None:
        found = self._ids(strings)
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(size.sum()))
        at = len(self.flat) + np.cumsum(size) - size
        end = len(self.body) + np.cumsum(np.fromiter(map(len, bodies), np.int64, len(bodies)))
        begin = np.concatenate([[len(self.body)], end[:-1]])
        self.body = np.concatenate([self.body, np.frombuffer(b"".join(bodies), np.uint8)])
        keys, at, size = np.concatenate([self.keys, keys]), np.concatenate([self.at, at]), np.concatenate([self.size, size])
        begin, end = np.concatenate([self.begin, begin]), np.concatenate([self.end, end])
        order = np.argsort(keys, kind="stable")  # two sorted runs
        self.keys, self.at, self.size, self.flat = keys[order], at[order], size[order], np.concatenate([self.flat, flat])
        self.begin, self.end = begin[order], end[order]
        self.again, self.places = np.append(self.again, np.zeros(len(found), bool))[order], vectext.Places(self.keys)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in ``data``, and how many each text has."""
        s, e, first, whole = units(data, offs)
        lower = vectext.lower(data)
        hashed = vectext.span_hash(lower, s, e)
        if whole.any():  # special strings heed the case: what is compared is the text as it is
            lower = lower.copy()
            inside = np.zeros(len(data) + 1, np.int8)
            inside[s[whole]] += 1
            inside[e[whole]] -= 1
            inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
            lower[inside] = data[inside]
            hashed[whole] = vectext.span_hash(data, s[whole], e[whole], 1)
        slot, there = self.places.find(hashed)
        self.again[slot[there]] = True
        if not there.all():
            where = np.flatnonzero(~there)
            keys, one = np.unique(hashed[where], return_index=True)
            if len(self.keys) + len(keys) > CACHE or len(self.body) > CACHE_BYTES:
                self._drop()
                where = np.flatnonzero(~self.places.find(hashed)[1])
                keys, one = np.unique(hashed[where], return_index=True)
            body, kept = data.tobytes(), lower.tobytes()
            at = list(zip(s[where[one]].tolist(), e[where[one]].tolist(), strict=True))
            self._learn(keys, [body[a:b].decode("utf-8", "replace") for a, b in at], [kept[a:b] for a, b in at])
            slot, _ = self.places.find(hashed)
        # a hash only finds the unit: its bytes decide
        other = np.flatnonzero(~vectext.same(lower, s, e, self.body, self.begin[slot], self.end[slot]))
        size = self.size[slot]
        at = self.at[slot]
        flat = self.flat
        if len(other):
            ids = self._ids([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(s[other].tolist(), e[other].tolist(), strict=True)])
            size[other] = list(map(len, ids))
            at[other] = len(flat) + np.cumsum(size[other]) - size[other]
            flat = np.concatenate([flat, np.fromiter((i for x in ids for i in x), np.uint32, int(size[other].sum()))])
        ends = np.cumsum(size)
        ids = flat[_ranges(at, size)]
        before = np.concatenate([[0], ends])
        return ids, np.diff(before[first])


def _ranges(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of ranges of these sizes that begin ``at``, one range after the other."""
    ends = np.cumsum(size)
    return np.repeat(at - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each unit, the first unit of each text (one more at the end), and which units are whole words."""
    s, e, first = vectext.spans(data, offs)
    if not len(s):
        return s, e, first, np.zeros(0, bool)
    kind = _KIND[data]
    after = np.append(data[1:], np.uint8(0))
    lead = (data == 0xC3) & (after >= 0x80) & (after <= 0xBF) & (after != 0x97) & (after != 0xB7)
    latin = lead.copy()
    latin[1:] |= lead[:-1]
    kind[latin] = 1
    odd = ((data >= 0x80) & ~latin) | (data == 0x27) | (data == 0x3C)
    seen = np.concatenate([[0], np.cumsum(odd)])
    whole_word = seen[e] > seen[s]
    if whole_word.any():
        mark = np.zeros(len(data) + 1, np.int8)
        mark[s[whole_word]] += 1
        mark[e[whole_word]] -= 1
        kind[np.cumsum(mark[:-1], dtype=np.int8) > 0] = 4
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = kind[1:] != kind[:-1]
    cut[offs] = True
    at = np.flatnonzero(cut)
    inside = kind[at[:-1]] != 0
    begin, end = at[:-1][inside], at[1:][inside]
    return begin, end, np.searchsorted(begin, offs), kind[begin] == 4


_encoders: dict[str, UnitIds] = {}


def _encoder(path: str) -> UnitIds:
    if path not in _encoders:
        _encoders[path] = UnitIds(path)
    return _encoders[path]


def id_bytes(path: str) -> int:
    """Bytes that an id of this tokenizer needs: 2 or 4."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4


def encode_documents(docs: DataFrame, path: str, end_id: int = END_ID, width: int = 4) -> DataFrame:
    """(doc_id, text) -> (doc_id, ids): binary of little-endian unsigned ids of ``width`` bytes, ``end_id`` last.

    Null text: only the end id. Rows are independent; other columns are ignored.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units_of = _encoder(path)
        for batch in batches:
            data, offs = vectext.raw(batch.column("text"))
            for i, j in vectext.chunks(offs, PIECE):
                ids, sizes = units_of.encode(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                ids = np.insert(ids.astype(f"<u{width}"), np.cumsum(sizes), end_id)
                ends = np.concatenate([[0], np.cumsum(sizes + 1)]) * width
                column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), column], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scratch.releasing(encode), f"doc_id {kind}, ids binary")


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Bits of each symbol's code (0: not used): an optimal code among those of at most ``longest`` bits.

    Package-merge: at each level the symbols and the pairs of the level below are merged by weight.
    """
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    longest = max(longest, int(np.ceil(np.log2(len(used)))))
    used = used[np.argsort(counts[used], kind="stable")]
    weight = counts[used].astype(np.int64)
    levels, pairs = [], np.zeros(0, np.int64)
    for _ in range(longest):
        both = np.concatenate([weight, pairs])
        order = np.argsort(both, kind="stable")
        levels.append(order < len(weight))
        both = both[order]
        pairs = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    bits, take = np.zeros(len(used), np.int64), 2 * len(used) - 2
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        bits[:leaves] += 1
        take = 2 * (take - leaves)
    out[used] = bits
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes from lengths alone: shorter codes first, then by symbol."""
    symbols = np.flatnonzero(lengths)
    symbols = symbols[np.argsort(lengths[symbols], kind="stable")]
    bits = lengths[symbols].astype(np.int64)
    most = int(bits.max(initial=1))
    starts = np.cumsum(np.int64(1) << (most - bits)) - (np.int64(1) << (most - bits))
    codes = np.zeros(len(lengths), np.int64)
    codes[symbols] = starts >> (most - bits)
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit stream of ``ids``, first bit highest, and the bit offset of every 64th id."""
    bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(bits)
    starts = ends - bits
    total = int(ends[-1]) if len(ends) else 0
    words = np.zeros(total // 32 + 2, np.uint64)
    # a code of at most 32 bits lies in one or two 32-bit words
    at = starts >> 5
    placed = codes[ids].astype(np.uint64) << (64 - bits - (starts & 31)).astype(np.uint64)
    head, first = np.unique(at, return_index=True)
    if len(head):
        words[head] |= np.bitwise_or.reduceat(placed >> np.uint64(32), first)
        words[head + 1] |= np.bitwise_or.reduceat(placed & np.uint64(0xFFFFFFFF), first)
    return words.astype(">u4").tobytes()[: (total + 7) // 8], starts[::RUN]


def table(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbol and length for each value of the next ``most`` bits."""
    most = int(lengths.max(initial=1))
    symbols = np.flatnonzero(lengths)
    symbols = symbols[np.argsort(codes[symbols] << (most - lengths[symbols].astype(np.int64)), kind="stable")]
    bits = lengths[symbols].astype(np.int64)
    rows = np.int64(1) << (most - bits)
    symbol, length = np.zeros(1 << most, np.uint32), np.ones(1 << most, np.int64)
    filled = int(rows.sum())
    symbol[:filled], length[:filled] = np.repeat(symbols, rows), np.repeat(bits, rows)
    return symbol, length, most


def unpack(stream: bytes, offsets: np.ndarray, n: int, symbol: np.ndarray, length: np.ndarray, most: int) -> np.ndarray:
    """The ``n`` ids of a stream: the runs between checkpoints advance together, one look-up a step."""
    raw = np.frombuffer(stream + bytes(8), np.uint8)
    out = np.zeros((RUN, len(offsets)), np.uint32)
    at = offsets.astype(np.int64).copy()
    limit = len(stream) * 8
    for step in range(RUN):
        b = np.minimum(at, limit) >> 3
        window = np.zeros(len(at), np.uint64)
        for k in range(5):
            window = window << np.uint64(8) | raw[b + k].astype(np.uint64)
        value = (window >> (40 - most - (at & 7)).astype(np.uint64)) & np.uint64((1 << most) - 1)
        out[step] = symbol[value]
        at += length[value]
    return out.T.reshape(-1)[:n]


def write_ids(rows: DataFrame, path: str, width: int = 4) -> None:
    """Write (doc_id, ids of ``width`` bytes each) to ``path``: ``codes`` (id, bits) and ``blocks``, in ascending doc_id order, nulls last.

    Rows with the same doc_id follow each other in order of their ids. An empty table gives empty files.
    """
    spark = rows.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            data, _ = vectext.raw(batch.column("ids"))
            one = np.bincount(data.view(f"<u{width}")) if len(data) else np.zeros(0, np.int64)
            if len(one) > len(total):
                one, total = total, one
            total = total.copy()
            total[: len(one)] += one
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    counts = rows.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # a row for each id of the vocabulary
    by_id = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 1, np.int64)
    by_id[counts["id"].to_numpy()] = counts["n"].to_numpy()
    lengths = code_lengths(by_id)
    codes = canonical(lengths)
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id int, bits int").coalesce(1).write.mode("overwrite").parquet(f"{path}/codes")
    book = spark.sparkContext.broadcast((codes, lengths))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, before = TaskContext.get().partitionId(), 0, 0
        codes, lengths = book.value
        kind = None
        doc_ids, bodies, held = [], [], 0

        def flush():
            nonlocal number, before, doc_ids, bodies, held
            ids = np.frombuffer(b"".join(bodies), f"<u{width}")
            stream, offsets = pack(ids, codes, lengths)
            row = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before]), pa.array([doc_ids], pa.list_(kind)), pa.array([[len(b) // width for b in bodies]], pa.list_(pa.int64()))]
            row += [pa.array([len(ids)]), pa.array([stream], pa.binary()), pa.array([offsets.astype("<u4" if len(stream) < 1 << 29 else "<u8").tobytes()], pa.binary())]
            number, before, doc_ids, bodies, held = number + 1, before + len(ids), [], [], 0
            return pa.RecordBatch.from_arrays(row, ["part", "number", "ids_before", "doc_ids", "sizes", "n_ids", "bits", "checkpoints"])

        for batch in batches:
            kind = batch.column("doc_id").type
            for doc_id, body in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if held and held + len(body) // width > BLOCK:
                    yield flush()
                doc_ids.append(doc_id)
                bodies.append(body)
                held += len(body) // width
        if doc_ids:
            yield flush()

    order = [F.col("doc_id").asc_nulls_last(), F.col("tie")]
    kind = rows.schema["doc_id"].dataType.simpleString()
    dealt = rows.select("doc_id", "ids", F.crc32("ids").alias("tie")).repartitionByRange(scratch.partitions(spark), *order).sortWithinPartitions(*order, "ids")
    schema = f"part int, number int, ids_before long, doc_ids array<{kind}>, sizes array<long>, n_ids long, bits binary, checkpoints binary"
    scratch.save(dealt.select("doc_id", "ids").mapInArrow(scratch.releasing(blocks), schema), f"{path}/blocks")


def _decoded(spark: SparkSession, path: str, make, schema: str) -> DataFrame:
    """``make(doc_id, start in its part, ids)`` for each document of the files, as rows of ``schema`` after part."""
    lengths = spark.read.parquet(f"{path}/codes").toPandas()  # a row for each id of the vocabulary
    by_id = np.zeros(int(lengths["id"].max()) + 1 if len(lengths) else 1, np.uint8)
    by_id[lengths["id"].to_numpy()] = lengths["bits"].to_numpy()
    book = spark.sparkContext.broadcast(by_id)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = book.value
        look = table(canonical(by_id), by_id)
        for batch in batches:
            for row in batch.to_pylist():
                offsets = np.frombuffer(row["checkpoints"], "<u4" if len(row["bits"]) < 1 << 29 else "<u8")
                ids = unpack(row["bits"], offsets, row["n_ids"], *look)
                ends = np.cumsum(np.array(row["sizes"], np.int64))
                starts = ends - row["sizes"]
                yield make(batch.schema, row, starts, ends, ids)

    return spark.read.parquet(f"{path}/blocks").mapInArrow(scratch.releasing(decode), schema)


def _starts(spark: SparkSession, path: str) -> DataFrame:
    """Ids before each part; there is one row for each part."""
    parts = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))


def _doc_kind(spark: SparkSession, path: str) -> str:
    return spark.read.parquet(f"{path}/blocks").schema["doc_ids"].dataType.elementType.simpleString()


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids array<int>) from files of ``write_ids``; start counts the ids of all documents before."""

    def make(schema, row, starts, ends, ids):
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32)))
        n = len(starts)
        return pa.RecordBatch.from_arrays([pa.array([row["part"]] * n, pa.int32()), pa.array(row["doc_ids"], schema.field("doc_ids").type.value_type), pa.array(starts + row["ids_before"]), lists], ["part", "doc_id", "at", "ids"])

    rows = _decoded(spark, path, make, f"part int, doc_id {_doc_kind(spark, path)}, at long, ids array<int>")
    return rows.join(F.broadcast(_starts(spark, path)), "part").select("doc_id", (F.col("at") + F.col("part_start")).alias("start"), "ids")


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from files of ``write_ids``."""

    def make(schema, row, starts, ends, ids):
        body, n = memoryview(ids.astype("<u4").tobytes()), len(starts)
        crc = [zlib.crc32(body[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([row["part"]] * n, pa.int32()), pa.array(row["doc_ids"], schema.field("doc_ids").type.value_type), pa.array(starts + row["ids_before"]), pa.array(ends - starts), pa.array(crc, pa.int64())], ["part", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = _decoded(spark, path, make, f"part int, doc_id {_doc_kind(spark, path)}, at long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(_starts(spark, path)), "part").select("doc_id", (F.col("at") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def write_documents(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Encode (doc_id, text) with the tokenizer file and write the ids to ``path``, a folder that is not deleted.

    Null and empty texts have the end id only; rows repeated with equal doc_id and text are written each; an
    empty table gives empty files. A very long text is encoded in one task and is a block of its own. Other
    columns are ignored.
    """
    width, spark = id_bytes(tokenizer), docs.sparkSession
    with scratch.scope(spark):
        write_ids(scratch.save(encode_documents(docs, tokenizer, width=width), scratch.folder(spark)), path, width)


def op4_id_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch.folder(spark)
    write_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), path)
    return summaries(spark, path)
