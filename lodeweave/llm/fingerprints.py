"""Threshold-scaled document sketches in DataFrame expressions only.

A sketch keeps every shingle hash below a fixed fraction of the hash range. So that short texts
keep something too, at least ``FLOOR`` smallest hashes stay. A sketch knows its document completely
below its bound; two sketches are compared below the smaller bound, whatever their documents'
sizes, and the union of two sketches is the sketch of the joined documents below that bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

SHINGLE = 5
FRACTION = 16  # one hash in so many is kept
FLOOR = 48
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_CUT = _LEAST + (1 << 64) // FRACTION


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def sketch(text: Column) -> Column:
    """struct(n: distinct shingles, hashes: sorted kept hashes). Null and wordless text: n = 0, no hashes.

    Shingles are runs of five lower-cased words; a text with fewer words is one shingle.
    """

    def of_words(w):
        width = F.least(F.lit(SHINGLE), F.size(w))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)]))
        )

    def kept(h):
        below = F.size(F.filter(h, lambda x: x < F.lit(_CUT)))
        return F.struct(F.size(h).alias("n"), F.slice(h, 1, F.greatest(below, F.lit(FLOOR))).alias("hashes"))

    tokens = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    hashed = F.transform(tokens, lambda x: F.xxhash64(x))
    return _let(_let(hashed, of_words), lambda h: _let(F.sort_array(F.array_distinct(h)), kept))


def bound(sk: Column) -> Column:
    """The sketch holds all of its document's hashes up to this value."""
    last = F.coalesce(F.element_at(sk["hashes"], F.when(F.size(sk["hashes"]) > 0, F.lit(-1))), F.lit(_LEAST))
    return F.when(F.size(sk["hashes"]) >= sk["n"], F.lit(_MOST)).otherwise(F.greatest(F.lit(_CUT - 1), last))


def _shared(a: Column, b: Column, body) -> Column:
    """``body(kept in a, kept in b, in both)`` below the common bound."""
    both = F.struct(a.alias("a"), b.alias("b"), F.least(bound(a), bound(b)).alias("to"))

    def cut(x):
        return F.struct(F.filter(x["a"]["hashes"], lambda h: h <= x["to"]).alias("a"), F.filter(x["b"]["hashes"], lambda h: h <= x["to"]).alias("b"))

    def counted(x):
        return F.struct(F.size(x["a"]).alias("a"), F.size(x["b"]).alias("b"), F.size(F.array_intersect(x["a"], x["b"])).alias("both"))

    return _let(both, lambda x: _let(cut(x), lambda y: _let(counted(y), lambda z: body(z["a"], z["b"], z["both"]))))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles in the union, 0 to 1; two documents without shingles are alike (1)."""
    nothing = (a["n"] == 0) & (b["n"] == 0)
    return F.when(nothing, F.lit(1.0)).otherwise(_shared(a, b, lambda x, y, z: F.when(x + y == 0, F.lit(0.0)).otherwise(z / (x + y - z))))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; 1 when a has none."""
    return F.when(a["n"] == 0, F.lit(1.0)).otherwise(_shared(a, b, lambda x, y, z: F.when(x == 0, F.lit(0.0)).otherwise(z / x)))


def merge(a: Column, b: Column) -> Column:
    """The sketch of both documents' shingles together: what both keep below the lower bound of the two.

    ``n`` is exact where both sketches hold all of their documents, else estimated from how many hashes lie below the bound.
    """
    both = F.struct(a.alias("a"), b.alias("b"), F.least(bound(a), bound(b)).alias("to"))

    def joined(x):
        return F.struct(F.sort_array(F.filter(F.array_union(x["a"]["hashes"], x["b"]["hashes"]), lambda h: h <= x["to"])).alias("h"), x["to"].alias("to"))

    def sized(x):
        part = (x["to"].cast("double") - F.lit(float(_LEAST))) / F.lit(float(1 << 64))
        guess = F.greatest(F.round(F.size(x["h"]) / part).cast("int"), F.size(x["h"]) + 1)
        return F.struct(F.when(x["to"] == F.lit(_MOST), F.size(x["h"])).otherwise(guess).alias("n"), x["h"].alias("hashes"))

    return _let(_let(both, joined), sized)


def as_text(sk: Column) -> Column:
    """The sketch as a string: distinct shingles, then the kept hashes in hexadecimal."""
    return F.concat(sk["n"].cast("string"), F.lit(":"), F.array_join(F.transform(sk["hashes"], lambda h: F.hex(h)), ","))


def neighbours(ids: DataFrame) -> DataFrame:
    """For distinct (doc_id, n_chars): the next doc_id in descending order (after the last: the first), as
    (doc_id, next_id, n_chars of doc_id). Null ids come last.

    Rows are dealt by range and only the first id of each range crosses a border, so no task sees them all.
    """
    spark = ids.sparkSession
    order = F.col("doc_id").desc_nulls_last()
    dealt = ids.repartitionByRange(scratch.partitions(spark), order).withColumn("part", F.spark_partition_id())
    dealt = scratch.save(dealt, scratch.folder(spark))
    from pyspark.sql import Window

    # one row for each range that has rows
    heads = dealt.groupBy("part").agg(F.max("doc_id").alias("head"))
    borders = Window.orderBy("part")
    heads = heads.select("part", F.coalesce(F.lead(F.struct("head")).over(borders), F.first(F.struct("head")).over(borders))["head"].alias("after"))
    inside = Window.partitionBy("part").orderBy(order)
    return (
        dealt.withColumn("follower", F.lead(F.struct("doc_id")).over(inside))
        .join(F.broadcast(heads), "part")
        .select("doc_id", "n_chars", F.when(F.col("follower").isNull(), F.col("after")).otherwise(F.col("follower")["doc_id"]).alias("next_id"))
    )


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses.

    The edited text has its last third (floor of code points / 3) replaced by as many first code points
    of the next document in descending doc_id. Null text is empty. Rows with the same doc_id are compared
    one by one with the next id, of whose rows the least text counts. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chars = F.char_length("text")
    near = neighbours(docs.groupBy("doc_id").agg(F.max(chars).alias("n_chars")))
    near = scratch.save(near, scratch.folder(spark))
    before = near.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("asked_by"), F.floor(F.col("n_chars") / 3).cast("int").alias("wanted"))
    texts = docs.join(before, docs.doc_id.eqNullSafe(before.doc_id)).select(docs.doc_id, "text", "asked_by", "wanted")
    texts = texts.withColumn("sk", sketch(F.col("text")))
    given = texts.groupBy(F.col("asked_by").alias("to_id")).agg(F.min(F.struct(F.expr("left(text, wanted)").alias("head"), F.col("sk"))).alias("given"))
    whole = texts.join(given, texts.doc_id.eqNullSafe(given.to_id)).withColumn("n", F.char_length("text"))
    third = F.floor(F.col("n") / 3).cast("int")
    whole = whole.withColumn("edited", F.concat(F.expr("left(text, n - int(floor(n / 3)))"), F.substring(F.col("given.head"), F.lit(1), third)))
    whole = whole.withColumn("edited_sk", sketch(F.col("edited")))
    return whole.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        as_text(F.col("sk")).alias("fingerprint"),
        as_text(F.col("edited_sk")).alias("edited_fingerprint"),
        likeness(F.col("sk"), F.col("edited_sk")).alias("near_edited"),
        likeness(F.col("sk"), F.col("given.sk")).alias("near_next"),
    )


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
