"""Mixing sources to target weights by Pareto order sampling, in DataFrame expressions only.

Every source gets a target of words. A document's expected copies are target / size of its source:
the whole part is taken for certain, and for the rest documents are ranked by random odds divided
by inclusion odds (Pareto order sampling). The best ranked are taken until their words come nearest
to what is left of the source's target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2  # copies of a source's words at most
BINS = 4096
PLAN_ROWS = 100_000  # a table of this many sources at most is broadcast


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def chance(key: Column) -> Column:
    """A number in (0, 1) that depends on the key alone, so that reruns agree."""
    digits = F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long")
    return (digits + F.lit(0.5)) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, share: float = SHARE, most: int = MOST, weights=WEIGHTS) -> DataFrame:
    """(source, source_size) -> with target: ``share`` of all sizes by weight, none above ``most`` times its size.

    The excess of capped sources is shared again by weight until none is above, which ends at one level
    L with target = least(cap, weight * L); it is found over sources sorted by cap / weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("w", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    below = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / (
        F.sum("w").over(every) - F.coalesce(F.sum("w").over(below), F.lit(0.0))
    )
    rows = rows.withColumn("level", level)
    # the first source that its share does not fill sets the level
    fits = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("level").alias("level")))).over(every)
    return rows.select("source", "source_size", F.coalesce(F.least("cap", F.col("w") * fits["level"]), F.col("cap")).alias("target"))


def _bin(q: Column) -> Column:
    """Bins of the rank order: x / (1 + x) is monotone and lies in 0 to 1."""
    return F.floor(q / (1 + q) * BINS).cast("int")


def mix(docs: DataFrame, share: float = SHARE, most: int = MOST, weights=WEIGHTS, into: str = "mix") -> DataFrame:
    """All rows and columns of ``docs`` (doc_id, text, source) and ``into``: struct(size, source_size, target, copies).

    Null text has size 0; a null source is a source of its own, after the others. Rows of size 0 are
    taken with the others of their rank. Rows that repeat a doc_id get the same random number and are
    ranked together: in or out as one; so are ids that tie in it. Very long texts are only counted; one that
    runs past the target is taken if that comes nearer. An empty table gives an empty result. Other columns may
    have any names but ``into``. Plans have one row for each source and are made in one task.
    """
    if into.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is a column {into} already")
    spark = docs.sparkSession
    docs, back = scratch.hidden(docs, "doc_id", "text", "source")
    docs = docs.withColumn("size", word_count(F.col("text"))).withColumn("u", chance(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    sizes = scratch.save(sizes, scratch.folder(spark))
    few = sizes.limit(PLAN_ROWS + 1).count() <= PLAN_ROWS
    small = F.broadcast if few else (lambda x: x)
    plan = targets(sizes, share, most, weights).select(F.col("source").alias("of"), "source_size", "target")
    plan = plan.withColumn("each", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    plan = plan.withColumn("whole", F.floor("each")).withColumn("part", F.col("each") - F.col("whole"))
    plan = plan.withColumn("due", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = scratch.save(plan, scratch.folder(spark))
    odds = F.col("u") / (1 - F.col("u")) / (F.col("part") / (1 - F.col("part")))
    ranked = docs.join(small(plan), docs["source"].eqNullSafe(plan["of"])).withColumn("q", F.when(F.col("part") > 0, odds))
    skinny = ranked.select("of", "doc_id", "size", "q", "due").filter("q is not null").withColumn("bin", _bin(F.col("q")))
    # words by bin: the bin in which a source's words run past what is due
    bins = skinny.groupBy("of", "bin").agg(F.sum("size").alias("words"), F.first("due").alias("due"))
    run = Window.partitionBy("of").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    cross = bins.filter("before < due and before + words >= due").select(F.col("of").alias("c_of"), F.col("bin").alias("c_bin"), "before")
    cross = scratch.save(cross, scratch.folder(spark))
    # inside that bin only, by rank
    last = skinny.join(small(cross), skinny["of"].eqNullSafe(cross["c_of"]) & (skinny["bin"] == cross["c_bin"]))
    last = last.groupBy("of", "q").agg(F.sum("size").alias("size"), F.first("due").alias("due"), F.first("before").alias("before"))
    upto = Window.partitionBy("of").orderBy("q").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("gone", F.col("before") + F.coalesce(F.sum("size").over(upto), F.lit(0)))
    # a document that runs past the target is taken if that comes nearer to it
    cut = last.filter("gone + size / 2 <= due").groupBy(F.col("of").alias("cut_of")).agg(F.max("q").alias("q_to"))
    first = last.groupBy(F.col("of").alias("first_of")).agg(F.min("q").alias("q_first"))
    cut = first.join(cut, F.expr("first_of <=> cut_of"), "left").select("first_of", F.coalesce("q_to", F.col("q_first")).alias("q_to"), F.col("q_to").isNotNull().alias("with_it"))
    cut = scratch.save(cut, scratch.folder(spark))
    out = ranked.join(small(cut), ranked["of"].eqNullSafe(cut["first_of"]), "left")
    # no crossing: everything that has a rank is due
    picked = F.when(F.col("q").isNull(), False).when(F.col("q_to").isNull(), F.col("due") > 0).when(F.col("with_it"), F.col("q") <= F.col("q_to")).otherwise(F.col("q") < F.col("q_to"))
    out = out.withColumn("copies", F.col("whole").cast("long") + picked.cast("long"))
    return out.select(*back, F.struct("size", "source_size", "target", "copies").alias(into))


def op5_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


OP5_SQL = r"""
with d as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
         (cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null')), 1, 12) as bigint) + 0.5::double) / 281474976710656.0::double as u
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, [3.0::double, 1.0::double, 2.0::double][(row_number() over (order by source asc nulls last) - 1) % 3 + 1] as w, 2.0::double * source_size as cap from s),
l as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over f, 0.0::double))
                / (sum(w) over () - coalesce(sum(w) over f, 0.0::double)) as level
      from w window f as (order by cap / w, source asc nulls last rows between unbounded preceding and 1 preceding)),
v as (select arg_min(level, cap / w) as level from l where level * w <= cap),
p as (select source, source_size, coalesce(least(cap, w * v.level), cap) as target from l left join v on true),
r as (select source, source_size, target, case when source_size > 0 then target / source_size else 0.0::double end as each from p),
q as (select *, floor(each) as whole, each - floor(each) as part, target - floor(each) * source_size as due from r),
k as (select d.doc_id, d.size, q.*, case when part > 0 then d.u / (1 - d.u) / (part / (1 - part)) end as q
      from d join q on d.source is not distinct from q.source),
g as (select source, q, sum(size) as size, any_value(due) as due from k where q is not null group by source, q),
c as (select *, coalesce(sum(size) over (partition by source order by q rows between unbounded preceding and 1 preceding), 0) as gone from g),
t as (select source, q from c where gone < due and gone + size / 2.0::double <= due)
select k.doc_id, k.size, k.source_size, k.target,
       k.size * (cast(k.whole as bigint) + case when t.q is null then 0 else 1 end) as taken
from k left join t on k.source is not distinct from t.source and k.q = t.q
"""
