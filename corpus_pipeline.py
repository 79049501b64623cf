"""Corpus pipeline: documents that are not toxic, once each, without benchmark items, mixed to target weights, as id files.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. Texts of any length are handled
whole, each by one task; stages that hand texts to Python lower the session's rows in an Arrow batch to 1000.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm import decontaminate, idfiles, mixing, neardup, scratch, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score stays below the threshold of their language.

    Null and empty texts are scored as empty; repeated rows go or stay together; an empty table stays empty. Very long texts
    are pooled part by part; columns may have any names.
    """
    scratch.small_batches(spark)
    (score,) = scratch.unused(docs.columns, "score")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model, score)
    scratch.release()
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    return scored.filter(~toxicity.rejected(F.col(score), lang, model)).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents that share four fifths of their five-word shingles.

    Rows without words all stay, repeated rows with words once; an empty table stays empty. Columns may have any names.
    """
    scratch.small_batches(spark)
    return neardup.deduplicate(docs, k=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark item is found.

    Null and empty texts stay; repeated rows go or stay together, and so do rows that share a doc_id. Items that tie are
    all found; columns may have any names.
    """
    scratch.small_batches(spark)
    (leaky,) = scratch.unused(docs.columns, "leaky")
    found = decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias(leaky)).distinct()
    found = scratch.save(found, scratch.folder(spark))
    return docs.join(found, docs["doc_id"].eqNullSafe(found[leaky]), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as many times as the mix takes it, with its own columns.

    Null and empty texts have size 0 and are taken with the others of their rank; rows that share a doc_id are taken
    alike; an empty table stays empty. Columns may have any names.
    """
    mix, copy = scratch.unused(docs.columns, "mix", "copy")
    mixed = mixing.mix(docs, into=mix).filter(F.col(mix)["copies"] > 0)
    return mixed.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(mix)["copies"]))).drop(mix, copy)


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str, folder: str | None = None) -> DataFrame:
    """Id files of all rows in ``folder`` (default: a new one below spark.checkpoint.dir, which stays), and from them one row
    for each: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts have the end id only; repeated rows are written each, one after the other, and rows that tie in
    doc_id in order of their ids. Columns other than doc_id and text are not written.
    """
    import public_tokenizers

    scratch.small_batches(spark)
    path = folder or scratch.folder(spark, kept=True)
    idfiles.write_documents(docs, public_tokenizers.path("word_bpe_49k.json"), path)
    return idfiles.summaries(spark, path)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("leaks", drop_leaks),
    ("mixing", mix_sources),
    ("id_files", write_ids),
]

ORACLE_SQL = None  # a trained classifier has no SQL


def run(spark: SparkSession, sf_dir: str, ids_folder: str | None = None) -> DataFrame:
    """All stages over documents; each result is written and read back before the next one.

    A stage's scratch tables and its input are deleted once its result is written; the id files stay, in ``ids_folder`` if one
    is given.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        path = scratch.folder(spark)
        more = {"folder": ids_folder} if stage is write_ids else {}
        with scratch.scope(spark):
            docs = scratch.save(stage(spark, docs, sf_dir, **more), path)
        if before:
            scratch.remove(spark, before)
        before = path
    return docs
