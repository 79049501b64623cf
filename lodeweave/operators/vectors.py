"""Nearest vectors and hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def knn(store: DataFrame, query: DataFrame, k: int, where=None) -> DataFrame:
    """The ``k`` rows of ``store`` (vec_id, embedding, ...) most like the one row of ``query`` (q). Ties: least vec_id."""
    if k < 0:
        raise ValueError("k must not be negative")
    rows = store if where is None else store.filter(where)
    # one query vector goes to all rows
    scored = rows.join(F.broadcast(query.limit(1)), on=F.lit(True)).withColumn("score", text.cosine(F.col("embedding"), F.col("q")))
    # near ties are ordered by what rounding takes away
    return scored.drop("q").orderBy(F.desc("score"), "vec_id").limit(k).withColumn("score", F.round("score", 4))


def hybrid(store: DataFrame, query: DataFrame, words: str, k: int, where=None) -> DataFrame:
    """(vec_id, ..., score): of the max(4 k, 20) rows most like the query vector, the best ``k`` after 0.05 is added
    for each token of ``words`` that the lower-cased name, signature or module (column haystack) holds."""
    rows = store if where is None else store.filter(where)
    scored = rows.join(F.broadcast(query.limit(1)), on=F.lit(True)).withColumn("likeness", text.cosine(F.col("embedding"), F.col("q")))
    near = scored.drop("q").orderBy(F.desc("likeness"), "vec_id").limit(max(4 * k, 20))
    boost = F.lit(0.05) * text.hits(text.query_tokens(F.lit(words)), F.lower("haystack"))
    best = near.withColumn("score", F.col("likeness") + boost).orderBy(F.desc("score"), "vec_id").limit(k)
    return best.withColumn("score", F.round("score", 4)).drop("likeness")


def keyword_scores(docs: DataFrame, query: str) -> DataFrame:
    """score: 1 for each query word in the name, else 0.5 for each in the first 400 characters; words of 3 or more."""
    score = F.lit(0.0)
    for word in sorted({w for w in query.lower().split() if len(w) > 2}):
        score = score + F.when(F.contains(F.lower("name"), F.lit(word)), 1.0).when(F.contains(F.lower(F.substring("content", 1, 400)), F.lit(word)), 0.5).otherwise(0.0)
    return docs.withColumn("score", score).filter("score > 0")
