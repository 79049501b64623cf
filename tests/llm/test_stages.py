"""Every pipeline stage with nulls, repeated rows, empty tables and columns named after its working columns."""

import pytest

import corpus_pipeline
from lodeweave.llm import neardup, scratch

FOLDER = "/root/testdata/sf0.001"
NAMES = "score size u copies target part whole due of q source_size mix copy leaky kept_id n most row bin words set sig node family a b y o z pos label key kept_ids _id _n _row _0 _1".split()


def wide(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for i, name in enumerate(NAMES):
        docs = docs.selectExpr("*", f"coalesce(doc_id, 7) * 100 + {i} as `{name}`")
    return docs.selectExpr("*", "map('k', doc_id) as `m.n`")


@pytest.mark.parametrize("at", range(4))
def test_stages_keep_all_columns(spark, at):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "en", "a", 5), (2, text + " eleven", None, None, None), (3, None, "de", "b", None), (4, "", "de", "b", 0), (4, "", "de", "b", 0), (None, "nothing known of this row at all", "en", "a", 3), (5, "some other words here", "en", "a", 1), (5, "some other words here", "en", "a", 1)]
    docs = wide(spark, rows)
    name, stage = corpus_pipeline.STAGES[at]
    out = stage(spark, docs, FOLDER)
    assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
    ids = [r["doc_id"] for r in out.collect()]
    for r in out.collect():
        base = (7 if r["doc_id"] is None else r["doc_id"]) * 100
        assert [r[x] for x in NAMES] == [base + i for i in range(len(NAMES))], name
        assert r["m.n"] == {"k": r["doc_id"]}
    if name == "near_duplicates":
        assert sorted(ids, key=str) == [1, 3, 4, 4, 5, None]
    if name in ("toxicity", "leaks"):
        assert len(ids) == len(rows)
    empty = stage(spark, docs.limit(0), FOLDER)
    assert empty.columns == docs.columns and empty.count() == 0


def test_last_stage_with_odd_rows(spark):
    rows = [(1, "x y", "en", "a", 5), (1, "x y", "en", "a", 5), (2, None, None, None, None), (None, "", "en", "a", 0)]
    out = corpus_pipeline.write_ids(spark, wide(spark, rows), FOLDER).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in out) == [("1", out[0]["n_tokens"]), ("1", out[0]["n_tokens"]), ("2", 1), ("None", 1)]
    assert corpus_pipeline.write_ids(spark, wide(spark, rows).limit(0), FOLDER).count() == 0


def test_stage_scratch_is_deleted(spark):
    docs = spark.createDataFrame([(i, f"a b c d e {i // 2}") for i in range(20)], "doc_id long, text string")
    made = []
    folder = scratch.folder

    def noted(spark, kept=False):
        made.append(folder(spark, kept))
        return made[-1]

    scratch.folder = noted
    try:
        with scratch.scope(spark):
            assert neardup.deduplicate(docs).count() == 10
    finally:
        scratch.folder = folder
    path = spark._jvm.org.apache.hadoop.fs.Path
    assert made and not any(path(x).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(x)) for x in made)


def test_filter_in_front_of_joins_by_id(spark, monkeypatch):
    """Every id of the list passes, whatever the filter's size; results do not depend on it."""
    from pyspark.sql import functions as F

    rows = spark.range(5000).select(F.when(F.col("id") != 7, F.col("id")).alias("doc_id"), F.lit(1).alias("at"))
    ids = spark.createDataFrame([(i,) for i in range(0, 5000, 50)] + [(None,)], "x long")
    passed = {}
    for bits in (1 << 15, 1 << 27):
        monkeypatch.setattr(neardup, "FILTER_BITS", bits)
        marked = neardup._marked(rows, F.col("doc_id"), ids, "maybe")
        assert marked.columns == ["doc_id", "at", "maybe"] and marked.count() == 5000
        passed[bits] = {r["doc_id"] for r in marked.filter("maybe").collect()}
        assert passed[bits] >= {None, *range(0, 5000, 50)}
    assert len(passed[1 << 27]) < 105 and not neardup._marked(rows, F.col("doc_id"), ids.limit(0), "maybe").filter("maybe").count()
    monkeypatch.setattr(neardup, "FILTER_BITS", 1 << 5)
    docs = spark.createDataFrame([(i, " ".join(f"w{j + i // 3 * 30}" for j in range(30))) for i in range(60)] + [(3, "a b"), (None, ""), (None, "")], "doc_id long, text string")
    kept = sorted(str(r["doc_id"]) for r in neardup.deduplicate(docs).collect())
    assert kept == sorted([str(i) for i in range(0, 60, 3)] + ["None", "None"])


def test_scopes_of_threads(spark, tmp_path):
    """A scope that ends in one thread leaves the tables of another one."""
    import threading

    inner, go = [], threading.Event()

    def other():
        with scratch.scope(spark):
            inner.append(scratch.folder(spark))
            scratch.save(spark.range(3), inner[0])
            go.wait(30)
            inner.append(spark.read.parquet(inner[0]).count())

    thread = threading.Thread(target=other)
    with scratch.scope(spark):
        own = scratch.folder(spark)
        thread.start()
        while not inner:
            pass
        scratch.save(spark.range(5), own)
    go.set()
    thread.join()
    assert inner[1] == 3 and not spark._jvm.org.apache.hadoop.fs.FileSystem.getLocal(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(own))


def test_ids_go_where_they_are_asked_for(spark, tmp_path):
    from lodeweave.llm import idfiles

    rows = [(2, "x y", "en", "a", 5), (1, None, None, None, None)]
    out = corpus_pipeline.write_ids(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), FOLDER, str(tmp_path / "ids"))
    assert sorted(tuple(r) for r in out.collect()) == sorted(tuple(r) for r in idfiles.summaries(spark, str(tmp_path / "ids")).collect())
