"""The kept graph against one that is built anew."""

import random

import pytest

from lodeweave.streaming import store

DEFINITIONS, SITES = "file string, name string, qn string", "file string, name string, site long"


def rebuilt(files):
    """calls (name, file, site, qn) of all files (file -> (names defined, names called))."""
    least = {}
    for f, (defined, _) in files.items():
        for n in defined:
            least[n] = min(least.get(n, f"{f}.{n}"), f"{f}.{n}")
    return sorted((n, f, i, f"{f}.{n}" if n in files[f][0] else least.get(n)) for f, (_, called) in files.items() for i, n in enumerate(called))


def batch_of(spark, files, changed):
    kept = [f for f in changed if f in files]
    return (
        spark.createDataFrame([(f,) for f in changed] + [(None,)], "file string"),
        spark.createDataFrame([(f, n, f"{f}.{n}") for f in kept for n in files[f][0]] + [("stranger", "a", "stranger.a")], DEFINITIONS),
        spark.createDataFrame([(f, n, i) for f in kept for i, n in enumerate(files[f][1])], SITES),
    )


def calls_of(kept):
    return sorted((tuple(r[c] for c in ("name", "file", "site", "qn")) for r in kept.read("calls").collect()), key=str)


def test_random_batches_equal_a_rebuild(spark, tmp_path, monkeypatch):
    draw = random.Random(6)
    names = [f"n{i}" for i in range(12)]
    kept, files = store.Store(spark, str(tmp_path), buckets=3), {}
    for batch in range(20):
        changed = draw.sample([f"f{i}" for i in range(9)], draw.randint(1, 3))
        for f in changed:
            if f in files and draw.random() < 0.35:
                del files[f]
            else:
                files[f] = (sorted(draw.sample(names, draw.randint(0, 4))), [draw.choice(["n0", *names]) for _ in range(draw.randint(0, 5))])
        rows = batch_of(spark, files, changed)
        if batch == 7:  # cut off half way: before the manifest, after some tables
            seen = calls_of(kept)
            write = store.Store._write
            monkeypatch.setattr(store.Store, "_write", lambda self, name, *a: write(self, name, *a) if name != "calls" else (_ for _ in ()).throw(OSError("cut off")))
            with pytest.raises(OSError):
                kept.apply(batch, *rows)
            monkeypatch.undo()
            assert calls_of(kept) == seen and kept.manifest()["applied"] == 6
        assert kept.apply(batch, *rows, mark=f"2024-01-{batch + 1:02d}")
        if batch == 11:  # delivered again, and an older one with other content
            assert not kept.apply(batch, *rows) and not kept.apply(3, *batch_of(spark, {}, list(files)))
        if batch in (4, 11, 12, 19):
            assert calls_of(kept) == sorted(rebuilt(files), key=str)
    assert kept.manifest()["mark"] == "2024-01-20" and kept.manifest()["version"] == 20
    found = {(r["file"], r["name"]) for r in kept.read("definitions").collect()}
    assert found == {(f, n) for f, (defined, _) in files.items() for n in defined}
    assert kept.vacuum() > 10 and calls_of(kept) == sorted(rebuilt(files), key=str) and len(kept.versions()) == 2


def test_deleted_file_leaves_callers(spark, tmp_path):
    files = {"a": (["f"], []), "b": (["g"], ["f", "f", "g"])}
    kept = store.Store(spark, str(tmp_path), buckets=2)
    kept.apply(0, *batch_of(spark, files, ["a", "b"]))
    del files["a"]
    kept.apply(1, *batch_of(spark, files, ["a"]))
    assert calls_of(kept) == [("f", "b", 0, None), ("f", "b", 1, None), ("g", "b", 2, "b.g")]
    assert [r["qn"] for r in kept.read("definitions").collect()] == ["b.g"]


def test_second_writer_fails(spark, tmp_path):
    one = store.Store(spark, str(tmp_path), buckets=2)
    one.apply(0, *batch_of(spark, {"a": (["f"], [])}, ["a"]))
    state = one.manifest()
    with pytest.raises(RuntimeError):
        one._publish(state)
    assert one.versions() == [1]


def test_stream_of_changes(spark, tmp_path):
    files = {"a": (["f"], ["g"]), "b": (["g"], ["f"])}
    kept = store.Store(spark, str(tmp_path / "store"), buckets=2)
    rows = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "3")], "file string, mark string")
    rows.write.parquet(str(tmp_path / "changes"))

    def load(changed):
        wanted = [r["file"] for r in changed.collect()]
        return batch_of(spark, files, wanted)[1:]

    for _ in range(2):
        kept.apply_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "changes")), load, str(tmp_path / "checkpoint")).awaitTermination()
    assert calls_of(kept) == sorted(rebuilt(files), key=str) and kept.manifest()["mark"] == "3" and kept.versions() == [1]


def test_sites_are_written_once_a_batch(spark, tmp_path, monkeypatch):
    files = {"a": (["f"], ["g", "g"]), "b": (["g"], ["f"])}
    kept, deleted = store.Store(spark, str(tmp_path), buckets=2), []
    path = store.Store._path
    monkeypatch.setattr(store.Store, "_path", lambda self, name: deleted.append(name.split("/")[-1]) or path(self, name))
    kept.apply(0, *batch_of(spark, files, ["a", "b"]))
    assert {x for x in deleted if x.startswith("step-")} == {"step-files", "step-definitions", "step-sites", "step-touched"}
    assert calls_of(kept) == sorted(rebuilt(files), key=str)
