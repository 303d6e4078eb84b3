"""Versions of tables, the corpus's next state, and the folder that feeds it."""

import os
import time

import pytest
from pyspark.sql import functions as F

from corpusframe.operators import catalog
from corpusframe.sources.versions import Conflict, Versions, write_register
from corpusframe.streaming import jobs

SCHEMA = {"a": "k int, v string", "b": "k int"}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_writer_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    v = Versions(spark, str(tmp_path / "t"), SCHEMA)
    assert v.current() is None and rows(v.read("a")) == []
    table = lambda *x: spark.createDataFrame(list(x), SCHEMA["a"])
    assert v.publish({"a": table((1, "x")), "b": spark.createDataFrame([(5,)], "k int")}) == 0
    held = v.read("a")
    real = Versions._make_current

    def dies(self, number, mark):
        raise KeyboardInterrupt  # the files are written, the mark is not

    monkeypatch.setattr(Versions, "_make_current", dies)
    with pytest.raises(KeyboardInterrupt):
        v.publish({"a": table((2, "y"))}, 0)
    assert v.current() == 0 and rows(v.read("a")) == [(1, "x")] and len(list((tmp_path / "t").glob("v-*"))) == 2
    monkeypatch.setattr(Versions, "_make_current", real)

    def half(self, *_):  # the mark is drafted and never moved
        (tmp_path / "t" / "_marks" / ".draft").write_text('{"directory": "nowhere"')
        raise OSError

    monkeypatch.setattr(Versions, "_make_current", half)
    with pytest.raises(OSError):
        v.publish({"a": table((3, "z"))}, 0)
    monkeypatch.setattr(Versions, "_make_current", real)
    assert v.current() == 0 and v.publish({"a": table((4, "w"))}, 0) == 1
    assert rows(v.read("a")) == [(4, "w")] and rows(v.read("b")) == [(5,)]  # b is carried over
    assert rows(held) == [(1, "x")] and rows(v.read("a", 0)) == [(1, "x")]  # readers hold their version
    assert v.drop_old(1) == [0] and rows(v.read("a")) == [(4, "w")] and len(list((tmp_path / "t").glob("v-*"))) == 1


def test_two_writers_from_one_version(spark, tmp_path):
    a, b = (Versions(spark, str(tmp_path / "t"), SCHEMA) for _ in range(2))
    table = lambda *x: spark.createDataFrame(list(x), SCHEMA["a"])
    a.publish({"a": table((1, "x"))})
    with pytest.raises(Conflict):
        b.publish({"a": table((2, "y"))}, None)
    with pytest.raises(Conflict):
        b._make_current(0, {"directory": "other", "tables": []})  # as if both had looked before either wrote
    seen = []

    def slow(have):
        if not seen:  # another writer comes in between
            a.publish({"a": have["a"].union(table((3, "z")))}, 0)
        seen.append(rows(have["a"]))
        return {"a": have["a"].union(table((4, "w")))}

    assert b.update(slow) == 2 and rows(b.read("a")) == [(1, "x"), (3, "z"), (4, "w")] and len(seen) == 2
    assert b.publish({"a": table()}, 2, key="k") == 3 and b.publish({"a": table((9, "q"))}, 3, key="k") == 3 and rows(b.read("a")) == []


def test_registers_replace_and_keep_the_last_of_a_key(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "t"), {"runs": "name string, at int, score double"})
    table = lambda *x: spark.createDataFrame(list(x), "name string, at int, score double")
    write_register(v, "runs", table(("a", 1, 0.5), ("b", 5, 0.1)), "name", "at")
    write_register(v, "runs", table(("a", 2, 0.7), ("b", 4, 0.2), ("c", None, 0.3)), "name", "at")
    write_register(v, "runs", table(("a", 2, 0.8)), "name", "at")
    assert rows(v.read("runs")) == [("a", 2, 0.8), ("b", 5, 0.1), ("c", None, 0.3)]
    write_register(v, "runs", table(("z", 1, None)))
    assert rows(v.read("runs")) == [("z", 1, None)]


def test_next_state_of_a_corpus(spark):
    ledger = spark.createDataFrame([("same", "h1", "processed", 1, 1, ["s1"]), ("gone", "h2", "processed", 1, 1, ["g1", "g2"]), ("changed", "h3", "processed", 1, 1, ["c1"]), ("old", "h4", "processed", 1, 1, None), ("bad", "h5", "error", 1, 1, []), ("blank", "h6", "no_text", 1, 1, []), ("broke", "h7", "processed", 1, 1, ["b1"])], jobs.INGEST["ledger"])
    chunks = spark.createDataFrame([(k, p, "t") for k, p in [("s1", "same"), ("g1", "gone"), ("g2", "gone"), ("c1", "changed"), ("x", "old"), ("b1", "broke")]], jobs.INGEST["chunks"])
    cat = spark.createDataFrame([("same", "h1", 1, 1), ("changed", "n3", 2, 2), ("old", "n4", 2, 2), ("bad", "h5", 1, 1), ("blank", "h6", 1, 1), ("broke", "n7", 1, 2), ("fresh", "n8", 3, 3), ("late", "n9", 3, 3)], "path string, hash string, size bigint, modified_ns bigint")
    new = spark.createDataFrame([("n1", "changed", "t"), ("n2", "changed", "t"), ("n3", "old", "t"), ("n4", "broke", "t"), ("n5", "late", "t"), ("no", "same", "t")], jobs.INGEST["chunks"])
    failed = spark.createDataFrame([("broke", "read"), ("late", "embed"), ("same", "read")], "path string, step string")
    after = catalog.next_state({"chunks": chunks, "ledger": ledger}, cat, new, failed)
    assert rows(after["chunks"].select("chunk_key", "path")) == [("n1", "changed"), ("n2", "changed"), ("n3", "old"), ("s1", "same"), ("x", "old")]
    told = {r.path: (r.hash, r.status, r.chunk_ids) for r in after["ledger"].collect()}
    assert told == {"same": ("h1", "processed", ["s1"]), "changed": ("n3", "processed", ["n1", "n2"]), "old": ("n4", "processed", ["n3"]), "bad": ("h5", "error", []), "blank": ("h6", "no_text", []), "broke": ("n7", "error", []), "fresh": ("n8", "no_text", [])}
    assert rows(after["report"]) == [("broke", "failed: read"), ("late", "failed: embed"), ("old", "stuck")]


def lines(files):
    return files.select("path", F.explode(F.split("text", "\n")).alias("text")).where("trim(text) <> ''")


def test_folder_ingest_skips_copies_fresh_files_and_what_is_known(spark, tmp_path):
    folder, v = tmp_path / "in", Versions(spark, str(tmp_path / "t"), jobs.INGEST)
    (folder / "sub").mkdir(parents=True)
    old = time.time() - 3600

    def put(name, text, at=old):
        (folder / name).write_text(text)
        os.utime(folder / name, (at, at))

    put("a.txt", "one\ntwo\none")
    put("sub/b.txt", "one\ntwo\none")  # a copy of a.txt
    put("c.txt", "\n \n")
    put("d.txt", "still being written", time.time() + 5)
    put("e.pdf", "not text")
    jobs.ingest(spark, str(folder), v, lines)
    told = lambda: {r.path.rsplit("/", 1)[1]: (r.status, len(r.chunk_ids)) for r in v.read("ledger").collect()}
    assert told() == {"a.txt": ("processed", 2), "b.txt": ("duplicate", 0), "c.txt": ("no_text", 0)} and v.current() == 0
    jobs.ingest(spark, str(folder), v, lines)
    assert v.current() == 0  # nothing new
    put("a.txt", "three", old + 10)
    put("d.txt", "finished", old + 20)
    jobs.ingest(spark, str(folder), v, lines)
    assert told() == {"a.txt": ("processed", 1), "b.txt": ("duplicate", 0), "c.txt": ("no_text", 0), "d.txt": ("processed", 1)}
    assert sorted(r.text for r in v.read("chunks").collect()) == ["finished", "three"]


def test_a_stream_that_stops_in_mid_batch_ingests_once(spark, tmp_path):
    folder, v = tmp_path / "in", Versions(spark, str(tmp_path / "t"), jobs.INGEST)
    folder.mkdir()
    for name, text in (("a.txt", "one\ntwo"), ("b.txt", "three")):
        (folder / name).write_text(text)
    job, calls = jobs.ingest_batch(v, lines, "test"), []

    def breaks(files, number):
        job(files, number)
        calls.append(number)
        if len(calls) == 1:
            raise RuntimeError("the executor is gone")  # after the version was published, before the batch was committed

    run = lambda: jobs.periodic(jobs.hot_folder(spark, str(folder), settle="0 seconds", text=True), breaks, str(tmp_path / "mark"), 0)
    with pytest.raises(Exception, match="the executor is gone"):
        run().awaitTermination()
    assert v.numbers() == [0] and v.read("chunks").count() == 3
    run().awaitTermination()
    assert calls == [0, 0] and v.numbers() == [0] and v.read("chunks").count() == 3
    (folder / "c.txt").write_text("four")
    run().awaitTermination()
    assert calls == [0, 0, 1] and v.numbers() == [0, 1] and v.read("chunks").count() == 4
