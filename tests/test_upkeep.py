"""Upkeep jobs on small tables: states, moves, ledgers, retention, warnings, passages of several files."""

import datetime

from pyspark.sql import functions as F

from corpusframe.operators import upkeep


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_states_only_move_as_allowed(spark):
    log = [(1, "accepted", 1), (1, "trash", 2), (1, "pending", 3), (2, "trash", 1), (2, "rejected", 2), (2, "accepted", 3), (3, "odd", 1), (3, None, 2), (4, "rejected", 5), (4, "pending", 6), (4, "accepted", 7)]
    got = upkeep.settled_states(spark.createDataFrame(log, "id int, status string, at int"))
    assert rows(got) == [(1, "pending", 3, 0), (2, "rejected", 2, 2), (3, "pending", None, 2), (4, "accepted", 7, 0)]


def test_trash_lists_newest_first_with_what_is_known(spark):
    trash = spark.createDataFrame([(1, "in/a.txt", "h1", 10), (2, "in/b.txt", "h2", 30), (None, "c.txt", None, 20)], "id int, original_path string, hash string, removed int")
    uploads = spark.createDataFrame([(1, "mine.txt", "h1", "ann", "trash"), (7, "again.txt", "h2", "bob", "pending")], "id int, name string, hash string, contributor string, status string")
    assert [tuple(r) for r in upkeep.trash_view(trash, uploads).collect()] == [(2, "b.txt", None, 30, False, True), (None, "c.txt", None, 20, False, False), (1, "mine.txt", "ann", 10, True, False)]
    assert upkeep.trash_view(trash, uploads, 1).count() == 1


def test_moves_collide_stay_and_give_way(spark):
    plan = spark.createDataFrame([("x/1", "a/One"), ("x/2", "A/one"), ("x/3", "a/three"), ("b/4", "b/4"), ("x/5", "b/FIVE"), ("b/6", "b/SIX")], "path string, target string")
    there = spark.createDataFrame([("b/4",), ("b/five",), ("b/6",), ("B/six",), ("b/Six",)], "path string")
    got = dict(upkeep.move_plan(plan, there).select("path", "action").collect())
    assert got == {"x/1": "collision", "x/2": "collision", "x/3": "move", "b/4": "stays", "x/5": "kept", "b/6": "kept"}
    assert ("b", "kept", 2) in rows(upkeep.move_counts(upkeep.move_plan(plan, there)))


def test_rebuilt_ledger_and_retention(spark):
    cat = spark.createDataFrame([("a", "h", 1, 1), ("b", "h", 1, 1), ("c", "k", 1, 1)], "path string, hash string, size int, modified_ns int")
    chunks = spark.createDataFrame([("2", "a"), ("1", "a"), ("9", "b")], "chunk_key string, path string")
    assert rows(upkeep.rebuilt_ledger(chunks, cat).select("path", "status", "chunk_ids")) == [("a", "processed", ["1", "2"]), ("b", "duplicate", []), ("c", "no_text", [])]
    day = lambda d: datetime.datetime(2024, 1, d)
    turns = spark.createDataFrame([(1, "x", "old", day(1)), (2, "x", "new", day(9)), (3, "y", "gone", day(2))], "turn_id int, conv_id string, question string, at timestamp")
    convs = spark.createDataFrame([("x", "title", day(1)), ("y", "t", day(2)), ("z", "young", day(8))], "conv_id string, title string, at timestamp")
    blocks = spark.createDataFrame([(day(1),), (day(7),)], "at timestamp")
    kept = upkeep.retained(turns, convs, blocks, F.lit(day(5)))
    assert [r.turn_id for r in kept["turns"].collect()] == [2] and kept["blocks"].count() == 1
    assert rows(kept["conversations"].select("conv_id", "title")) == [("x", "new"), ("z", "young")]
    assert all(upkeep.retained(turns, convs, blocks, None)[k].count() == n for k, n in (("turns", 3), ("conversations", 3), ("blocks", 2)))


def test_warnings_of_three_kinds(spark):
    sources = spark.createDataFrame([(1, 1, "f", "n", "c1"), (1, 2, "f", "n", "c2"), (1, 3, "g", None, "c3"), (1, 4, "h", "ok", "c4")], "query_id int, rank int, file string, node string, chunk_key string")
    labels = spark.createDataFrame([("n", "expired"), ("ok", "in_force")], "node string, label string")
    d = datetime.date
    times = spark.createDataFrame([("f", None, True), ("g", d(2030, 1, 2), False), ("h", d(2020, 1, 1), False)], "file string, effective_on date, is_draft boolean")
    amended = spark.createDataFrame([("c2", ["A", "B"]), ("c4", [])], "chunk_key string, by array<string>")
    got = upkeep.answer_warnings(sources, labels, times, amended, F.lit(d(2025, 1, 1)))
    assert rows(got) == [(1, "draft", "f", 1, None), (1, "not_yet", "g", 3, "02/01/2030"), (1, "passage", "c2", 2, "A, B"), (1, "status", "n", 1, "expired")]


def test_passages_of_several_files(spark):
    chunks = spark.createDataFrame([(10 * f + k, f"f{f}", f"solar part{k}" if k == 3 else f"other thing{k}") for f in range(6) for k in range(9)], "chunk_key int, file string, text string")
    asked = spark.createDataFrame([(1, "solar", f"f{f}", f) for f in range(6)] + [(2, "nowhere", "f5", 0)], "query_id int, text string, file string, pos int")
    got = rows(upkeep.files_passages(asked, chunks))
    assert [r for r in got if r[0] == 1] == [(1, f"f{f}", 10 * f + 3, 1) for f in range(4)]  # four files, the one hit of each
    assert [r[2] for r in got if r[0] == 2] == [50, 52, 54, 56]  # no hit: spread over the file
    summary = rows(upkeep.files_passages(asked, chunks, True, budget=12))
    assert [r[2] for r in summary if r[:2] == (1, "f2")] == [20, 23, 26] and len([r for r in summary if r[0] == 2]) == 9
