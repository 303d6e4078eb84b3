"""Repetitive and very long texts cost what their length asks for; the pipeline against its stages by hand."""

import time

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from corpusframe.llm import decontamination, license_scans
from tests.llm.test_operators import alnum, reference_hits, spaced


def test_a_megabyte_of_licence_words_is_scanned_in_time(spark):
    words = "public mit apache license general gnu lesser "
    df = spark.createDataFrame([(1, words * 23_000 + "mit license"), (2, "mit license " * 3)], "doc_id long, text string")
    began = time.time()
    rows = {r.doc_id: r for r in license_scans.scan_licenses(df).drop("places").collect()}
    assert time.time() - began < 30
    # "apache license" stands in every repeat, "mit license" at the end alone
    assert (rows[1].n_words, rows[1].n_base, rows[1].first_word, rows[1].last_word, rows[1].base_labels) == (161_002, 23_001, 2, 161_000, "apache,mit") and rows[2].n_base == 3


def test_the_automaton_does_not_climb_with_the_length_of_an_item():
    steps = {}
    for size in (200, 6400):
        automaton = decontamination.Automaton([("a", [7] * size), ("b", [7, 7])], 10)
        began = time.process_time()
        found = [m for m in automaton.matches([7] * 20_000)]
        steps[size] = time.process_time() - began
        assert len(found) == 20_000 - 9 + 20_000 - 1
    assert steps[6400] < 10 * steps[200] + 0.2


def test_repetitive_items_and_texts_match_brute_force(spark):
    items = [(1, "x " * 30), (2, "x x x"), (3, "x y " * 8), (4, "y x y")]
    texts = ["x " * 50, "y x y x", "x y " * 6 + "z " + "x " * 9, "x x"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.contamination(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_words, sum(s.end - s.begin for s in got[i].spans), got[i]["items"]) == reference_hits(t, items)


def _tables(spark, folder, n=70, seed=4, extra=False):
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for i in range(n):
        text = " ".join(f"w{k}" for k in rng.integers(0, 400, int(rng.integers(20, 60)))) + "."
        if i % 5 == 0:
            text = "zorgle blat you zorgle. " + text
        rows.append((i, text, ["en", "de"][i % 2], f"site{i % 3}", len(text)))
        labels.append((i, 1, int(i % 5 == 0)))
    item = " ".join(f"q{k}" for k in range(30))
    rows += [(100 + k, rows[7 + k][1], "en", "site1", 5) for k in range(3)]  # copies
    rows += [(110, rows[11][1] + " tail", "en", "site2", 5), (111, f"Before it {item} and after it " + rows[13][1], "de", "site0", 5), (112, item, "en", "site0", 5), (113, None, None, None, None), (114, "", "en", "site1", 0), (None, "a lone text without an id", "en", "site2", 25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        docs = docs.drop("n_chars").withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in ("score", "tokens", "epoch", "spans", "offending", "size", "row_key", "component")})
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, item


def shingles(text):
    w = spaced(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_pipeline_stage_by_stage(spark, tmp_path):
    folder = str(tmp_path)
    docs, item = _tables(spark, folder)
    stages = dict(corpus_pipeline.STAGES)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "near copies", "decontamination", "mixing", "sharding"]
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)

    clean = stages["toxicity"](spark, docs, folder).cache()
    kept = {r[0] for r in rows(clean)}
    assert clean.columns == docs.columns and not kept & set(range(0, 70, 5)) and kept >= {i for i in range(70) if i % 5} | {100, 101, 102, 110, 111, 112, 113, 114, None}

    single = stages["near copies"](spark, clean, folder).cache()
    own = rows(clean)
    groups = {}
    for r in own:  # the first row of each group that 0.75 of shingles link, by brute force
        s = shingles(r[1])
        if s:
            groups[r[0]] = s
    parent = {k: k for k in groups}
    root = lambda k: k if parent[k] == k else root(parent[k])
    for a in groups:
        for b in groups:
            if str(a) < str(b) and 100 * len(groups[a] & groups[b]) >= 75 * len(groups[a] | groups[b]):
                parent[root(a)] = root(b)
    least = {}
    for k in groups:
        least[root(k)] = min(least.get(root(k), k), k) if k is not None else k
    expected = set(least.values()) | {r[0] for r in own if not shingles(r[1])}
    assert {r[0] for r in rows(single)} == expected and single.columns == docs.columns

    cut = stages["decontamination"](spark, single, folder).cache()
    expected = {}
    for r in rows(single):
        n, hit, _ = reference_hits(r[1], [(1, item)])
        if 2 * hit <= n:
            expected[r[0]] = alnum(r[1]) if not hit else alnum(r[1].replace(item, ""))
    assert {r[0]: alnum(r[1]) for r in rows(cut)} == expected and 112 not in expected and "q3" not in expected[111]
    assert all(r[4] == len(r[1]) for r in rows(cut) if r[1] is not None)

    mixed = stages["mixing"](spark, cut, folder).cache()
    total, taken = (sum(len(spaced(r[1])) for r in rows(x)) for x in (cut, mixed))
    assert set(map(tuple, mixed.collect())) <= set(map(tuple, cut.collect())) and mixed.count() == len({r[0] for r in rows(mixed)})
    longest = max(len(spaced(r[1])) for r in rows(cut))
    leaves = len({(r[2], r[3]) for r in rows(cut)})
    assert abs(taken - corpus_pipeline.MIX_SHARE * total) <= leaves * longest / 2

    out = stages["sharding"](spark, mixed, folder)
    found = out.collect()
    sizes = [sum(r.shard == s for r in found) for s in range(corpus_pipeline.SHARDS)]
    assert {tuple(r)[:5] for r in found} == set(map(tuple, mixed.collect())) and max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in found if r.shard == s) == list(range(n)) for s, n in enumerate(sizes)) and {r.law for r in found} == {"rows"}
    assert corpus_pipeline.run(spark, folder).count() == len(found)


def test_pipeline_with_clashing_columns_and_without_lengths(spark, tmp_path):
    folder = str(tmp_path)
    docs, _ = _tables(spark, folder, n=30, extra=True)
    assert "n_chars" not in docs.columns
    out = corpus_pipeline.run(spark, folder).collect()
    assert out and all(r[c] == f"{c}{'-' if r.doc_id is None else r.doc_id}" for r in out for c in ("score", "tokens", "epoch", "spans", "offending", "row_key", "component"))
    assert all(r.own_size == f"size{'-' if r.doc_id is None else r.doc_id}" and r.size == len((r.text or "").encode()) + 16 for r in out)
