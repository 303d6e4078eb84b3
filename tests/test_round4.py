"""Findings of round 4: jobs whose rows, exchanges or passes grew faster than their input, and a key that upper case changes."""

import random

import numpy as np
from pyspark.sql import functions as F

from corpusframe.functions import text as T
from corpusframe.operators import graph, retrieval, text_jobs, upkeep
from corpusframe.plans import q_rules
from tests.test_search import own_bm25


def made(df, kind):
    """Rows that each operator of a kind made while df was collected."""
    out = []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if kind in name and node.metrics().contains("numOutputRows"):
            out.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return out


def test_citations_meet_the_years_of_a_name_and_not_all_its_laws(spark):
    laws = [(n, 1990 + k % 20, 100 * n + k) for n in range(3) for k in range(200)] + [(3, None, 7), (3, 1999, 8), (4, None, 9), (None, 1990, 1), (5, 2001, None)]
    cites = [(i, i % 7, 1985 + i % 30) for i in range(300)] + [(900, 0, None), (901, None, 2000), (902, 3, 1990), (903, 1, 1991), (903, 2, 2005)]
    got = graph.resolve_names(spark.createDataFrame(cites, "cite_id int, name int, year int"), spark.createDataFrame(laws, "name int, year int, number int"))
    low = lambda x: (x is not None, x or 0)
    want = {}
    for c, name, year in cites:
        for n, ly, number in laws:
            if n == name and n is not None:
                key = (low(None if None in (ly, year) else int(ly <= year)), low(ly), low(number))
                want[c] = max(want.get(c, (key, number)), (key, number), key=lambda x: x[0])
    assert {r.cite_id: r.number for r in got.collect()} == {c: v[1] for c, v in want.items()}
    joins = made(got, "Join")
    assert joins and max(joins) <= len(cites)


def test_pages_are_compressed_where_they_are(spark):
    words = "sun wind water plan school solar roof land thông tư of".split()
    rnd = random.Random(4)
    line = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    rows = [(i, "\n".join([line(4), *(line(rnd.choice((2, 9, 14))) + f" number{j % 3}" for j in range(i % 9))])) for i in range(60)] + [(90, None), (91, ""), (92, "\n\n"), (93, "x" * 40 + "\n\n" + "- " * 30 + "\n" + "? " * 30 + "\n" + "! " * 30 + "\n" + "; " * 30)]
    rows.append((94, "sun\n" + "\n".join("water of the land and the roofs %d" % (j % 2) for j in range(6)) + "\nthe sun on roofs of a school, a plan"))
    pages = spark.createDataFrame(rows, "page_id int, text string").repartition(3)
    got = retrieval.compress_pages(pages, F.substring_index("text", "\n", 1))
    cut = {r.page_id: (r.q, r.p) for r in pages.select("page_id", T.tokens_expanded(F.substring_index("text", "\n", 1)).alias("q"), F.transform(F.split("text", r"\n+"), lambda p: F.struct(p.alias("x"), T.tokens_expanded(p).alias("t"))).alias("p")).collect()}
    want = {}
    for page, (q, parts) in cut.items():
        own = [(p.x, p.t) for p in parts or [] if len(p.x.strip(" ")) >= 30]
        if own:
            score = own_bm25([t for _, t in own], q) if any(t for _, t in own) else [0] * len(own)
            best = sorted(sorted(range(len(own)), key=lambda i: (-max(0, round(score[i], 6)), i))[:3])
            want[page] = ("\n".join(own[i][0] for i in best), len(best))
    assert {r.page_id: (r.text, r.paragraphs) for r in got.collect()} == want and len(want) > 30
    assert "Exchange" not in retrieval.compress_pages(pages.sparkSession.createDataFrame(rows, "page_id int, text string"), F.col("text"))._jdf.queryExecution().executedPlan().toString()


def test_keys_of_ranked_turns_match_as_lower_case_does(spark, tmp_path):
    rows = [(1, 0, "die große Straße"), (1, 1, "der Weg"), (1, 2, " roße"), (2, 0, "A PLAN"), (2, 1, "a plan"), (3, 0, "one"), (3, 1, None)]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = q_rules.QUERIES["E2_ranks"](spark, str(tmp_path)).collect()
    assert {r.conv_id: r.ranks for r in got} == {1: "1", 2: "1", 3: "1"}  # the key of the last turn with a text: "roße", " plan", "ne"


def test_ranking_inside_groups_exchanges_no_postings(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "PAIR_BLOCK", 3)
    monkeypatch.setattr(retrieval, "CELL_BLOCK", 16)
    rnd = random.Random(5)
    words = "sun wind water plan school solar roof land thông tư of".split()
    line = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    chunks = [(f"c{i:03}", "abcd"[i % 4] if i % 9 else None, line(i % 13)) for i in range(200)] + [("n", "a", None), ("e", "x", line(5))]
    asked = [(i, "abz"[i % 3] if i % 7 else None, line(6)) for i in range(24)]
    schema = "chunk_key string, doc_id string, text string"
    got = retrieval.bm25_within(spark.createDataFrame(asked, "query_id int, doc_id string, text string"), spark.createDataFrame(chunks, schema), "chunk_key", "doc_id", 5)
    cut = {r.chunk_key: r.t for r in spark.createDataFrame(chunks, schema).select("chunk_key", T.tokens_expanded("text").alias("t")).collect()}
    terms = {r.query_id: r.t for r in spark.createDataFrame(asked, "query_id int, doc_id string, text string").select("query_id", T.tokens_expanded("text").alias("t")).collect()}
    want = set()
    for q, g, _ in asked:
        own = [c for c, x, _ in chunks if x == g and g is not None]
        score = [round(s, 6) for s in own_bm25([cut[c] for c in own], terms[q])] if own else []
        want |= {(q, g, c, s, r) for r, (s, c) in enumerate(sorted((-s, c) for s, c in zip(score, own) if s > 0)[:5], 1)}
    assert {(r.query_id, r.doc_id, r.chunk_key, -r.score, r["rank"]) for r in got.collect()} == want and len(want) > 50
    assert max(made(got, "Join"), default=0) <= len(chunks)


def test_files_with_hits_are_not_spread(spark):
    word = lambda i: "x" + "".join(chr(97 + int(c)) for c in f"{i:03}")
    chunks = spark.createDataFrame([(i, f"f{i % 3}", f"sun wind {word(i)}" if i % 3 < 2 else "water") for i in range(300)], "chunk_key long, file string, text string")
    asked = spark.createDataFrame([(q, f"sun wind {word(3 * q)} {word(3 * q + 1)}", f"f{p}", p) for q in range(30) for p in range(3)], "query_id long, text string, file string, pos int")
    got = upkeep.files_passages(asked, chunks)
    found = {}
    for r in got.collect():
        found.setdefault((r.query_id, r.file), []).append((r.place, r.chunk_key))
    assert all(sorted(found[q, f"f{p}"]) == [(1, 3 * q + p), (2, p if q else p + 3)] for q in range(30) for p in (0, 1)) and all(len(found[q, "f2"]) == 2 for q in range(30))
    assert max(made(got, "Join")) <= 30 * 100  # the third file's chunks for those that have no hit there, not every file's


def test_languages_cut_a_text_once(spark):
    plan = spark.createDataFrame([("a",)], "text string").select(text_jobs.detect_language())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") <= 2  # one for texts of ASCII, one for others
    # no script has a letter below U+0100, no telling letter is one of ASCII
    low = spark.createDataFrame([(chr(c), c) for c in range(256)], "c string, n int")
    assert low.where(F.greatest(*[F.col("c").rlike(p).cast("int") for p, _ in text_jobs.SCRIPTS]) > 0).count() == 0
    assert low.where((F.col("n") < 128) & (F.greatest(*[F.lower("c").rlike(p).cast("int") for p, _ in text_jobs.TELLING_LETTERS]) > 0)).count() == 0
    said = [("¿QUÉ TAL?", "es"), ("Straße", "de"), ("AÇÃO", "pt"), ("IŞIK", "tr"), ("ŁÓDŹ", "pl"), ("Được không", "vi"), ("THỦ ĐÔ", "vi"), ("слово", "ru"), ("这是 the", "zh-CN"), ("— “le chat” est œuvre", "fr"), ("der Übung für", "de"), ("", "en"), (None, "en"), ("the der", "en")]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(said)], "i int, text string").select("i", text_jobs.detect_language().alias("l")).collect()
    assert {r.i: r.l for r in got} == {i: x for i, (_, x) in enumerate(said)}


def test_a_task_gives_its_nearest_once_and_not_once_a_batch(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "PRODUCT_BLOCK", 600, raising=False)
    rng = np.random.default_rng(8)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist(), i % 5) for i in range(400)] + [(400, [0.0] * 4, 1), (401, [float("nan"), 1.0, 0.0, 0.0], 2)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").coalesce(1)
    asked = vectors.where("vec_id % 8 = 0 or vec_id = 401").select(F.col("vec_id").alias("query_id"), "embedding")
    v = {i: np.array(x) for i, x, _ in rows}
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        for cosine in (True, False):
            got = retrieval.nearest_vectors(asked, vectors, 3, "vec_id", cosine=cosine).collect()
            assert len(got) <= 3 * asked.count()
            found = {}
            for r in got:
                found.setdefault(r.query_id, set()).add((r.value, r.vec_id))
            unit = lambda x: x / (np.sqrt(x @ x) or 1)
            for q in range(0, 401, 8):
                other = [i for i in v if i != 401 and not (cosine and i == q)]
                value = lambda i: round(float(unit(v[i]) @ unit(v[q])), 9) + 0.0 if cosine else round(float(((v[i] - v[q]) ** 2).sum()), 6)  # noqa: B023, E731
                assert found[q] == {(value(i), i) for i in sorted(other, key=lambda i: (-value(i) if cosine else value(i), i))[:3]}, (q, cosine)
            assert 401 not in found
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
