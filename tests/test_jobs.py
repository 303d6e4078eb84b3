"""Jobs on small tables with known answers."""

import datetime as dt
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusframe.functions import text as T
from corpusframe.operators import calculators, catalog, chunking, evaluation, graph, lineage, metadata, notes, retrieval, text_jobs, usage
from corpusframe.operators.order import row_numbers
from corpusframe.sources import readers, tables
from corpusframe.streaming import jobs


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr("v").alias("x")).first().x


@pytest.mark.parametrize(
    "expr, value, expected",
    [
        (T.tokens, "Bài_1 là gì, của Tin học?", ["bài", "tin", "học"]), (T.fold_accents, "Đường Tin học", "Duong Tin hoc"), (T.split_camel_num, "Bai1_TinHoc5", "Bai 1_Tin Hoc 5"),
        (T.tokens_expanded, "Tin học", ["tin", "học", "hoc"]), (T.spell_out, "Tiết dạy của GV THPT cấp 3", "Tiết dạy của giáo viên trung học phổ thông"), (T.compact, " Có hiệu  lực\n", "cohieuluc"),
        (T.clean_ocr, "a | b  c\n• d ", "a b c\n d"), (T.first_url, "xem https://a.vn/b?c=1). nhé", "https://a.vn/b?c=1"), (T.first_url, "không", None), (T.tokens, None, []), (T.fold_accents, None, ""),
        (T.plain_evasion, "Sh!t... d.i.t", "shit d i t"), (T.short_title, "a  b", "a b"), (T.compact_positions, "a b\nc", [0, 2, 4]),
    ],
)
def test_text_functions(spark, expr, value, expected):
    assert one(spark, value, expr) == expected


def test_query_expansion(spark):
    got = one(spark, "hs THPT thời khóa biểu cấp 2 AI", T.expand_query)
    assert got.count("tkb") == 1 and {"học", "sinh", "trung", "thcs"} <= set(got) and got[-5:] == ["ai", "trí", "tuệ", "nhân", "tạo"]


def test_numbers(spark):
    for text, number in (("2.340.000", 2340000), ("2,5", 2.5), ("2.34", 2.34), ("x", None)):
        assert one(spark, text, T.parse_vn_number) == number
    for text, canon in (("2.340,5", "2340,5"), ("2.340", "2340"), ("1,234", "1234")):
        assert one(spark, text, T.canonical_number) == canon


def test_languages(spark):
    rows = [("안녕", "ko"), ("こんにちは", "ja"), ("你好", "zh-CN"), ("Привіт, як справи, її", "uk"), ("привет", "ru"), ("سلام چطور", "fa"), ("Tin học lớp", "vi"), ("el perro y la casa es muy", "es"), ("der Hund und die Katze", "de"), ("", "en"), ("truong hoc sinh giao vien", "vi")]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, text string").select("i", text_jobs.detect_language().alias("l")).orderBy("i").collect()
    assert [r.l for r in got] == [x for _, x in rows]


def test_blocked_words(spark):
    terms, bare = {"bad": ("địt", "óc chó")}, {"bad": ("vcl",), "worse": ("shit",)}
    rows = ["đ.ị.t", "địttttt", "hạt óc chó ngon", "óc chó", "vcllll", "sh!t happens", "bullish", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, text string")
    got = [r.groups for r in text_jobs.flag_blocked(df, terms, bare, allowed=("hạt óc chó",)).orderBy("i").collect()]
    assert got == [["bad"], ["bad"], [], ["bad"], ["bad"], ["worse"], [], []]


def test_document_numbers(spark):
    got = one(spark, "Căn cứ Nghị định 071/2020/ND-CP, Luật 43/2019/QH14 và 527/QĐ-TTg; Thông tư 27 / 2020 / TT-BGDDT, 71/2020/NĐ-CP", metadata.extract_numbers)
    assert got == ["71/2020/NĐ-CP", "27/2020/TT-BGDĐT", "527/QĐ-TTg", "43/2019/QH14"]
    assert one(spark, "Thông-tư-27-2020-tt-bgddt.doc", metadata.number_from_name) == "27/2020/TT-BGDĐT"
    assert one(spark, "huong-dan-27-2020-tt-bgddt.doc", metadata.number_from_name) is None
    assert one(spark, "27/2020/TT-BGDĐT", lambda v: metadata.document_type(F.col(v))) == "Thông tư"
    assert one(spark, "ngày 31 tháng 2 năm 2020", lambda v: metadata.issue_date(F.col(v))) is None


def test_relations(spark):
    rows = [(1, "Bãi bỏ khoản 2 Điều 5 của Thông tư số 1/2020/TT-BGDĐT."), (2, "Thay thế Thông tư số 1/2020/TT-BGDĐT."), (3, "được sửa đổi theo quy định tại Nghị định số 3/2025/NĐ-CP"), (4, "thay thế thành viên Hội đồng trường"), (5, None)]
    got = metadata.relations(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.rel, r.target, r.partial) for r in got} == {(1, "repeal", "1/2020/TT-BGDĐT", True), (2, "replace", "1/2020/TT-BGDĐT", False)}


def test_status_as_of_a_day(spark):
    d = dt.date
    nodes = spark.createDataFrame([("a", d(2000, 1, 1), None, None), ("b", d(2010, 1, 1), d(2010, 3, 1), None), ("c", None, None, 2030)], "node string, issued date, effective date, year int")
    edges = spark.createDataFrame([("b", "replace", "a", False, "text")], "src string, rel string, dst string, partial boolean, origin string")
    on = lambda day: {r.node: r.status for r in graph.status_as_of(nodes, edges, F.lit(day)).collect()}
    assert on(d(2010, 2, 1)) == {"a": "expiring", "b": "not_yet", "c": "not_yet"} and on(d(2011, 1, 1)) == {"a": "expired", "b": "in_force", "c": "not_yet"}
    today = F.lit(d(2026, 1, 1))
    for text, day in (("vào ngày 5/3/2020", d(2020, 3, 5)), ("tháng 2 năm 2024", d(2024, 2, 29)), ("năm 2019", d(2019, 12, 31)), ("năm 1980", None), ("hiện nay", None)):
        assert one(spark, text, lambda v: graph.question_as_of(F.col(v), today)) == day


def test_curated_edges_win(spark):
    kind = "src string, rel string, dst string, partial boolean"
    e = graph.build_edges(spark.createDataFrame([("a", "repeal", "b", True), ("a", "replace", "b", False), ("x", "amend", "y", False), ("z", "amend", "z", False), ("p", "amend", "q", False)], kind), spark.createDataFrame([("p", "amend", "q", True)], kind), spark.createDataFrame([("x", "amend", "y"), ("p", "amend", "q")], "src string, rel string, dst string"))
    assert {(r.src, r.rel, r.dst, r.origin) for r in e.collect()} == {("a", "replace", "b", "text"), ("p", "amend", "q", "curated")}


def test_catalog_difference(spark):
    cat = spark.createDataFrame([("a", "1", 1, 1), ("b", "2", 1, 1), ("c", "3", 1, 1), ("d", "4", 1, 1)], "path string, hash string, size long, modified_ns long")
    led = spark.createDataFrame([("a", "1", "processed", 1, 1), ("b", "x", "processed", 1, 1), ("c", "3", "no_text", 1, 1), ("e", "5", "processed", 1, 1)], "path string, hash string, status string, size long, modified_ns long")
    assert {r.path: r.change for r in catalog.diff_catalog(cat, led).collect()} == {"a": "unchanged", "b": "modified", "c": "new", "d": "new", "e": "deleted"}
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "id int")
    assert catalog.plan_removals(ids(range(90)), ids(range(100)), True).count() == 10
    assert catalog.plan_removals(ids(range(50)), ids(range(100)), True).count() == 0 and catalog.plan_removals(ids(range(90)), ids(range(100)), False).count() == 0
    a = catalog.corpus_fingerprint(cat, "path", "hash").first()
    assert a == catalog.corpus_fingerprint(cat.orderBy(F.desc("path")).repartition(3), "path", "hash").first()


def test_metrics_of_ranked_lists(spark):
    rows = spark.createDataFrame([("q1", ["a", "b x", "c"], ["X", "c"], "g", 2), ("q2", ["a"], ["z"], None, 1)], "query_id string, names array<string>, expected array<string>, grp string, n_relevant int")
    judged = evaluation.relevance_ranks(rows)
    assert {r.query_id: r.ranks for r in judged.collect()} == {"q1": [2, 3], "q2": []}
    m = {r.query_id: r for r in evaluation.rank_metrics(judged).collect()}
    assert m["q1"].rr == 0.5 and m["q1"].hit_1 == 0 and m["q1"].hit_3 == 1 and m["q1"].ap == pytest.approx((1 / 2 + 2 / 3) / 2) and m["q2"].ndcg == 0
    total = evaluation.summary(evaluation.rank_metrics(judged)).where("grp is null").first()
    assert total.questions == 2 and total.mrr == 0.25 and total.misses == 1


def test_split_keeps_what_is_set(spark):
    rows = [(i, "g", "test" if i == 0 else None) for i in range(50)] + [(100, "h", None), (200, "k", None), (201, "k", None)]
    got = evaluation.stratified_split(spark.createDataFrame(rows, "id int, grp string, split string"), "grp", "id").collect()
    n = {g: sum(r.split == "test" for r in got if r.grp == g) for g in "ghk"}
    assert n == {"g": 20, "h": 0, "k": 1} and next(r for r in got if r.id == 0).split == "test"


def test_diversified_list(spark):
    rows = [("q", k, s, t, float(x)) for k, s, t, x in [("1", "a", "same", 9), ("2", "a", "other", 8), ("3", "a", "third", 7), ("4", "b", "SAME ", 6), ("5", "b", "new", 5)]]
    got = retrieval.diversified(spark.createDataFrame(rows, "query_id string, key string, source string, text string, score double"), "key", 3).orderBy("place").collect()
    assert [r.key for r in got] == ["1", "2", "5"]


def test_grounding(spark):
    df = spark.createDataFrame([("see [1] and [3]: 2.340 and 17,5 of 9", ["pay 2340", "x"], ["f.pdf"])], "answer string, evidence array<string>, names array<string>")
    r = evaluation.check_answers(df).first()
    assert r.bad_citations == [3] and r.loose_numbers == ["17,5"]


def test_pieces_stay_within_their_limits():
    text = "\n".join("x" * (i % 90) + " end." for i in range(200)) + "y" * 3000
    parts = chunking.split_text(text)
    assert all(len(p) <= 1200 and text[a : a + len(p)] == p for a, p in parts)
    covered = 0
    for a, p in parts:
        assert covered - 150 <= a <= covered or not text[covered:a].strip()
        covered = max(covered, a + len(p))
    assert covered == len(text) and chunking.split_text("") == []


def test_sections(spark):
    df = spark.createDataFrame([(1, "short\nArticle 1. a\nArticle 2. b"), (2, "no heading"), (3, None)], "doc_id int, text string")
    got = [(r.doc_id, r.heading, r.start) for r in chunking.sections(df, r"Article \d+\.").orderBy("doc_id", "seq").collect()]
    assert got == [(1, "Article 1.", 6), (1, "Article 2.", 19), (2, None, 0)]


def test_row_numbers(spark):
    df = spark.createDataFrame([(float(x * x),) for x in range(200)], "v double").repartition(5)
    assert [r.row_no for r in row_numbers(df, "v").orderBy("v").collect()] == list(range(200)) and row_numbers(df.limit(0), "v").count() == 0


def test_results(spark):
    rows = [(1, s, 8.5) for s in range(7)] + [(1, 7, 3.0)] + [(2, s, 9.5) for s in range(7)]
    got = {r.student: (r.level, r.excellent) for r in calculators.classify_results(spark.createDataFrame(rows, "student int, subject int, average double")).collect()}
    assert got == {1: (2, False), 2: (4, True)}


def test_usage_of_no_turns(spark):
    kind = "turn_id long, conv_id string, seconds double, refused boolean, from_cache boolean, citation_ok boolean, figures_ok boolean"
    r = usage.usage_totals(spark.createDataFrame([], kind)).first()
    assert r.turns == 0 and r.refusal_rate == 0.0


def test_subtitles_and_html(spark):
    srt = "1\n00:00:01,000 --> 00:00:02,500\n<i>Hello</i> you\n\n2\n00:00:03,000 --> 00:00:04,000\nthere\n"
    cues = readers.subtitle_cues(spark.createDataFrame([("a.srt", srt)], "path string, text string"))
    block = readers.subtitle_blocks(cues).collect()
    assert [(b.start, b.end, b.text) for b in block] == [(1.0, 4.0, "Hello you there")]
    page = spark.createDataFrame([(1, "<head><title>T &amp; U</title></head><script>x</script><p>a&lt;b</p><p>c</p>")], "page_id int, html string")
    assert readers.html_to_text(page, blocks=True).first().text == "a<b\nc" and readers.html_to_text(page).first().title == "T & U"


def test_limiter_remembers_accepted_hits_only():
    assert jobs.accepted([0, 1, 2, 61, 61.5], 2, 60, [])[0] == [True, True, False, True, True]


def test_streams_agree_with_tables(spark, tmp_path):
    rows = [(f"k{i % 3}", dt.datetime(2024, 1, 1, 0, i % 50, i % 60), i) for i in range(150)]
    spark.createDataFrame(rows, "key string, at timestamp, id long").coalesce(1).write.parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = jobs.limiter(stream, 5, 600).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c1")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert {(r.id, r.allowed) for r in spark.table("limited").collect()} == {(r.id, r.allowed) for r in jobs.limited(table, 5, 600).collect()}
    q = jobs.daily_counts(stream.withColumnRenamed("key", "kind")).writeStream.format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "c2")).outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert sum(r.n for r in spark.table("daily").collect()) == 150


def test_registered_queries_have_functions_and_sql():
    from corpusframe.plans import registry

    queries, sql = registry.queries(), registry.oracle_sql()
    assert len(queries) > 90 and set(sql) <= set(queries)


def test_within_document_ranks_only_the_own_document(spark):
    rows = [(i, 2, f"alpha u{i}") for i in range(100, 10_150)] + [(1, 1, "alpha " + " ".join(f"f{i}" for i in range(50)))] + [(k, 3, "beta" + "x" * k) for k in range(2, 8)]
    chunks = spark.createDataFrame(rows, "chunk_key long, doc_id long, text string")
    questions = spark.createDataFrame([(1, 1, "alpha"), (2, 3, "omega"), (3, 3, "betaxxxxxx")], "query_id long, doc_id long, text string")
    got = sorted(tuple(r) for r in lineage.within_document(questions, chunks).collect())
    assert got == [(1, 1, 1), (2, 2, 1), (2, 3, 2), (2, 5, 3), (2, 6, 4), (3, 6, 1)]


def test_decomposed_letters_count_as_composed(spark):
    words = ["Tin h\u1ecdc l\u1edbp", "\u1ead \u1ebf \u1eef \u1ee3 \u1eb6 \u1e17", "\u00e9\u0302 x", "Vi\u1ec7t Nam \u0111\u01b0\u1eddng ph\u1ed1", "na\u00efve Z\u00fcrich \u00e7\u00e0", "", "q\u0303 plain"]
    forms = [unicodedata.normalize(f, w) for w in words for f in ("NFC", "NFD")] + ["a\u0302\u0323", "a\u0323\u0302", None]
    rows = spark.createDataFrame(list(enumerate(forms)), "i long, t string").select("i", T.composed("t").alias("c"), T.fold_accents("t").alias("f"), T.raw_tokens("t").alias("w")).orderBy("i").collect()
    for r, t in zip(rows, forms, strict=True):
        whole = unicodedata.normalize("NFC", t or "")
        assert r.c == whole
        bare = "".join(c for c in unicodedata.normalize("NFD", t or "") if not unicodedata.combining(c)).translate({ord("đ"): "d", ord("Đ"): "D"})
        assert r.f == bare
        assert r.w == re.findall(r"[^\W_][\w\u0300-\u036f]*", whole.lower())


def test_relations_of_the_harder_kinds(spark):
    far = "Văn bản áp dụng cho cơ sở giáo dục phổ thông và giáo dục thường xuyên trên cả nước. "
    rows = [
        (1, "3. Thông tư số 1/2020/TT-BGDĐT ngày 2 hết hiệu lực\nkể từ ngày Thông tư này có hiệu lực."),
        (2, "Khoản 2 Điều 3 của Nghị định số 7/2019/NĐ-CP hết hiệu lực thi hành khi Nghị định này bắt đầu có hiệu lực"),
        (3, "hết hiệu lực Thông tư số 5/2020/TT-BGDĐT"),
        (4, f"Bãi bỏ Điều 5 của Nghị định số 8/2018/NĐ-CP. {far}Thay thế Nghị định số 8/2018/NĐ-CP"),
        (5, "Bãi bỏ cụm từ ABC tại Nghị định số 9/2018/NĐ-CP"),
        (6, "Nghị định số 311/2025/NĐ-CP sửa đổi, bổ sung Nghị định số 71/2020/NĐ-CP"),
        (7, "sửa đổi, bổ sung bởi Luật số 4/2019/QH14"),
        (8, None),
    ]
    got = {(r.doc_id, r.rel, r.target, r.partial) for r in metadata.relations(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {
        (1, "repeal", "1/2020/TT-BGDĐT", False), (2, "repeal", "7/2019/NĐ-CP", True), (3, "repeal", "5/2020/TT-BGDĐT", False),
        (4, "replace", "8/2018/NĐ-CP", False), (5, "amend", "9/2018/NĐ-CP", True),
    }


def test_own_numbers_and_mentions(spark):
    rows = [
        (1, "12-2020-tt-bgddt.doc", "Số: 99/2021/TT-BGDĐT"), (2, "0043_ban.pdf", "Theo Luật số 8/2012/QH13\nSố: 43/2019/QH14"), (3, "5_x.pdf", "\nSố: 77/2021/NĐ-CP\n"),
        (4, "quy-che.pdf", "Theo Luật số 8/2012/QH13 thì"), (5, "31_signed.pdf", "Số:   /TT-BGDĐT\nHà Nội, ngày 2 tháng 3 năm 2024"), (6, None, None),
    ]
    got = {r.doc_id: (r.number, r.origin, r.guessed) for r in metadata.own_number(spark.createDataFrame(rows, "doc_id long, name string, text string")).collect()}
    assert got == {
        1: ("12/2020/TT-BGDĐT", "name", False), 2: ("43/2019/QH14", "header", False), 3: ("77/2021/NĐ-CP", "field", True),
        4: (None, None, None), 5: ("31/2024/TT-BGDĐT", "signed", True), 6: (None, None, None),
    }


def test_nearest_vectors_in_blocks_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    data = [(i, rng.normal(size=5).round(1).tolist()) for i in range(60)] + [(60, [0.0] * 5)]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3)
    asked = vectors.select(F.col("vec_id").alias("query_id"), "embedding")
    for block in (7, 2048):
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
        got = {(r.query_id, r["rank"]): r.vec_id for r in retrieval.dense(asked, vectors, 4).collect()}
        v = {i: np.array(x, np.float32).astype(float) for i, x in data}
        for q in v:
            want = sorted(v, key=lambda i: (round(float(((v[i] - v[q]) ** 2).sum()), 6), i))[:4]
            assert [got[q, k] for k in range(1, 5)] == want
    assert retrieval.dense(asked.limit(0), vectors, 4).count() == 0 and retrieval.dense(asked, vectors.limit(0), 4).count() == 0


def test_activity_batches_over_hours_match_one_sorted_pass(spark):
    rng = np.random.default_rng(6)
    at = sorted(1_700_000_000 + int(x) for x in rng.integers(0, 40_000, 60)) + [1_700_100_000, 1_700_100_600, 1_700_101_200]
    rows = spark.createDataFrame([(x,) for x in at], "s long").select(F.timestamp_seconds("s").alias("at"))
    got = sorted((r.b, r.n) for r in jobs.activity_batches(rows, "600 seconds").select(F.unix_timestamp("begin").alias("b"), "n").collect())
    want, last = [], None
    for x in at:
        if last is None or x - last >= 600:
            want.append([x, 0])
        want[-1][1] += 1
        last = x
    assert got == [tuple(w) for w in want]


def test_notes_name_what_replaced_a_document(spark):
    asked = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "d")], "query_id long, node string")
    day = dt.date(2030, 1, 1)
    status = spark.createDataFrame([("a", "expired", ["x", "y"], None), ("b", "in_force", [], None), ("c", "expiring", ["z"], day), ("d", "partly", ["x"], None)], "node string, status string, by array<string>, `from` date")
    said = notes.question_notes(asked, status)
    assert {(r.query_id, r.note, r["from"]) for r in said.collect()} == {(1, "a no longer in force, replaced by x, y", None), (2, "c in force until it is replaced by z", day), (2, "d repealed in part by x", None)}
    files = spark.createDataFrame([("x", 7, False), ("y", 8, True), ("z", 9, False)], "node string, doc_id long, is_draft boolean")
    assert {tuple(r) for r in notes.documents_to_pull(said, files).collect()} == {(1, "a", "replace", "x", 7), (2, "c", "replace", "z", 9), (2, "d", "repeal", "x", 7)}


def test_companions_give_their_best_passage(spark):
    asked = spark.createDataFrame([(1, "học phí đại học", 5, "71/2020/NĐ-CP", 0), (1, "học phí đại học", 6, None, 1), (1, "học phí đại học", 7, None, 2), (1, "học phí đại học", 8, None, 3)], "query_id long, question string, doc_id long, number string, priority int")
    passages = spark.createDataFrame([(5, 0, "học phí đại học công lập"), (5, 1, "sửa đổi Nghị định số 71/2020/NĐ-CP"), (6, 0, "khác"), (6, 1, "khác nữa"), (7, 0, "học phí"), (8, 0, "học phí đại học")], "doc_id long, seq int, text string")
    present = spark.createDataFrame([(1, 7)], "query_id long, doc_id long")
    got = [(r.doc_id, r.seq, r.place) for r in notes.companion_passages(asked, passages, present).orderBy("place").collect()]
    assert got == [(5, 1, 1), (6, 0, 2)]


def test_kinds_and_topics(spark):
    rows = [(1, "a.pdf", "x\nNGHỊ QUYẾT \ny", None, None), (2, "01-QD-BGDDT.pdf", "", None, None), (3, "a.pdf", "(Ban hành kèm theo Quyết định của Bộ)", None, None), (4, "a.pdf", "trích V/v nghỉ hè", None, None), (5, "a.pdf", "", None, "3/2020/TT-X"), (6, None, None, None, None)]
    got = {r.doc_id: r.kind for r in notes.document_kind(spark.createDataFrame(rows, "doc_id long, name string, text string, kind string, number string")).collect()}
    assert got == {1: "Nghị quyết", 2: "Quyết định", 3: "Quyết định", 4: "Công văn", 5: "Thông tư", 6: None}
    split = lambda q: tuple(one(spark, q, lambda v: notes.topic_and_scope(F.col(v))))
    assert split("Năng lực chung trong Chương trình tổng thể gồm những gì?") == ("Chương trình tổng thể", "")
    assert split("Các quy định hiện hành về hồ sơ là gì") == ("Các quy định hiện hành về hồ sơ", "") and split("Học sinh giỏi cần gì về điểm số?") == (None, "điểm số") and split(None) == (None, "")


def test_the_register_keeps_runs_apart(spark, tmp_path):
    kind = "run_id string, question_set string, split string, mode string, grp string, sample int, complete boolean, at long, v int"
    runs = [("r1", "s", "dev", "m", "g", None, True, 1, 1), ("r2", "s", "dev", "m", "g", None, True, 2, 2), ("r3", "s", "dev", "m", "g", None, False, 3, 3), ("r4", "s", "test", "m", "g", 5, True, 1, 4)]
    for r in runs:
        notes.record_run(spark.createDataFrame([r], kind), str(tmp_path / "runs"))
    assert {r.run_id for r in notes.latest_runs(spark.read.parquet(str(tmp_path / "runs"))).collect()} == {"r2", "r4"}


def test_the_gate_is_chosen_with_a_margin(spark):
    rows = spark.createDataFrame([(True, 0.05, 1.4), (True, 0.3, 1.25), (False, 0.3, 0.9), (False, 0.5, 1.0)], "off_topic boolean, coverage double, dist double")
    r = notes.gate_choice(rows).first()
    assert (r.least, r.most, r.caught, r.total, r.margin) == (0.04, 1.1, 2, 2, 0.1)
    assert notes.gate_choice(rows.withColumn("off_topic", F.lit(False)), distances=(0.8,)).count() == 0


def test_parts_of_elements_are_numbered(spark):
    long = " ".join(f"word{i}." for i in range(400))
    rows = spark.createDataFrame([(1, "slide 1", long), (2, "slide 2", "short"), (3, "slide 3", None)], "doc_id long, label string, text string")
    got = sorted(chunking.element_chunks(rows, ["doc_id"], "label").collect())
    own = [r for r in got if r.doc_id == 1]
    assert [r.label for r in own] == [f"slide 1 (phần {i + 1}/{len(own)})" for i in range(len(own))] and len(own) > 1 and {r.format for r in got} == {"theo_phan_tu"}
    assert all(r.text == long[r.offset : r.offset + len(r.text)] and len(r.text) <= 1200 for r in own)
    covered = set().union(*(range(r.offset, r.offset + len(r.text)) for r in own))
    assert covered >= {i for i, c in enumerate(long) if not c.isspace()}
    assert [(r.label, r.text) for r in got if r.doc_id > 1] == [("slide 2", "short")]


def test_variants_of_evasion_match_a_plain_version(spark):
    joined = lambda t: re.sub(r"(?<![^\s])([^\W\d_]) (?=[^\W\d_](\s|$))", r"\1", t)
    for text, base in (("d i t  me!", "d i t me"), ("heeello", "heeello"), ("a​b", "ab"), ("SH!T", "shit"), ("", "")):
        got = one(spark, text, T.evasion_variants)
        j = joined(base)
        assert got == [base, j, re.sub(r"(\w)\1{2,}", r"\1\1", j), re.sub(r"(\w)\1+", r"\1", j)], text


def test_records_from_outside(spark):
    docs = spark.createDataFrame([(1, "a.pdf", "Sốf92 năm"), (2, "b.signed.pdf", "số 2026"), (3, "c.pdf", None), (4, "d.pdf", "2025 1969")], "doc_id long, name string, text string")
    said = spark.createDataFrame(
        [(1, "92 / QĐ-TTg", "2025-09-15", True), (2, "26/2020/TT-BGDĐT", "2025-09-45", True), (3, "5/2020/TT-BGDĐT", None, None), (4, "2025/2025/TT-BGDĐT", " 2024-02-29 ", False), (9, "1/2020/TT-X", None, None)],
        "doc_id long, number string, issued string, is_draft boolean",
    )
    got = {r.doc_id: (r.number, r.issued, r.is_draft) for r in metadata.valid_records(said, docs).collect()}
    assert got == {1: ("92/QĐ-TTg", "2025-09-15", True), 2: ("26/2020/TT-BGDĐT", None, False), 3: (None, None, False), 4: (None, "2024-02-29", False)}
    heads = spark.createDataFrame([(1, "CỘNG HÒA XÃ HỘI"), (2, "Căn cứ Luật"), (3, "CQNG HOA XA HOI"), (4, "giáo án"), (5, "căn cứ")], "doc_id long, text string")
    own = spark.createDataFrame([(1, "1/2020/TT-X", False), (2, "2/2020/TT-X", True)], "doc_id long, number string, guessed boolean")
    assert sorted(r.doc_id for r in metadata.records_wanted(heads, own).collect()) == [2, 3, 5]


def test_followups_of_attachments_and_role_first(spark):
    answers = spark.createDataFrame([(1, "**first point** and **second one** and **third one**"), (2, "plain"), (3, None)], "conv_id long, text string")
    files = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, "c"), (2, 1, "z")], "conv_id long, place int, name string")
    got = {}
    for r in sorted(lineage.attachment_followups(answers, files, n=9).collect()):
        got.setdefault(r.conv_id, []).append(r.text)
    say = lineage.ATTACHED
    assert got[1] == [say["about"] % "first point", say["about"] % "second one", say["summary"] % "a", say["summary"] % "b", say["compare"], say["parts"] % "a", say["parts"] % "b", say["meaning"]]
    assert got[2] == [say["summary"] % "z", say["parts"] % "z", say["meaning"]] and got[3] == [say["meaning"]]
    rows = spark.createDataFrame([("x", 1, "p"), ("x", 2, "q"), ("y", 1, "q"), ("y", 2, "r"), ("z", 1, "s"), ("z", 2, None)], "grp string, pos int, text string")
    told = sorted(usage.role_first(rows, ["y", "none"], 3).collect())
    assert [(r.role, r.text) for r in told] == [("none", "p"), ("none", "q"), ("none", "s"), ("y", "q"), ("y", "r"), ("y", "p")]


def test_teaching_load_and_awards(spark):
    schools = spark.createDataFrame([(1, 19, 1), (2, 27, 2), (3, None, 1)], "id long, classes int, region int")
    duties = spark.createDataFrame([(1, "party_secretary", None, "lower"), (2, "party_secretary", None, "lower"), (3, "party_secretary", None, "lower"), (2, "subject_room", 2, "lower"), (2, "infant_care", None, "primary"), (3, "odd", None, None)], "id long, duty string, rooms int, level string")
    got = calculators.duty_lessons(duties, schools, spark.createDataFrame([("form", 4.0)], "duty string, lessons double"))
    assert sorted((r.id, r.duty, r.lessons) for r in got.collect() if r.lessons is not None) == [(1, "party_secretary", 4.0), (2, "infant_care", 4.0), (2, "party_secretary", 3.0), (2, "subject_room", 6.0)] and got.count() == 6
    staff = spark.createDataFrame([(1, "g", "p", "head"), (2, "g", "p", "teacher"), (3, "g", "none", "teacher"), (4, "g", "p", None)], "id long, kind string, level string, role string")
    load = calculators.general_load(staff, spark.createDataFrame([("g", "p", 10.0)], "kind string, level string, lessons_base double"), got)
    assert sorted(tuple(r) for r in load.collect()) == [(1, 2.0, 0.0, 2.0, False), (2, 10.0, 13.0, 0.0, True), (3, None, 0.0, None, False), (4, 10.0, 0.0, 10.0, False)]
    results = spark.createDataFrame([(1, 4, True), (2, 4, False), (3, 3, True), (4, 4, True)], "student long, level int, excellent boolean")
    conduct = spark.createDataFrame([(1, 4), (2, 4), (3, 4), (4, 3)], "student long, level int")
    assert sorted(tuple(r) for r in calculators.awards(results, conduct).collect()) == [(1, "excellent"), (2, "good")]


def test_schedule_expiry_typed_tables_and_counts(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    rows = [(k, day + dt.timedelta(hours=h)) for k, h in (("a", 0), ("a", 5), ("a", 11), ("b", 0), ("a", 40))]
    uses = spark.createDataFrame(rows, "key string, at timestamp")
    want = [("a", day, day + dt.timedelta(hours=17), 3), ("a", day + dt.timedelta(hours=40), day + dt.timedelta(hours=46), 1), ("b", day, day + dt.timedelta(hours=6), 1)]
    assert sorted(tuple(r) for r in jobs.expiring(uses, "6 hours").collect()) == want
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    uses.coalesce(1).write.parquet(source)
    write = lambda batch, k: batch.write.mode("overwrite").parquet(f"{out}/batch={k}")
    for _ in range(2):  # the second run finds nothing new
        stream = jobs.expiring(spark.readStream.schema(uses.schema).parquet(source), "6 hours", "1 hour")
        jobs.periodic(stream, write, str(tmp_path / "marks"), 0).awaitTermination()
    ended = sorted((r.key, r.begin, r.expires, r.uses) for r in spark.read.parquet(out).collect())
    assert ended == [w for w in want if w[2] <= day + dt.timedelta(hours=39)]
    path = str(tmp_path / "uploads")
    tables.append(spark.createDataFrame([("7", "n", 1), ("x", None, 2)], "id string, name string, extra int"), "uploads", path)
    back = tables.load(spark, "uploads", path)
    assert back.columns[:3] == ["id", "name", "stored_name"] and sorted((r.id is None, r.id, r.name) for r in back.collect()) == [(False, 7, "n"), (True, None, None)]
    seen, mark = tables.observed(uses, "uses", keys=F.max("key"))
    seen.write.format("noop").mode("overwrite").save()
    assert mark.get == {"n": 5, "keys": "b"}


def test_activity_of_a_table_ends_where_that_of_a_stream_does(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    at = spark.createDataFrame([(day + dt.timedelta(minutes=m),) for m in (0, 10, 20, 31, 59, 61, 69, 400)], "at timestamp")
    got = sorted(tuple(r) for r in jobs.activity_batches(at, "10 minutes").collect())
    assert [(r[0].minute + 60 * (r[0].hour), r[2]) for r in got] == [(0, 1), (10, 1), (20, 1), (31, 1), (59, 3), (400, 1)]
    at.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.activity_batches(spark.readStream.schema(at.schema).parquet(str(tmp_path / "in")), "10 minutes", "1 minute")
    jobs.periodic(stream, lambda b, k: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={k}"), str(tmp_path / "marks"), 0).awaitTermination()
    assert sorted((r.begin, r.end, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == got[:-1]
