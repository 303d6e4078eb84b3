"""Queries G10, G14, M17, Q7, I3, E9 and E17 over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusframe.functions import text as T
from corpusframe.operators import notes as N
from corpusframe.operators import retrieval as R
from corpusframe.plans.inputs import paragraphs, questions, table
from corpusframe.plans.q_corpus import ORACLE_SQL as CORPUS
from corpusframe.plans.q_corpus import _status
from corpusframe.plans.q_retrieval import _VOTE, _candidates, _chunks, _knn, _vectors


def _asked(s, d):
    """Every test item asks for two nodes."""
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array(F.col("item_id") % 100 + 1, (F.col("item_id") * 7) % 100 + 1)).alias("k")).select("query_id", F.concat(F.lit("n"), "k").alias("node"))


def _files(s, d):
    return table(s, d, "documents").select(F.concat(F.lit("n"), F.col("doc_id") % 1000).alias("node"), "doc_id", (F.col("lang") == "de").alias("is_draft"))


def _notes(s, d):
    return N.question_notes(_asked(s, d), _status(s, d))


def _companions(s, d):
    q = questions(s, d).select("query_id", F.col("text").alias("question"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("priority"))
    asked = q.select("query_id", "question", "priority", (F.col("query_id") * 4 + F.col("priority")).alias("doc_id"), F.lit(None).cast("string").alias("number"))
    return N.companion_passages(asked, paragraphs(s, d), table(s, d, "labels").where("toxic = 1").select((F.col("doc_id") / 4).cast("long").alias("query_id"), "doc_id"))


def _kinds(s, d):
    n = F.col("doc_id")
    name = F.when(n % 6 == 3, "Thong_tu_huong_dan.doc").when(n % 6 == 4, "12-kh-truong.pdf").otherwise("ban-sao.pdf")
    head = F.when(n % 6 == 1, F.concat(F.lit("Số: "), n % 900 + 1, F.lit("/2020/ND-CP\n"))).when(n % 6 == 2, "BỘ GIÁO DỤC\nQUYẾT ĐỊNH\nVề việc học\n").when(n % 6 == 5, "Số: /BGDĐT-GDPT\nV/v triển khai Thông tư 27/2020/TT-BGDĐT\n").otherwise("")
    rows = table(s, d, "documents").select("doc_id", name.alias("name"), F.concat(head, "text").alias("text"), F.when(n % 6 == 0, "Chỉ thị").alias("kind"), F.lit(None).cast("string").alias("number"))
    return N.document_kind(rows)


def _topics(s, d):
    n = F.col("item_id").cast("string")
    q = F.when(F.col("item_id") % 4 == 0, F.concat(F.lit("Chương trình giáo dục "), n, F.lit(" đặt ra những yêu cầu nào về phẩm chất "), n, F.lit("?"))).when(F.col("item_id") % 4 == 1, F.concat(F.lit("Tiếng trung dạy từ lớp "), n)).when(F.col("item_id") % 4 == 2, F.concat(F.lit("Nói rõ hơn về môn học trong Chương trình "), n, F.lit("?"))).otherwise(F.lit("Học sinh phổ thông được nghỉ mấy ngày về mùa hè không?"))
    return table(s, d, "benchmark").select("item_id", N.topic_and_scope(q).alias("t")).select("item_id", "t.topic", "t.scope")


def _stored(s, d):
    c = table(s, d, "conversations").select("conv_id").distinct()
    k = F.col("conv_id")
    runs = c.select(F.lit("r").alias("run_id"), F.concat(F.lit("q"), k).alias("question"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("s"), (k + i * 3) % 20, F.lit("."))).alias("names"), F.lit(None).cast("array<string>").alias("expected"))
    labels = c.where(k % 5 != 0).select(F.concat(F.lit("q"), k).alias("question"), F.array(F.concat(F.lit("s"), (k * 2) % 20, F.lit("."))).alias("expected"), F.when(k % 2 == 0, "dev").otherwise("test").alias("split"))
    return N.rescored(runs, labels, "dev").select("question", "rr", "hit_1", "hit_10", "ndcg")


def _choice(s, d):
    c = _candidates(s, d).groupBy("query_id").agg(F.max("idf_coverage").alias("coverage"), F.min(F.coalesce("dist", F.lit(9.99))).alias("dist"))
    return N.gate_choice(c.select((F.col("coverage") < 0.1).alias("off_topic"), "coverage", "dist"))


QUERIES = {
    "G10_notes": lambda s, d: _notes(s, d).select("query_id", "node", "note", "from"),
    "G10_pull": lambda s, d: N.documents_to_pull(_notes(s, d), _files(s, d)),
    "G14_companions": _companions,
    "M17_kinds": _kinds,
    "Q7_topics": _topics,
    "I3_confusion": lambda s, d: N.confusion(_knn(s, d).join(_vectors(s, d), "vec_id")),
    "E17_rescored": _stored,
    "E9_choice": _choice,
}
_S = f"s AS ({CORPUS['G5_status']}), a AS (SELECT DISTINCT item_id AS query_id, 'n' || k AS node FROM (SELECT item_id, unnest([item_id % 100 + 1, (item_id * 7) % 100 + 1]) AS k FROM benchmark))"
ORACLE_SQL = {
    "G10_notes": f"WITH {_S} SELECT query_id, node, node || ' ' || CASE status WHEN 'expired' THEN 'no longer in force, replaced by' WHEN 'expiring' THEN 'in force until it is replaced by' WHEN 'partly' THEN 'repealed in part by' ELSE 'amended by' END || ' ' || replace(\"by\", ',', ', ') AS note, \"from\" FROM a JOIN s USING (node) WHERE status IN ('expired', 'expiring', 'partly', 'amended')",
    "G10_pull": f"WITH {_S}, e AS (SELECT query_id, node, CASE status WHEN 'partly' THEN 'repeal' WHEN 'amended' THEN 'amend' ELSE 'replace' END AS rel, unnest(string_split(\"by\", ',')) AS b FROM a JOIN s USING (node) WHERE status IN ('expired', 'expiring', 'partly', 'amended')) SELECT DISTINCT query_id, node, rel, b AS \"by\", doc_id FROM e JOIN documents ON b = 'n' || (doc_id % 1000) WHERE lang <> 'de'",
    "M17_kinds": "SELECT doc_id, ['Chỉ thị', 'Nghị định', 'Quyết định', 'Thông tư', 'Kế hoạch', 'Công văn'][doc_id % 6 + 1] AS kind FROM documents",
    "Q7_topics": "SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'Chương trình giáo dục ' || item_id WHEN 2 THEN 'Chương trình ' || item_id END AS topic, CASE item_id % 4 WHEN 0 THEN 'phẩm chất ' || item_id WHEN 3 THEN 'mùa hè' ELSE '' END AS scope FROM benchmark",
    "I3_confusion": f"WITH {_VOTE} SELECT label AS true, predicted AS said, count(*) AS n FROM pr JOIN embeddings USING (vec_id) GROUP BY ALL",
    "E17_rescored": "WITH c AS (SELECT DISTINCT conv_id AS k FROM conversations WHERE conv_id % 5 <> 0 AND conv_id % 2 = 0), h AS (SELECT k, list_position(list_transform(range(0, 10), lambda i: (k + i * 3) % 20), (k * 2) % 20) AS r FROM c) SELECT 'q' || k AS question, CASE WHEN r > 0 THEN round(1.0 / r, 9) ELSE 0 END AS rr, CASE WHEN r = 1 THEN 1 ELSE 0 END AS hit_1, CASE WHEN r > 0 THEN 1 ELSE 0 END AS hit_10, CASE WHEN r > 0 THEN round(ln(2.0) / ln(r + 1.0), 9) ELSE 0 END AS ndcg FROM h",
}
