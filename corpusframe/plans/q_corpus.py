"""Queries S4-S9, C1-C11, M1-M14, G2-G13, B1-B6 and W3-W6 over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusframe.functions import text as T
from corpusframe.operators import calculators as B
from corpusframe.operators import chunking as C
from corpusframe.operators import graph as G
from corpusframe.operators import metadata as M
from corpusframe.plans.inputs import PARAGRAPHS, paragraphs, table
from corpusframe.sources import readers as S
from corpusframe.streaming import jobs as W


def _elements(s, d):
    p = paragraphs(s, d)
    return p.select("doc_id", F.col("seq").alias("elem_no"), "text", (F.floor(F.col("seq") / 3) + 1).cast("int").alias("page"))


def _headed(s, d):
    """Documents with a heading in front of every line that opens with a capital D, L or T."""
    return table(s, d, "documents").select("doc_id", F.regexp_replace("text", r"(?m)^([DLT])", "Article 7. $1").alias("text"))


def _chunks(s, d):
    return paragraphs(s, d).select("doc_id", "seq", "text", "source", "lang")


FILL = "Văn bản áp dụng cho cơ sở giáo dục phổ thông và giáo dục thường xuyên trên cả nước."


def _legal(s, d):
    """Documents with a number, a date and relations made of their own columns, in front of their text."""
    n = F.col("doc_id")
    decree = F.concat(F.lit("Nghị định số "), (F.col("n_chars") % 300 + 1).cast("string"), F.lit("/2015/ND-CP"))
    next_ = F.concat(((n + 1) % 900 + 1).cast("string"), F.lit("/"), (2010 + (n + 1) % 14).cast("string"), F.lit("/TT-BGDDT"))
    said = (
        F.when(n % 5 == 0, F.concat(F.lit("Thay thế "), decree, F.lit("."))).when(n % 5 == 1, F.concat(F.lit("Bãi bỏ Thông tư số "), next_, F.lit("."))).when(n % 5 == 2, F.concat(F.lit("Sửa đổi, bổ sung một số điều của "), decree, F.lit(".")))
        .when(n % 5 == 3, F.concat(decree, F.lit(" hết hiệu lực kể từ ngày Thông tư này có hiệu lực."))).otherwise(F.concat(F.lit("Điều 5 được thay thế theo quy định tại "), decree, F.lit(".")))
    )
    head = F.concat(
        F.lit("Số: "), (n % 900 + 1).cast("string"), F.lit("/"), (2010 + n % 14).cast("string"), F.lit("/TT-BGDDT\nBộ Giáo dục và Đào tạo, ngày "), (n % 31 + 1).cast("string"), F.lit(" tháng "), (n % 12 + 1).cast("string"),
        F.lit(f" năm 2021\n{FILL} "), said, F.lit(f" {FILL} Bãi bỏ khoản 2 Điều 3 của Quyết định số 0527/QD-TTg; được sửa đổi theo Luật số 43/2019/QH14. Có hiệu lực thi hành từ ngày "), (n % 28 + 1).cast("string"), F.lit(" tháng 3 năm 2022.\n"),
    )
    return table(s, d, "documents").select("doc_id", F.concat(head, "text").alias("text"), F.concat_ws("-", F.lit("thong-tu"), (n % 900 + 1).cast("string"), F.lit("2020-tt-bgddt.doc")).alias("name"))


_LEGAL = """legal AS (SELECT doc_id, 'Số: ' || (doc_id % 900 + 1) || '/' || (2010 + doc_id % 14) || '/TT-BGDDT' AS own, doc_id % 31 + 1 AS d, doc_id % 12 + 1 AS m, n_chars % 300 + 1 AS r, text,
  CASE WHEN doc_id % 5 = 1 THEN ((doc_id + 1) % 900 + 1) || '/' || (2010 + (doc_id + 1) % 14) || '/TT-BGDĐT' ELSE (n_chars % 300 + 1) || '/2015/NĐ-CP' END AS mid FROM documents),
  rels AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'replace' WHEN 2 THEN 'amend' ELSE 'repeal' END AS rel, mid AS target, doc_id % 5 = 2 AS partial FROM legal WHERE doc_id % 5 <> 4 UNION ALL SELECT doc_id, 'repeal', '527/QĐ-TTg', true FROM legal)"""


def _based(s, d):
    """Documents with an attachment note, a basis block and a first article in front of their text."""
    n = F.col("doc_id")
    attach = F.when(n % 3 == 0, F.concat(F.lit("(Ban hành kèm theo Thông tư số "), F.col("n_chars") % 300 + 1, F.lit("/2021/TT-BGDDT)\n"))).otherwise(F.lit("QUY CHẾ\n"))
    basis = F.concat(F.lit("Căn cứ Luật Giáo dục số "), n % 40 + 1, F.lit("/2019/QH14;\n"), F.when(n % 2 == 0, F.concat(F.lit("Căn cứ Nghị định số "), n % 90 + 1, F.lit("/2022/ND-CP ngày 1 tháng 2 năm 2022;\n"))).otherwise(F.lit("Theo đề nghị của Vụ trưởng;\n")))
    guide = F.when(n % 4 == 0, F.lit("quy định chi tiết một số điều của Luật Giáo dục đại học.\n")).otherwise(F.concat(F.lit("hướng dẫn thi hành Nghị định số "), n % 70 + 1, F.lit("/2020/ND-CP.\n")))
    return table(s, d, "documents").select("doc_id", F.concat(attach, basis, F.lit("Điều 1. Thông tư này "), guide, "text").alias("text"))


def _profiles(s, d):
    return _legal(s, d).select("doc_id", F.get(M.extract_numbers("text"), F.lit(0)).alias("number"))


def _mentions(s, d):
    rel = F.when(F.col("l_returnflag") == "A", "replace").when(F.col("l_returnflag") == "R", "repeal").otherwise("amend")
    x = table(s, d, "lineitem").select(F.concat(F.lit("n"), F.col("l_suppkey")).alias("src"), rel.alias("rel"), F.concat(F.lit("n"), (F.col("l_partkey") * 7 + F.col("l_orderkey") * 13) % 30011).alias("dst"), (F.col("l_quantity") > 25).alias("partial"))
    return x.groupBy("src", "rel", "dst").agg(F.bool_and("partial").alias("partial"))


def _curated(s, d):
    return table(s, d, "supplier").where("s_acctbal > 9000").select(F.concat(F.lit("n"), "s_suppkey").alias("src"), F.lit("replace").alias("rel"), F.concat(F.lit("n"), F.col("s_suppkey") + 1).alias("dst"), F.lit(False).alias("partial"))


def _suppressed(s, d):
    return _mentions(s, d).where("src < dst and rel = 'amend'").select("src", "rel", "dst")


def _edges(s, d):
    return G.build_edges(_mentions(s, d), _curated(s, d), _suppressed(s, d))


def _nodes(s, d):
    day = F.expr("date'1995-01-01'")
    return table(s, d, "supplier").select(F.concat(F.lit("n"), "s_suppkey").alias("node"), F.date_add(day, (F.col("s_nationkey") * 150).cast("int")).alias("issued"), F.when(F.col("s_acctbal") > 5000, F.date_add(day, (F.col("s_nationkey") * 150 + 60).cast("int"))).alias("effective"), (1995 + F.col("s_nationkey")).cast("int").alias("year"))


def _status(s, d):
    return G.status_as_of(_nodes(s, d), _edges(s, d), F.expr("date'2000-01-01'"))


def _staff(s, d):
    c = table(s, d, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("id"), F.when(k % 3 == 0, "primary").when(k % 3 == 1, "lower").otherwise("upper").alias("level"), F.when(k % 2 == 0, "II").otherwise("III").alias("rank"), (k % 8 + 1).cast("int").alias("grade"), F.lit(None).cast("double").alias("stated"),
        F.when(F.col("c_nationkey") < 5, 0.7).alias("area"), F.when(F.col("c_mktsegment") == "BUILDING", 0.4).otherwise(0.0).alias("position_coef"), F.when(k % 10 == 0, 0.05).otherwise(0.0).alias("over_frame"), F.lit(0.0).alias("reserved_coef"),
        F.when(F.col("c_mktsegment") == "BUILDING", "deputy").when(F.col("c_mktsegment") == "MACHINERY", "director").otherwise("teacher").alias("position"),
    )


def _rates(s):
    titles = s.createDataFrame([(lv, r, "a" if r == "II" else "b", 0.35 if lv == "primary" else 0.3) for lv in ("primary", "lower", "upper") for r in ("II", "III")], "level string, rank string, scale string, allowance double")
    return titles, s.createDataFrame([("a", 4.0, 6.38, 8), ("b", 2.34, 4.98, 9)], "scale string, first double, last double, steps int")


def _duties(s, d):
    return table(s, d, "orders").select(F.col("o_custkey").alias("id"), F.floor(F.col("o_totalprice") / 10000).cast("double").alias("lessons"), (F.col("o_orderstatus") == "O").alias("capped"))


def _scores(s, d):
    n = F.col("l_linenumber")
    return table(s, d, "lineitem").select(F.col("l_suppkey").alias("student"), (F.col("l_partkey") % 8).cast("int").alias("subject"), F.when(F.col("l_linestatus") == "O", 1).otherwise(2).alias("term"), F.when(n == 1, "mid").when(n == 2, "final").otherwise("regular").alias("kind"), F.round(F.col("l_quantity") / 5, 1).alias("mark"))


def _hits(s, d):
    e = table(s, d, "events")
    return e.select(F.col("event_type").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("id"))


QUERIES = {
    "S4_html_text": lambda s, d: S.html_to_text(table(s, d, "pages")),
    "S4_html_blocks": lambda s, d: S.html_to_text(table(s, d, "pages"), blocks=True),
    "S2_kinds": lambda s, d: table(s, d, "pages").select(S.kind_of(F.regexp_replace("url", r"[?#].*$", "")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n")),
    "S5_table_blocks": lambda s, d: S.table_to_blocks(table(s, d, "part").withColumn("nothing", F.lit("")), "p_partkey"),
    "C1_sections": lambda s, d: C.sections(_headed(s, d), r"Article \d+\.").select("doc_id", "seq", "start", "heading", F.md5("text").alias("text")),
    "C1_join_pages": lambda s, d: C.join_pages(_elements(s, d)).select("doc_id", F.md5("text").alias("text")),
    "C3_split_long": lambda s, d: C.split_long(_chunks(s, d), ["doc_id", "seq"]).select("doc_id", "seq", "part", "parts", "offset", F.char_length("text").alias("chars")),
    "C5_page_starts": lambda s, d: C.page_starts(_elements(s, d)),
    "C5_pages_as_of": lambda s, d: C.as_of(C.sections(C.join_pages(_elements(s, d)), r"[DLT]\w+").select("doc_id", "seq", "start"), C.page_starts(_elements(s, d)), "doc_id", "start", "page"),
    "C7_spread_sample": lambda s, d: C.spread_sample(_chunks(s, d).select("doc_id", "seq"), "doc_id", "seq", 3),
    "C8_pack": lambda s, d: C.pack(_chunks(s, d), "doc_id", "seq", F.col("lang"), 2000).select("doc_id", F.md5("text").alias("text")),
    "C10_candidates": lambda s, d: C.candidate_passages(_chunks(s, d), "doc_id", r"^[DLT]", r"(?i)license").select("doc_id", "seq", "tier"),
    "C11_statistics": lambda s, d: C.chunk_statistics(table(s, d, "documents"), "source", "lang", ["de", "en", "es", "fr"]),
    "M1_numbers": lambda s, d: _legal(s, d).select("doc_id", F.array_join(M.extract_numbers("text"), ",").alias("numbers")),
    "M2_file_number": lambda s, d: _legal(s, d).select("doc_id", M.number_from_name("name").alias("number")),
    "M4_profile": lambda s, d: _legal(s, d).select("doc_id", M.document_type(F.get(M.extract_numbers("text"), F.lit(0))).alias("kind"), M.issue_date(F.col("text")).alias("issued"), M.agency(F.col("text")).alias("agency")),
    "M5_relations": lambda s, d: M.relations(_legal(s, d)),
    "M3_own_number": lambda s, d: M.own_number(_legal(s, d).withColumn("name", F.when(F.col("doc_id") % 3 == 0, F.col("name")).when(F.col("doc_id") % 3 == 1, F.concat(F.col("doc_id") % 900 + 1, F.lit("_ban-sao.pdf"))).otherwise(F.lit("ban-sao.pdf")))),
    "M6_mentions": lambda s, d: M.mentions(_based(s, d)),
    "M8_reverse": lambda s, d: M.reverse_relations(M.relations(_legal(s, d)), _profiles(s, d)),
    "M10_time_status": lambda s, d: M.time_status(_legal(s, d), M.issue_date(F.col("text"))),
    "M12_M14_facets": lambda s, d: M.facets(M.classify(table(s, d, "documents").select("doc_id", F.col("source").alias("name"), "text"), "name", "text", {"site": [("first", "^src[0-4]$"), ("rest", "^src[5-9]")], "topic": [("licence", "(?i)license"), ("toxic", "moron|idiot")]}), ["site", "topic"]),
    "G2_edges": _edges,
    "G3_resolve_names": lambda s, d: G.resolve_names(table(s, d, "orders").select(F.col("o_orderkey").alias("cite_id"), (F.col("o_custkey") % 25).cast("int").alias("name"), F.year("o_orderdate").alias("year")), table(s, d, "supplier").select(F.col("s_nationkey").alias("name"), (1990 + F.col("s_suppkey") % 20).cast("int").alias("year"), F.col("s_suppkey").alias("number"))),
    "G4_starts": lambda s, d: G.starts(_nodes(s, d)),
    "G5_status": lambda s, d: (lambda r: r.withColumn("by", F.array_join("by", ",")))(G.status_as_of(_nodes(s, d), _edges(s, d), F.expr("date'2000-01-01'"))),
    "G7_related": lambda s, d: G.related(_edges(s, d)),
    "G12_question_day": lambda s, d: table(s, d, "orders").select("o_orderkey", G.question_as_of(F.concat(F.lit("ngày "), F.dayofmonth("o_orderdate"), F.lit("/"), F.month("o_orderdate"), F.lit("/"), F.year("o_orderdate")), F.expr("date'2000-06-30'")).alias("day")),
    "G13_statistics": lambda s, d: G.graph_statistics(_edges(s, d), _nodes(s, d)),
    "B1_payroll": lambda s, d: B.payroll(_staff(s, d), *_rates(s)),
    "B2_teaching_load": lambda s, d: B.teaching_load(_staff(s, d).select("id", "position"), _duties(s, d)),
    "B4_term_averages": lambda s, d: B.term_averages(_scores(s, d)),
    "B4_year_averages": lambda s, d: B.year_averages(B.term_averages(_scores(s, d))),
    "B5_results": lambda s, d: B.classify_results(B.year_averages(B.term_averages(_scores(s, d)))),
    "W3_activity": lambda s, d: W.activity_batches(_hits(s, d), "10 minutes"),
    "W4_rolling": lambda s, d: W.rolling_counts(_hits(s, d), 3600).select("id", "recent"),
    "W4_limited": lambda s, d: W.limited(table(s, d, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("id")), 2, 36000),
    "W6_daily": lambda s, d: W.daily_counts(_hits(s, d).withColumnRenamed("key", "kind")),
}
_ELEMENTS = f"{PARAGRAPHS}, elements AS (SELECT doc_id, seq AS elem_no, text, CAST(seq // 3 + 1 AS INT) AS page FROM paragraphs)"
_MENTIONS = """mentions AS (SELECT src, rel, dst, bool_and(p) AS partial FROM (SELECT 'n' || l_suppkey AS src, CASE l_returnflag WHEN 'A' THEN 'replace' WHEN 'R' THEN 'repeal' ELSE 'amend' END AS rel, 'n' || ((l_partkey * 7 + l_orderkey * 13) % 30011) AS dst, l_quantity > 25 AS p FROM lineitem) GROUP BY ALL),
  curated AS (SELECT 'n' || s_suppkey AS src, 'replace' AS rel, 'n' || (s_suppkey + 1) AS dst FROM supplier WHERE s_acctbal > 9000),
  e0 AS (SELECT src, rel, dst, 'curated' AS origin, false AS partial FROM curated UNION ALL SELECT src, rel, dst, 'text', partial FROM (SELECT * FROM mentions ANTI JOIN curated USING (src, rel, dst)) WHERE src <> dst AND NOT (src < dst AND rel = 'amend')),
  full_ AS (SELECT DISTINCT src, dst FROM e0 WHERE NOT partial AND rel IN ('replace', 'repeal')), edges AS (SELECT e0.* FROM e0 LEFT JOIN full_ USING (src, dst) WHERE NOT (partial AND rel IN ('replace', 'repeal') AND full_.src IS NOT NULL)),
  nodes AS (SELECT 'n' || s_suppkey AS node, DATE '1995-01-01' + CAST(s_nationkey * 150 AS INT) AS issued, CASE WHEN s_acctbal > 5000 THEN DATE '1995-01-01' + CAST(s_nationkey * 150 + 60 AS INT) END AS effective FROM supplier), st AS (SELECT node, coalesce(effective, issued) AS start FROM nodes)"""
_STATUS = """e AS (SELECT dst AS node, src, rel, partial, start <= DATE '2000-01-01' AS live FROM edges JOIN st ON st.node = src),
  g AS (SELECT node, bool_or(rel <> 'amend' AND NOT partial AND live) AS gone, bool_or(rel <> 'amend' AND NOT partial AND NOT live) AS going, bool_or(partial AND live AND rel <> 'amend') AS parts, bool_or(rel = 'amend' AND live) AS amended FROM e GROUP BY node),
  status AS (SELECT node, CASE WHEN gone THEN 'expired' WHEN going THEN 'expiring' WHEN start > DATE '2000-01-01' THEN 'not_yet' WHEN parts THEN 'partly' WHEN amended THEN 'amended' ELSE 'in_force' END AS status FROM st LEFT JOIN g USING (node))"""
_STAFF = """staff AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'primary' ELSE 'other' END AS level, CASE WHEN c_custkey % 2 = 0 THEN 'II' ELSE 'III' END AS rank, c_custkey % 8 + 1 AS grade, CASE WHEN c_nationkey < 5 THEN 0.7 ELSE 0 END AS area,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 0.4 ELSE 0 END AS pos, CASE WHEN c_custkey % 10 = 0 THEN 0.05 ELSE 0 END AS ov, CASE c_mktsegment WHEN 'BUILDING' THEN 'deputy' WHEN 'MACHINERY' THEN 'director' ELSE 'teacher' END AS position FROM customer)"""
_AVG = """sc AS (SELECT l_suppkey AS student, CAST(l_partkey % 8 AS INT) AS subject, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 2 END AS term, CASE l_linenumber WHEN 1 THEN 'mid' WHEN 2 THEN 'final' ELSE 'regular' END AS kind, round(l_quantity / 5, 1) AS mark FROM lineitem),
  ta AS (SELECT student, subject, term, CAST(round(CAST((coalesce(sum(mark) FILTER (kind = 'regular'), 0) + 2 * max(mark) FILTER (kind = 'mid') + 3 * max(mark) FILTER (kind = 'final')) / (count(*) FILTER (kind = 'regular') + 5) AS DECIMAL(14, 6)), 1) AS DOUBLE) AS average FROM sc GROUP BY ALL),
  ya AS (SELECT student, subject, CAST(round(CAST((max(average) FILTER (term = 1) + 2 * max(average) FILTER (term = 2)) / 3 AS DECIMAL(14, 6)), 1) AS DOUBLE) AS average FROM ta GROUP BY ALL)"""
_LVL = "CASE WHEN list_min(x) >= 6.5 AND len(list_filter(x, lambda m: m >= 8)) >= 6 THEN 4 WHEN list_min(x) >= 5 AND len(list_filter(x, lambda m: m >= 6.5)) >= 6 THEN 3 WHEN list_min(x) >= 3.5 AND len(list_filter(x, lambda m: m >= 5)) >= 6 THEN 2 ELSE 1 END"
ORACLE_SQL = {
    "S2_kinds": "SELECT CASE WHEN regexp_matches(regexp_replace(url, '[?#].*$', ''), '\\.html?$') THEN 'web' ELSE 'text' END AS kind, count(*) AS n FROM pages GROUP BY 1",
    "S5_table_blocks": "WITH p AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS total FROM part) SELECT i // 40 AS block, 'Sheet 1 · rows ' || (min(i) + 1) || '-' || (max(i) + 1) || '/' || any_value(total) AS label, 'p_name' || chr(9) || 'p_brand' || chr(9) || 'p_type' || chr(9) || 'p_size' || chr(9) || 'p_retailprice' || chr(10) || string_agg(p_name || chr(9) || p_brand || chr(9) || p_type || chr(9) || p_size || chr(9) || p_retailprice, chr(10) ORDER BY i) AS text FROM p GROUP BY 1",
    "C1_join_pages": f"WITH {_ELEMENTS} SELECT doc_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY elem_no)) AS text FROM elements GROUP BY doc_id",
    "C5_page_starts": f"WITH {_ELEMENTS}, s AS (SELECT doc_id, page, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY elem_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM elements) SELECT doc_id, page, CAST(min(start) AS BIGINT) AS start FROM s GROUP BY ALL",
    "C7_spread_sample": f"WITH {PARAGRAPHS}, r AS (SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS t FROM paragraphs) SELECT doc_id, seq FROM r WHERE t <= 3 OR i IN (0, t // 3, 2 * t // 3)",
    "C8_pack": f"WITH {PARAGRAPHS} SELECT doc_id, md5(string_agg('[' || lang || ']' || chr(10) || text, '' ORDER BY seq)[1:2000]) AS text FROM paragraphs GROUP BY doc_id",
    "C10_candidates": f"WITH {PARAGRAPHS}, g AS (SELECT doc_id, seq, CASE WHEN length(text) >= 300 AND length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) / length(text) >= 0.6 AND NOT regexp_matches(text, '(?i)license') THEN CASE WHEN regexp_matches(text, '^[DLT]') THEN 2 ELSE 1 END ELSE 0 END AS tier FROM paragraphs) SELECT * FROM g QUALIFY tier = max(tier) OVER (PARTITION BY doc_id)",
    "C11_statistics": "SELECT source, count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'es') AS es, count(*) FILTER (WHERE lang = 'fr') AS fr FROM documents GROUP BY source",
    "M1_numbers": f"WITH {_LEGAL} SELECT doc_id, (doc_id % 900 + 1) || '/' || (2010 + doc_id % 14) || '/TT-BGDĐT,' || mid || ',527/QĐ-TTg,43/2019/QH14' AS numbers FROM legal",
    "M2_file_number": "SELECT doc_id, (doc_id % 900 + 1) || '/2020/TT-BGDĐT' AS number FROM documents",
    "M4_profile": f"WITH {_LEGAL} SELECT doc_id, 'Thông tư' AS kind, try_cast('2021-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(d AS VARCHAR), 2, '0') AS DATE) AS issued, 'BỘ GIÁO DỤC VÀ ĐÀO TẠO' AS agency FROM legal",
    "M5_relations": f"WITH {_LEGAL} SELECT * FROM rels",
    "M8_reverse": f"WITH {_LEGAL} SELECT l.doc_id, rel, list_sort(list(DISTINCT r.doc_id)) AS by FROM rels r JOIN legal l ON r.target = replace(l.own[5:], 'BGDDT', 'BGDĐT') AND r.doc_id <> l.doc_id GROUP BY ALL",
    "M6_mentions": f"WITH {_LEGAL} SELECT doc_id, 'basis' AS rel, (doc_id % 40 + 1) || '/2019/QH14' AS target FROM legal UNION ALL SELECT doc_id, 'basis', (doc_id % 90 + 1) || '/2022/NĐ-CP' FROM legal WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'attach', r || '/2021/TT-BGDĐT' FROM legal WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'guide', CASE WHEN doc_id % 4 = 0 THEN 'Luật Giáo dục đại học' ELSE (doc_id % 70 + 1) || '/2020/NĐ-CP' END FROM legal",
    "M3_own_number": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN (doc_id % 900 + 1) || '/2020/TT-BGDĐT' ELSE (doc_id % 900 + 1) || '/' || (2010 + doc_id % 14) || '/TT-BGDĐT' END AS number, CASE doc_id % 3 WHEN 0 THEN 'name' WHEN 1 THEN 'header' ELSE 'field' END AS origin, false AS guessed FROM documents",
    "M10_time_status": "SELECT doc_id, make_date(2022, 3, doc_id % 28 + 1) AS effective_on, false AS is_draft FROM documents",
    "M12_M14_facets": "WITH l AS (SELECT CASE WHEN regexp_matches(source, '^src[0-4]$') THEN 'first' WHEN regexp_matches(source, '^src[5-9]') THEN 'rest' END AS site, CASE WHEN regexp_matches(text, '(?i)license') AND NOT regexp_matches(text, 'moron|idiot') THEN 'licence' WHEN regexp_matches(text, 'moron|idiot') AND NOT regexp_matches(text, '(?i)license') THEN 'toxic' END AS topic FROM documents) SELECT 'site' AS dimension, site AS value, count(*) AS n FROM l GROUP BY site UNION ALL SELECT 'topic', topic, count(*) FROM l GROUP BY topic",
    "G2_edges": f"WITH {_MENTIONS} SELECT * FROM edges",
    "G3_resolve_names": "WITH c AS (SELECT o_orderkey AS cite_id, o_custkey % 25 AS name, year(o_orderdate) AS y FROM orders), l AS (SELECT s_nationkey AS name, 1990 + s_suppkey % 20 AS ly, s_suppkey AS number FROM supplier) SELECT cite_id, arg_max(number, (ly <= y, ly, number)) AS number FROM c JOIN l USING (name) GROUP BY cite_id",
    "G4_starts": f"WITH {_MENTIONS} SELECT * FROM st",
    "G5_status": f"""WITH {_MENTIONS}, e AS (SELECT dst AS node, src, rel, partial, start <= DATE '2000-01-01' AS live, start FROM edges JOIN st ON st.node = src),
      g AS (SELECT node, list(DISTINCT src) FILTER (rel <> 'amend' AND NOT partial AND live) AS gone, list(DISTINCT src) FILTER (rel <> 'amend' AND NOT partial AND NOT live) AS going, min(start) FILTER (rel <> 'amend' AND NOT partial AND NOT live) AS w, list(DISTINCT src) FILTER (partial AND live AND rel <> 'amend') AS parts, list(DISTINCT src) FILTER (rel = 'amend' AND live) AS amended FROM e GROUP BY node),
      r AS (SELECT node, CASE WHEN len(gone) > 0 THEN 'expired' WHEN len(going) > 0 THEN 'expiring' WHEN start > DATE '2000-01-01' THEN 'not_yet' WHEN len(parts) > 0 THEN 'partly' WHEN len(amended) > 0 THEN 'amended' ELSE 'in_force' END AS status, gone, going, w, parts, amended FROM st LEFT JOIN g USING (node))
      SELECT node, status, array_to_string(list_sort(CASE status WHEN 'expired' THEN gone WHEN 'expiring' THEN going WHEN 'partly' THEN parts WHEN 'amended' THEN amended ELSE [] END), ',') AS by, CASE WHEN status = 'expiring' THEN w END AS "from" FROM r""",
    "G7_related": f"""WITH {_MENTIONS}, o AS (SELECT src AS node, dst AS other, CASE rel WHEN 'amend' THEN 2 ELSE 0 END AS p FROM edges UNION ALL SELECT dst, src, CASE rel WHEN 'amend' THEN 3 ELSE 1 END FROM edges), b AS (SELECT node, other, min(p) AS p FROM o GROUP BY ALL),
      k AS (SELECT *, CAST(row_number() OVER (PARTITION BY node ORDER BY p, other) AS INT) AS place FROM b) SELECT node, other, ['replace', 'replaced_by', 'amend', 'amended_by'][p + 1] AS relation, place FROM k WHERE place <= 8""",
    "G12_question_day": "SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) < DATE '2000-06-30' THEN CAST(o_orderdate AS DATE) END AS day FROM orders",
    "G13_statistics": f"WITH {_MENTIONS} SELECT rel, count(*) AS edges, count(*) FILTER (WHERE src IN (SELECT node FROM nodes) AND dst IN (SELECT node FROM nodes)) AS inside, count(*) FILTER (WHERE origin = 'curated') AS curated FROM edges GROUP BY rel",
    "B1_payroll": f"""WITH {_STAFF}, k AS (SELECT *, CASE rank WHEN 'II' THEN round(4.0 + round((6.38 - 4.0) / 7, 2) * (grade - 1), 2) ELSE round(2.34 + round((4.98 - 2.34) / 8, 2) * (grade - 1), 2) END AS coefficient, greatest(CASE level WHEN 'primary' THEN 0.35 ELSE 0.3 END, area) AS pref FROM staff),
      l AS (SELECT id, CAST(coefficient AS DOUBLE) AS coefficient, CAST(round_even(coefficient * 2340000, 0) AS BIGINT) AS salary, CAST(round_even(pos * 2340000, 0) AS BIGINT) AS position_pay, CAST(round_even(coefficient * ov * 2340000, 0) AS BIGINT) AS over_pay, CAST(round_even((coefficient * (1 + ov) + pos) * pref * 2340000, 0) AS BIGINT) AS preferential_pay FROM k),
      c AS (SELECT *, CAST(round_even((salary + position_pay + over_pay) * 0.105, 0) AS BIGINT) AS contributions FROM l)
      SELECT id, coefficient, salary, position_pay, over_pay, CAST(0 AS BIGINT) AS reserved_pay, preferential_pay, contributions, salary + position_pay + over_pay + preferential_pay - contributions AS net, false AS mismatch FROM c""",
    "B2_teaching_load": f"""WITH {_STAFF}, d AS (SELECT o_custkey AS id, coalesce(sum(floor(o_totalprice / 10000)) FILTER (o_orderstatus = 'O'), 0) AS c, coalesce(sum(floor(o_totalprice / 10000)) FILTER (o_orderstatus <> 'O'), 0) AS u FROM orders GROUP BY 1),
      j AS (SELECT id, position, least(coalesce(c, 0), 297.5) + coalesce(u, 0) AS cut FROM staff LEFT JOIN d USING (id)), k AS (SELECT *, CASE position WHEN 'director' THEN 47.6 WHEN 'deputy' THEN 59.5 ELSE greatest(595 - cut, 0) END AS due FROM j)
      SELECT id, CAST(595 AS DOUBLE) AS base, CAST(CASE WHEN position = 'teacher' THEN cut ELSE 0 END AS DOUBLE) AS reduction, CAST(due AS DOUBLE) AS due, position = 'teacher' AND cut > 595 AS negative, CAST(round(due * 0.5, 2) AS DOUBLE) AS overtime_cap FROM k""",
    "B4_term_averages": f"WITH {_AVG} SELECT * FROM ta",
    "B4_year_averages": f"WITH {_AVG} SELECT * FROM ya",
    "B5_results": f"""WITH {_AVG}, v AS (SELECT student, list_sort(list(average)) AS x FROM ya WHERE average IS NOT NULL GROUP BY student), p AS (SELECT student, x, {_LVL} AS plain FROM v),
      w AS (SELECT p.student, p.plain, p.x AS own, i, list_concat(p.x[1 : i - 1], p.x[i + 1 :]) AS x FROM p, LATERAL (SELECT unnest(range(1, len(p.x) + 1)) AS i)), z AS (SELECT student, any_value(plain) AS plain, any_value(own) AS own, count(*) FILTER (WHERE {_LVL} >= plain + 2) AS lifted FROM w GROUP BY student)
      SELECT student, CAST(CASE WHEN lifted = 1 THEN plain + 1 ELSE plain END AS INT) AS level, CASE WHEN lifted = 1 THEN plain + 1 ELSE plain END = 4 AND len(list_filter(own, lambda m: m >= 9)) >= 6 AS excellent FROM z""",
    "W3_activity": "WITH g AS (SELECT ts, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) < INTERVAL 10 MINUTES THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT ts, sum(new) OVER (ORDER BY ts) AS k FROM g) SELECT min(ts) AS \"begin\", max(ts) + INTERVAL 10 MINUTES AS \"end\", count(*) AS n FROM s GROUP BY k",
    "W4_rolling": "SELECT event_id AS id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS recent FROM events",
    "W6_daily": "SELECT date_trunc('day', ts) AS day, event_type AS kind, count(*) AS n FROM events GROUP BY ALL",
}
