"""Queries R8, R9, R10, R12, R13, R15 and R16: searches over a corpus whose tokens are stored once."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusframe.functions import text as T
from corpusframe.operators import lineage as N
from corpusframe.operators import retrieval as R
from corpusframe.operators import search as S
from corpusframe.plans.inputs import PARAGRAPHS, QUESTIONS, paragraphs, questions, table
from corpusframe.plans.q_retrieval import _CAND, _chunks, _corpus, _shingles
from corpusframe.plans.q_text import expanded

#: The scope of R10.
LANGUAGES = ("en", "de")


def _spread(s, d):
    """The hybrid search without a scope."""
    return S.hybrid(questions(s, d), _corpus(s, d), mismatch=F.col("lang") != "en").select("query_id", "doc_id", "place")


def _scoped(s, d):
    """The hybrid search among documents in English or German; the scope decides before ranking."""
    return S.hybrid(questions(s, d), _corpus(s, d), F.col("lang").isin(*LANGUAGES), F.col("lang") != "en").select("query_id", "place", "doc_id", "source")


def _compared(s, d):
    """Every test item asks what its first ten words and its last ten have in common."""
    w = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    side = lambda x: F.array_join(x, " ")
    return questions(s, d).select("query_id", F.concat(F.lit("so sánh "), side(F.slice(w, 1, 10)), F.lit(" và "), side(F.slice(F.reverse(w), 1, 10))).alias("text"))


def _balanced(s, d):
    return S.balanced(_compared(s, d), _corpus(s, d), mismatch=F.col("lang") != "en").select("query_id", "part", "place", "doc_id")


def _own_source(s, d):
    asked = questions(s, d).withColumn("doc_id", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")))
    return N.within_document(asked, table(s, d, "documents").select(F.col("doc_id").alias("chunk_key"), F.col("source").alias("doc_id"), "text"))


def _compress(s, d):
    return R.compress_pages(table(s, d, "documents").select("doc_id", "text", "source"), F.substring_index("text", "\n", 1), "doc_id").select("doc_id", F.md5("text").alias("kept"), "paragraphs")


def _pages(s, d):
    """Lines of documents are pages; of every document of two lines or more the two in the middle are a passage, the first's first words its key sentence."""
    lines = paragraphs(s, d).select(F.col("doc_id").alias("file"), "text", "seq")
    lists = lines.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]).alias("t"))  # a document's lines
    pages = lists.select("file", F.posexplode("t").alias("p", "text")).select("file", (F.col("p") + 1).alias("page"), "text")
    m = F.floor(F.size("t") / 2).cast("int")
    passages = lists.where(F.size("t") >= 2).select(F.col("file").alias("passage_id"), "file", F.concat_ws(" ", F.get("t", m - 1), F.get("t", m)).alias("text"), F.when(F.col("file") % 3 == 0, F.substring(F.get("t", m), 1, 40)).alias("focus"), F.lit(1).alias("hint"))
    return S.locate_pages(passages, pages)


def _spans(s, d):
    found = R.locate(questions(s, d), _chunks(s, d))
    pairs = found.join(questions(s, d), "query_id").withColumn("passage", T.raw_tokens("text")).drop("text").join(_chunks(s, d).select("doc_id", T.raw_tokens("text").alias("page")), "doc_id")
    return S.aligned_spans(pairs)


QUERIES = {
    "R8_diversified": _spread,
    "R9_balanced": _balanced,
    "R10_hybrid": _scoped,
    "R12_within": _own_source,
    "R13_compress": _compress,
    "R15_pages": _pages,
    "R16_spans": _spans,
}

_SCORE = "score + 0.025 * body + 0.035 * title + 0.040 * idfc + CASE WHEN retrievers LIKE '%+%' THEN 0.004 ELSE 0 END - CASE WHEN lang <> 'en' THEN 0.012 ELSE 0 END - CASE WHEN expired THEN 0.015 ELSE 0 END"
_HEAD = "lower(substring(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 200))"


def _greedy(n: str = "4") -> str:
    """CTE taken(query_id, docs): the candidates of cand in the order of their score, at most two of a source, none with a head that is there."""
    return f"""od AS (SELECT query_id, doc_id, source, {_HEAD} AS head, row_number() OVER (PARTITION BY query_id ORDER BY round({_SCORE}, 12) DESC, doc_id) AS i FROM cand),
      gr AS (SELECT query_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS docs, CAST([] AS VARCHAR[]) AS srcs, CAST([] AS VARCHAR[]) AS heads FROM (SELECT DISTINCT query_id FROM od)
        UNION ALL SELECT g.query_id, o.i, CASE WHEN ok THEN list_append(docs, o.doc_id) ELSE docs END, CASE WHEN ok THEN list_append(srcs, o.source) ELSE srcs END, CASE WHEN ok THEN list_append(heads, o.head) ELSE heads END
        FROM gr g JOIN od o ON o.query_id = g.query_id AND o.i = g.i + 1, LATERAL (SELECT len(g.docs) < {n} AND len(list_filter(g.srcs, lambda s: s = o.source)) < 2 AND NOT list_contains(g.heads, o.head) AS ok)),
      taken AS (SELECT query_id, arg_max(docs, i) AS docs FROM gr GROUP BY query_id), placed AS (SELECT query_id, unnest(docs) AS doc_id, CAST(generate_subscripts(docs, 1) AS INT) AS place FROM taken)"""


_INSIDE = "lang IN ('en', 'de')"
_SCOPED = _CAND.replace("FROM sc WHERE score > 0)", f"FROM sc JOIN documents sd USING (doc_id) WHERE score > 0 AND sd.{_INSIDE})").replace("FROM vq, vd)", f"FROM vq, (SELECT vd.* FROM vd JOIN documents sd USING (doc_id) WHERE sd.{_INSIDE}) vd)")
assert _SCOPED.count(_INSIDE) == 2
_W = "string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')"
#: Parts of a comparison as questions of their own, numbered ten a question.
_PARTS = f"questions AS (SELECT item_id * 10 + part AS query_id, CASE part WHEN 0 THEN 'so sánh ' || array_to_string({_W}[1:10], ' ') ELSE array_to_string(list_reverse({_W})[1:10], ' ') END AS text FROM benchmark, (SELECT unnest([0, 1]) AS part))"
_GROUPED = f"""{QUESTIONS}, {expanded('text', 'documents', 'doc_id')}, {expanded('text', 'questions', 'query_id').replace('x0', 'y0').replace('x1', 'y1').replace(' x AS', ' y AS')},
  p AS (SELECT source, doc_id, w AS term, count(*) AS tf FROM x JOIN documents USING (doc_id) GROUP BY ALL), l AS (SELECT source, doc_id, count(w) AS len FROM documents LEFT JOIN x USING (doc_id) GROUP BY ALL),
  gs AS (SELECT source, count(*) AS n, avg(len) AS avgdl FROM l GROUP BY source), df AS (SELECT source, term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p JOIN gs USING (source) GROUP BY source, term),
  idf AS (SELECT source, term, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY source) ELSE raw END AS idf FROM df),
  qt AS (SELECT query_id, 'src' || (query_id % 20) AS source, w AS term, count(*) AS qtf FROM y GROUP BY ALL),
  sc AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 6) AS score FROM qt JOIN idf USING (source, term) JOIN p USING (source, term) JOIN l USING (source, doc_id) JOIN gs USING (source) GROUP BY ALL)"""
_PAGE = f"""pr0 AS (SELECT doc_id, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS text FROM (SELECT doc_id, regexp_split_to_array(text, '\\n+') AS t FROM documents)), pr AS (SELECT doc_id || '|' || pos AS id, doc_id, pos, text FROM pr0 WHERE length(trim(text)) >= 30),
  pq AS (SELECT doc_id, string_split(text, chr(10))[1] AS text FROM documents), {expanded('text', 'pr', 'id')}, {expanded('text', 'pq', 'doc_id').replace('x0', 'y0').replace('x1', 'y1').replace(' x AS', ' y AS')},
  p AS (SELECT doc_id, id, w AS term, count(*) AS tf FROM x JOIN pr USING (id) GROUP BY ALL), l AS (SELECT doc_id, id, count(w) AS len FROM pr LEFT JOIN x USING (id) GROUP BY ALL), gs AS (SELECT doc_id, count(*) AS n, avg(len) AS avgdl FROM l GROUP BY doc_id),
  df AS (SELECT doc_id, term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p JOIN gs USING (doc_id) GROUP BY doc_id, term), idf AS (SELECT doc_id, term, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY doc_id) ELSE raw END AS idf FROM df),
  qt AS (SELECT doc_id, w AS term, count(*) AS qtf FROM y GROUP BY ALL),
  sc AS (SELECT id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 6) AS score FROM qt JOIN idf USING (doc_id, term) JOIN p USING (doc_id, term) JOIN l USING (doc_id, id) JOIN gs USING (doc_id) GROUP BY id),
  rk AS (SELECT pr.*, row_number() OVER (PARTITION BY doc_id ORDER BY greatest(coalesce(score, 0), 0) DESC, pos) AS r FROM pr LEFT JOIN sc USING (id))"""


def _three(text: str) -> str:
    w = f"regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}]+')"
    return f"list_distinct(CASE WHEN len({w}) >= 3 THEN list_transform(range(1, len({w}) - 1), lambda i: array_to_string(({w})[i : i + 2], ' ')) WHEN len({w}) > 0 THEN [array_to_string({w}, ' ')] ELSE [] END)"


_ALIGNED = f"""{_shingles('sa', 'query_id', 'questions')}, {_shingles('sb', 'doc_id', 'documents')}, h AS (SELECT query_id, doc_id, count(DISTINCT sa.s) AS score FROM sa JOIN sb ON sa.s = sb.s GROUP BY ALL),
  found AS (SELECT query_id, arg_max(doc_id, (score, -doc_id)) AS doc_id FROM h GROUP BY query_id),
  pp AS (SELECT f.query_id, sa0.w AS passage, sb0.w AS page, CASE WHEN len(sa0.w) <= 4 THEN 1 ELSE 2 END AS n FROM found f JOIN sa0 USING (query_id) JOIN sb0 USING (doc_id)),
  ga AS (SELECT query_id, n, i - 1 AS a, page[i : i + n - 1] AS s FROM (SELECT query_id, page, n, unnest(range(1, len(page) - n + 2)) AS i FROM pp)), gb AS (SELECT query_id, i - 1 AS b, passage[i : i + n - 1] AS s FROM (SELECT query_id, passage, n, unnest(range(1, len(passage) - n + 2)) AS i FROM pp)),
  hh AS (SELECT query_id, n, a, b, a - b AS lag, a - row_number() OVER (PARTITION BY query_id, a - b ORDER BY a) AS g FROM ga JOIN gb USING (query_id, s)),
  b0 AS (SELECT query_id, lag, min(a) AS a, max(a) + any_value(n) AS t, min(b) AS b, min(b) + max(a) + any_value(n) - min(a) AS bt FROM hh GROUP BY query_id, lag, g),
  b1 AS (SELECT * FROM b0 x WHERE NOT EXISTS (SELECT 1 FROM b0 y WHERE y.query_id = x.query_id AND y.b <= x.b AND y.bt >= x.bt AND (y.b < x.b OR y.bt > x.bt))),
  b2 AS (SELECT *, CASE WHEN coalesce(lag - lag(lag) OVER (PARTITION BY query_id ORDER BY lag, a), 13) > 12 THEN 1 ELSE 0 END AS nw FROM b1), b3 AS (SELECT *, sum(nw) OVER (PARTITION BY query_id ORDER BY lag, a) AS gp FROM b2),
  b4 AS (SELECT query_id, gp, min(a) AS begin, max(t) AS "end", len(list_distinct(flatten(list(range(b, bt))))) AS matched FROM b3 GROUP BY query_id, gp)
  SELECT p.query_id, CAST(x.begin AS INT) AS begin, CAST(x."end" AS INT) AS "end", CAST(x.matched AS INT) AS matched FROM pp p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, begin, gp) AS r FROM b4 JOIN (SELECT query_id, len(passage) AS words FROM pp) USING (query_id) WHERE matched >= least(3, words)) x ON x.query_id = p.query_id AND x.r = 1"""

ORACLE_SQL = {
    "R8_diversified": f"WITH RECURSIVE {_CAND}, {_greedy()} SELECT query_id, doc_id, place FROM placed",
    "R10_hybrid": f"WITH RECURSIVE {_SCOPED}, {_greedy()} SELECT query_id, place, doc_id, source FROM placed JOIN documents USING (doc_id)",
    "R9_balanced": f"""WITH RECURSIVE {_CAND.replace(QUESTIONS, _PARTS)}, {_greedy('2')}, fs AS (SELECT query_id // 10 AS q, query_id % 10 AS part, place, doc_id, row_number() OVER (PARTITION BY query_id // 10, sha256(text) ORDER BY query_id % 10, place) AS r FROM placed JOIN documents USING (doc_id))
      SELECT q AS query_id, CAST(part AS INT) AS part, place, doc_id FROM fs WHERE r = 1""",
    "R12_within": f"WITH {_GROUPED}, o AS (SELECT query_id, doc_id AS chunk_key, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS place FROM sc WHERE score > 0) SELECT * FROM o WHERE place <= 4",
    "R13_compress": f"WITH {_PAGE} SELECT doc_id, md5(string_agg(text, chr(10) ORDER BY pos)) AS kept, count(*) AS paragraphs FROM rk WHERE r <= 3 GROUP BY doc_id",
    "R15_pages": f"""WITH {PARAGRAPHS}, ln AS (SELECT doc_id AS file, text, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS page FROM paragraphs), li AS (SELECT file, list(text ORDER BY page) AS t FROM ln GROUP BY file),
      ps AS (SELECT file, t[len(t) // 2] || ' ' || t[len(t) // 2 + 1] AS text, CASE WHEN file % 3 = 0 THEN substring(t[len(t) // 2 + 1], 1, 40) END AS focus FROM li WHERE len(t) >= 2), pg AS (SELECT file, page, {_three('text')} AS s FROM ln),
      pt AS (SELECT file, {_three('text')} AS s, {_three('focus')} AS f FROM ps), sh AS (SELECT file, page, len(list_intersect(pt.s, pg.s)) AS score, len(list_intersect(pt.f, pg.s)) AS focus, len(pt.s) AS n FROM pt JOIN pg USING (file)),
      sm AS (SELECT *, max(score) OVER (PARTITION BY file) AS top, first_value(page) OVER (PARTITION BY file ORDER BY focus DESC, score DESC, (page = 1) DESC, page) AS mp FROM sh)
      SELECT file AS passage_id, CAST(page AS INT) AS page, score, page = mp AS main FROM sm WHERE top > 0 AND (page = mp OR (abs(page - mp) = 1 AND score >= greatest(2, 0.2 * n)))
      UNION ALL SELECT DISTINCT file, 1, 0, true FROM sm WHERE top = 0""",
    "R16_spans": f"WITH {QUESTIONS}, {_ALIGNED}",
}
