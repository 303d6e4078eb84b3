"""Queries R1-R7, R11, R15, R17, K1-K3, I1-I3, E1-E9, E15 over documents, test items, vectors and labels."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from corpusframe.operators import evaluation as E
from corpusframe.operators import retrieval as R
from corpusframe.operators import search as S
from corpusframe.plans.inputs import QUESTIONS, questions, scratch, table
from corpusframe.plans.q_corpus import _MENTIONS, _STATUS, _status
from corpusframe.plans.q_text import expanded, fold, tok


def _chunks(s, d):
    return table(s, d, "documents").select("doc_id", "text", "source", "lang")


def _bm25(s, d):
    return R.bm25(questions(s, d), R.indexed(_chunks(s, d), scratch(s)), "doc_id")


def _vectors(s, d):
    return table(s, d, "embeddings").select("vec_id", "embedding", "label")


def _query_vectors(s, d):
    """Every vector whose id is divisible by 100 asks."""
    return _vectors(s, d).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _corpus(s, d):
    """The documents with tokens and hashed vectors, each stored once; those whose node of the relation graph has expired are told."""
    tokens = R.indexed(_chunks(s, d), scratch(s))
    vectors, path = R.hashed_vectors(tokens, "doc_id"), scratch(s)
    vectors.write.parquet(path)
    gone = _status(s, d).where("status = 'expired'").select("node")
    expired = tokens.select("doc_id", F.concat(F.lit("n"), F.col("doc_id") % 120).alias("node")).join(gone, "node", "left_semi")
    return S.Corpus(_chunks(s, d), tokens, s.read.schema(vectors.schema).parquet(path), expired)


def _fused(s, d):
    """BM25 and hashed vectors."""
    tokens = R.indexed(_chunks(s, d), scratch(s))
    near = R.dense(R.hashed_vectors(questions(s, d), "query_id"), R.hashed_vectors(tokens, "doc_id"), 15, "doc_id", "vector")
    return R.rrf(R.bm25(questions(s, d), tokens, "doc_id"), near, key="doc_id", names=("bm25", "dense"))


def _candidates(s, d, corpus=None):
    """The fused run with coverages, the distance if a vector found it, and whether the document's node has expired; a document's title is its first line."""
    return S.candidates(questions(s, d), corpus or _corpus(s, d), mismatch=F.col("lang") != "en")


def _reranked(s, d):
    return R.rerank(_candidates(s, d))


def _gate(s, d):
    corpus = _corpus(s, d)
    run = _candidates(s, d, corpus).select("query_id", F.col("body_coverage").alias("coverage"), "idf_coverage", "dist")
    return R.off_topic(questions(s, d), run, R.vocabulary(corpus.tokens), F.lit(math.log(corpus.tokens.count() + 1)))


def _judged(s, d):
    """Each class vector's nearest others; relevant where the class is the same."""
    near = E.nearest(_query_rows(s, d), _vectors(s, d), 12)
    own = _query_rows(s, d).select("vec_id", F.col("label").alias("own"))
    near = near.join(own, "vec_id").groupBy("vec_id", "own").agg(F.array_sort(F.collect_list(F.when(F.col("label") == F.col("own"), F.col("rank")))).alias("ranks"))
    n = _vectors(s, d).groupBy("label").agg((F.count("*") - 1).alias("n_relevant"))
    return near.join(n, near["own"] == n["label"]).select(F.col("vec_id").alias("query_id"), F.concat(F.lit("c"), F.col("own") % 3).alias("grp"), "ranks", "n_relevant")


def _query_rows(s, d):
    return _vectors(s, d).where("vec_id % 100 = 0")


def _knn(s, d):
    return E.knn_vote(E.nearest(_query_rows(s, d), _vectors(s, d), 7))


def _cache_inputs(s, d):
    e = _vectors(s, d)
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("vec_id") * 3600)
    both = e.select("vec_id", F.col("embedding").alias("vector"), F.concat(F.lit("m"), F.col("label") % 2).alias("model"), F.lit("f").alias("fingerprint"), at.alias("t"), "label")
    return both.where("label < 5").select(F.col("vec_id").alias("query_id"), "vector", "model", "fingerprint", F.col("t").alias("at")), both.where("label >= 5").select(F.col("vec_id").alias("entry"), "vector", "model", "fingerprint", F.col("t").alias("created"))


def _split(s, d):
    return E.stratified_split(_vectors(s, d).select("vec_id", "label", F.lit(None).cast("string").alias("split")), "label", "vec_id")


def _metrics(s, d):
    return E.rank_metrics(_judged(s, d))


def _sweep(s, d):
    c = _candidates(s, d).groupBy("query_id").agg(F.max("body_coverage").alias("coverage"), F.min(F.coalesce("dist", F.lit(9.99))).alias("dist"))
    return E.gate_sweep(c.select((F.col("coverage") < 0.9).alias("off_topic"), "coverage", "dist"))


def _answers(s, d):
    c = table(s, d, "documents").select("doc_id", F.concat_ws(" ", F.lit("see [1] and [4]: 12, 3.400 and"), F.col("n_chars").cast("string")).alias("answer"), F.array(F.col("text"), F.lit("3,400 of 12"), F.lit("x")).alias("evidence"), F.array("source").alias("names"))
    r = E.check_answers(c)
    return r.select("doc_id", F.size("bad_citations").alias("n_bad"), F.array_join(F.array_sort("loose_numbers"), ",").alias("loose"))


QUERIES = {
    "R1_bm25": _bm25,
    "R2_dense": lambda s, d: R.dense(_query_vectors(s, d), _vectors(s, d), 10),
    "R3_rrf": lambda s, d: _fused(s, d).select("query_id", "doc_id", "score", "retrievers", "rank"),
    "R4_vocabulary": lambda s, d: R.vocabulary(_chunks(s, d)).select("term", "df", F.round("idf", 9).alias("idf")),
    "R5_rerank": lambda s, d: _reranked(s, d).select("query_id", "doc_id", F.round("rerank_score", 7).alias("rerank_score")),
    "R6_coverage": lambda s, d: _candidates(s, d).select("query_id", "doc_id", F.round("idf_coverage", 6).alias("idf_coverage")),
    "R11_off_topic": _gate,
    "R15_locate": lambda s, d: R.locate(questions(s, d), _chunks(s, d)),
    "R17_longest_run": lambda s, d: R.longest_copied_run(questions(s, d), _chunks(s, d), "query_id", "doc_id"),
    "K1_cache_lookup": lambda s, d: E.cache_lookup(*_cache_inputs(s, d)),
    "I1_knn": _knn,
    "I2_choose_k": lambda s, d: E.choose_k(_vectors(s, d)),
    "I3_class_scores": lambda s, d: E.class_scores(_knn(s, d).join(_vectors(s, d), "vec_id")),
    "E1_document_ranking": lambda s, d: E.document_ranking(_bm25(s, d).join(_chunks(s, d), "doc_id").select("query_id", "rank", F.col("source").alias("name"))),
    "E3_rank_metrics": lambda s, d: _metrics(s, d).drop("ranks"),
    "E5_summary": lambda s, d: E.summary(_metrics(s, d)),
    "E6_rank_distribution": lambda s, d: E.rank_distribution(_judged(s, d)),
    "E7_stratified_split": _split,
    "E9_gate_sweep": _sweep,
    "E15_check_answers": _answers,
}

_BM25 = f"""{QUESTIONS}, {expanded('text', 'documents', 'doc_id')}, {expanded('text', 'questions', 'query_id').replace('x0', 'y0').replace('x1', 'y1').replace(' x AS', ' y AS')},
  p AS (SELECT doc_id, w AS term, count(*) AS tf FROM x GROUP BY ALL), l AS (SELECT doc_id, count(w) AS len FROM documents LEFT JOIN x USING (doc_id) GROUP BY doc_id),
  bst AS (SELECT count(*) AS n, avg(len) AS avgdl FROM l), df AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p, bst GROUP BY term),
  idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM df) ELSE raw END AS idf FROM df),
  qt AS (SELECT query_id, w AS term, count(*) AS qtf FROM y GROUP BY ALL),
  sc AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 6) AS score FROM qt JOIN idf USING (term) JOIN p USING (term) JOIN l USING (doc_id), bst GROUP BY ALL),
  bm AS (SELECT * FROM (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM sc WHERE score > 0) WHERE rank <= 15)"""


def _shingles(name: str, key: str, source: str) -> str:
    return f"""{name}0 AS (SELECT {key}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM {source}),
      {name} AS (SELECT {key}, i - 1 AS i, array_to_string(w[i : i + 2], ' ') AS s FROM (SELECT {key}, w, unnest(range(1, len(w) - 1)) AS i FROM {name}0))"""


_RUNS = f"""{_shingles('sa', 'query_id', 'questions')}, {_shingles('sb', 'doc_id', 'documents')},
  hits AS (SELECT DISTINCT query_id, doc_id, sa.i, sa.i - sb.i AS d FROM sa JOIN sb ON sa.s = sb.s),
  isl AS (SELECT *, i - row_number() OVER (PARTITION BY query_id, doc_id, d ORDER BY i) AS g FROM hits),
  runs AS (SELECT query_id, doc_id, max(n) AS longest FROM (SELECT query_id, doc_id, count(*) + 2 AS n FROM isl GROUP BY query_id, doc_id, d, g) GROUP BY ALL)"""


def _hashed(name: str, key: str, source: str) -> str:
    """CTE name(key, e): the hashed vectors."""
    return f"""{name}0 AS (SELECT {key}, CAST('0x' || md5(w)[1:4] AS INT) AS h FROM (SELECT {key}, unnest({tok('text')}) AS w FROM {source})),
      {name}1 AS (SELECT {key}, h % 64 AS dim, CAST(sum(CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END) AS DOUBLE) AS v FROM {name}0 GROUP BY ALL HAVING v <> 0), {name}2 AS (SELECT {key}, sqrt(sum(v * v)) AS n FROM {name}1 GROUP BY {key}),
      {name} AS (SELECT k.{key}, list(coalesce(v, 0.0) / n ORDER BY k.dim) AS e FROM (SELECT {key}, n, unnest(range(0, 64)) AS dim FROM {name}2) k LEFT JOIN {name}1 USING ({key}, dim) GROUP BY k.{key})"""


_DENSE = f"""{_hashed('vq', 'query_id', 'questions')}, {_hashed('vd', 'doc_id', 'documents')},
  ds AS (SELECT query_id, doc_id, round(list_sum(list_transform(range(1, 65), lambda i: (vq.e[i] - vd.e[i]) * (vq.e[i] - vd.e[i]))), 6) AS dist FROM vq, vd),
  dn AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist, doc_id) AS INT) AS rank FROM ds) WHERE rank <= 15)"""
_FUSED = f"""{_BM25}, {_DENSE}, un AS (SELECT query_id, doc_id, rank, 'bm25' AS name FROM bm UNION ALL SELECT query_id, doc_id, rank, 'dense' FROM dn),
  fu AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, string_agg(name, '+' ORDER BY name) AS retrievers FROM un GROUP BY ALL)"""
_Q, _B = tok("q.text"), tok("d.text")
_RAW = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
_LINE = "string_split(d.text, chr(10))[1]"
_CAND = f"""{_FUSED}, {_MENTIONS}, {_STATUS}, vo AS (SELECT term, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) AS idf FROM (SELECT doc_id, unnest(list_distinct({tok('text')})) AS term FROM documents) GROUP BY term),
  qw AS (SELECT query_id, term, idf IS NULL AS unseen, coalesce(idf, (SELECT ln(count(*) + 1) FROM documents)) AS w FROM (SELECT query_id, unnest({tok('text')}) AS term FROM questions) LEFT JOIN vo USING (term)),
  c0 AS (SELECT fu.*, dist, d.source, d.text, d.lang, coalesce(st2.status = 'expired', false) AS expired, len(list_intersect(list_distinct({_Q}), {_B})) / greatest(len(list_distinct({_Q})), 1) AS body,
    len(list_intersect(list_distinct({_Q}), {_RAW.format(_LINE)})) / greatest(len(list_distinct({_Q})), 1) AS title, list_concat({_RAW.format(_LINE)}, {_RAW.format(fold(_LINE))}) AS tt
    FROM fu JOIN documents d USING (doc_id) JOIN questions q USING (query_id) LEFT JOIN dn USING (query_id, doc_id) LEFT JOIN status st2 ON st2.node = 'n' || (doc_id % 120)),
  iw AS (SELECT query_id, doc_id, sum(CASE WHEN list_contains(tt, term) OR list_contains(tt, {fold('term')}) THEN w ELSE 0 END) / sum(w) AS idfc FROM c0 JOIN qw USING (query_id) GROUP BY ALL),
  cand AS (SELECT c0.*, coalesce(idfc, 0) AS idfc FROM c0 LEFT JOIN iw USING (query_id, doc_id))"""
_NEAR = """v AS (SELECT vec_id, label, list_transform(embedding, lambda z: CAST(z AS DOUBLE)) AS e FROM embeddings), u AS (SELECT vec_id, label, list_transform(e, lambda z: z / sqrt(list_dot_product(e, e))) AS e FROM v),
  qr AS (SELECT * FROM u WHERE vec_id % 100 = 0),
  nr AS (SELECT * FROM (SELECT a.vec_id, a.label AS own, b.label, round(list_dot_product(a.e, b.e), 9) AS sim, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.e, b.e), 9) DESC, b.vec_id) AS INT) AS rank FROM qr a JOIN u b ON a.vec_id <> b.vec_id) WHERE rank <= 12)"""
_VOTE = f"""{_NEAR}, vt AS (SELECT vec_id, label, sum(greatest(sim, 0)) AS w FROM nr WHERE rank <= 7 GROUP BY ALL),
  pr AS (SELECT vec_id, arg_max(label, (round(w, 6), -label)) AS predicted, round(max(w) / sum(w), 6) AS confidence FROM vt GROUP BY vec_id)"""
_JUDGED = f"""{_NEAR}, jd AS (SELECT vec_id AS query_id, 'c' || (own % 3) AS grp, list_sort(list(rank) FILTER (label = own)) AS rk, (SELECT count(*) - 1 FROM u WHERE u.label = nr.own) AS n_relevant FROM nr GROUP BY vec_id, own),
  jk AS (SELECT *, coalesce(list_filter(rk, lambda r: r <= 10), []) AS w, greatest(n_relevant, 1) AS n FROM jd),
  me AS (SELECT query_id, grp, n_relevant, round(coalesce(1.0 / list_min(w), 0), 9) AS rr, CAST(coalesce(list_min(rk) <= 1, false) AS INT) AS hit_1, CAST(coalesce(list_min(rk) <= 3, false) AS INT) AS hit_3, CAST(coalesce(list_min(rk) <= 5, false) AS INT) AS hit_5, CAST(coalesce(list_min(rk) <= 10, false) AS INT) AS hit_10,
    len(w) / n AS recall, len(w) / 10 AS precision, round(coalesce(list_sum(list_transform(w, lambda r, i: i / r)), 0) / least(n, 10), 9) AS ap,
    round(coalesce(list_sum(list_transform(w, lambda r: ln(2.0) / ln(r + 1.0))), 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda r: ln(2.0) / ln(r + 1.0))), 9) AS ndcg, list_min(rk) AS first FROM jk)"""

ORACLE_SQL = {
    "R1_bm25": f"WITH {_BM25} SELECT * FROM bm",
    "R2_dense": "WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, round(list_sum(list_transform(range(1, len(e) + 1), lambda i: (CAST(e[i] AS DOUBLE) - embedding[i]) * (CAST(e[i] AS DOUBLE) - embedding[i]))), 6) AS dist FROM q, embeddings) SELECT * FROM (SELECT query_id, vec_id, dist, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS INT) AS rank FROM s) WHERE rank <= 10",
    "R3_rrf": f"WITH {_FUSED} SELECT query_id, doc_id, score, retrievers, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM fu",
    "R4_vocabulary": f"WITH t AS (SELECT doc_id, unnest(list_distinct({tok('text')})) AS term FROM documents) SELECT term, count(*) AS df, round(ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)), 9) AS idf FROM t GROUP BY term",
    "R5_rerank": f"WITH {_CAND} SELECT query_id, doc_id, round(score + 0.025 * body + 0.035 * title + 0.040 * idfc + CASE WHEN retrievers LIKE '%+%' THEN 0.004 ELSE 0 END - CASE WHEN lang <> 'en' THEN 0.012 ELSE 0 END - CASE WHEN expired THEN 0.015 ELSE 0 END, 7) AS rerank_score FROM cand",
    "R6_coverage": f"WITH {_CAND} SELECT query_id, doc_id, round(idfc, 6) AS idf_coverage FROM cand",
    "R11_off_topic": f"""WITH {_CAND}, a AS (SELECT q.query_id, count(term) AS n, coalesce(sum(w), 0) AS w, coalesce(sum(CASE WHEN unseen THEN w ELSE 0 END), 0) AS u FROM questions q LEFT JOIN qw USING (query_id) GROUP BY ALL),
      b AS (SELECT query_id, max(body) AS best, max(idfc) AS ib, min(coalesce(dist, 9.99)) AS near FROM cand GROUP BY query_id)
      SELECT query_id, CASE WHEN best IS NULL THEN 'no_documents' WHEN best < 0.12 THEN 'low_coverage' WHEN n >= 4 AND u / w >= 0.3 THEN 'unseen_words' WHEN n >= 4 AND ib < 0.6 THEN 'low_idf_coverage' WHEN near > 1.0 THEN 'far' END AS reason FROM a LEFT JOIN b USING (query_id)""",
    "R15_locate": f"WITH {QUESTIONS}, {_shingles('sa', 'query_id', 'questions')}, {_shingles('sb', 'doc_id', 'documents')}, h AS (SELECT query_id, doc_id, count(DISTINCT sa.s) AS score FROM sa JOIN sb ON sa.s = sb.s GROUP BY ALL) SELECT query_id, arg_max(doc_id, (score, -doc_id)) AS doc_id, max(score) AS score FROM h GROUP BY query_id",
    "R17_longest_run": f"WITH {QUESTIONS}, {_RUNS} SELECT * FROM runs",
    "E1_document_ranking": f"WITH {_BM25} SELECT query_id, source AS name, CAST(row_number() OVER (PARTITION BY query_id ORDER BY min(rank), source) AS INT) AS rank FROM bm JOIN documents USING (doc_id) GROUP BY query_id, source",
    "I1_knn": f"WITH {_VOTE} SELECT * FROM pr",
    "I3_class_scores": f"WITH {_VOTE}, c AS (SELECT label AS class, count(*) AS support, count(*) FILTER (WHERE label = predicted) AS hit FROM pr JOIN embeddings USING (vec_id) GROUP BY label), s AS (SELECT predicted AS class, count(*) AS said FROM pr GROUP BY predicted), z AS (SELECT class, support, coalesce(hit / said, 0) AS p, hit / support AS r FROM c LEFT JOIN s USING (class)) SELECT class, support, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM z",
    "E3_rank_metrics": f"WITH {_JUDGED} SELECT * EXCLUDE (first) FROM me",
    "E5_summary": f"WITH {_JUDGED} SELECT grp, count(*) AS questions, round(avg(rr), 6) AS mrr, round(avg(hit_1), 6) AS hit_1, round(avg(hit_3), 6) AS hit_3, round(avg(hit_5), 6) AS hit_5, round(avg(hit_10), 6) AS hit_10, round(avg(ap), 6) AS map, round(avg(ndcg), 6) AS ndcg, round(avg(first), 6) AS mean_rank, count(*) FILTER (WHERE first IS NULL) AS misses FROM me GROUP BY GROUPING SETS ((grp), ())",
    "E6_rank_distribution": f"WITH {_JUDGED}, b AS (SELECT CASE WHEN first IS NULL THEN 'miss' WHEN first > 10 THEN '>10' ELSE CAST(first AS VARCHAR) END AS bucket FROM me) SELECT n.bucket, count(b.bucket) AS n FROM (SELECT unnest(['1', '2', '3', '4', '5', '6', '7', '8', '9', '10', '>10', 'miss']) AS bucket) n LEFT JOIN b USING (bucket) GROUP BY n.bucket",
    "E7_stratified_split": "WITH r AS (SELECT vec_id, label, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY sha256('split|' || label || '|' || vec_id), vec_id) AS p FROM embeddings) SELECT vec_id, label, CASE WHEN p <= CASE WHEN n < 2 THEN 0 ELSE least(greatest(floor(n * 0.4 + 0.5), 1), n - 1) END THEN 'test' ELSE 'dev' END AS split FROM r",
    "E9_gate_sweep": f"WITH {_CAND}, gs AS (SELECT query_id, max(body) AS c, min(coalesce(dist, 9.99)) AS d FROM cand GROUP BY query_id) SELECT CAST(l AS DOUBLE) AS least, CAST(m AS DOUBLE) AS most, count(*) FILTER (WHERE (c < l OR d > m) AND c < 0.9) AS caught, count(*) FILTER (WHERE c < 0.9) AS total, count(*) FILTER (WHERE (c < l OR d > m) AND c >= 0.9) AS wrong FROM gs, (SELECT unnest([0.04, 0.08, 0.12, 0.16, 0.20]) AS l), (SELECT unnest([0.8, 0.9, 1.0, 1.1, 1.2, 1.3]) AS m) GROUP BY ALL",
}
