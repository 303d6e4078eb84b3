"""More queries of evaluation runs, caches, classes, lineage and suggestions over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusframe.operators import evaluation as E
from corpusframe.operators import evaluation_runs as X
from corpusframe.operators import lineage as N
from corpusframe.operators import retrieval as R
from corpusframe.plans.inputs import PARAGRAPHS, QUESTIONS, TURNS, paragraphs, questions, table, turns
from corpusframe.plans.q_corpus import _MENTIONS, _STATUS, _edges, _legal, _nodes, _status
from corpusframe.plans.q_corpus import G as graph
from corpusframe.plans.q_retrieval import _BM25, _JUDGED, _VOTE, _bm25, _judged, _knn, _query_rows, _vectors
from corpusframe.plans.q_text import tok


def _runs(s, d):
    t = turns(s, d)
    return t.select(F.col("turn_id").alias("query_id"), F.col("role").alias("grp"), "question", "refused", (F.col("seconds") > 200).alias("expect_refusal"), "from_cache", "citation_ok", "figures_ok", "seconds", F.col("citation_ok").alias("right_source"))


def _questions(s, d):
    t = table(s, d, "conversations").where("role = 'user'")
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("question"), (F.col("turn") % 2 == 0).alias("asks_number"), F.concat(F.lit("src"), F.col("conv_id") % 20).alias("source"))


def _versions(s, d):
    b = table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text", F.when(F.col("role") == "user", F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("defects"))
    return b, b.select("query_id", F.concat("text", F.lit(" new")).alias("text"), F.array(F.lit("y")).alias("defects"))


def _cache(s, d):
    e = table(s, d, "events")
    return e.select(F.col("event_id").alias("entry"), F.concat_ws("-", "event_type", F.floor("value").cast("string")).alias("question"), F.col("ts").alias("created"), F.col("ts").alias("last_used"), F.lit(1).alias("uses"), F.concat(F.lit("f"), F.col("user_id") % 2).alias("fingerprint"))


def _pairs(s, d):
    return _knn(s, d).join(_vectors(s, d).select("vec_id", "label"), "vec_id")


def _passages(s, d):
    n = _nodes(s, d).select("node")
    p = paragraphs(s, d).select(F.concat_ws("#", "doc_id", "seq").alias("chunk_key"), F.concat(F.lit("n"), F.col("doc_id") % 120).alias("node"), (F.col("seq") == 7).alias("is_draft"), F.lit(False).alias("attached"), "doc_id", "seq", "text")
    return p.join(n.withColumn("known", F.lit(1)), "node", "left").withColumn("node", F.when(F.col("known") == 1, F.col("node"))).drop("known")


def _labels(s, d):
    return N.passage_labels(_passages(s, d), _status(s, d), table(s, d, "labels").where("toxic = 1").select(F.concat_ws("#", "doc_id", F.lit("0")).alias("chunk_key")))


def _external(s, d):
    return table(s, d, "labels").select("doc_id", F.concat(F.col("doc_id") % 900 + 1, F.lit("/2020/TT-BGDDT")).alias("number"))


def _asked(s, d):
    q = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("theo "), F.col("item_id") % 900 + 1, F.lit("/2015/ND-CP và "), F.col("item_id") % 300 + 1, F.lit("/2016 ?")).alias("text"))
    n = table(s, d, "documents").select(F.concat(F.col("doc_id") % 900 + 1, F.lit("/"), 2014 + F.col("doc_id") % 3, F.lit("/NĐ-CP")).alias("node")).distinct()
    return N.asked_numbers(q, n)


QUERIES = {
    "E4_bootstrap": lambda s, d: X.bootstrap_interval(E.rank_metrics(_judged(s, d)), "rr", "query_id").select("n", F.round("mean", 6).alias("mean"), ((F.col("low") <= F.col("mean")) & (F.col("mean") <= F.col("high"))).alias("inside")),
    "E8_answer_quality": lambda s, d: X.answer_quality(_runs(s, d)).withColumn("wrongly_refused", F.array_join("wrongly_refused", "|")),
    "E10_window_coverage": lambda s, d: X.window_coverage(_judged(s, d)),
    "E10_worst": lambda s, d: X.worst_queries(_judged(s, d)),
    "E12_subset": lambda s, d: X.question_subset(questions(s, d), 15).select("query_id"),
    "E13_defects": lambda s, d: X.question_defects(_questions(s, d)).select("query_id", F.array_join("defects", ",").alias("defects")),
    "E14_plan": lambda s, d: X.question_plan(_questions(s, d).select("query_id", "source"), table(s, d, "documents").select("source", F.col("doc_id").alias("passage_id"))),
    "E16_trimmed": lambda s, d: table(s, d, "documents").select("doc_id", F.char_length(X.trimmed_answer("text")).alias("chars")),
    "E19_regenerate": lambda s, d: X.regenerate(*_versions(s, d)),
    "K4_hits": lambda s, d: X.hit_statistics(turns(s, d).select(F.regexp_replace("question", " ", "-").alias("question"), "at"), _cache(s, d)),
    "K5_purge": lambda s, d: X.purge(_cache(s, d), "f1", F.expr("timestamp'2024-01-31 00:00:00'"), 10).select("entry"),
    "K3_lru": lambda s, d: E.lru_trim(_cache(s, d), F.expr("timestamp'2024-01-31 00:00:00'")).select("entry"),
    "I4_accuracy": lambda s, d: X.accuracy_by(_pairs(s, d).withColumn("origin", F.col("vec_id") % 4), "origin"),
    "I5_sweep": lambda s, d: X.threshold_sweep(_pairs(s, d), [1, 2], [0.2, 0.3, 0.4]),
    "I8_baselines": lambda s, d: X.classifier_accuracy(_vectors(s, d), _query_rows(s, d)),
    "I9_unseen": lambda s, d: X.unseen(table(s, d, "documents").select("text"), table(s, d, "documents").where("lang = 'en'").select(F.sha2("text", 256).alias("key"))).select("key"),
    "C6_offsets": lambda s, d: N.recovered_offsets(paragraphs(s, d).select("doc_id", "seq", "text"), table(s, d, "documents")),
    "L12_route": lambda s, d: N.route(table(s, d, "documents").select("doc_id", "lang", "n_chars"), [(F.col("n_chars") < 300, "short"), (F.col("lang") == "en", "english")], "other").select("doc_id", "folder"),
    "L8_queue": lambda s, d: N.queue_view(table(s, d, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("hash"), F.col("doc_id").alias("created")), table(s, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "accepted").otherwise("rejected").alias("status"), F.col("doc_id").alias("at"))).select("id", "status", "superseded"),
    "M7_profiles": lambda s, d: N.build_profiles(_legal(s, d), _external(s, d)),
    "M11_amended": lambda s, d: N.amended_passages(_legal(s, d).select(F.col("doc_id").alias("chunk_key"), F.concat(F.lit("Điều này được sửa đổi\ntheo quy định\ntại Nghị định số "), F.col("doc_id") % 50 + 1, F.lit("/2025/ND-CP. "), "text").alias("text"))),
    "M13_roll_up": lambda s, d: N.rolled_up(paragraphs(s, d), "doc_id", "seq").select("doc_id", F.md5("text").alias("text")),
    "G1_nodes": lambda s, d: N.assign_nodes(table(s, d, "documents").select("doc_id", F.when(F.col("n_chars") > 2000, F.concat(F.col("doc_id"), F.lit("/2020/TT-X"))).alias("number"), (F.col("lang") == "en").alias("attached")), table(s, d, "labels").where("toxic = 1").select("doc_id", F.concat(F.lit("c"), "doc_id").alias("node"))),
    "G6_labels": _labels,
    "G8_companions": lambda s, d: N.companions(graph.related(_edges(s, d), 50).select("node", "other"), _passages(s, d).select("node", "doc_id").distinct(), _status(s, d).where("status = 'expired'")),
    "G9_asked": _asked,
    "G11_warnings": lambda s, d: N.source_warnings(_bm25(s, d).select("query_id", "rank", F.concat_ws("#", "doc_id", F.lit("0")).alias("chunk_key")), _labels(s, d).join(_passages(s, d).select("chunk_key", "node"), "chunk_key")),
    "R7_recency": lambda s, d: R.recency(_bm25(s, d).join(table(s, d, "documents"), "doc_id").select("query_id", "doc_id", "source", "text", F.date_add(F.expr("date'2020-01-01'"), F.col("doc_id").cast("int")).alias("doc_date")), "doc_id").select("query_id", "doc_id", "bonus"),
    "R9_sub_queries": lambda s, d: N.sub_queries(table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("Điều "), F.col("item_id") % 9 + 1, F.lit(" và điều 12 nói gì")).alias("text"))),
    "R14_unreadable": lambda s, d: N.unreadable_match(questions(s, d), table(s, d, "documents").select("doc_id", F.col("text").alias("title"))),
    "R18_records": lambda s, d: N.source_records(_bm25(s, d).join(table(s, d, "documents"), "doc_id").select("query_id", "rank", "source", F.lit(1).alias("page"), F.col("lang").alias("label"), "text")).select("query_id", F.size("sources").alias("n"), F.get("sources", F.lit(0))["source"].alias("first")),
    "R19_allocate": lambda s, d: N.allocate(_bm25(s, d).join(table(s, d, "documents").select("doc_id", F.col("source").alias("file")), "doc_id").select("query_id", "doc_id", "file", "rank")),
    "Q4_same_subject": lambda s, d: N.same_subject(table(s, d, "documents").select(F.col("lang").alias("subject"), (F.col("n_chars") % 3).cast("string").alias("kind"), (F.col("doc_id") % 3).alias("level"), (F.col("doc_id") % 12).alias("grade")), "en", 5),
    "Q6_key_phrases": lambda s, d: N.key_phrases(table(s, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("k"), F.concat(F.lit('**bold one** "quoted words" '), "text").alias("text")), "k", "text"),
    "Q10_assembled": lambda s, d: N.assembled([table(s, d, "conversations").where("role = 'user'").select("conv_id", "text", F.col("turn").alias("pos")), table(s, d, "conversations").where("role = 'assistant'").select("conv_id", "text", F.col("turn").alias("pos"))], "conv_id", 4),
}
_CACHE = "cache AS (SELECT event_id AS entry, event_type || '-' || CAST(floor(value) AS BIGINT) AS question, ts, 'f' || (user_id % 2) AS fingerprint FROM events)"
ORACLE_SQL = {
    "E8_answer_quality": f"WITH {TURNS} SELECT role AS grp, count(*) AS answers, count(*) FILTER (WHERE citation_ok) AS \"right\", count(*) FILTER (WHERE refused) AS refused, count(*) FILTER (WHERE citation_ok) AS cited, count(*) FILTER (WHERE figures_ok) AS grounded, round(avg(seconds), 3) AS seconds, array_to_string(list_sort(list_distinct(list(question) FILTER (WHERE refused AND seconds <= 200)))[1:5], '|') AS wrongly_refused FROM turns GROUP BY role".replace("ts AS at", 'ts AS "at"'),
    "E10_window_coverage": f"WITH {_JUDGED} SELECT count(*) AS questions, count(*) FILTER (WHERE first <= 4) AS covered, count(*) FILTER (WHERE first IS NULL) AS missed FROM me",
    "E10_worst": f"WITH {_JUDGED} SELECT query_id, first FROM me ORDER BY first DESC NULLS FIRST, query_id LIMIT 8",
    "E12_subset": f"WITH {QUESTIONS} SELECT query_id FROM questions ORDER BY sha256('sample|' || query_id), query_id LIMIT 15",
    "E14_plan": "WITH q AS (SELECT conv_id * 1000 + turn AS query_id, 'src' || (conv_id % 20) AS source FROM conversations WHERE role = 'user'), qk AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY query_id) AS k FROM q), p AS (SELECT source, doc_id AS passage_id, row_number() OVER (PARTITION BY source ORDER BY sha256('plan|' || source || '|' || doc_id), doc_id) AS k FROM documents) SELECT query_id, source, passage_id FROM qk LEFT JOIN p USING (source, k)",
    "E19_regenerate": "WITH b AS (SELECT conv_id * 1000 + turn AS query_id, text, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS n FROM conversations), o AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY query_id) > 1 AS again FROM b), t AS (SELECT *, again OR n = 1 AS take FROM o) SELECT query_id, CASE WHEN take THEN text || ' new' ELSE text END AS text, take AS replaced FROM t",
    "K4_hits": f"WITH {_CACHE}, f AS (SELECT question, min(entry) AS entry, count(*) AS n, max(ts) AS last FROM cache GROUP BY question) SELECT c.entry, 1 + coalesce(n, 0) AS uses, coalesce(last, ts) AS last_used FROM cache c LEFT JOIN f ON f.entry = c.entry",
    "K5_purge": f"WITH {_CACHE} SELECT entry FROM cache WHERE fingerprint = 'f1' AND ts >= TIMESTAMP '2024-01-21'",
    "K3_lru": f"WITH {_CACHE} SELECT entry FROM cache WHERE ts >= TIMESTAMP '2024-01-01' ORDER BY ts DESC, entry LIMIT 300",
    "I4_accuracy": f"WITH {_VOTE} SELECT vec_id % 4 AS origin, count(*) AS n, round(avg(CAST(predicted = label AS INT)), 6) AS accuracy FROM pr JOIN embeddings USING (vec_id) GROUP BY 1",
    "I5_sweep": f"WITH {_VOTE}, j AS (SELECT predicted, confidence, label FROM pr JOIN embeddings USING (vec_id)) SELECT CAST(t AS DOUBLE) AS threshold, x AS target, count(*) FILTER (WHERE predicted = x AND confidence >= t AND label = x) AS caught, count(*) FILTER (WHERE label = x) AS total, count(*) FILTER (WHERE predicted = x AND confidence >= t AND label <> x) AS wrong FROM j, (SELECT unnest([0.2, 0.3, 0.4]) AS t), (SELECT CAST(unnest([1, 2]) AS INT) AS x) GROUP BY ALL",
    "I9_unseen": "SELECT DISTINCT sha256(text) AS key FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE lang = 'en')",
    "L12_route": "SELECT doc_id, CASE WHEN n_chars < 300 THEN 'short' WHEN lang = 'en' THEN 'english' ELSE 'other' END AS folder FROM documents",
    "R7_recency": f"""WITH {_BM25}, c AS (SELECT query_id, doc_id, source, list_distinct({tok('text')}) AS t FROM bm JOIN documents USING (doc_id)),
      w AS (SELECT DISTINCT a.query_id, a.doc_id FROM c a JOIN c b ON a.query_id = b.query_id AND a.source <> b.source AND a.doc_id > b.doc_id WHERE len(a.t) > 0 AND len(list_intersect(a.t, b.t)) >= 0.35 * (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))))
      SELECT c.query_id, c.doc_id, CASE WHEN w.doc_id IS NULL THEN 0.0 ELSE 0.012 END AS bonus FROM c LEFT JOIN w ON w.query_id = c.query_id AND w.doc_id = c.doc_id""",
    "R18_records": f"WITH {_BM25} SELECT query_id, CAST(count(*) AS INT) AS n, arg_min(source, rank) AS first FROM bm JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY query_id",
    "R19_allocate": f"WITH {_BM25}, r AS (SELECT query_id, doc_id, source AS file, rank, dense_rank() OVER (PARTITION BY query_id ORDER BY source) AS f, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS place FROM bm JOIN documents USING (doc_id)), m AS (SELECT *, max(f) OVER (PARTITION BY query_id) AS n FROM r WHERE f <= 4) SELECT query_id, doc_id, file, rank, CAST(place AS INT) AS place FROM m WHERE place <= greatest(2, 4 // n)",
    "L8_queue": "WITH q AS (SELECT d.doc_id AS id, md5(text) AS hash, CASE WHEN l.doc_id IS NULL THEN 'pending' WHEN quality = 1 THEN 'accepted' ELSE 'rejected' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)) SELECT id, status, status = 'pending' AND row_number() OVER (PARTITION BY hash, status ORDER BY id DESC) > 1 AS superseded FROM q",
    "M7_profiles": "SELECT doc_id, (doc_id % 900 + 1) || '/2020/TT-BGDĐT' AS number, 'name' AS origin FROM documents",
    "M11_amended": "SELECT doc_id AS chunk_key, (doc_id % 50 + 1) || '/2025/NĐ-CP' AS by FROM documents UNION ALL SELECT doc_id, (n_chars % 300 + 1) || '/2015/NĐ-CP' FROM documents WHERE doc_id % 5 = 4",
    "M13_roll_up": f"WITH {PARAGRAPHS}, b AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM paragraphs) SELECT doc_id, md5(string_agg(text, chr(10) ORDER BY seq)) AS text FROM b WHERE b < 3000 GROUP BY doc_id",
    "G1_nodes": "SELECT doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'c' || doc_id WHEN n_chars > 2000 THEN doc_id || '/2020/TT-X' WHEN lang = 'en' THEN 'file:' || doc_id END AS node FROM documents LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l USING (doc_id)",
    "G6_labels": f"""WITH {_MENTIONS}, {_STATUS}, {PARAGRAPHS}, p AS (SELECT doc_id || '#' || seq AS chunk_key, seq, status, toxic FROM paragraphs LEFT JOIN status ON node = 'n' || (doc_id % 120) LEFT JOIN (SELECT doc_id, toxic FROM labels WHERE toxic = 1) l USING (doc_id)),
      l AS (SELECT chunk_key, CASE WHEN seq = 7 THEN 'draft' WHEN status IS NULL THEN NULL WHEN status IN ('expired', 'expiring', 'not_yet') THEN status WHEN seq = 0 AND toxic = 1 THEN 'passage_amended' ELSE status END AS label FROM p)
      SELECT chunk_key, label, CASE WHEN label IN ('draft', 'expired') THEN 'high' WHEN label IN ('expiring', 'not_yet', 'passage_amended', 'partly') THEN 'mid' WHEN label IS NOT NULL THEN 'low' END AS level FROM l""",
    "G8_companions": f"""WITH {_MENTIONS}, {_STATUS}, {PARAGRAPHS}, o AS (SELECT src AS node, dst AS other, CASE rel WHEN 'amend' THEN 2 ELSE 0 END AS p FROM edges UNION ALL SELECT dst, src, CASE rel WHEN 'amend' THEN 3 ELSE 1 END FROM edges),
      b AS (SELECT node, other, min(p) AS p FROM o GROUP BY ALL), k AS (SELECT node, other, row_number() OVER (PARTITION BY node ORDER BY p, other) AS place FROM b), f AS (SELECT DISTINCT 'n' || (doc_id % 120) AS other, doc_id FROM paragraphs)
      SELECT DISTINCT k.node, doc_id FROM k JOIN f USING (other) JOIN status ON status.node = k.other WHERE place <= 50 AND status <> 'expired'""",
    "G9_asked": """WITH n AS (SELECT DISTINCT (doc_id % 900 + 1) || '/' || (2014 + doc_id % 3) || '/NĐ-CP' AS node FROM documents), k AS (SELECT regexp_extract(node, '^(\\d+/\\d+)/', 1) AS p, min(node) AS node FROM n GROUP BY 1 HAVING count(*) = 1)
      SELECT item_id AS query_id, node FROM benchmark JOIN n ON node = (item_id % 900 + 1) || '/2015/NĐ-CP' UNION SELECT item_id, node FROM benchmark JOIN k ON p = (item_id % 300 + 1) || '/2016'""",
    "R9_sub_queries": "WITH b AS (SELECT item_id AS query_id, unnest([0, 1]) AS part FROM benchmark) SELECT query_id, CAST(part AS INT) AS part, CASE part WHEN 0 THEN 'Điều ' || (query_id % 9 + 1) ELSE 'điều 12' END || ' nói gì' AS text FROM b",
    "R14_unreadable": f"WITH {QUESTIONS}, q AS (SELECT query_id, len(list_distinct({tok('text')})) AS n, unnest(list_distinct({tok('text')})) AS w FROM questions), t AS (SELECT doc_id, unnest(list_distinct({tok('text')})) AS w FROM documents), h AS (SELECT query_id, doc_id, n, count(*) AS o FROM q JOIN t USING (w) WHERE n >= 4 GROUP BY ALL HAVING count(*) >= 4 AND count(*) >= 0.7 * n) SELECT query_id, arg_max(doc_id, (o, -doc_id)) AS doc_id FROM h GROUP BY query_id",
}
