"""Queries L8, L13, L16, U12, G11 and R19 of corpusframe.operators.upkeep, over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusframe.operators import catalog as L
from corpusframe.operators import upkeep as K
from corpusframe.plans.inputs import CATALOG, LEDGER, TURNS, catalog, ledger, questions, table, turns
from corpusframe.plans.q_corpus import _MENTIONS, _STATUS, _status
from corpusframe.plans.q_retrieval import _BM25, _bm25
from corpusframe.plans.q_search import _GROUPED
from corpusframe.plans.q_usage import CUT, _blocks, _long

_MOVES = ("accepted", "rejected", "trash", "pending")


def _states(s, d):
    """Each user's events as moves of an upload: views accept, clicks reject, others by the event's value."""
    e, k = table(s, d, "events"), F.col("event_type")
    status = F.when(k == "view", "accepted").when(k == "click", "rejected").when(F.col("value") > 50, "trash").otherwise("pending")
    return K.settled_states(e.select(F.col("user_id").alias("id"), status.alias("status"), F.struct("ts", "event_id").alias("at"))).select("id", "status", F.col("at.event_id").alias("last"), "refused")


def _uploads(s, d):
    """Documents as uploads: those with a label of low quality were thrown away, those without one wait."""
    docs, labels = table(s, d, "documents"), table(s, d, "labels")
    j = docs.join(labels, "doc_id", "left").withColumn("status", F.when(F.col("quality").isNull(), "pending").when(F.col("quality") == 1, "accepted").otherwise("trash"))
    j = j.select(F.col("doc_id").alias("id"), F.concat(F.lit("u"), "doc_id").alias("name"), F.col("source").alias("contributor"), F.md5("text").alias("hash"), "status", "lang")
    trash = j.where("status = 'trash'").select("id", "hash", F.concat_ws("/", F.lit("in"), "lang", F.col("id").cast("string")).alias("original_path"), F.col("id").alias("removed"))
    return trash, j.where("status <> 'trash' or lang = 'en'")


def _plan(s, d):
    """Documents go to a folder of their language under a name of their length; one of four languages is there already."""
    cat = table(s, d, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.concat(F.col("lang"), F.lit("/N"), F.col("n_chars").cast("string")).alias("target"), "lang", "n_chars")
    there = cat.where("lang = 'de'").select(F.concat(F.lit("DE/n"), F.col("n_chars").cast("string")).alias("path")).distinct()
    return K.move_plan(cat.select("path", "target"), there)


def _found_again(s, d):
    chunks = ledger(s, d).select(F.explode("chunk_ids").alias("chunk_key"), F.element_at(F.split("path", "/"), -1).alias("name"))
    return K.rebuilt_ledger(L.reattach(chunks, ledger(s, d), catalog(s, d)), catalog(s, d)).select("path", "status", F.size("chunk_ids").alias("n"))


def _retained(s, d):
    long, convs = _long(s, d)
    kept = K.retained(long, convs, _blocks(s, d), F.expr(CUT))
    count = lambda name, rows: rows.agg(F.lit(name).alias("of"), F.count("*").alias("n"), F.unix_micros(F.min("at").cast("timestamp")).alias("since"))
    return count("turns", kept["turns"]).unionByName(count("conversations", kept["conversations"])).unionByName(count("blocks", kept["blocks"]))


def _warned(s, d):
    """The documents that BM25 gives a test item are its sources; a file is a source's documents of one language."""
    docs = table(s, d, "documents")
    run = _bm25(s, d).where("rank <= 5").join(docs, "doc_id")
    node = F.concat(F.lit("n"), (F.col("doc_id") % 120).cast("string"))
    sources = run.select("query_id", "rank", F.concat_ws("-", "source", "lang").alias("file"), node.alias("node"), F.col("doc_id").alias("chunk_key"))
    times = docs.groupBy(F.concat_ws("-", "source", "lang").alias("file")).agg((F.count("*") % 3 == 0).alias("is_draft"), F.date_add(F.expr("date'1999-01-01'"), F.max("n_chars").cast("int")).alias("effective_on"))
    amended = docs.select(F.col("doc_id").alias("chunk_key"), F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b(\w+ing)\b"), F.lit(1))).alias("by"))
    warned = K.answer_warnings(sources.withColumn("chunk_key", F.col("chunk_key").cast("string")), _status(s, d).select("node", F.col("status").alias("label")), times, amended.select(F.col("chunk_key").cast("string"), "by"), F.expr("date'2005-01-01'"))
    return warned.select("query_id", "kind", "about", "place", F.md5(F.coalesce("said", F.lit("-"))).alias("said"))


def _asked_files(s, d, summary):
    """Every test item asks six sources; documents are their passages."""
    q = questions(s, d).withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("file", F.concat(F.lit("src"), ((F.col("query_id") + 3 * F.col("pos")) % 20).cast("string")))
    return K.files_passages(q, table(s, d, "documents").select(F.col("doc_id").alias("chunk_key"), F.col("source").alias("file"), "text"), summary)


QUERIES = {
    "L8_states": _states,
    "L8_trash": lambda s, d: K.trash_view(*_uploads(s, d)),
    "L13_moves": _plan,
    "L13_counts": lambda s, d: K.move_counts(_plan(s, d)),
    "L16_ledger": _found_again,
    "U12_retained": _retained,
    "G11_answer": _warned,
    "R19_question": lambda s, d: _asked_files(s, d, False),
    "R19_summary": lambda s, d: _asked_files(s, d, True),
}

_PLAN = """pl AS (SELECT source || '/' || doc_id AS path, lang || '/N' || n_chars AS target FROM documents), th AS (SELECT DISTINCT 'de/n' || n_chars AS t FROM documents WHERE lang = 'de'),
  mv AS (SELECT path, target, CASE WHEN count(*) OVER (PARTITION BY lower(target)) > 1 THEN 'collision' WHEN t IS NOT NULL THEN 'kept' ELSE 'move' END AS action FROM pl LEFT JOIN th ON t = lower(target))"""
_FILES = "fq AS (SELECT query_id, pos, 'src' || ((query_id + 3 * pos) % 20) AS file FROM (SELECT item_id AS query_id, unnest(range(0, 6)) AS pos FROM benchmark)), ff AS (SELECT query_id, file FROM fq WHERE pos < 4)"
_SPREAD = "ss AS (SELECT query_id, file, doc_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY query_id, file) AS t FROM {} JOIN documents ON source = file WINDOW w AS (PARTITION BY query_id, file ORDER BY doc_id)), sp AS (SELECT * FROM ss WHERE t <= {k} OR list_contains(list_transform(range(0, {k}), lambda j: j * t // {k}), i))"

ORACLE_SQL = {
    "L8_states": """WITH RECURSIVE e AS (SELECT user_id AS id, event_id, CASE event_type WHEN 'view' THEN 'accepted' WHEN 'click' THEN 'rejected' ELSE CASE WHEN value > 50 THEN 'trash' ELSE 'pending' END END AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
      f AS (SELECT DISTINCT id, CAST(0 AS BIGINT) AS i, 'pending' AS status, CAST(NULL AS BIGINT) AS last, 0 AS refused FROM e
        UNION ALL SELECT f.id, e.i, CASE WHEN ok THEN e.status ELSE f.status END, CASE WHEN ok THEN e.event_id ELSE f.last END, f.refused + CASE WHEN ok THEN 0 ELSE 1 END
        FROM f JOIN e ON e.id = f.id AND e.i = f.i + 1, LATERAL (SELECT (f.status = 'pending' AND e.status IN ('accepted', 'rejected')) OR (f.status = 'accepted' AND e.status = 'trash') OR (f.status = 'rejected' AND e.status IN ('trash', 'pending')) OR (f.status = 'trash' AND e.status = 'pending') AS ok))
      SELECT id, arg_max(status, i) AS status, (list(last ORDER BY i DESC))[1] AS last, max(refused) AS refused FROM f GROUP BY id""",
    "L8_trash": """WITH u AS (SELECT d.doc_id AS id, source, md5(text) AS hash, lang, CASE WHEN quality IS NULL THEN 'pending' WHEN quality = 1 THEN 'accepted' ELSE 'trash' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)),
      k AS (SELECT * FROM u WHERE status <> 'trash' OR lang = 'en') SELECT t.id, CASE WHEN k.id IS NULL THEN CAST(t.id AS VARCHAR) ELSE 'u' || t.id END AS name, k.source AS contributor, t.id AS removed, k.id IS NOT NULL AS known, t.hash IN (SELECT hash FROM k WHERE status = 'pending') AS queued_again
      FROM u t LEFT JOIN k ON k.id = t.id WHERE t.status = 'trash'""",
    "L13_moves": f"WITH {_PLAN} SELECT * FROM mv",
    "L13_counts": f"WITH {_PLAN} SELECT string_split(target, '/')[1] AS folder, action, count(*) AS n FROM mv GROUP BY ALL",
    "L16_ledger": f"""WITH {LEDGER}, now AS (SELECT hash, min(path) AS path FROM catalog GROUP BY hash), ch AS (SELECT string_split(l.path, '/')[-1] AS name, arg_min(n.path, hash) AS path FROM ledger l JOIN now n USING (hash) GROUP BY 1),
      c AS (SELECT ch.path, count(DISTINCT chunk_key) AS n FROM (SELECT unnest(chunk_ids) AS chunk_key, string_split(path, '/')[-1] AS name FROM ledger) JOIN ch USING (name) GROUP BY ch.path),
      r AS (SELECT path, row_number() OVER (PARTITION BY hash ORDER BY path) > 1 AS later FROM catalog) SELECT path, CASE WHEN later THEN 'duplicate' WHEN n IS NULL THEN 'no_text' ELSE 'processed' END AS status, CAST(CASE WHEN later THEN 0 ELSE coalesce(n, 0) END AS INT) AS n FROM r LEFT JOIN c USING (path)""",
    "U12_retained": f"""WITH {TURNS}, k AS (SELECT * FROM turns WHERE "at" >= TIMESTAMP '2024-01-20'), c AS (SELECT client, min("at") AS "at", min("at") FILTER (WHERE "at" >= TIMESTAMP '2024-01-20') AS f FROM turns GROUP BY client)
      SELECT 'turns' AS "of", count(*) AS n, epoch_us(min("at")) AS since FROM k UNION ALL SELECT 'blocks', count(*), epoch_us(min("at")) FROM k
      UNION ALL SELECT 'conversations', count(*), epoch_us(min(CASE WHEN c."at" < TIMESTAMP '2024-01-20' THEN f ELSE c."at" END)) FROM c WHERE f IS NOT NULL OR c."at" >= TIMESTAMP '2024-01-20'""",
    "G11_answer": f"""WITH {_BM25}, {_MENTIONS}, {_STATUS}, so AS (SELECT query_id, rank, source || '-' || lang AS file, 'n' || (doc_id % 120) AS node, doc_id, text FROM bm JOIN documents USING (doc_id) WHERE rank <= 5),
      tm AS (SELECT source || '-' || lang AS file, count(*) % 3 = 0 AS is_draft, DATE '1999-01-01' + CAST(max(n_chars) AS INT) AS on_ FROM documents GROUP BY 1),
      am AS (SELECT query_id, rank, CAST(doc_id AS VARCHAR) AS about, (SELECT array_to_string(list(w ORDER BY i), ', ') FROM (SELECT w, min(i) AS i FROM (SELECT unnest(x) AS w, generate_subscripts(x, 1) AS i FROM (SELECT regexp_extract_all(text, '\\b([0-9A-Za-z_]+ing)\\b', 1) AS x)) GROUP BY w)) AS "by" FROM so),
      un AS (SELECT query_id, 'status' AS kind, node AS about, min(rank) AS place, any_value(status) AS said FROM so JOIN status USING (node) WHERE status <> 'in_force' GROUP BY query_id, node
        UNION ALL SELECT query_id, CASE WHEN any_value(is_draft) THEN 'draft' ELSE 'not_yet' END, file, min(rank), CASE WHEN any_value(is_draft) THEN NULL ELSE strftime(any_value(on_), '%d/%m/%Y') END FROM so JOIN tm USING (file) WHERE is_draft OR on_ > DATE '2005-01-01' GROUP BY query_id, file
        UNION ALL SELECT query_id, 'passage', about, rank, "by" FROM am WHERE "by" <> '')
      SELECT query_id, kind, about, place, md5(coalesce(said, '-')) AS said FROM un""",
    "R19_question": f"""WITH {_GROUPED.replace("'src' || (query_id % 20) AS source, w AS term, count(*) AS qtf FROM y GROUP BY ALL", "file AS source, w AS term, count(*) AS qtf FROM y JOIN ff USING (query_id) GROUP BY ALL").replace('GROUP BY ALL)', 'GROUP BY ALL)', 1).replace('qt AS (', _FILES + ', qt AS (')},
      hi AS (SELECT query_id, source AS file, doc_id, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) AS place FROM (SELECT sc.query_id, d.source, sc.doc_id, score FROM sc JOIN documents d USING (doc_id)) WHERE score > 0), no AS (SELECT * FROM ff ANTI JOIN hi USING (query_id, file)), {_SPREAD.format('no', k=2)}
      SELECT query_id, file, doc_id AS chunk_key, CAST(place AS INT) AS place FROM hi WHERE place <= 2 UNION ALL SELECT query_id, file, doc_id, CAST(row_number() OVER (PARTITION BY query_id, file ORDER BY doc_id) AS INT) FROM sp""",
    "R19_summary": f"WITH {_FILES}, {_SPREAD.format('ff', k=6)} SELECT query_id, file, doc_id AS chunk_key, CAST(row_number() OVER (PARTITION BY query_id, file ORDER BY doc_id) AS INT) AS place FROM sp",
}
