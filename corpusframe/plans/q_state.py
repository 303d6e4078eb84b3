"""Queries S7, L3 and W1: registers and corpora that change as a whole, and the folder that feeds one."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusframe.operators import catalog as L
from corpusframe.plans.inputs import LEDGER, PARAGRAPHS, catalog, ledger, paragraphs, scratch, table
from corpusframe.sources.versions import Versions, write_register
from corpusframe.streaming import jobs


def _register(s, d):
    """Each user's last event: those of even days are written first, the others come over them."""
    rows = table(s, d, "events").select("user_id", "event_id", "event_type", F.day("ts").alias("day"))
    register = Versions(s, scratch(s), {"last": "user_id bigint, event_id bigint, event_type string, day int"})
    for part in (rows.where("day % 2 = 0"), rows.where("day % 2 = 1")):
        write_register(register, "last", part, "user_id", "event_id")
    return register.read("last")


def _updated(s, d):
    """The ledger of an earlier run after the documents as they are now: those of one source cannot be read, those of another not embedded."""
    cat, old = catalog(s, d), ledger(s, d)
    chunks = old.select(F.explode("chunk_ids").alias("chunk_key"), "path", F.lit("old").alias("text"))
    new = paragraphs(s, d).join(cat.select("doc_id", "path"), "doc_id").select(F.sha1(F.concat_ws("#", "path", F.col("seq").cast("string"))).alias("chunk_key"), "path", "text")
    source = F.split("path", "/")[0]
    failed = cat.where(source.isin("src3", "src4")).select("path", F.when(source == "src3", "read").otherwise("embed").alias("step"))
    store = Versions(s, scratch(s), {**jobs.INGEST, "report": "path string, why string"})
    store.publish({"chunks": chunks, "ledger": old}, note="earlier run")
    store.update(lambda have: L.next_state(have, cat, new, failed))
    counts = store.read("chunks").groupBy("path").agg(F.count("*").alias("n_chunks"))
    report = store.read("report").groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("why")), "; ").alias("why"))
    known = store.read("ledger").select("path", "status", F.size("chunk_ids").alias("n_ids"))
    return known.join(counts, "path", "full_outer").join(report, "path", "full_outer").select("path", "status", "n_ids", "n_chunks", "why")


def _ingested(s, d):
    """Documents as files of a folder, one for each source, looked through twice: the second look finds nothing new."""
    folder, store = scratch(s), Versions(s, scratch(s), jobs.INGEST)
    table(s, d, "documents").select("source", "text").repartition("source").write.partitionBy("source").text(folder)
    cut = lambda files: files.select("path", F.explode(F.split("text", "\n")).alias("text")).where("trim(text) <> ''")
    jobs.ingest(s, folder, store, cut, settle="-5 seconds")
    first = store.current()
    jobs.ingest(s, folder, store, cut, settle="-5 seconds")
    counts = store.read("chunks").groupBy("path").agg(F.count("*").alias("n_chunks"))
    place = F.regexp_extract("path", "(source=[^/]*)/", 1)
    return store.read("ledger").join(counts, "path", "left").select(place.alias("place"), "status", F.size("chunk_ids").alias("n_ids"), "n_chunks", F.lit(store.current() == first).alias("settled"))


QUERIES = {"S7_versions": _register, "L3_next_state": _updated, "W1_ingest": _ingested}

ORACLE_SQL = {
    "S7_versions": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, CAST(day(arg_max(ts, event_id)) AS INT) AS day FROM events GROUP BY user_id",
    "L3_next_state": f"""WITH {LEDGER}, {PARAGRAPHS}, df AS (SELECT coalesce(c.path, l.path) AS path, c.path IS NULL AS gone, CASE WHEN c.path IS NULL THEN 'deleted' WHEN l.path IS NULL THEN 'new' WHEN c.hash <> l.hash THEN 'modified' WHEN l.status = 'no_text' THEN 'new' ELSE 'unchanged' END AS change,
        CASE string_split(c.path, '/')[1] WHEN 'src3' THEN 'read' WHEN 'src4' THEN 'embed' END AS step, l.status, l.chunk_ids FROM catalog c FULL JOIN ledger l ON c.path = l.path),
      nc AS (SELECT path, count(*) AS n FROM paragraphs JOIN catalog USING (doc_id) GROUP BY path),
      st AS (SELECT path, CASE WHEN change = 'unchanged' THEN status WHEN step = 'read' THEN 'error' WHEN n IS NULL THEN 'no_text' ELSE 'processed' END AS status, CASE WHEN change = 'unchanged' THEN len(chunk_ids) WHEN step = 'read' THEN 0 ELSE coalesce(n, 0) END AS n_ids FROM df LEFT JOIN nc USING (path) WHERE change <> 'deleted' AND NOT (change <> 'unchanged' AND step IS NOT NULL AND step = 'embed')),
      ch AS (SELECT path, count(*) AS n_chunks FROM (SELECT path, unnest(l.chunk_ids) AS k FROM ledger l JOIN df USING (path) WHERE change NOT IN ('modified', 'deleted') UNION ALL SELECT path, CAST(n AS VARCHAR) FROM (SELECT path, unnest(range(0, n)) AS n FROM nc) JOIN df USING (path) WHERE change IN ('new', 'modified') AND step IS NULL) GROUP BY path),
      rp AS (SELECT path, 'failed: ' || step AS why FROM df WHERE change IN ('new', 'modified') AND step IS NOT NULL)
      SELECT path, status, CAST(n_ids AS INT) AS n_ids, n_chunks, why FROM st FULL JOIN ch USING (path) FULL JOIN rp USING (path)""",
    "W1_ingest": "SELECT 'source=' || source AS place, 'processed' AS status, CAST(count(DISTINCT line) AS INT) AS n_ids, count(DISTINCT line) AS n_chunks, true AS settled FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' GROUP BY source",
}
