"""Queries L1-L18 over documents as files, with labels and test items as the ledger of an earlier run."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusframe.operators import catalog as L
from corpusframe.plans.inputs import CATALOG, LEDGER, catalog, ledger, table

NOW = "timestamp'2024-02-01 00:00:00'"


def _files(s, d):
    return table(s, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("owner"), (F.col("event_type") == "view").alias("guest"), F.col("ts").alias("created"))


def _listing(s, d):
    return catalog(s, d).select(F.col("doc_id").alias("id"), F.col("path").alias("name"), "size", F.substring("hash", 1, 32).alias("md5"), F.col("modified_ns").alias("modified"))


def _state(s, d):
    return ledger(s, d).join(catalog(s, d).select("path", F.col("doc_id").alias("id")), "path").select("id", "path", F.substring("hash", 1, 32).alias("md5"), F.col("modified_ns").alias("modified"))


def _chunks(s, d):
    return ledger(s, d).select(F.explode("chunk_ids").alias("chunk_key"), "path")


QUERIES = {
    "L1_diff": lambda s, d: L.diff_catalog(catalog(s, d), ledger(s, d)),
    "L2_refresh": lambda s, d: L.refresh_ledger(catalog(s, d), ledger(s, d)),
    "L3_apply_delta": lambda s, d: L.apply_delta(_chunks(s, d), ledger(s, d), L.diff_catalog(catalog(s, d), ledger(s, d)), catalog(s, d).select(F.sha1("hash").alias("chunk_key"), "path")),
    "L4_inventory": lambda s, d: L.inventory(catalog(s, d), ledger(s, d)),
    "L4_summary": lambda s, d: L.inventory_summary(L.inventory(catalog(s, d), ledger(s, d))),
    "L5_staleness": lambda s, d: L.is_stale(catalog(s, d), ledger(s, d)),
    "L6_duplicates": lambda s, d: L.find_duplicate_content(catalog(s, d).select("path", "hash"), ledger(s, d)),
    "L7_latest": lambda s, d: L.latest_by(catalog(s, d).select("path", "hash", "modified_ns"), "hash", F.col("modified_ns")),
    "L10_plan_sync": lambda s, d: L.plan_sync(_listing(s, d), _state(s, d), catalog(s, d), ["txt"], 20_000),
    "L11_removals": lambda s, d: L.plan_removals(table(s, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id")), table(s, d, "documents").select(F.col("doc_id").alias("id")).join(table(s, d, "labels").select(F.col("doc_id").alias("id")), "id"), True, part=0.5),
    "L13_collisions": lambda s, d: L.collisions(table(s, d, "documents").select("doc_id", F.concat_ws("/", "lang", "n_chars").alias("target"))),
    "L14_remap": lambda s, d: L.remap_paths(ledger(s, d).select("path", "status"), catalog(s, d).where("size > 1000").select(F.col("path").alias("old"), F.concat(F.lit("big/"), "path").alias("new"))),
    "L15_fingerprint": lambda s, d: L.corpus_fingerprint(table(s, d, "documents"), "doc_id", "text"),
    "L16_reattach": lambda s, d: L.reattach(_chunks(s, d).select("chunk_key", F.element_at(F.split("path", "/"), -1).alias("name")), ledger(s, d), catalog(s, d)),
    "L17_evict": lambda s, d: L.evict(_files(s, d), F.expr(NOW), days=10, keep=50, quota=40).select("id", "action"),
    "L18_unique_names": lambda s, d: L.unique_names(catalog(s, d)),
}
_DIFF = f"{LEDGER}, df AS (SELECT path, CASE WHEN c.hash IS NULL THEN 'deleted' WHEN l.hash IS NULL THEN 'new' WHEN c.hash <> l.hash THEN 'modified' WHEN status = 'no_text' THEN 'new' ELSE 'unchanged' END AS change FROM catalog c FULL JOIN ledger l USING (path))"
_INV = f"{LEDGER}, inv AS (SELECT c.path, string_split(c.path, '/')[-1] AS name, CASE WHEN l.size IS NULL OR l.size <> c.size OR abs(l.modified_ns - c.modified_ns) >= 2000000000 THEN 'pending' ELSE status END AS status FROM catalog c LEFT JOIN ledger l USING (path))"
ORACLE_SQL = {
    "L1_diff": f"WITH {_DIFF} SELECT * FROM df",
    "L2_refresh": f"WITH {LEDGER}, j AS (SELECT l.path, l.hash, l.status, l.size, l.modified_ns, c.size AS s, c.modified_ns AS m, coalesce(c.hash = l.hash AND (c.size <> l.size OR c.modified_ns <> l.modified_ns), false) AS refreshed FROM ledger l LEFT JOIN catalog c USING (path)) SELECT path, hash, status, CASE WHEN refreshed THEN s ELSE size END AS size, CASE WHEN refreshed THEN m ELSE modified_ns END AS modified_ns, refreshed FROM j",
    "L3_apply_delta": f"WITH {_DIFF}, ch AS (SELECT unnest(chunk_ids) AS chunk_key, path FROM ledger), dead AS (SELECT chunk_key FROM ch JOIN df USING (path) WHERE change IN ('modified', 'deleted')) SELECT * FROM ch ANTI JOIN dead USING (chunk_key) UNION ALL SELECT sha1(hash), path FROM catalog",
    "L4_inventory": f"WITH {_INV} SELECT *, count(*) OVER (PARTITION BY name) = 1 AS \"unique\" FROM inv",
    "L4_summary": f"WITH {_INV} SELECT status, count(*) AS n FROM inv GROUP BY status",
    "L5_staleness": f"WITH {LEDGER}, j AS (SELECT path, c.size IS NULL OR l.size IS NULL OR c.size <> l.size OR c.modified_ns <> l.modified_ns AS off FROM catalog c FULL JOIN ledger l USING (path)) SELECT bool_or(off) AS stale, count(DISTINCT string_split(path, '/')[1]) AS sources, count(*) FILTER (WHERE off) AS drifted FROM j",
    "L6_duplicates": f"WITH {LEDGER} SELECT path, hash, hash IN (SELECT hash FROM ledger) OR row_number() OVER (PARTITION BY hash ORDER BY path) > 1 AS duplicate FROM catalog",
    "L7_latest": f"WITH {CATALOG} SELECT path, hash, modified_ns FROM catalog QUALIFY row_number() OVER (PARTITION BY hash ORDER BY modified_ns DESC) = 1",
    "L10_plan_sync": f"WITH {LEDGER} SELECT c.doc_id AS id, c.path, CASE WHEN c.size > 20000 THEN 'skip' WHEN l.path IS NOT NULL AND substr(c.hash, 1, 32) = substr(l.hash, 1, 32) THEN 'unchanged' ELSE 'adopt' END AS action FROM catalog c LEFT JOIN ledger l USING (path)",
    "L11_removals": "WITH g AS (SELECT doc_id AS id FROM labels WHERE quality IS DISTINCT FROM 1) SELECT id FROM g WHERE (SELECT count(*) FROM g) <= greatest(20, 0.5 * (SELECT count(*) FROM labels))",
    "L13_collisions": "SELECT doc_id, lang || '/' || n_chars AS target, count(*) OVER (PARTITION BY lower(lang || '/' || n_chars)) > 1 AS collides FROM documents",
    "L14_remap": f"WITH {LEDGER} SELECT CASE WHEN c.path IS NOT NULL THEN 'big/' || l.path ELSE l.path END AS path, status, c.path IS NOT NULL AS moved FROM ledger l LEFT JOIN (SELECT path FROM catalog WHERE size > 1000) c ON l.path = c.path",
    "L15_fingerprint": "WITH h AS (SELECT substr(md5(CAST(doc_id AS VARCHAR)), 1, 6) AS p, doc_id, sha256(doc_id || chr(31) || strlen(text) || chr(31) || text) AS h FROM documents), g AS (SELECT p, sha256(string_agg(h, '' ORDER BY doc_id)) AS h, count(*) AS n FROM h GROUP BY p), k AS (SELECT p[1:3] AS p, sha256(string_agg(h, '' ORDER BY g.p)) AS h, sum(n) AS n FROM g GROUP BY g.p[1:3]) SELECT substr(sha256(string_agg(h, '' ORDER BY p)), 1, 12) AS fingerprint, CAST(sum(n) AS BIGINT) AS chunks FROM k",
    "L16_reattach": f"WITH {LEDGER}, now AS (SELECT hash, min(path) AS path FROM catalog GROUP BY hash), ch AS (SELECT string_split(l.path, '/')[-1] AS name, arg_min(n.path, hash) AS path FROM ledger l JOIN now n USING (hash) GROUP BY 1) SELECT chunk_key, ch.path FROM (SELECT unnest(chunk_ids) AS chunk_key, string_split(path, '/')[-1] AS name FROM ledger) JOIN ch USING (name)",
    "L17_evict": "WITH f AS (SELECT event_id AS id, user_id AS owner, event_type = 'view' AS guest, ts AS created, ts >= TIMESTAMP '2024-02-01' - INTERVAL 10 DAYS AS fresh FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY guest AND fresh ORDER BY created DESC, id) AS g, row_number() OVER (PARTITION BY owner ORDER BY created DESC, id) AS o FROM f) SELECT id, CASE WHEN guest AND NOT fresh THEN 'expired' WHEN guest AND g > 50 THEN 'overflow' WHEN NOT guest AND o > 40 THEN 'over_quota' ELSE 'kept' END AS action FROM r",
    "L18_unique_names": f"WITH {CATALOG} SELECT string_split(path, '/')[-1] AS name, min(path) AS path FROM catalog GROUP BY 1 HAVING count(*) = 1",
}
