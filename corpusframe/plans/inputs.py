"""The jobs' input tables as views of the shared ones, and the same as SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A shared table. Texts that come in fewer splits than there are cores (a single small file) are spread, as work on them is dear; what has
    splits enough stays where it is."""
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name == "documents" and rows.rdd.getNumPartitions() < cores else rows


_OWN_FOLDER: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names; where it is unset, as in tests, in a temporary one, but not on a cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        if not _OWN_FOLDER:
            _OWN_FOLDER.append(tempfile.mkdtemp(prefix="corpusframe-"))
        shared = _OWN_FOLDER[0]
    return f"{shared}/{uuid.uuid4().hex}"


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, seq, text: the lines of every document that are not blank."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("seq", "text")).where("trim(text) <> ''")


PARAGRAPHS = """paragraphs AS (SELECT * FROM (SELECT doc_id, source, lang, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS seq,
  unnest(string_split(text, chr(10))) AS text FROM documents) WHERE trim(text) <> '')"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, size, modified_ns, hash of the documents as files."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.octet_length("text").cast("long").alias("size"), (F.col("doc_id") * 1_000_000_000).alias("modified_ns"), F.sha2("text", 256).alias("hash"), "doc_id")


CATALOG = """catalog AS (SELECT source || '/' || doc_id || '.txt' AS path, CAST(strlen(text) AS BIGINT) AS size, doc_id * 1000000000 AS modified_ns, sha256(text) AS hash, doc_id FROM documents)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an earlier run knew: labelled documents, those of low quality in an older version, and files since gone."""
    old = catalog(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    status = F.when(F.col("toxic") == 1, "error").when(F.col("size") < 500, "no_text").otherwise("processed")
    drift = F.when(F.col("size") > 2000, 3_000_000_000).otherwise(0)
    rows = old.select("path", F.when(F.col("quality") == 0, F.sha2(F.concat(F.lit("old"), "hash"), 256)).otherwise(F.col("hash")).alias("hash"), status.alias("status"), "size", (F.col("modified_ns") - drift).alias("modified_ns"), F.array(F.sha1("path"), F.sha1(F.concat("path", F.lit("#2")))).alias("chunk_ids"))
    gone = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("gone/"), F.col("item_id").cast("string"), F.lit(".txt")).alias("path"), F.sha2("text", 256).alias("hash"), F.lit("processed").alias("status"), F.octet_length("text").cast("long").alias("size"), F.lit(0).cast("long").alias("modified_ns"), F.array(F.sha1("text")).alias("chunk_ids"))
    return rows.unionByName(gone)


LEDGER = f"""{CATALOG}, ledger AS (SELECT path, CASE WHEN quality = 0 THEN sha256('old' || hash) ELSE hash END AS hash,
  CASE WHEN toxic = 1 THEN 'error' WHEN size < 500 THEN 'no_text' ELSE 'processed' END AS status, size, modified_ns - CASE WHEN size > 2000 THEN 3000000000 ELSE 0 END AS modified_ns, [sha1(path), sha1(path || '#2')] AS chunk_ids
  FROM catalog JOIN labels USING (doc_id) UNION ALL
  SELECT 'gone/' || item_id || '.txt', sha256(text), 'processed', CAST(strlen(text) AS BIGINT), 0, [sha1(text)] FROM benchmark)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, text: every test item asks."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


QUESTIONS = "questions AS (SELECT item_id AS query_id, text FROM benchmark)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as turns: turn_id, conv_id (a user's day), client, role, question, seconds, flags, detail, at."""
    e = table(spark, sf_dir, "events")
    kind, v = F.col("event_type"), F.col("value")
    return e.select(
        F.col("event_id").alias("turn_id"), F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("conv_id"), F.col("user_id").cast("string").alias("client"),
        F.when(F.col("user_id") % 3 == 0, "teacher").when(F.col("user_id") % 3 == 1, "student").otherwise("guest").alias("role"),
        F.concat_ws(" ", kind, F.floor(v).cast("string")).alias("question"), v.alias("seconds"), (kind == "error").alias("refused"), (kind == "view").alias("from_cache"), (v < 100).alias("citation_ok"), (v < 50).alias("figures_ok"), F.col("props").alias("detail"), F.col("ts").alias("at"),
    )


TURNS = """turns AS (SELECT event_id AS turn_id, user_id || '-' || strftime(ts, '%Y%m%d') AS conv_id, CAST(user_id AS VARCHAR) AS client,
  CASE user_id % 3 WHEN 0 THEN 'teacher' WHEN 1 THEN 'student' ELSE 'guest' END AS role, event_type || ' ' || CAST(floor(value) AS BIGINT) AS question, value AS seconds,
  event_type = 'error' AS refused, event_type = 'view' AS from_cache, value < 100 AS citation_ok, value < 50 AS figures_ok, props AS detail, ts AS at FROM events)"""
