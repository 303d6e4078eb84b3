"""Line dedup: lines that many different sites carry are boilerplate and leave every document.

The spread of a line is the number of distinct sites it stands on. HyperLogLog sketches per line hash, merged by aggregation,
estimate it; lines near the threshold get an exact distinct count, so the decision never hangs on an estimate's error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusframe.llm.common import read, stored

MIN_SITES = 5
LG_K = 12


def boilerplate_lines(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """line hashes of lines(line long, site long) that stand on at least so many sites.

    Copies of a line on one site combine before they are exchanged, by line and site, so what meets by line afterwards is a
    row per site at most. Lines of one site only (most) are then dropped by a minimum and a maximum per line. The band of exact counts is half to one and a half times the
    threshold, over a hundred standard errors of a sketch with 4,096 registers.
    """
    lines = stored(lines.select("line", "site").distinct())
    pairs = lines.groupBy("line").agg(F.min("site").alias("lo"), F.max("site").alias("hi")).where("lo <> hi").select("line")
    several = lines.join(pairs, "line", "left_semi")
    spread = several.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"))
    spread = stored(spread.where(F.col("sites") >= max(2, min_sites * 0.5)))
    near = several.join(spread.where(F.col("sites") < min_sites * 1.5).select("line"), "line", "left_semi")
    exact = near.groupBy("line").agg(F.count_distinct("site").alias("n")).where(F.col("n") >= min_sites).select("line")
    return spread.where(F.col("sites") >= min_sites * 1.5).select("line").union(exact)


def without_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """doc_id, n_lines, n_removed, text of every row of docs(doc_id, text, site).

    Lines end at a newline and are compared whole. Empty lines are never boilerplate. A null text stays null with no lines;
    a null site is a site of its own; an empty text has one empty line. Repeated rows each stay. Other columns are not read.
    Hashes have 64 bits: two different lines are taken for one with a chance of 2 ** -64.
    """
    if min_sites < 2:
        raise ValueError("min_sites must be 2 at least")
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce(F.col(site).cast("string"), F.lit("\0"))).alias("site"), F.xxhash64(F.col("doc_id"), F.col("text")).alias("key"))
    lines = rows.select("key", "site", F.explode(F.split("text", "\n")).alias("l")).where("l <> ''")
    lines = stored(lines.select("key", "site", F.xxhash64("l").alias("line")))
    common = boilerplate_lines(lines.select("line", "site"), min_sites, lg_k)
    removed = lines.select("key", "line").join(common, "line", "left_semi").groupBy("key").agg(F.collect_set("line").alias("gone"))
    own = F.split("text", "\n")
    kept = F.filter(own, lambda l: (l == "") | ~F.array_contains("gone", F.xxhash64(l)))
    out = rows.join(removed, "key", "left").withColumn("kept", F.when(F.col("gone").isNull(), own).otherwise(kept))
    n = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    return out.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(n).alias("n_lines"), F.when(F.col("text").isNull(), 0).otherwise(n - F.size("kept")).alias("n_removed"), F.array_join("kept", "\n").alias("text"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_boilerplate(read(spark, sf_dir, "documents"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, coalesce(source, chr(0)) AS site FROM documents),
l AS (SELECT rid, site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d WHERE text IS NOT NULL),
b AS (SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}),
k AS (SELECT rid, count(*) AS n_lines, count(b.line) AS n_removed, string_agg(CASE WHEN b.line IS NULL THEN l.line END, chr(10) ORDER BY pos) AS text
      FROM l LEFT JOIN b ON l.line = b.line GROUP BY rid)
SELECT d.doc_id, CAST(coalesce(k.n_lines, 0) AS INT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS INT) AS n_removed, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text
FROM d LEFT JOIN k ON d.rid = k.rid"""
