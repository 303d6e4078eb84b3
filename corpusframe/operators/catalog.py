"""Catalog change capture and admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def diff_catalog(cat: DataFrame, ledger: DataFrame) -> DataFrame:
    """L1: path, change: new, modified, unchanged or deleted. A file without text is tried again (new); one that failed with the same hash is unchanged."""
    a, b = cat.select("path", F.col("hash").alias("h")), ledger.select("path", F.col("hash").alias("old"), "status")
    both = a.join(b, "path", "full_outer")
    change = F.when(F.col("h").isNull(), "deleted").when(F.col("old").isNull(), "new").when(F.col("h") != F.col("old"), "modified").when(F.col("status") == "no_text", "new").otherwise("unchanged")
    return both.select("path", change.alias("change"))


def refresh_ledger(cat: DataFrame, ledger: DataFrame) -> DataFrame:
    """L2: unchanged rows whose size or time drifted take the new values; all else stays."""
    c = cat.select("path", F.col("hash").alias("h"), F.col("size").alias("s"), F.col("modified_ns").alias("m"))
    out = ledger.join(c, "path", "left")
    drift = (F.col("h") == F.col("hash")) & ((F.col("s") != F.col("size")) | (F.col("m") != F.col("modified_ns")))
    drift = F.coalesce(drift, F.lit(False))
    return out.select("path", "hash", "status", F.when(drift, F.col("s")).otherwise(F.col("size")).alias("size"), F.when(drift, F.col("m")).otherwise(F.col("modified_ns")).alias("modified_ns"), drift.alias("refreshed"))


def apply_delta(chunks: DataFrame, ledger: DataFrame, delta: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """L3: chunks(chunk_key, path, text) without those of modified and deleted files (by the ids in the ledger), with the new ones."""
    dead = delta.where("change in ('modified', 'deleted')").join(ledger.select("path", F.explode("chunk_ids").alias("chunk_key")), "path").select("chunk_key")
    return chunks.join(dead, "chunk_key", "left_anti").unionByName(new_chunks)


def next_state(state: dict[str, DataFrame], cat: DataFrame, new_chunks: DataFrame, failed: DataFrame) -> dict[str, DataFrame]:
    """L3 in full: chunks(chunk_key, path, text), ledger and report (path, why) after the files of cat(path, hash, size, modified_ns).

    new_chunks(chunk_key, path, text) come from the new and modified files, failed(path, step) tells those that could not be read
    (step read: into the ledger as error, so that they rest until they change) or embedded (step embed: not in the ledger, so
    that they come again). Chunks of modified and deleted files go by the ids in the ledger; files with none on record are
    reported as stuck. A file that was read and gave no chunk is no_text. Rows of files that did not change stay as they are.
    """
    chunks, ledger = state["chunks"], state["ledger"]
    delta = diff_catalog(cat, ledger)
    again = delta.where("change in ('new', 'modified')").select("path")
    gone = delta.where("change in ('modified', 'deleted')").join(ledger.select("path", "chunk_ids"), "path")
    step = failed.groupBy("path").agg(F.min(F.when(F.col("step") == "read", "read").otherwise("embed")).alias("step"))
    fresh = again.join(step, "path", "left")
    usable = new_chunks.join(fresh.where("step is null").select("path"), "path", "left_semi").select(*chunks.columns)
    kept = chunks.join(gone.select(F.explode("chunk_ids").alias("chunk_key")), "chunk_key", "left_anti").select(*chunks.columns).unionByName(usable)
    ids = usable.groupBy("path").agg(F.array_sort(F.collect_set("chunk_key")).alias("chunk_ids"))  # a file's chunks
    told = fresh.where("step is null or step = 'read'").join(cat.select("path", "hash", "size", "modified_ns"), "path").join(ids, "path", "left")
    status = F.when(F.col("step") == "read", "error").when(F.col("chunk_ids").isNull(), "no_text").otherwise("processed")
    told = told.select("path", "hash", status.alias("status"), "size", "modified_ns", F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"))
    columns = ["path", "hash", "status", "size", "modified_ns", "chunk_ids"]
    rested = ledger.join(delta.where("change = 'unchanged'").select("path"), "path", "left_semi").select(*columns)
    stuck = gone.where("coalesce(size(chunk_ids), 0) <= 0").select("path", F.lit("stuck").alias("why"))
    report = stuck.unionByName(fresh.where("step is not null").select("path", F.concat(F.lit("failed: "), "step").alias("why")))
    return {"chunks": kept, "ledger": rested.unionByName(told), "report": report}


def inventory(cat: DataFrame, ledger: DataFrame, slack_ns: int = 2_000_000_000) -> DataFrame:
    """L4: path, name, status (pending if unknown, resized or moved in time by two seconds), unique (whether the name is)."""
    known = ["processed", "no_text", "duplicate", "error"]
    j = cat.join(ledger.select("path", "status", F.col("size").alias("s"), F.col("modified_ns").alias("m")), "path", "left")
    stale = F.col("s").isNull() | (F.col("s") != F.col("size")) | (F.abs(F.col("m") - F.col("modified_ns")) >= slack_ns) | ~F.col("status").isin(known)
    name = F.element_at(F.split("path", "/"), -1)
    j = j.withColumns({"name": name, "status": F.when(stale, "pending").otherwise(F.col("status"))})
    return j.select("path", "name", "status", (F.count("*").over(W.partitionBy("name")) == 1).alias("unique"))


def inventory_summary(inv: DataFrame) -> DataFrame:
    return inv.groupBy("status").agg(F.count("*").alias("n"))


def is_stale(cat: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row: stale (key sets differ or a drift), sources, drifted."""
    j = cat.select("path", F.col("size").alias("s"), F.col("modified_ns").alias("m")).join(ledger.select("path", "size", "modified_ns"), "path", "full_outer")
    off = F.col("s").isNull() | F.col("size").isNull() | (F.col("s") != F.col("size")) | (F.col("m") != F.col("modified_ns"))
    return j.agg(F.bool_or(off).alias("stale"), F.count_distinct(F.split("path", "/")[0]).alias("sources"), F.count_if(off).alias("drifted"))


def find_duplicate_content(incoming: DataFrame, corpus: DataFrame) -> DataFrame:
    """Incoming rows with duplicate: the same hash is there already, or came earlier in the batch (by path)."""
    seen = corpus.select("hash").distinct().withColumn("__seen", F.lit(True))
    again = F.row_number().over(W.partitionBy("hash").orderBy("path")) > 1
    return incoming.join(seen, "hash", "left").withColumn("duplicate", F.coalesce("__seen", F.lit(False)) | again).drop("__seen")


def latest_by(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(*[o.desc_nulls_last() for o in order]))).where("__r = 1").drop("__r")


def plan_sync(listing: DataFrame, state: DataFrame, cat: DataFrame, supported: list[str], most_bytes: int) -> DataFrame:
    """Id, action: skip, unchanged, adopt or download."""
    ext = F.lower(F.element_at(F.split("name", r"\."), -1))
    path = F.regexp_replace("name", r'[<>:"\\|?*\x00-\x1f]', "_")
    j = listing.withColumn("path", path).join(state.select("id", F.col("path").alias("sp"), F.col("md5").alias("sm"), F.col("modified").alias("st")), "id", "left")
    j = j.join(cat.select("path", F.col("size").alias("disk")), "path", "left")
    same = (F.col("sp") == F.col("path")) & F.when(F.col("md5").isNotNull(), F.col("md5") == F.col("sm")).otherwise(F.col("modified") == F.col("st"))
    action = F.when(~ext.isin(supported) | (F.col("size") > most_bytes), "skip").when(F.coalesce(same, F.lit(False)), "unchanged").when(F.col("disk") == F.col("size"), "adopt").otherwise("download")
    return j.select("id", "path", action.alias("action"))


def plan_removals(listing: DataFrame, state: DataFrame, authoritative: bool, floor: int = 20, part: float = 0.1) -> DataFrame:
    """Ids no longer listed; none at all if the listing is not authoritative or too many are gone."""
    gone = state.join(listing, "id", "left_anti")
    n, g = state.agg(F.count("*").alias("__n")), gone.agg(F.count("*").alias("__g"))
    guarded = gone.crossJoin(F.broadcast(n.crossJoin(g)))
    return guarded.where(F.lit(authoritative) & (F.col("__g") <= F.greatest(F.lit(floor), F.col("__n") * part))).drop("__n", "__g")


def collisions(plan: DataFrame, target: str = "target") -> DataFrame:
    """Rows of the plan with collides: another row has the same target but for case."""
    return plan.withColumn("collides", F.count("*").over(W.partitionBy(F.lower(target))) > 1)


def remap_paths(rows: DataFrame, moves: DataFrame, column: str = "path") -> DataFrame:
    """Old paths become new ones; moved tells."""
    j = rows.join(moves.select(F.col("old").alias(column), F.col("new").alias("__new")), column, "left")
    return j.withColumns({"moved": F.col("__new").isNotNull(), column: F.coalesce("__new", column)}).drop("__new")


def corpus_fingerprint(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """One hash that does not depend on row order: hashes of rows are hashed per part of the key space (16 million parts by six
    hex digits of the key's hash), those per 4,096 of them, and so once more, so that no task holds more than a few thousand hashes."""
    row = F.sha2(F.concat_ws("\x1f", F.col(key).cast("string"), F.octet_length(text).cast("string"), F.col(text)), 256)
    level = chunks.select(F.substring(F.md5(F.col(key).cast("string")), 1, 6).alias("p"), F.col(key).alias("k"), row.alias("h"), F.lit(1).cast("long").alias("n"))
    for digits in (3, 0):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), "")
        level = level.groupBy("p").agg(F.sha2(joined, 256).alias("h"), F.sum("n").alias("n"))
        level = level.select(F.substring("p", 1, digits).alias("p"), F.col("p").alias("k"), "h", "n")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), "")
    return level.agg(F.substring(F.sha2(whole, 256), 1, 12).alias("fingerprint"), F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("chunks"))


def reattach(chunks: DataFrame, old: DataFrame, cat: DataFrame) -> DataFrame:
    """chunks(chunk_key, name) to the first path that now has one of the hashes the old name had; others drop out."""
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    now = cat.groupBy("hash").agg(F.min("path").alias("path"))
    choice = old.select(name("path").alias("name"), "hash").join(now, "hash").groupBy("name").agg(F.min_by("path", "hash").alias("path"))
    return chunks.join(choice, "name").select("chunk_key", "path")


def evict(files: DataFrame, now: Column, days: int = 30, keep: int = 200, quota: int = 100) -> DataFrame:
    """files(id, owner, guest, created) with action: expired and overflow guests go; over_quota marks account files beyond the quota."""
    fresh = F.col("created") >= now - F.expr(f"INTERVAL {days} DAYS")
    newest = files.where(F.col("guest") & fresh).orderBy(F.desc("created"), "id").limit(keep).select("id").withColumn("__newest", F.lit(True))
    place = F.row_number().over(W.partitionBy("owner").orderBy(F.desc("created"), "id"))
    files = files.withColumn("__place", place).join(F.broadcast(newest), "id", "left")
    over = F.col("guest") & F.col("__newest").isNull()
    action = F.when(F.col("guest") & ~fresh, "expired").when(over, "overflow").when(~F.col("guest") & (F.col("__place") > quota), "over_quota").otherwise("kept")
    return files.withColumn("action", action).drop("__place", "__newest")


def unique_names(cat: DataFrame) -> DataFrame:
    """Name -> path where one file only has the name."""
    return cat.groupBy(F.element_at(F.split("path", "/"), -1).alias("name")).agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1").select("name", "path")
