"""Upkeep of a corpus and its service tables: queue states, trash, moves, ledgers, retention, warnings, passages of several files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusframe.operators.chunking import spread_sample
from corpusframe.operators.retrieval import bm25_within

#: From which state an upload may go to which.
MOVES = {"pending": ("accepted", "rejected"), "accepted": ("trash",), "rejected": ("trash", "pending"), "trash": ("pending",)}


def settled_states(log: DataFrame, order: str = "at") -> DataFrame:
    """Id, status, at, refused: of each upload's log(id, status, at) the state it ends in, when it got there, and how many moves were none
    that its state allows. Uploads begin as pending. A fold over an upload's own history; equal times go by the state's name."""
    lists = log.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(order, "status"))).alias("l"))
    allowed = F.create_map(*[x for k, v in MOVES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    kind = log.schema[order].dataType
    start = F.struct(F.lit("pending").alias("status"), F.lit(None).cast(kind).alias("at"), F.lit(0).alias("refused"))

    def step(s: Column, x: Column) -> Column:
        ok = F.coalesce(F.array_contains(F.try_element_at(allowed, s["status"]), x["status"]), F.lit(False))
        return F.struct(F.when(ok, x["status"]).otherwise(s["status"]).alias("status"), F.when(ok, x[order]).otherwise(s["at"]).alias("at"), (s["refused"] + F.when(ok, 0).otherwise(1)).alias("refused"))

    return lists.select("id", F.aggregate("l", start, step).alias("s")).select("id", "s.status", "s.at", "s.refused")


def trash_view(trash: DataFrame, uploads: DataFrame, limit: int | None = None) -> DataFrame:
    """The trash, newest first: id, name (the upload's, else the last part of the original path), contributor, removed, and whether its
    upload is still known and whether a pending one has the same content."""
    u = uploads.select("id", F.col("name").alias("__name"), "contributor", F.lit(True).alias("known"))
    waiting = uploads.where("status = 'pending'").select("hash").distinct().withColumn("__again", F.lit(True))
    rows = trash.join(u, "id", "left").join(waiting, "hash", "left")
    no = F.lit(False)
    rows = rows.select("id", F.coalesce("__name", F.element_at(F.split("original_path", "/"), -1)).alias("name"), "contributor", "removed", F.coalesce("known", no).alias("known"), F.coalesce("__again", no).alias("queued_again"))
    rows = rows.orderBy(F.desc("removed"), F.desc("id"))
    return rows if limit is None else rows.limit(limit)


def move_plan(plan: DataFrame, existing: DataFrame) -> DataFrame:
    """plan(path, target) with action: collision where rows of the plan share a target but for case, stays where a path is its own target,
    kept where another file is there already (but for case), else move."""
    there = existing.select(F.lower("path").alias("__there"), F.col("path").alias("__path"))
    there = there.groupBy("__there").agg(F.count("*").alias("__n"), F.min("__path").alias("__one"))
    j = plan.join(there, F.lower("target") == F.col("__there"), "left")
    same = F.count("*").over(W.partitionBy(F.lower("target"))) > 1
    other = F.col("__there").isNotNull() & ((F.col("__n") > 1) | (F.col("__one") != F.col("path")))
    action = F.when(same, "collision").when(F.col("path") == F.col("target"), "stays").when(other, "kept").otherwise("move")
    return j.select("path", "target", action.alias("action"))


def move_counts(actions: DataFrame) -> DataFrame:
    """Folder, action, n; the folder is the target's."""
    folder = F.regexp_extract("target", r"^(.*)/[^/]*$", 1)
    return actions.groupBy(folder.alias("folder"), "action").agg(F.count("*").alias("n"))


def rebuilt_ledger(chunks: DataFrame, cat: DataFrame) -> DataFrame:
    """The ledger after chunks(chunk_key, path) found their files again: of files with one content the first path holds it, later ones are
    duplicate; a file of its own without chunks is no_text."""
    ids = chunks.groupBy("path").agg(F.array_sort(F.collect_set("chunk_key")).alias("chunk_ids"))  # a file's chunks
    later = F.row_number().over(W.partitionBy("hash").orderBy("path")) > 1
    j = cat.select("path", "hash", "size", "modified_ns").withColumn("__later", later).join(ids, "path", "left")
    status = F.when(F.col("__later"), "duplicate").when(F.col("chunk_ids").isNull(), "no_text").otherwise("processed")
    own = F.when(F.col("__later") | F.col("chunk_ids").isNull(), F.array().cast("array<string>")).otherwise(F.col("chunk_ids"))
    return j.select("path", "hash", status.alias("status"), "size", "modified_ns", own.alias("chunk_ids"))


def retained(turns: DataFrame, convs: DataFrame, blocks: DataFrame, cutoff: Column | None) -> dict[str, DataFrame]:
    """The three tables after retention: turns and block events from the cutoff on; conversations that have a turn left or are younger, those
    that are older re-titled and re-dated from their oldest turn that is left. Without a cutoff all stay."""
    if cutoff is None:
        return {"turns": turns, "conversations": convs, "blocks": blocks}
    from corpusframe.operators.usage import retention

    return {"turns": turns.where(F.col("at") >= cutoff), "conversations": retention(turns, convs, cutoff), "blocks": blocks.where(F.col("at") >= cutoff)}


def answer_warnings(sources: DataFrame, labels: DataFrame, times: DataFrame, amended: DataFrame, today: Column) -> DataFrame:
    """query_id, kind, about, place, said: warnings of an answer's sources(query_id, rank, file, node, chunk_key), three kinds in one list.

    status: of a document that labels(node, label) do not say is in force, once an answer, at its first source. draft or not_yet: of
    a file that times(file, effective_on, is_draft) call a draft, or in force only after today; once an answer. passage: of every
    source whose own text names what changed it, by amended(chunk_key, by ARRAY).
    """
    once = lambda rows, by: rows.withColumn("__r", F.row_number().over(W.partitionBy("query_id", by).orderBy("rank"))).where("__r = 1")
    out = lambda rows, kind, about, said: rows.select("query_id", kind.alias("kind"), F.col(about).alias("about"), F.col("rank").alias("place"), said.alias("said"))
    status = once(sources.where("node is not null").join(labels.where("label <> 'in_force'"), "node"), "node")
    timed = once(sources.join(times.where(F.col("is_draft") | (F.col("effective_on") > today)), "file"), "file")
    own = sources.join(amended.where("size(by) > 0"), "chunk_key")
    when = F.when(F.col("is_draft"), F.lit(None).cast("string")).otherwise(F.date_format("effective_on", "dd/MM/yyyy"))
    return out(status, F.lit("status"), "node", F.col("label")).unionByName(out(timed, F.when(F.col("is_draft"), "draft").otherwise("not_yet"), "file", when)).unionByName(out(own, F.lit("passage"), "chunk_key", F.array_join("by", ", ")))


def files_passages(asked: DataFrame, chunks: DataFrame, summary: bool = False, files: int = 4, total: int = 4, budget: int = 24) -> DataFrame:
    """query_id, file, chunk_key, place: passages of the first four files of each asked(query_id, text, file, pos). A question gets
    max(2, total // files) of each by the file's own BM25 (R12), files without a hit a sample spread over them; a summary gets
    max(3, budget // files) spread over each (C7). chunks(chunk_key, file, text)."""
    first = asked.withColumn("__p", F.row_number().over(W.partitionBy("query_id").orderBy("pos", "file"))).where(F.col("__p") <= files)
    first = first.withColumn("__n", F.count("*").over(W.partitionBy("query_id"))).withColumn("__id", F.to_json(F.struct("query_id", "file")))
    each = F.greatest(F.lit(3), F.floor(F.lit(budget) / F.col("__n"))) if summary else F.greatest(F.lit(2), F.floor(F.lit(total) / F.col("__n")))
    first = first.withColumn("__each", each.cast("int"))
    most = max(3, budget) if summary else max(2, total)
    rest, hits = first.select("__id", "file", "__each"), None
    if not summary:
        scored = bm25_within(first.select(F.col("__id").alias("query_id"), "file", "text"), chunks.select("chunk_key", "file", "text"), "chunk_key", "file", most)
        hits = scored.select(F.col("query_id").alias("__id"), "chunk_key", "rank").join(first.select("__id", "__each"), "__id").where(F.col("rank") <= F.col("__each")).select("__id", "chunk_key", F.col("rank").alias("place")).persist()  # most rows a file that is asked
        rest = rest.join(hits.select("__id").distinct(), "__id", "left_anti")
    rows = rest.join(chunks.select("file", "chunk_key"), "file")
    # the sizes that samples may have are few: one sample for each of them
    spread = None
    for k in sorted({max(3, budget // n) if summary else max(2, total // n) for n in range(1, files + 1)}):
        part = spread_sample(rows.where(F.col("__each") == k).select("__id", "chunk_key"), "__id", "chunk_key", k)
        spread = part if spread is None else spread.unionByName(part)
    spread = spread.withColumn("place", F.row_number().over(W.partitionBy("__id").orderBy("chunk_key")))
    found = spread if hits is None else hits.unionByName(spread)
    return found.join(first.select("__id", "query_id", "file"), "__id").select("query_id", "file", "chunk_key", "place")
