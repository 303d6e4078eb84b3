"""Structured Streaming jobs (W1-W6) and their batch twins."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusframe.operators.catalog import find_duplicate_content, next_state
from corpusframe.sources.versions import Versions


def hot_folder(spark: SparkSession, folder: str, extensions: str = "*.txt", settle: str = "60 seconds", text: bool = False) -> DataFrame:
    """A stream of path, size, modified, hash (and text, if asked for) of files in a folder; the checkpoint replaces a list of seen files. The
    source tells a file once, so one that had not settled then is not told again before it changes: for folders that are written to
    all the time ingest() looks by the clock instead."""
    kind = spark.read.format("binaryFile").load(folder).schema
    files = spark.readStream.format("binaryFile").schema(kind).option("pathGlobFilter", extensions).load(folder)
    ready = files.where(F.col("modificationTime") <= F.current_timestamp() - F.expr(f"INTERVAL {settle}"))
    more = [F.decode("content", "UTF-8").alias("text")] if text else []
    return ready.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("hash"), *more)


#: Tables of an ingest: the chunks of all files, and what is known of each file.
INGEST = {"chunks": "chunk_key string, path string, text string", "ledger": "path string, hash string, status string, size bigint, modified_ns bigint, chunk_ids array<string>"}


def ingest_batch(state: Versions, cut: Callable[[DataFrame], DataFrame], name: str = "ingest") -> Callable[[DataFrame, int | None], None]:
    """What to do with a batch of settled files(path, size, modified, hash, text): those whose content the corpus or an earlier file of
    the batch has (L6) stay out of it and are told in the ledger, the others are cut into chunks(path, text) and applied (L1, L3). A file
    that comes with another content replaces its chunks; files that are not in the batch are left alone. All becomes one version
    under the job's name and the batch's number, so a batch that comes again after a failure changes nothing."""

    def job(files: DataFrame, number: int | None) -> None:
        def change(have: Mapping[str, DataFrame]) -> Mapping[str, DataFrame]:
            last = F.row_number().over(W.partitionBy("path").orderBy(F.desc("modified"), "hash"))
            rows = files.withColumn("__r", last).where("__r = 1").drop("__r").withColumn("modified_ns", F.unix_micros("modified") * 1000)
            elsewhere = have["ledger"].join(rows.select("path"), "path", "left_anti")
            rows = find_duplicate_content(rows, elsewhere.where("status <> 'duplicate'"))
            own = have["ledger"].join(rows.select("path"), "path", "left_semi")
            new = rows.where("not duplicate")
            chunks = cut(new.select("path", "text")).withColumn("chunk_key", F.sha2(F.concat_ws("\x1f", "path", "text"), 256)).dropDuplicates(["chunk_key"]).select("chunk_key", "path", "text")
            none = files.sparkSession.createDataFrame([], "path string, step string")
            # what turned into a copy of another file is no longer among the files, and so loses its chunks
            after = next_state({"chunks": have["chunks"], "ledger": own}, new.select("path", "hash", "size", "modified_ns"), chunks, none)
            again = rows.where("duplicate").select("path", "hash", F.lit("duplicate").alias("status"), "size", "modified_ns", F.array().cast("array<string>").alias("chunk_ids"))
            return {"chunks": after["chunks"], "ledger": elsewhere.unionByName(after["ledger"]).unionByName(again)}

        state.update(change, note=f"{name}, batch {number}", key=None if number is None else f"{name}/{number}")

    return job


def settled(spark: SparkSession, folder: str, ledger: DataFrame, extensions: str = "*.txt", settle: str = "60 seconds", listed: int = 100_000) -> DataFrame | None:
    """Path, size, modified, hash, text of the files of a folder, and of those in it, that have rested for a while and are not in the ledger
    with their size and time; None where there are none. Only those files are opened, up to so many by name, more by a join."""
    before = spark.sql(f"SELECT date_format(current_timestamp() - INTERVAL {settle}, \"yyyy-MM-dd'T'HH:mm:ss\")").first()[0]
    load = lambda paths: spark.read.format("binaryFile").option("pathGlobFilter", extensions).option("recursiveFileLookup", True).option("modifiedBefore", before).load(paths)
    found = load(folder).select("path", F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("modified_ns"))
    new = found.join(ledger.select("path", "size", "modified_ns"), ["path", "size", "modified_ns"], "left_anti").select("path")
    names = [r["path"] for r in new.limit(listed + 1).collect()]
    if not names:
        return None
    files = load(names) if len(names) <= listed else load(folder).join(new, "path", "left_semi")
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("hash"), F.decode("content", "UTF-8").alias("text"))


def ingest(spark: SparkSession, folder: str, state: Versions, cut: Callable[[DataFrame], DataFrame], checkpoint: str | None = None, settle: str = "60 seconds", minutes: int = 5) -> StreamingQuery | None:
    """A folder's settled text files come into the tables of state: once, or with a checkpoint every so many minutes. A clock drives the looking,
    the ledger says what is known, so a file that was too new is there the next time."""

    def look(_: DataFrame | None, number: int | None) -> None:
        files = settled(spark, folder, state.read("ledger"), settle=settle)
        if files is not None:
            ingest_batch(state, cut, checkpoint or folder)(files, number)

    if checkpoint is None:
        look(None, None)
        return None
    return periodic(spark.readStream.format("rate").load(), look, checkpoint, max(1, minutes))


def activity_batches(events: DataFrame, gap: str = "90 seconds", late: str = "1 day") -> DataFrame:
    """Windows of activity, each closed by a gap: begin, end, n. A stream (append) merges its open windows by state,
    and merges inside tasks first where spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition is set; over a table,
    breaks are found inside hours, and between them from each hour's first and last event, so no task sees all events."""
    if events.isStreaming:
        events = events.withWatermark("at", late)
        # a session takes in what comes at its very end, where a gap has passed already
        w = F.session_window("at", f"{gap} -1 microseconds").alias("w")
        all_ = F.substring(F.col("at").cast("string"), 1, 0).alias("all")  # sessions of a stream need a key; this one is always empty
        return events.groupBy(all_, w).agg(F.count("*").alias("n")).select(F.col("w.start").alias("begin"), (F.col("w.end") + F.expr("INTERVAL 1 microsecond")).alias("end"), "n")
    wide = F.expr(f"INTERVAL {gap}")
    rows = events.where("at is not null").select("at", F.date_trunc("hour", "at").alias("hour"))
    hours = rows.groupBy("hour").agg(F.min("at").alias("first"), F.max("at").alias("last"))  # a row per hour
    hours = hours.withColumn("earlier", F.lag("last").over(W.orderBy("hour"))).withColumn("opens", F.coalesce(F.col("first") >= F.col("earlier") + wide, F.lit(True)))
    inside = W.partitionBy("hour").orderBy("at")
    rows = rows.withColumn("breaks", F.coalesce(F.col("at") >= F.lag("at").over(inside) + wide, F.lit(False)).cast("long"))
    rows = rows.withColumn("nth", F.sum("breaks").over(inside))
    most = rows.groupBy("hour").agg(F.max("nth").alias("most"))
    hours = hours.join(most, "hour").withColumn("base", F.sum(F.col("most") + F.col("opens").cast("long")).over(W.orderBy("hour")) - F.col("most"))
    both = rows.join(F.broadcast(hours.select("hour", "base")), "hour").groupBy((F.col("base") + F.col("nth")).alias("k"))
    return both.agg(F.min("at").alias("begin"), F.max("at").alias("m"), F.count("*").alias("n")).select("begin", (F.col("m") + wide).alias("end"), "n")


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Day, kind, n; events later than a day are dropped from a stream."""
    if events.isStreaming:
        events = events.withWatermark("at", late)
    return events.groupBy(F.window("at", "1 day").alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "kind", "n")


def expiring(uses: DataFrame, ttl: str = "30 days", late: str = "1 day") -> DataFrame:
    """Key, begin, expires, uses: the lives of entries used at (key, at): each use renews an entry, and it is gone once more than a ttl has passed since the last one. A stream
    gives a life once the watermark has passed its end; its state is one row an open entry."""
    if uses.isStreaming:
        uses = uses.withWatermark("at", late)
    lives = uses.groupBy("key", F.session_window("at", ttl).alias("w")).agg(F.count("*").alias("uses"))
    return lives.select("key", F.col("w.start").alias("begin"), F.col("w.end").alias("expires"), "uses")


def periodic(source: DataFrame, job: Callable[[DataFrame, int], None], checkpoint: str, minutes: int = 15) -> StreamingQuery:
    """job(rows, batch number) on what is new in a stream, every so many minutes; with 0, once on all there is. A batch that was cut
    short comes again under its number, so a job that writes below that number does its work once."""
    trigger = {"processingTime": f"{minutes} minutes"} if minutes > 0 else {"availableNow": True}
    return source.writeStream.foreachBatch(job).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def rolling_counts(events: DataFrame, seconds: int = 60) -> DataFrame:
    """W4, batch twin: per event how many of its key came in the seconds up to it."""
    w = W.partitionBy("key").orderBy(F.col("at").cast("timestamp").cast("double")).rangeBetween(-seconds, 0)
    return events.withColumn("recent", F.count("*").over(w))


def accepted(times: list[float], most: int, seconds: float, kept: list[float]) -> tuple[list[bool], list[float]]:
    """Which hits of one key pass: fewer than so many accepted ones lie in the time before; refused hits are not remembered."""
    out = []
    for t in times:
        kept = [x for x in kept if x > t - seconds]
        out.append(len(kept) < most)
        if out[-1]:
            kept.append(t)
    return out, kept


def limiter(events: DataFrame, most: int = 20, seconds: int = 60, late: str = "1 day") -> DataFrame:
    """A stream of hits(key, at, id) with allowed. State: the accepted times of a key within the window, so bounded by most; a key that is
    quiet for a window is forgotten once the watermark has passed."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["at", "id"])
        ok, kept = accepted([t.timestamp() for t in rows["at"]], most, seconds, kept)
        state.update((kept,))
        until = int((max(t.timestamp() for t in rows["at"]) + seconds) * 1000)
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": key[0], "id": rows["id"], "allowed": ok})

    schema = events.schema
    out = f"key {schema['key'].dataType.simpleString()}, id {schema['id'].dataType.simpleString()}, allowed boolean"
    return events.withWatermark("at", late).groupBy("key").applyInPandasWithState(step, out, "kept array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def limited(events: DataFrame, most: int = 20, seconds: int = 60) -> DataFrame:
    """W4 over a table: the same rule over each key's hits in order. Sorted rows stream through a task, which remembers the accepted times
    of one key within the window; a key of any number of hits fits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, kept = None, []
        for rows in batches:
            allowed = []
            for key, at in zip(rows["key"], rows["at"], strict=True):
                if last is None or key != last:
                    last, kept = key, []
                ok, kept = accepted([at.timestamp()], most, seconds, kept)
                allowed += ok
            yield pd.DataFrame({"key": rows["key"], "id": rows["id"], "allowed": allowed})

    schema = events.schema
    out = f"key {schema['key'].dataType.simpleString()}, id {schema['id'].dataType.simpleString()}, allowed boolean"
    return events.select("key", "at", "id").repartition("key").sortWithinPartitions("key", "at", "id").mapInPandas(run, out)
