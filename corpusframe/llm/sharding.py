"""Sharding: a keyed Feistel permutation of global row numbers, walked until it falls inside the table.

Row numbers follow (doc_id, checksum of the text, size). The permuted number p gives shard p mod n and slot p div n, so the
counts of any two shards differ by one at most and slots have no gaps, whatever the keys look like.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusframe.llm.common import read, stored

ROUNDS = 8
#: Of a domain of at most n + 2 * sqrt(n) + 1 numbers, so many walks leave the table with a chance below n ** -30.
WALKS = 64


def numbered(df: DataFrame, order: list[str], name: str = "row_no") -> tuple[DataFrame, int]:
    """df with the place of each row (from 0) in the order of these columns, and the number of rows.

    One range exchange; a salt behind the ordering columns lets rows that are equal in all of them spread over tasks. The
    sorted rows are stored, because a second run may draw other range bounds. Only one number per task is looked at again.
    """
    salted = df.withColumn("__salt", F.xxhash64(F.monotonically_increasing_id()))
    tasks = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = salted.repartitionByRange(tasks, *order, "__salt").sortWithinPartitions(*order, "__salt").drop("__salt")
    kept = stored(ranged.withColumn("__at", F.monotonically_increasing_id()))
    task, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = kept.groupBy(task.alias("__task")).agg(F.count("*").alias("__n")).collect()  # a row per task of the exchange
    total, before, rows = 0, {}, {r["__task"]: r["__n"] for r in sizes}
    for t in sorted(rows):
        before[t], total = total, total + rows[t]
    if not before:
        return kept.withColumn(name, F.lit(0).cast("long")).drop("__at"), 0
    starts = df.sparkSession.createDataFrame(sorted(before.items()), "__task long, __before long")
    out = kept.withColumn("__task", task).join(F.broadcast(starts), "__task")
    return out.withColumn(name, F.col("__before") + within).drop("__at", "__task", "__before"), total


def permuted(number: Column, n: int, seed: int) -> Column:
    """A permutation of 0 .. n-1: an alternating Feistel network over Z_a x Z_b with a * b >= n, applied until the result is below n."""
    if n < 2:
        return number
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)

    def once(x: Column) -> Column:
        def turn(s: Column, i: Column) -> Column:
            modulus = F.when(i % 2 == 0, F.lit(a)).otherwise(F.lit(b)).cast("long")
            mixed = F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], i, F.lit(seed).cast("long")), modulus), modulus)
            return F.struct(s["r"].alias("l"), mixed.alias("r"))

        start = F.struct(_div(x, b).alias("l"), F.pmod(x, F.lit(b).cast("long")).alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["l"] * F.lit(b).cast("long") + s["r"])

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), once(number), lambda x, _: F.when(x < F.lit(n), x).otherwise(once(x)))
    return F.when(walked < F.lit(n), walked).otherwise(F.raise_error(F.lit("the permutation did not fall inside the table")).cast("long"))


def _div(x: Column, b: int) -> Column:
    return F.call_function("div", x, F.lit(b).cast("long"))


def sharded(docs: DataFrame, n_shards: int = 40, seed: int = 17) -> DataFrame:
    """docs with shard and slot; counts of the shards are at most one apart.

    Needs doc_id, size and text_crc32 (see measured()); other columns pass through, but for shard and slot, which are
    replaced. Null ids come first. Rows alike in id, checksum and size are interchangeable: which of them gets which slot
    is open, the set of slots is not. An empty table gives no rows.
    """
    placed, n = numbered(docs.drop("shard", "slot"), ["doc_id", "text_crc32", "size"], "__row")
    placed = placed.withColumn("__p", permuted(F.col("__row"), n, seed))
    return placed.withColumns({"shard": F.pmod("__p", F.lit(n_shards).cast("long")).cast("int"), "slot": _div(F.col("__p"), n_shards)}).drop("__p", "__row")


def measured(docs: DataFrame) -> DataFrame:
    """docs with size (UTF-8 bytes of the text plus 16) and text_crc32; a null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"size": F.octet_length(text).cast("long") + 16, "text_crc32": F.crc32(text)})


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``. The text itself stays where it is: only id, size and checksum are exchanged."""
    rows = measured(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return sharded(rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
