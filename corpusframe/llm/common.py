"""What the operators of this subpackage share: table reading, stored intermediates and connected components."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_FOLDER: list[str] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; where it is unset, as in tests, a temporary one, but not on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if not _OWN_FOLDER:
        _OWN_FOLDER.append(tempfile.mkdtemp(prefix="corpusframe-"))
    return _OWN_FOLDER[0]


def stored(df: DataFrame) -> DataFrame:
    """Write df once as a table in the shared folder and read it back: lineage ends here, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_bytes(spark: SparkSession, most: int) -> Iterator[None]:
    """Arrow batches of at most so many bytes for what runs meanwhile: texts and sets are long rows, and tasks hold a batch on both sides."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(most, int(before.rstrip("bB")))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shipped(spark: SparkSession, what: Any) -> Broadcast:
    """A broadcast that opened() reads on executors without a copy of this package: classes travel with their objects, as functions do."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(what))


def opened(sent: Broadcast) -> Any:
    return pickle.loads(sent.value)


def id_hash(column: str = "doc_id") -> Column:
    """CRC-32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def ascii_lower(text: Column) -> Column:
    """Lower-case so that every ASCII word comes out as if only A-Z were lowered.

    U+212A is the one letter whose lower form is a lone ASCII letter; it is replaced by another non-ASCII letter first,
    so word bounds stay and no ASCII word arises that was not there.
    """
    return F.lower(F.replace(text, F.lit("K"), F.lit("ĸ")))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges(a long, b long): node, component (its smallest node).

    In every round each node hooks on to its smallest neighbour, hooks are followed by pointer jumping, and the edges are
    drawn anew between what they lead to; loops and repeats drop out, so the graph shrinks round by round. Every step is a
    stored table; no node's neighbours are ever gathered, a hub only meets map-side minima.
    """
    left = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    labels = stored(left.select(F.col("a").alias("node")).union(left.select("b")).distinct().withColumn("label", F.col("node")))
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        both = left.union(left.select("b", "a"))
        hooks = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")))
        while True:  # hooks point to smaller nodes, so paths end; each jump halves them
            next_ = hooks.select(F.col("a").alias("to"), F.col("to").alias("far"))
            jumped = stored(hooks.join(next_, "to", "left").select("a", F.coalesce("far", "to").alias("to"), (F.col("far") < F.col("to")).alias("moved")))
            hooks = jumped.select("a", "to")
            if jumped.where("moved").isEmpty():
                break
        far = hooks.select(F.col("a").alias("label"), F.col("to").alias("far"))
        labels = stored(labels.join(far, "label", "left").select("node", F.coalesce("far", "label").alias("label")))
        ends = left.join(hooks.withColumnRenamed("to", "x"), "a").select("x", "b").join(hooks.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        left = stored(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    else:
        raise RuntimeError("components did not settle")
    return labels.select("node", F.col("label").alias("component"))
