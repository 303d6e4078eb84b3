"""The training-data pipeline: five stages over documents, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusframe.llm import decontamination, jaccard_join, mixing, sharding, toxicity
from corpusframe.llm.common import read, stored

#: DuckDB has no SQL for a learned score; the stages are tested against brute force.
ORACLE_SQL = None
#: Of the tokens that reach the mix, the part it takes; a document is used once.
MIX_SHARE, MIX_EPOCHS, SEED, SHARDS = 0.9, 1, 11, 40


#: Columns that stages read; all others ride along under names that no stage uses.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def apart(docs: DataFrame, stage) -> DataFrame:
    """What stage makes of docs, with the columns of docs as they were: those that stages do not read are set aside meanwhile."""
    own = {c: f"__own_{c}" for c in docs.columns if c not in DOCUMENT}
    out = stage(docs.withColumnsRenamed(own))
    return out.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def short_batches(spark: SparkSession) -> None:
    """From here on texts pass through Python in Arrow batches of 4 MB at most (one row at least): a task holds a batch on both sides. The setting
    stays, as a stage's rows are only read when its result is written."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the model is fitted to the labels of these documents."""
    short_batches(spark)
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return apart(docs, lambda d: toxicity.scored(d, model).where("score < 0.5"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    return apart(docs, jaccard_join.one_of_each)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the passages they share with test items, and without those that are mostly such passages."""
    short_batches(spark)

    def cut(d: DataFrame) -> DataFrame:
        out = decontamination.decontaminated(d, read(spark, sf_dir, "benchmark"))
        return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(d.schema["n_chars"].dataType), F.col("n_chars"))) if "n_chars" in d.columns else out

    return apart(docs, cut)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen so that domains, languages and sources come near their target weights."""
    return apart(docs, lambda d: mixing.mixed(d, None, mixing.WEIGHTS, MIX_EPOCHS, SEED, share=MIX_SHARE))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with size, checksum, law, shard and slot; columns of their own by these names come out as own_<name>."""
    docs = docs.withColumnsRenamed({c: f"own_{c}" for c in ("size", "text_crc32", "law", "shard", "slot")})
    return sharding.sharded(sharding.measured(docs), SHARDS).withColumn("law", F.lit("rows"))


STAGES = [
    ("toxicity", without_toxic),
    ("near copies", without_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
