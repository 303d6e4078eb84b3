"""Typed tables of conversations, turns, block events, uploads and the trash (S10), and counts of what passes a point of a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Columns of each table.
TABLES = {
    "conversations": "conv_id string, client string, role string, title string, created timestamp, updated timestamp",
    "turns": "turn_id bigint, conv_id string, question string, answer string, sources array<string>, refused boolean, from_cache boolean, citation_ok boolean, figures_ok boolean, seconds double, detail string, at timestamp",
    "block_events": "groups array<string>, origin string, role string, at timestamp",
    "uploads": "id bigint, name string, stored_name string, hash string, size bigint, contributor string, status string, reason string, created timestamp, changed timestamp",
    "trash": "id bigint, path string, original_path string, hash string, removed timestamp",
}


def typed(rows: DataFrame, name: str) -> DataFrame:
    """Rows as the named table has them: its columns in order and cast (NULL where a value cannot be), those not given NULL, others left out."""
    have = {c.lower() for c in rows.columns}
    want = StructType.fromDDL(TABLES[name])
    cast = lambda f: F.col(f.name).try_cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)
    return rows.select(*[cast(f).alias(f.name) for f in want])


def append(rows: DataFrame, name: str, path: str) -> None:
    """Add rows to the named table at a path."""
    typed(rows, name).write.mode("append").parquet(path)


def load(spark, name: str, path: str) -> DataFrame:
    """The named table at a path, by its own columns and not by those that a file happens to have."""
    return spark.read.schema(TABLES[name]).parquet(path)


def observed(rows: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """rows, and a mark that holds the named aggregates (and n, the rows) once an action has run; no pass of its own."""
    mark = Observation(name)
    return rows.observe(mark, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in counts.items()]), mark
