"""Row numbers over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def row_numbers(rows: DataFrame, order: str, name: str = "row_no", cells: int = 1024) -> DataFrame:
    """rows with their place (from 0) in the order of a numeric column without repeats: cells between approximate quantiles, so of
    like numbers of rows however the values lie, are counted, then numbered on their own."""
    cuts = rows.agg(F.percentile_approx(order, F.lit([i / cells for i in range(1, cells)]), 10 * cells)).first()[0]
    cuts = F.lit(sorted(set(cuts or [0])))
    steps = F.lit([1 << b for b in reversed(range(cells.bit_length()))])
    # by bisection: how many of the cuts are not above the value
    cell = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= F.size(cuts)) & (F.get(cuts, at + s - 1) <= F.col(order)), at + s).otherwise(at))
    r = rows.withColumn("__c", cell)
    n = r.groupBy("__c").agg(F.count("*").alias("__n"))  # at most as many rows as cells
    before = n.withColumn("__b", F.sum("__n").over(W.orderBy("__c").rowsBetween(W.unboundedPreceding, -1))).select("__c", F.coalesce("__b", F.lit(0)).alias("__b"))
    r = r.join(F.broadcast(before), "__c")
    return r.withColumn(name, F.col("__b") + F.row_number().over(W.partitionBy("__c").orderBy(order)) - 1).drop("__c", "__b")
