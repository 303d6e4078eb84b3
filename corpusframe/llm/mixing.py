"""Mixing sources to target weights: a token budget is dealt down a tree of domains, languages and sources.

At every node the budget goes to the children by weight; what a child cannot use (its tokens times the epochs allowed) goes
to its siblings, and only what all of them together cannot use goes back up. Each leaf takes whole epochs and then a prefix,
in tokens, of the next epoch's seeded order, to the nearest document.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusframe.llm.common import read, stored

LEVELS = ("domain", "lang", "source")
#: Leaves whose totals may come to the driver.
MAX_LEAVES = 100_000
#: Documents of a leaf that share one cell of the seeded order, about.
CELL_ROWS = 512


def shares(budget: float, weights: Mapping[str, float], capacity: Mapping[str, float]) -> dict[str, float]:
    """Budget of each sibling: by weight, none above its capacity, what is left over dealt again by weight among those with room."""
    out, open_, left = dict.fromkeys(capacity, 0.0), {k for k in capacity if capacity[k] > 0 and weights.get(k, 1.0) > 0}, float(budget)
    while open_ and left > 1e-9:
        total = sum(weights.get(k, 1.0) for k in sorted(open_))
        full = {k for k in open_ if out[k] + left * weights.get(k, 1.0) / total >= capacity[k]}
        if not full:
            for k in sorted(open_):
                out[k] += left * weights.get(k, 1.0) / total
            return out
        for k in sorted(full):
            left -= capacity[k] - out[k]
            out[k] = float(capacity[k])
        open_ -= full
    return out


def budgets(leaves: Mapping[tuple[str, ...], int], budget: float, weights: tuple[Mapping[str, float], ...], max_epochs: float) -> dict[tuple[str, ...], int]:
    """Whole tokens for each leaf, top down; the capacity of a node is that of its leaves."""
    out: dict[tuple[str, ...], int] = {}

    def deal(prefix: tuple[str, ...], own: dict[tuple[str, ...], int], amount: float) -> None:
        depth = len(prefix)
        if depth == len(weights):
            out[prefix] = int(math.floor(amount + 1e-6))
            return
        children: dict[str, dict] = {}
        for leaf, tokens in own.items():
            children.setdefault(leaf[depth], {})[leaf] = tokens
        given = shares(amount, weights[depth], {k: sum(v.values()) * max_epochs for k, v in children.items()})
        for k in sorted(children):
            deal((*prefix, k), children[k], given[k])

    deal((), dict(leaves), min(budget, sum(leaves.values()) * max_epochs))
    return out


def tokens_of(text: str = "text") -> Column:
    """Words between white space."""
    bare = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def domain_of(source: str = "source") -> Column:
    """Four domains by the number in the source's name; names without one are of domain d0."""
    return F.concat(F.lit("d"), F.coalesce(F.regexp_extract(F.col(source), r"(\d+)$", 1).try_cast("long"), F.lit(0)) % 4)


def mixed(docs: DataFrame, budget: int | None, weights: tuple[Mapping[str, float], ...], max_epochs: int, seed: int, share: float = 1.0, domain: Column | None = None) -> DataFrame:
    """Rows of docs, once for each epoch that takes them, with epoch (from 0) and tokens.

    budget is in tokens; None is the given share of all tokens. Names that a level's weights lack weigh 1; a weight of 0
    shuts a branch out. Null names are the empty text. The last epoch of a leaf ends between two groups of alike rows (same id
    and text), where its tokens come nearest to the budget, the earlier place at equal distance; so a leaf misses its budget
    by half of one group at most, and what some leaves lack others have. Texts of no tokens come along with every full epoch.
    Columns tokens and epoch are replaced; an empty table gives no rows. Rows are picked where they are read, by comparing
    their place in the seeded order with their leaf's last place; only a leaf's totals and the cell in which its prefix
    ends are looked at more closely, so a leaf of any size is spread over tasks.
    """
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    leaf = F.struct(name(domain_of() if domain is None else domain).alias("domain"), name(F.col("lang")).alias("lang"), name(F.col("source")).alias("source"))
    rows = docs.drop("tokens", "epoch").withColumns({"tokens": tokens_of(), "__leaf": leaf, "__key": F.xxhash64("doc_id", "text")})
    light = stored(rows.select("__leaf", "__key", "tokens"))
    totals = light.groupBy("__leaf").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).limit(MAX_LEAVES + 1).collect()
    if len(totals) > MAX_LEAVES:
        raise ValueError(f"the tree has more than {MAX_LEAVES} leaves")
    have = {tuple(r["__leaf"]): r["tokens"] for r in totals}
    total = sum(have.values())
    given = budgets(have, total * share if budget is None else budget, weights, max_epochs)
    plan = []
    for r in totals:
        key = tuple(r["__leaf"])
        full = min(max_epochs, given[key] // have[key]) if have[key] else 0
        bits = min(30, max(0, math.ceil(math.log2(max(1, r["n"] / CELL_ROWS)))))
        plan.append((*key, int(full), int(given[key] - full * have[key]), bits))
    spark = docs.sparkSession
    plan = F.broadcast(spark.createDataFrame(plan, "domain string, lang string, source string, full int, rest long, bits int").select(F.struct("domain", "lang", "source").alias("__leaf"), "full", "rest", "bits"))

    place = F.xxhash64(F.lit(seed).cast("long"), F.col("full"), F.col("__key"))
    # cells are the leading bits of the place, in signed order
    cell = F.when(F.col("bits") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftright(place, 64 - bits)"))
    placed = light.join(plan, "__leaf").where("rest > 0").withColumn("place", place).withColumn("cell", cell)
    cells = placed.groupBy("__leaf", "cell").agg(F.sum("tokens").alias("t"), F.first("rest").alias("rest"))
    running = cells.withColumn("before", F.sum("t").over(W.partitionBy("__leaf").orderBy("cell")) - F.col("t"))
    last = stored(running.where("before <= rest and before + t > rest").select("__leaf", "cell", "before", "rest"))
    inside = placed.join(F.broadcast(last.select("__leaf", "cell", "before")), ["__leaf", "cell"]).groupBy("__leaf", "cell", "place", "before", "rest").agg(F.sum("tokens").alias("t"))
    upto = F.col("before") + F.sum("t").over(W.partitionBy("__leaf", "cell").orderBy("place"))
    inside = inside.withColumn("upto", upto).where("upto <= rest or upto - rest < rest - (upto - t)").groupBy("__leaf").agg(F.max("place").alias("end"))
    bound = last.join(inside, "__leaf", "left").select("__leaf", F.col("cell").alias("last_cell"), "end")
    chosen = rows.join(plan, "__leaf").join(F.broadcast(bound), "__leaf", "left").withColumn("place", place).withColumn("cell", cell)
    more = (F.col("rest") > 0) & ((F.col("cell") < F.col("last_cell")) | (F.col("cell") == F.col("last_cell")) & (F.col("place") <= F.col("end")))
    copies = F.col("full") + F.coalesce(more, F.lit(False)).cast("int")
    columns = [c for c in docs.columns if c not in ("tokens", "epoch")]
    return chosen.withColumn("__copies", copies).where("__copies > 0").select(*columns, "tokens", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)).alias("epoch"))


#: Production weights of the three levels; names not given weigh 1.
WEIGHTS = ({"d0": 0.4, "d1": 0.3, "d2": 0.2, "d3": 0.1}, {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}, {})


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget of six tenths of all tokens, four epochs at most."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixed(docs, None, WEIGHTS, max_epochs=4, seed=11, share=0.6).select("doc_id", domain_of().alias("domain"), "lang", "source", "tokens", "epoch")
