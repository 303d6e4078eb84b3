"""Evaluation of ranked lists, splits, gates and answers (E1-E12, E15), caches (K1-K6) and nearest-neighbour classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusframe.operators.retrieval import nearest_vectors


def document_ranking(run: DataFrame, name: str = "name") -> DataFrame:
    """Chunk list -> names, trimmed and not empty, each at its first place, gaps closed."""
    first = run.withColumn(name, F.trim(name)).where(F.col(name) != "").groupBy("query_id", name).agg(F.min("rank").alias("r"))
    return first.select("query_id", name, F.row_number().over(W.partitionBy("query_id").orderBy("r", name)).alias("rank"))


def relevance_ranks(runs: DataFrame) -> DataFrame:
    """query_id, names (ranked), expected -> ranks of hits: case-blind substrings, each key and each name once, keys tried in order."""

    def step(acc: Column, x: Column) -> Column:
        key = F.filter(acc["left"], lambda k: F.contains(F.lower(x["name"]), F.lower(k)))
        place = F.array_position(acc["left"], key[0]).cast("int")
        rest = F.concat(F.slice(acc["left"], 1, F.greatest(place - 1, F.lit(0))), F.slice(acc["left"], place + 1, F.size(acc["left"])))
        return F.when(F.size(key) > 0, F.struct(rest.alias("left"), F.array_append(acc["ranks"], x["rank"]).alias("ranks"))).otherwise(acc)

    ranked = F.transform("names", lambda n, i: F.struct(n.alias("name"), (i + 1).alias("rank")))
    start = F.struct(F.col("expected").alias("left"), F.array().cast("array<int>").alias("ranks"))
    return runs.withColumn("ranks", F.aggregate(ranked, start, step, lambda s: s["ranks"]))


def rank_metrics(judged: DataFrame, ks=(1, 3, 5, 10), k: int = 10) -> DataFrame:
    """judged(query_id, ranks, n_relevant) -> rr, hit_k, recall, precision, ap, ndcg at k."""
    within = F.filter("ranks", lambda r: r <= k)
    n = F.greatest(F.col("n_relevant"), F.lit(1))
    rr = F.coalesce(1.0 / F.array_min(within), F.lit(0.0))
    ap = F.aggregate(F.transform(F.array_sort(within), lambda r, i: (i + 1) / r), F.lit(0.0), lambda s, x: s + x) / F.least(n, F.lit(k))
    gain = lambda a: F.aggregate(a, F.lit(0.0), lambda s, r: s + F.ln(F.lit(2.0)) / F.ln(r + 1.0))
    ideal = gain(F.sequence(F.lit(1), F.least(n, F.lit(k)).cast("int")))
    hits = {f"hit_{j}": F.coalesce(F.array_min("ranks") <= j, F.lit(False)).cast("int") for j in ks}
    return judged.withColumns({"rr": F.round(rr, 9), **hits, "recall": F.size(within) / n, "precision": F.size(within) / k, "ap": F.round(ap, 9), "ndcg": F.round(gain(within) / ideal, 9)})


def summary(metrics: DataFrame, group: str = "grp") -> DataFrame:
    """E5: one pass for groups and the total (group NULL): questions, MRR, Hit@k, MAP, nDCG, mean rank of hits, misses."""
    rows = metrics.withColumn(group, F.when(F.coalesce(group, F.lit("")) == "", "other").otherwise(F.col(group))).withColumn("first", F.array_min("ranks"))
    out = rows.groupingSets([[group], []], group).agg(
        F.count("*").alias("questions"), F.round(F.avg("rr"), 6).alias("mrr"), *[F.round(F.avg(f"hit_{j}"), 6).alias(f"hit_{j}") for j in (1, 3, 5, 10)],
        F.round(F.avg("ap"), 6).alias("map"), F.round(F.avg("ndcg"), 6).alias("ndcg"), F.round(F.avg("first"), 6).alias("mean_rank"), F.count_if(F.col("first").isNull()).alias("misses"),
    )
    return out


def rank_distribution(judged: DataFrame) -> DataFrame:
    """Bucket 1..10, >10, miss with counts; all buckets are there."""
    first = F.array_min("ranks")
    bucket = F.when(first.isNull(), "miss").when(first > 10, ">10").otherwise(first.cast("string"))
    n = judged.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    names = [*map(str, range(1, 11)), ">10", "miss"]
    every = judged.sparkSession.createDataFrame([(x,) for x in names], "bucket string")
    return every.join(n, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def stratified_split(rows: DataFrame, group: str, key: str, part: float = 0.4, seed: str = "split") -> DataFrame:
    """Split test for floor(n * part + 0.5) of each group, between 1 and n - 1 (none of a group of one), by a seeded hash; kept where set already."""
    w = W.partitionBy(group)
    n = F.count("*").over(w)
    target = F.when(n < 2, 0).otherwise(F.least(F.greatest(F.floor(n * part + 0.5), F.lit(1)), n - 1))
    order = F.sha2(F.concat_ws("|", F.lit(seed), F.col(group).cast("string"), F.col(key).cast("string")), 256)
    given = F.count_if(F.col("split") == "test").over(w)
    place = F.row_number().over(W.partitionBy(group, F.col("split").isNull()).orderBy("__o", key))
    out = rows.withColumns({"__o": order, "__t": target, "__g": given}).withColumn("__p", place)
    return out.withColumn("split", F.coalesce("split", F.when(F.col("__p") <= F.col("__t") - F.col("__g"), "test").otherwise("dev"))).drop("__o", "__t", "__g", "__p")


def gate_sweep(scored: DataFrame, coverages=(0.04, 0.08, 0.12, 0.16, 0.20), distances=(0.8, 0.9, 1.0, 1.1, 1.2, 1.3)) -> DataFrame:
    """scored(off_topic, coverage, dist) against a grid of thresholds: caught, total, wrongly refused."""
    spark = scored.sparkSession
    grid = spark.createDataFrame([(c, d) for c in coverages for d in distances], "least double, most double")
    refused = (F.col("coverage") < F.col("least")) | (F.col("dist") > F.col("most"))
    out = scored.join(F.broadcast(grid)).groupBy("least", "most")  # a grid of parameters, not of rows
    return out.agg(F.count_if(refused & F.col("off_topic")).alias("caught"), F.count_if("off_topic").alias("total"), F.count_if(refused & ~F.col("off_topic")).alias("wrong"))


def check_answers(answers: DataFrame) -> DataFrame:
    """answers(answer, evidence ARRAY, names ARRAY) -> bad_citations, loose_numbers: citations [n] outside the evidence, and
    numbers (canonical, without 0-10 and single digits) that no evidence text or file name has."""
    cited = F.transform(F.regexp_extract_all("answer", F.lit(r"\[(\d{1,3})\]"), F.lit(1)), lambda x: x.cast("int"))
    bad = F.array_distinct(F.filter(cited, lambda n: (n < 1) | (n > F.size("evidence"))))
    canon = lambda t: F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(r"\d+(?:[.,]\d+)*"), F.lit(0)), lambda x: F.when(x.rlike(r"^[\d.]*\d,\d{1,2}$"), F.replace(x, F.lit("."), F.lit(""))).otherwise(F.translate(x, ".,", ""))))
    own = F.filter(canon(F.regexp_replace("answer", r"\[\d{1,3}\]", " ")), lambda x: (F.char_length(x) > 1) & (x != "10"))
    there = canon(F.concat_ws(" ", "evidence", "names"))
    return answers.withColumns({"bad_citations": bad, "loose_numbers": F.array_except(own, there)})


def dot(a, b) -> Column:
    """Products of doubles, summed in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def unit(v) -> Column:
    """A vector over its length (zero vectors stay)."""
    c = F.col(v) if isinstance(v, str) else v
    length = F.sqrt(dot(c, c))
    return F.transform(c, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(x.cast("double")))


def nearest(x: DataFrame, train: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, rank, sim, label of the k nearest other rows of train by cosine, ties to the smaller key. The rows asked for go in bounded
    blocks to where the training rows are."""
    queries = x.select(F.col(key).alias("query_id"), vector)
    near = nearest_vectors(queries, train.withColumnRenamed(key, "__k"), k, "__k", vector, cosine=True)
    near = near.select(F.col("query_id").alias(key), "__k", F.round("value", 9).alias("sim"))
    near = near.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("sim"), "__k"))).where(F.col("rank") <= k)
    return near.join(train.select(F.col(key).alias("__k"), F.col(label).alias("label")), "__k").select(key, "label", "sim", "rank")


def knn_vote(neighbours: DataFrame, key: str = "vec_id") -> DataFrame:
    """Predicted label (largest sum of similarities, clipped at 0; ties to the smaller label) and its share."""
    votes = neighbours.groupBy(key, "label").agg(F.sum(F.greatest("sim", F.lit(0.0))).alias("w"))
    best = votes.groupBy(key).agg(F.max_by(F.struct("label", "w"), F.struct(F.round("w", 6), -F.col("label"))).alias("b"), F.sum("w").alias("total"))
    return best.select(key, F.col("b.label").alias("predicted"), F.round(F.coalesce(F.try_divide("b.w", "total"), F.lit(0.0)), 6).alias("confidence"))


def class_scores(pairs: DataFrame, true: str = "label", said: str = "predicted") -> DataFrame:
    """Per class that is present: support, precision, recall, F1 (0 where a denominator is 0)."""
    n = pairs.groupBy(true, said).agg(F.count("*").alias("n"))
    t = n.groupBy(F.col(true).alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(true) == F.col(said), F.col("n")).otherwise(0)).alias("hit"))
    p = n.groupBy(F.col(said).alias("class")).agg(F.sum("n").alias("said"))
    both = t.join(p, "class", "left").withColumn("said", F.coalesce("said", F.lit(0)))
    precision, recall = F.coalesce(F.try_divide("hit", "said"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    return both.select("class", "support", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)), 6).alias("f1"))


def choose_k(rows: DataFrame, grid=(3, 5, 7, 9, 11, 15), key: str = "vec_id") -> DataFrame:
    """Leave-one-out macro-F1 of each k, chosen: the highest, of equals the largest k. One ranked self-join serves the grid."""
    ranked = nearest(rows, rows, max(grid), key).withColumnRenamed("label", "near")
    each = ranked.select(key, "rank", "near", "sim", F.explode(F.lit(list(grid))).alias("k")).where("rank <= k")
    votes = each.groupBy("k", key, "near").agg(F.sum(F.greatest("sim", F.lit(0.0))).alias("w"))
    best = votes.groupBy("k", key).agg(F.max_by("near", F.struct(F.round("w", 6), -F.col("near"))).alias("predicted"))
    n = best.join(rows.select(key, "label"), key).groupBy("k", "label", "predicted").agg(F.count("*").alias("n"))
    t = n.groupBy("k", F.col("label").alias("c")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    p = n.groupBy("k", F.col("predicted").alias("c")).agg(F.sum("n").alias("said"))
    f1 = t.join(p, ["k", "c"], "left").select("k", F.coalesce(F.try_divide(2 * F.col("hit"), F.col("support") + F.coalesce("said", F.lit(0))), F.lit(0.0)).alias("f1"))
    out = f1.groupBy("k").agg(F.round(F.avg("f1"), 6).alias("macro_f1"))
    return out.withColumn("chosen", F.row_number().over(W.orderBy(F.desc("macro_f1"), F.desc("k"))) == 1)


def cache_lookup(queries: DataFrame, cache: DataFrame, days: int = 30, hit: float = 0.96, candidate: float = 0.88) -> DataFrame:
    """K1: queries(query_id, vector, model, fingerprint, at), cache(entry, vector, model, fingerprint, created): the best cosine among
    entries of the same model and fingerprint that are not too old, the first entry among equals; tier hit, candidate or miss."""
    c = cache.select("entry", unit("vector").alias("__v"), "model", "fingerprint", "created")
    fresh = (F.col("created") <= F.col("at")) & (F.col("created") >= F.col("at") - F.expr(f"INTERVAL {days} DAYS"))
    pairs = queries.withColumn("__u", unit("vector")).join(c, ["model", "fingerprint"]).where(fresh).select("query_id", "entry", F.round(dot("__u", "__v"), 6).alias("sim"))
    best = pairs.groupBy("query_id").agg(F.max_by(F.struct("entry", "sim"), F.struct("sim", -F.col("entry"))).alias("b"))
    out = queries.select("query_id").join(best, "query_id", "left")
    tier = F.when(F.col("b.sim") >= hit, "hit").when(F.col("b.sim") >= candidate, "candidate").otherwise("miss")
    return out.select("query_id", F.col("b.entry").alias("entry"), F.col("b.sim").alias("sim"), tier.alias("tier"))


def lru_trim(cache: DataFrame, now: Column, days: int = 30, keep: int = 300) -> DataFrame:
    """K3: entries not older than so many days, of those the most recently used."""
    live = cache.where(F.col("created") >= now - F.expr(f"INTERVAL {days} DAYS"))
    return live.orderBy(F.desc("last_used"), "entry").limit(keep)
