"""More of evaluation, caches and classes: confidence intervals, sweeps, registers, question checks."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusframe.functions import text as T


def _drawn_in_cells(counts: list[int], draws: int, seed: int):
    """Arrow batches (cell, v) sorted by cell -> cell, b, n, total: how many rows each resample draws from a cell, and their sum.

    A resample's n draws are dealt over the cells as a multinomial draw would: by halves, down a tree over the cells, each node by
    a binomial draw seeded with its bounds. So a task that holds one cell comes to the same numbers as all others, from the
    cells' sizes alone.
    """
    upto = np.concatenate([[0], np.cumsum(counts)])

    def share(cell: int) -> np.ndarray:
        low, high, k = 0, len(counts), np.full(draws, upto[-1])
        while high - low > 1:
            middle = (low + high) // 2
            left = np.random.default_rng([seed, low, high]).binomial(k, (upto[middle] - upto[low]) / max(upto[high] - upto[low], 1))
            low, high, k = (low, middle, left) if cell < middle else (middle, high, k - left)
        return k

    def told(cell: int, values: np.ndarray) -> pa.RecordBatch:
        k, rng = share(cell), np.random.default_rng([seed, cell, cell, 1])
        totals = [float(values[rng.integers(0, len(values), int(m))].sum()) for m in k]
        return pa.RecordBatch.from_arrays([pa.array(np.full(draws, cell), pa.int32()), pa.array(np.arange(draws), pa.int32()), pa.array(k.astype(np.int64)), pa.array(totals)], ["cell", "b", "n", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            cells, values = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j in itertools.pairwise(np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1], [True]])) if len(cells) else []):
                if cells[i] != at and held:
                    yield told(at, np.concatenate(held))
                    held = []
                at = int(cells[i])
                held.append(values[i:j])
        if held:
            yield told(at, np.concatenate(held))

    return run


def resamples(values: DataFrame, value: str, key: str, draws: int = 2000, seed: int = 7, cell_rows: int = 50_000) -> DataFrame:
    """B, n, total of so many resamples: each draws as many rows as there are (values that are not null), with replacement. Rows are cut
    into cells of bounded size by a hash of their key; a cell's number of draws in each resample is dealt to it beforehand, so no row
    is looked up across cells and the sizes add up to n exactly. Repeated keys and equal values are rows of their own."""
    rows = values.where(F.col(value).isNotNull()).select(F.col(key).alias("key"), F.col(value).cast("double").alias("v"))
    cells = max(1, -(-rows.count() // cell_rows))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(cells)).cast("int"))
    found = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a number for every cell_rows rows
    counts = [found.get(c, 0) for c in range(cells)]
    tasks = min(cells, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = rows.repartition(tasks, "cell").sortWithinPartitions("cell", F.xxhash64("key"), "v").select("cell", "v")
    drawn = parts.mapInArrow(_drawn_in_cells(counts, draws, seed), "cell int, b int, n long, total double")
    return drawn.groupBy("b").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def bootstrap_interval(values: DataFrame, value: str, key: str, draws: int = 2000, seed: int = 7, level: float = 0.95) -> DataFrame:
    """N, mean, low, high of a mean: percentiles by place of the means of resamples(). One row is its own interval; no rows give NULLs."""
    means = resamples(values, value, key, draws, seed).agg(F.array_sort(F.collect_list(F.col("total") / F.col("n"))).alias("m"))  # as many as draws
    edge = (1 - level) / 2
    at = lambda k: F.get("m", F.lit(min(draws - 1, int(k * draws))))
    base = values.agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    pick = lambda k, name: F.when(F.col("n") == 1, F.col("mean")).when(F.col("n") > 1, at(k)).alias(name)
    return base.crossJoin(means).select("n", "mean", pick(edge, "low"), pick(1 - edge, "high"))


def answer_quality(runs: DataFrame, group: str = "grp") -> DataFrame:
    """Per group: answers, right sources, refusals, valid citations, grounded figures, mean seconds, five wrongly refused questions."""
    asked = runs.where(F.col("refused") & ~F.col("expect_refusal")).select(group, "question").distinct()
    five = asked.withColumn("__r", F.row_number().over(W.partitionBy(group).orderBy("question"))).where("__r <= 5")
    wrong = five.groupBy(group).agg(F.array_sort(F.collect_list("question")).alias("wrongly_refused"))
    totals = runs.groupBy(group).agg(F.count("*").alias("answers"), F.count_if("right_source").alias("right"), F.count_if("refused").alias("refused"), F.count_if("citation_ok").alias("cited"), F.count_if("figures_ok").alias("grounded"), F.round(F.avg("seconds"), 3).alias("seconds"))
    return totals.join(wrong, totals[group].eqNullSafe(wrong[group]), "left").drop(wrong[group]).withColumn("wrongly_refused", F.coalesce("wrongly_refused", F.array().cast("array<string>")))


def window_coverage(judged: DataFrame, window: int = 4) -> DataFrame:
    """One row: questions, those with a hit within the prompt's window, misses."""
    first = F.array_min("ranks")
    return judged.agg(F.count("*").alias("questions"), F.count_if(F.coalesce(first <= window, F.lit(False))).alias("covered"), F.count_if(first.isNull()).alias("missed"))


def worst_queries(judged: DataFrame, n: int = 8) -> DataFrame:
    """The questions whose first hit is lowest, misses lowest of all."""
    return judged.withColumn("first", F.array_min("ranks")).orderBy(F.desc_nulls_first("first"), "query_id").limit(n).select("query_id", "first")


def judged_set(questions: DataFrame, runs: DataFrame) -> DataFrame:
    """Labelled questions with their run; infrastructure failures go, questions that read but found nothing count as misses."""
    j = questions.where("size(expected) > 0").join(runs, "query_id", "left")
    return j.where("coalesce(failure, '') <> 'infrastructure'").select("query_id", "expected", F.coalesce("names", F.array().cast("array<string>")).alias("names"))


def question_subset(questions: DataFrame, n: int, seed: str = "sample", split: str | None = None) -> DataFrame:
    """A seeded sample of n questions, of a split if one is named; unassigned questions are then an error."""
    if split is not None:
        if not questions.where("split is null").isEmpty():
            raise ValueError("questions without a split")
        questions = questions.where(F.col("split") == split)
    return questions.orderBy(F.sha2(F.concat_ws("|", F.lit(seed), F.col("query_id").cast("string")), 256), "query_id").limit(n)


def question_defects(rows: DataFrame, runs: DataFrame | None = None, most_run: int = 6) -> DataFrame:
    """rows(query_id, question, asks_number) with defects: no question mark, fewer than 6 or more than 45 words, a dangling reference, a missing
    or forbidden number, a verbatim run (runs: query_id, longest) above the limit."""
    n = F.size(T.raw_tokens("question"))
    dangling = F.lower("question").rlike(r"(văn bản này|đoạn trên|tài liệu trên|the above|this passage)")
    number = F.col("question").rlike(r"\d")
    j = rows.withColumn("longest", F.lit(0)) if runs is None else rows.join(runs, "query_id", "left").fillna({"longest": 0})
    tests = [("no_question_mark", ~F.col("question").rlike(r"\?\s*$")), ("too_short", n < 6), ("too_long", n > 45), ("dangling", dangling), ("no_number", F.col("asks_number") & ~number), ("number", ~F.col("asks_number") & number), ("verbatim", F.col("longest") > most_run)]
    return j.withColumn("defects", F.array_compact(F.array(*[F.when(t, name) for name, t in tests])))


def question_plan(questions: DataFrame, passages: DataFrame, seed: str = "plan") -> DataFrame:
    """Each question of a file gets a passage of it that no other question has: the k-th question the k-th passage in a seeded order; NULL when they run out."""
    order = lambda *c: F.sha2(F.concat_ws("|", F.lit(seed), *[F.col(x).cast("string") for x in c]), 256)
    q = questions.withColumn("k", F.row_number().over(W.partitionBy("source").orderBy("query_id")))
    p = passages.withColumn("k", F.row_number().over(W.partitionBy("source").orderBy(order("source", "passage_id"), "passage_id")))
    return q.join(p, ["source", "k"], "left").select("query_id", "source", "passage_id")


def trimmed_answer(answer: str, least: float = 0.3) -> Column:
    """A cut answer up to its last whole sentence or line, less hanging headings; the whole if under three tenths were left; bold marks closed."""
    t = F.coalesce(F.col(answer), F.lit(""))
    cut = F.regexp_extract(t, r"(?s)^(.*[.!?…:;\n])", 1)
    lines = F.split(F.rtrim(cut), "\n")
    kept = F.aggregate(F.reverse(lines), F.array().cast("array<string>"), lambda acc, x: F.when((F.size(acc) == 0) & (F.trim(x).rlike(r"^(#+ .*|\*\*[^*]*\*\*:?|.*:)?$")), acc).otherwise(F.array_append(acc, x)))
    out = F.array_join(F.reverse(kept), "\n")
    out = F.when(F.char_length(out) < least * F.char_length(t), t).otherwise(out)
    marks = (F.char_length(out) - F.char_length(F.replace(out, F.lit("**"), F.lit("")))) / 2
    return F.when(marks % 2 == 1, F.concat(out, F.lit("**"))).otherwise(out)


def regenerate(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new(query_id, text, defects): a question is redone if it has defects or repeats an earlier text; the new one stays if it has no more
    defects than the old, or if that was a repeat."""
    o = old.withColumn("again", F.row_number().over(W.partitionBy(F.lower(F.trim("text"))).orderBy("query_id")) > 1)
    j = o.join(new.select("query_id", F.col("text").alias("nt"), F.col("defects").alias("nd")), "query_id", "left")
    take = (F.col("again") | (F.size("defects") > 0)) & F.col("nt").isNotNull() & (F.col("again") | (F.size("nd") <= F.size("defects")))
    return j.select("query_id", F.when(take, F.col("nt")).otherwise(F.col("text")).alias("text"), F.coalesce(take, F.lit(False)).alias("replaced"))


def same_evidence(a: str, b: str) -> Column:
    """K2: equal sorted lists, and not empty."""
    return (F.size(a) > 0) & (F.array_sort(F.col(a)) == F.array_sort(F.col(b)))


def hit_statistics(hits: DataFrame, cache: DataFrame) -> DataFrame:
    """K4: cache entries with the number of hits on the first entry of each question, and when it was last used."""
    first = cache.groupBy("question").agg(F.min("entry").alias("entry"))
    h = hits.join(first, "question").groupBy("entry").agg(F.count("*").alias("n"), F.max("at").alias("last"))
    return cache.join(h, "entry", "left").select("entry", (F.col("uses") + F.coalesce("n", F.lit(0))).alias("uses"), F.coalesce("last", "last_used").alias("last_used"))


def purge(cache: DataFrame, fingerprint: str, now: Column, days: int) -> DataFrame:
    """K5: entries of this fingerprint that are young enough."""
    return cache.where((F.col("fingerprint") == fingerprint) & (F.col("created") >= now - F.expr(f"INTERVAL {days} DAYS")))


def cacheable(history: str, scope: str, as_of: str, question: str) -> Column:
    """K6: no history, scope, past day or address in the question."""
    return (F.coalesce(F.size(history), F.lit(0)) < 1) & F.col(scope).isNull() & F.col(as_of).isNull() & T.first_url(question).isNull()


def accuracy_by(pairs: DataFrame, by: str, true: str = "label", said: str = "predicted") -> DataFrame:
    """I4."""
    return pairs.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg((F.col(true) == F.col(said)).cast("int")), 6).alias("accuracy"))


def threshold_sweep(pairs: DataFrame, labels: list, thresholds: list[float], true: str = "label", said: str = "predicted") -> DataFrame:
    """Per threshold and label: caught, total, wrongly caught. The grid is of parameters."""
    grid = pairs.sparkSession.createDataFrame([(t, x) for t in thresholds for x in labels], "threshold double, target int")
    j = pairs.join(F.broadcast(grid))
    acts = (F.col(said) == F.col("target")) & (F.col("confidence") >= F.col("threshold"))
    return j.groupBy("threshold", "target").agg(F.count_if(acts & (F.col(true) == F.col("target"))).alias("caught"), F.count_if(F.col(true) == F.col("target")).alias("total"), F.count_if(acts & (F.col(true) != F.col("target"))).alias("wrong"))


def action(said: str, confidence: str, least: dict[str, float], history: str, scope: str, text: str, greetings: list[str]) -> Column:
    """The label to act on, or NULL: allowed, sure enough, without history or scope; a greeting has six words at most and a greeting word."""
    table = F.create_map(*[x for k, v in least.items() for x in (F.lit(k), F.lit(v))])
    words = T.raw_tokens(text)
    greet = (F.size(words) <= 6) & F.arrays_overlap(words, F.lit(greetings))
    ok = F.coalesce(F.col(confidence) >= F.try_element_at(table, F.col(said)), F.lit(False)) & F.col(history).isNull() & F.col(scope).isNull()
    return F.when(ok & ((F.col(said) != "greeting") | greet), F.col(said))


def labelled_union(parts: list[DataFrame], declared: list[str]) -> DataFrame:
    """Examples of several origins as one table; a label that is not declared is an error."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    odd = out.where(~F.col("label").isin(declared)).select("label").distinct().limit(5).collect()
    if odd:
        raise ValueError(f"labels not declared: {sorted(r.label for r in odd)}")
    return out


def unseen(texts: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct texts without a vector yet."""
    return texts.select("text").distinct().withColumn("key", F.sha2("text", 256)).join(known.select("key"), "key", "left_anti")


def classifier_accuracy(train: DataFrame, test: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """I8: accuracy on test of logistic regression and Gaussian naive Bayes over vectors."""
    from pyspark.ml.classification import LogisticRegression, NaiveBayes
    from pyspark.ml.functions import array_to_vector

    ready = lambda df: df.select(F.col(label).cast("double").alias("label"), array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"))
    out = []
    for name, model in (("logistic_regression", LogisticRegression(maxIter=20, regParam=0.01)), ("gaussian_naive_bayes", NaiveBayes(modelType="gaussian"))):
        said = model.fit(ready(train)).transform(ready(test))
        out.append(said.agg(F.lit(name).alias("model"), F.round(F.avg((F.col("label") == F.col("prediction")).cast("int")), 6).alias("accuracy")))
    return out[0].unionByName(out[1])
