"""Usage statistics over turns, retention and suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def usage_totals(turns: DataFrame, since: Column | None = None) -> DataFrame:
    """One row; rates have three places and are 0 without turns."""
    t = turns if since is None else turns.where(F.col("at") >= since)
    rate = lambda c: F.coalesce(F.round(F.try_divide(F.count_if(c), F.count("*")), 3), F.lit(0.0))
    return t.agg(
        F.count("*").alias("turns"), F.count_distinct("conv_id").alias("conversations"), F.coalesce(F.round(F.avg("seconds"), 3), F.lit(0.0)).alias("avg_seconds"), F.count_if("refused").alias("refused"), F.count_if("from_cache").alias("cached"),
        F.count_if(~F.col("citation_ok")).alias("bad_citations"), F.count_if(~F.col("figures_ok")).alias("bad_figures"), rate(F.col("refused")).alias("refusal_rate"), rate(F.col("from_cache")).alias("cache_rate"),
    )


def slowest(turns: DataFrame, n: int = 10) -> DataFrame:
    """U2."""
    return turns.orderBy(F.desc("seconds"), "turn_id").limit(n).select("turn_id", "question", "seconds")


def repeated(turns: DataFrame, n: int = 15, least: int = 2) -> DataFrame:
    """Questions alike but for case and outer blanks: how often, and the first wording."""
    g = turns.groupBy(F.lower(F.trim("question")).alias("k")).agg(F.count("*").alias("n"), F.min_by("question", F.struct("at", "turn_id")).alias("question")).where(F.col("n") >= least)
    return g.orderBy(F.desc("n"), "k").limit(n).select("question", "n")


def per_role(turns: DataFrame, top: int = 5) -> DataFrame:
    """Per role counts, refusal rate, mean seconds and its most frequent questions (ties: the later asked first)."""
    stats = turns.groupBy("role").agg(F.count("*").alias("turns"), F.round(F.count_if("refused") / F.count("*"), 3).alias("refusal_rate"), F.round(F.avg("seconds"), 3).alias("avg_seconds"))
    q = turns.groupBy("role", "question").agg(F.count("*").alias("n"), F.max("at").alias("last"))
    w = W.partitionBy("role").orderBy(F.desc("n"), F.desc("last"), "question")
    q = q.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)
    lists = q.groupBy("role").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "question"))), lambda x: x["question"]).alias("top"))
    return stats.join(lists, "role")


def label_counts(turns: DataFrame, path: str = "$.k") -> DataFrame:
    """Counts of a value in the JSON detail, where it is valid and there."""
    v = F.get_json_object("detail", path)
    return turns.select(v.alias("label")).where("label is not null").groupBy("label").agg(F.count("*").alias("n"))


def block_statistics(events: DataFrame, groups: list[str], zone: str = "UTC") -> DataFrame:
    """Kind (total, group, role, day), name, n; an event of several groups counts in each, fixed groups are always there."""
    day = F.date_format(F.from_utc_timestamp("at", zone), "yyyy-MM-dd")
    own = events.select(F.explode(F.array_distinct("groups")).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    every = events.sparkSession.createDataFrame([(g,) for g in groups], "name string").join(own, "name", "left").select(F.lit("group").alias("kind"), "name", F.coalesce("n", F.lit(0)).alias("n"))
    total = events.agg(F.count("*").alias("n")).select(F.lit("total").alias("kind"), F.lit("").alias("name"), "n")
    by = lambda kind, c: events.groupBy(c.alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    return total.unionByName(every).unionByName(by("role", F.col("role"))).unionByName(by("day", day))


def conversation_list(convs: DataFrame, turns: DataFrame, limit: int = 200) -> DataFrame:
    """U8: conversations with their number of turns, newest first; the limit lies between 1 and 200."""
    n = turns.groupBy("conv_id").agg(F.count("*").alias("turns"))
    return convs.join(n, "conv_id", "left").withColumn("turns", F.coalesce("turns", F.lit(0))).orderBy(F.desc("at"), "conv_id").limit(max(1, min(200, limit)))


def conversation_detail(turns: DataFrame) -> DataFrame:
    """The turns of each conversation in order."""
    item = F.struct("at", "turn_id", "question")
    return turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["question"]).alias("questions"))


def latest_questions(turns: DataFrame, n: int) -> DataFrame:
    """At most 10,000."""
    return turns.orderBy(F.desc("at"), F.desc("turn_id")).limit(max(0, min(10_000, n))).select("turn_id", "question")


def delete_owner(turns: DataFrame, owners: DataFrame) -> DataFrame:
    """Turns without those of the owners."""
    return turns.join(owners, "client", "left_anti")


def transfer(turns: DataFrame, moves: DataFrame) -> DataFrame:
    """Turns with owners renamed by moves(client, new_client)."""
    return turns.join(moves, "client", "left").withColumn("client", F.coalesce("new_client", "client")).drop("new_client")


def retention(turns: DataFrame, convs: DataFrame, cutoff: Column) -> DataFrame:
    """conversations(conv_id, title, at) that stay: those with a turn since the cutoff, or that are younger; older ones that stay take
    title and date from their oldest remaining turn."""
    live = turns.where(F.col("at") >= cutoff)
    first = live.groupBy("conv_id").agg(F.min_by("question", F.struct("at", "turn_id")).alias("t"), F.min("at").alias("f"))
    j = convs.join(first, "conv_id", "left").where(F.col("f").isNotNull() | (F.col("at") >= cutoff))
    old = (F.col("at") < cutoff) & F.col("f").isNotNull()
    return j.select("conv_id", F.when(old, F.col("t")).otherwise(F.col("title")).alias("title"), F.when(old, F.col("f")).otherwise(F.col("at")).alias("at"))


def upsert_turns(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Each turn with the conversation it goes to: its own if the id is well formed and the client owns it, else a new one."""
    j = turns.join(convs.select("conv_id", F.col("client").alias("owner")), "conv_id", "left")
    ok = F.col("conv_id").rlike(r"^[A-Za-z0-9_-]{8,64}$") & (F.col("owner") == F.col("client"))
    return j.select("turn_id", F.when(F.coalesce(ok, F.lit(False)), F.col("conv_id")).otherwise(F.concat(F.lit("new-"), F.col("turn_id").cast("string"))).alias("goes_to"))


def round_robin(rows: DataFrame, leaf: str, order: str, text: str, most: int = 120) -> DataFrame:
    """Q2: one of each leaf in turn; place is global. Texts are cut at 120 characters. A list to show: its rank needs one task per round, not one in all."""
    rn = F.row_number().over(W.partitionBy(leaf).orderBy(order))
    rows = rows.select(leaf, F.substring(text, 1, most).alias(text), rn.alias("round"))
    return rows.withColumn("place", F.row_number().over(W.partitionBy("round").orderBy(leaf)))


def role_first(suggestions: DataFrame, roles: list[str], n: int) -> DataFrame:
    """Q9: role, place, text: of suggestions(grp, pos, text) those of the role's own group first, then one of each other group in turn, each text once.
    Before the k-th text of a group stand k - 1 others, so its first n are enough."""
    first = suggestions.where("text is not null").groupBy("grp", "text").agg(F.min("pos").alias("pos"))
    first = first.withColumn("nth", F.row_number().over(W.partitionBy("grp").orderBy("pos", "text"))).where(F.col("nth") <= n)
    asked = F.explode(F.array(*[F.lit(r) for r in roles])).alias("role")
    each = first.select(asked, "grp", "text", "nth").withColumn("own", F.col("grp") == F.col("role"))
    once = each.groupBy("role", "text").agg(F.min(F.struct(~F.col("own"), "nth", "grp")).alias("o"))
    place = F.row_number().over(W.partitionBy("role").orderBy("o", "text"))
    return once.withColumn("place", place).where(F.col("place") <= n).select("role", "place", "text")


def fuzzy_unique(groups: DataFrame, key: str, texts: str) -> DataFrame:
    """Q3: of each ordered list the texts that neither equal, contain nor lie in an earlier kept one, by letters and digits only."""
    norm = lambda t: F.trim(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}]+", " "))

    def step(acc: Column, x: Column) -> Column:
        n = norm(x)
        return F.when((n == "") | F.exists(acc, lambda y: F.contains(norm(y), n) | F.contains(n, norm(y))), acc).otherwise(F.array_append(acc, x))

    return groups.select(key, F.aggregate(texts, F.array().cast("array<string>"), step).alias("kept"))


def title_overlap(a: DataFrame, b: DataFrame, ka: str, kb: str, pairs: Column, least: int = 2) -> DataFrame:
    """Q5: titles that share two word pairs or more: how many."""
    x, y = a.select(ka, F.explode(F.array_distinct(pairs)).alias("p")), b.select(kb, F.explode(F.array_distinct(pairs)).alias("p"))
    return x.join(y, "p").groupBy(ka, kb).agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def cited_sources(answers: DataFrame) -> DataFrame:
    """Q8: answers(answer, sources): the sources whose number is cited as [n]; all if none is."""
    n = F.transform(F.regexp_extract_all("answer", F.lit(r"\[(\d{1,3})\]"), F.lit(1)), lambda x: x.cast("int"))
    kept = F.filter("sources", lambda _, i: F.array_contains(n, i + 1))
    return answers.withColumn("kept", F.when(F.size(kept) > 0, kept).otherwise(F.col("sources")))
