"""Typed relations between documents and their status in time (G1-G12). nodes(node, issued, effective, year, draft), edges(src, rel, dst, origin)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What counts first when related documents are listed.
PRIORITY = ("replace", "replaced_by", "amend", "amended_by", "guide", "guided_by", "attach", "attached_to", "basis", "basis_of")


def build_edges(mentions: DataFrame, curated: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Extracted mentions(src, rel, dst, partial) less self-edges and suppressions, with curated(src, rel, dst, partial) over them; a partial
    edge goes where a full one is there."""
    e = mentions.where("src <> dst").join(suppressed.select("src", "rel", "dst").distinct(), ["src", "rel", "dst"], "left_anti")
    both = e.withColumn("origin", F.lit("text")).unionByName(curated.withColumn("origin", F.lit("curated")))
    best = both.groupBy("src", "rel", "dst").agg(F.min_by(F.struct("origin", "partial"), F.struct(F.col("origin") != "curated", "partial")).alias("b"))
    out = best.select("src", "rel", "dst", "b.origin", "b.partial")
    full = F.min(F.col("partial").cast("int")).over(W.partitionBy("src", "dst", F.col("rel").isin("replace", "repeal")))
    return out.withColumn("__f", full).where("not (partial and __f = 0 and rel in ('replace', 'repeal'))").drop("__f")


def resolve_names(citations: DataFrame, laws: DataFrame) -> DataFrame:
    """citations(cite_id, name, year) to the latest law(name, year, number) of the name that is not after the year; else the latest. A name's
    laws are one row, of each year the highest number, so a citation meets as many as its name has years."""
    each = laws.where("name is not null").groupBy("name", F.col("year").alias("ly")).agg(F.max("number").alias("number"))
    of = each.groupBy("name").agg(F.collect_list(F.struct("ly", "number")).alias("laws"))  # a name's years
    best = F.array_max(F.transform("laws", lambda x: F.struct((x["ly"] <= F.col("year")).alias("in_time"), x["ly"].alias("ly"), x["number"].alias("number"))))
    picked = citations.join(of, "name").select("cite_id", best.alias("best")).repartition("cite_id")  # dealt first, so rows are sorted once, a part each
    return picked.groupBy("cite_id").agg(F.max("best").alias("best")).select("cite_id", "best.number")


def starts(nodes: DataFrame) -> DataFrame:
    """Node, start: effective date, else issue date, else the first of January of the year."""
    return nodes.select("node", F.coalesce("effective", "issued", F.make_date("year", F.lit(1), F.lit(1))).alias("start"))


def status_as_of(nodes: DataFrame, edges: DataFrame, day: Column) -> DataFrame:
    """Node, status, by (the documents that changed it), from (when it expires): replaced by one in force: expired; by one to come:
    expiring; itself to come: not_yet; partly repealed: partly; amended: amended; else in_force."""
    s = starts(nodes)
    e = edges.join(s.select(F.col("node").alias("src"), F.col("start").alias("from")), "src").where(F.col("from").isNotNull())
    live = F.col("from") <= day
    ends = F.col("rel").isin("replace", "repeal") & ~F.col("partial")
    g = e.groupBy(F.col("dst").alias("node")).agg(
        F.array_sort(F.collect_set(F.when(ends & live, F.col("src")))).alias("gone"), F.array_sort(F.collect_set(F.when(ends & ~live, F.col("src")))).alias("going"), F.min(F.when(ends & ~live, F.col("from"))).alias("when"),
        F.array_sort(F.collect_set(F.when(F.col("partial") & live & (F.col("rel") != "amend"), F.col("src")))).alias("parts"), F.array_sort(F.collect_set(F.when((F.col("rel") == "amend") & live, F.col("src")))).alias("amended"),
    )
    j = s.join(g, "node", "left")
    has = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    status = F.when(has("gone"), "expired").when(has("going"), "expiring").when(F.col("start") > day, "not_yet").when(has("parts"), "partly").when(has("amended"), "amended").otherwise("in_force")
    by = F.when(has("gone"), F.col("gone")).when(has("going"), F.col("going")).when(F.col("start") > day, F.array().cast(g.schema["gone"].dataType)).when(has("parts"), F.col("parts")).when(has("amended"), F.col("amended")).otherwise(F.array().cast(g.schema["gone"].dataType))
    return j.select("node", status.alias("status"), by.alias("by"), F.when(status == "expiring", F.col("when")).alias("from"))


def related(edges: DataFrame, k: int = 8) -> DataFrame:
    """Node, other, relation, place: each counterpart once at its best priority, the first k."""
    names = F.create_map(*[x for i, r in enumerate(PRIORITY) for x in (F.lit(r), F.lit(i))])
    back = {"replace": "replaced_by", "repeal": "replaced_by", "amend": "amended_by", "guide": "guided_by", "attach": "attached_to", "basis": "basis_of"}
    inverse = F.create_map(*[x for a, b in back.items() for x in (F.lit(a), F.lit(b))])
    rel = F.when(F.col("rel") == "repeal", "replace").otherwise(F.col("rel"))
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), rel.alias("relation")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), inverse[F.col("rel")].alias("relation")))
    out = out.withColumn("p", names[F.col("relation")])
    best = out.groupBy("node", "other").agg(F.min("p").alias("p"))
    best = best.withColumn("place", F.row_number().over(W.partitionBy("node").orderBy("p", "other"))).where(F.col("place") <= k)
    return best.select("node", "other", F.lit(list(PRIORITY))[F.col("p")].alias("relation"), "place")


def question_as_of(text: Column, today: Column) -> Column:
    """The day a question is about: a day, else the last of a month, else the end of a past year, if not before 1990 and before today; NULL: now."""
    t = F.lower(text)
    g = lambda p, i: F.regexp_extract(t, p, i)
    d, m, y = r"ngày\s+(\d{1,2})[/\s]+(?:tháng\s+)?(\d{1,2})[/\s]+(?:năm\s+)?(\d{4})", r"tháng\s+(\d{1,2})(?:\s+năm\s+|/)(\d{4})", r"năm\s+(\d{4})"
    date = lambda yy, mm, dd: F.try_to_date(F.concat_ws("-", yy, F.lpad(mm, 2, "0"), F.lpad(dd, 2, "0")), "yyyy-MM-dd")
    day = F.when(g(d, 1) != "", date(g(d, 3), g(d, 2), g(d, 1))).when(g(m, 1) != "", F.last_day(date(g(m, 2), g(m, 1), F.lit("01")))).when((g(y, 1) != "") & (g(y, 1).try_cast("int") < F.year(today)), date(g(y, 1), F.lit("12"), F.lit("31")))
    return F.when((day >= F.lit("1990-01-01").cast("date")) & (day < today), day)


def graph_statistics(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Per relation: edges, those with both ends known, those curated."""
    k = known.select("node").distinct()
    a = edges.join(k.select(F.col("node").alias("src"), F.lit(1).alias("a")), "src", "left").join(k.select(F.col("node").alias("dst"), F.lit(1).alias("b")), "dst", "left")
    return a.groupBy("rel").agg(F.count("*").alias("edges"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("inside"), F.count_if(F.col("origin") == "curated").alias("curated"))
