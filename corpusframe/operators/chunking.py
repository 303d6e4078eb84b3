"""Chunking with section and page lineage (C1-C11). Documents come as texts or as elements(doc_id, elem_no, text, page)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_CHARS, OVERLAP = 1200, 150
#: Cut points, best first.
LADDER = ("\n# ", "\n## ", "\n\n", "\n", ". ", " ", "")


def join_pages(elements: DataFrame) -> DataFrame:
    """doc_id, text: a document's elements in order, with a blank line between."""
    return elements.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("elem_no", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


def page_starts(elements: DataFrame) -> DataFrame:
    """doc_id, page, start: where each page begins in the joined text."""
    w = W.partitionBy("doc_id").orderBy("elem_no").rowsBetween(W.unboundedPreceding, -1)
    rows = elements.withColumn("start", F.coalesce(F.sum(F.char_length("text") + 2).over(w), F.lit(0)).cast("long"))
    return rows.groupBy("doc_id", "page").agg(F.min("start").alias("start"))


def sections(docs: DataFrame, heading: str, least_preamble: int = 50) -> DataFrame:
    """doc_id, seq, start, heading, text: the text from each heading at a line start to the next; what stands before the first
    is kept if it has over 50 characters; a text without headings is one piece. Offsets count from 0."""
    pieces = F.split("text", rf"(?m)(?=^{heading})")
    rows = docs.select("doc_id", F.posexplode(pieces).alias("seq", "text"))
    w = W.partitionBy("doc_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.char_length("text")).over(w), F.lit(0)).cast("long"))
    head = F.regexp_extract("text", rf"^({heading})", 1)
    rows = rows.withColumn("heading", F.when(head != "", F.trim(head)))
    n = F.count("*").over(W.partitionBy("doc_id"))
    keep = (F.col("heading").isNotNull() | (F.char_length(F.trim("text")) > least_preamble) | (F.col("__n") == 1)) & (F.trim("text") != "")
    return rows.withColumn("__n", n).where(keep).drop("__n")


def as_of(points: DataFrame, marks: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """points(by, at, ..) with the value of the last of marks(by, at, value) at or before them, by one sorted pass over both."""
    a = points.withColumns({"__p": F.lit(1), "__v": F.lit(None).cast(marks.schema[value].dataType)})
    b = marks.select(by, F.col(at).cast(points.schema[at].dataType).alias(at), F.lit(0).alias("__p"), F.col(value).alias("__v"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = W.partitionBy(by).orderBy(at, "__p")
    return both.withColumn(value, F.last("__v", ignorenulls=True).over(w)).where("__p = 1").drop("__p", "__v")


def split_text(text: str, most: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, str]]:
    """(offset, piece): pieces of at most so many characters, cut at the best mark of the ladder in their second half, each
    beginning at most overlap characters before the end of the one before."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + most)
        if end < len(text):
            for mark in LADDER:
                cut = text.rfind(mark, at + most // 2, end) if mark else end
                if cut > at:
                    end = cut + (len(mark) if not mark.startswith("\n") else 0) if mark else cut
                    end = min(end, at + most)
                    break
        if text[at:end].strip():
            out.append((at, text[at:end]))
        if end >= len(text):
            break
        back = text.rfind(" ", max(at + 1, end - overlap), end)
        at = max(at + 1, back + 1 if back >= 0 else end)
    return out


def split_long(chunks: DataFrame, keys: list[str], most: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Keys, part, parts, offset, text: chunks above the limit are cut, others pass; parts are numbered from 1."""
    fields = {f.name: f.dataType.simpleString() for f in chunks.schema.fields}
    schema = ", ".join([*(f"{k} {fields[k]}" for k in keys), "part int, parts int, offset int, text string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                own = split_text(r.text or "", most, overlap)
                rows += [(*(getattr(r, k) for k in keys), i + 1, len(own), at, piece) for i, (at, piece) in enumerate(own)]
            yield pd.DataFrame(rows, columns=[*keys, "part", "parts", "offset", "text"])

    return chunks.select(*keys, "text").mapInPandas(run, schema)


def element_chunks(elements: DataFrame, keys: list[str], label: str, most: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Keys, label, format, part, parts, offset, text: slides, sheets and cues never merge; one above the limit is cut, and its parts are
    numbered in the label."""
    cut = split_long(elements.select(*keys, label, "text"), [*keys, label], most, overlap)
    return cut.withColumns({label: F.when(F.col("parts") > 1, F.format_string("%s (phần %d/%d)", label, "part", "parts")).otherwise(F.col(label)), "format": F.lit("theo_phan_tu")})


def spread_sample(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """All rows of a group of at most n, else those at places int(i * total / n)."""
    w = W.partitionBy(by)
    r = rows.withColumns({"__i": F.row_number().over(w.orderBy(order)) - 1, "__t": F.count("*").over(w)})
    # place p is taken if some i has p = floor(i * t / n)
    i = F.ceil(F.col("__i") * n / F.col("__t"))
    return r.where((F.col("__t") <= n) | ((i < n) & (F.floor(i * F.col("__t") / n) == F.col("__i")))).drop("__i", "__t")


def pack(chunks: DataFrame, by: str, order: str, label: Column, budget: int = 5000) -> DataFrame:
    """By, text: labelled chunks in order, cut where the budget of characters ends."""
    rows = chunks.select(by, order, F.concat(F.lit("["), label, F.lit("]\n"), F.col("text")).alias("t"))
    w = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum(F.char_length("t")).over(w), F.lit(0)).cast("int")).where(F.col("before") < budget)
    rows = rows.withColumn("t", F.substring("t", F.lit(1), F.lit(budget) - F.col("before")))
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "t"))), lambda x: x["t"]), "").alias("text"))


def evidence_block(run: DataFrame, most: int = 900) -> DataFrame:
    """query_id, text: numbered evidence by rank, its head joined by bars, its body cut at the last blank before the limit."""
    cut = F.when(F.char_length("text") <= most, F.col("text")).otherwise(F.regexp_extract(F.substring("text", 1, most), r"(?s)^(.*)\s", 1))
    row = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.concat_ws(" | ", "source", "title"), F.lit("\n"), cut)
    return run.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", row.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))


def candidate_passages(chunks: DataFrame, by: str, heading: str, boilerplate: str, least: int = 300, letters: float = 0.6) -> DataFrame:
    """Of each document the good passages with a heading; if there are none, the good ones; if there are none, all."""
    share = F.try_divide(F.char_length(F.regexp_replace("text", r"[^\p{L}]", "")), F.char_length("text"))
    good = (F.char_length("text") >= least) & (F.coalesce(share, F.lit(0.0)) >= letters) & ~F.col("text").rlike(boilerplate)
    tier = F.when(good & F.col("text").rlike(heading), 2).when(good, 1).otherwise(0)
    return chunks.withColumn("tier", tier).withColumn("__b", F.max("tier").over(W.partitionBy(by))).where("tier = __b").drop("__b")


def chunk_statistics(chunks: DataFrame, by: str, kind: str, kinds: list[str]) -> DataFrame:
    """C11."""
    return chunks.groupBy(by).pivot(kind, kinds).count().na.fill(0)
