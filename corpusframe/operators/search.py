"""Searches put together from the retrieval operators: scope before ranking, balanced comparisons, pages and spans of a passage."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusframe.functions import text as T
from corpusframe.operators import retrieval as R
from corpusframe.operators.lineage import sub_queries

#: Candidates of each retriever, passages of an answer, passages of one source (of a question that asks for an overview).
POOL, KEPT, PER_SOURCE, PER_SOURCE_BROAD = 15, 4, 2, 4
#: Phrases that ask for an overview.
BROAD = ("tóm tắt", "tổng hợp", "toàn bộ", "nội dung chính", "các quy định chính")


class Corpus(NamedTuple):
    """What a search reads: chunks(doc_id, source, text, ..), the same of R.indexed(), a vector of each chunk, and ids of expired ones."""

    chunks: DataFrame
    tokens: DataFrame
    vectors: DataFrame
    expired: DataFrame


def scoped(vectors: DataFrame, tokens: DataFrame, scope: Column | None) -> DataFrame:
    """The vectors of chunks within a scope; without one all."""
    return vectors if scope is None else vectors.join(tokens.where(F.coalesce(scope, F.lit(False))).select("doc_id"), "doc_id", "left_semi")


def candidates(questions: DataFrame, corpus: Corpus, scope: Column | None = None, mismatch: Column | None = None, pool: int = POOL) -> DataFrame:
    """The fused run of BM25 and vectors with all that R5 and R11 look at. A scope, a predicate over the columns of corpus.tokens, decides
    before either retriever ranks (F1), so that a pool is full as long as the scope has rows; weights of words stay those of the
    whole corpus. Expiry costs points later and narrows nothing."""
    lexical = R.bm25(questions, corpus.tokens, "doc_id", pool, scope=scope)
    near = R.dense(R.hashed_vectors(questions, "query_id"), scoped(corpus.vectors, corpus.tokens, scope), pool, "doc_id", "vector")
    c = R.rrf(lexical, near, key="doc_id", names=("bm25", "dense")).join(near.select("query_id", "doc_id", "dist"), ["query_id", "doc_id"], "left")
    found = c.select("doc_id").distinct()
    chunks = corpus.chunks.join(F.broadcast(found) if questions.count() * 2 * pool <= 1_000_000 else found, "doc_id", "left_semi")
    c = c.join(chunks.withColumn("title", F.substring_index("text", "\n", 1)), "doc_id").join(questions.select("query_id", F.col("text").alias("question")), "query_id")
    share = lambda t: F.coalesce(F.try_divide(F.size(F.array_intersect(T.tokens("question"), t)), F.size(F.array_distinct(T.tokens("question")))), F.lit(0.0))
    c = c.withColumns({"body_coverage": share(T.tokens("text")), "title_coverage": share(T.raw_tokens("title")), "code_mismatch": F.lit(False) if mismatch is None else mismatch})
    c = c.join(corpus.expired.select("doc_id").distinct().withColumn("expired", F.lit(True)), "doc_id", "left").withColumn("expired", F.coalesce("expired", F.lit(False)))
    return R.coverage(c, questions, R.vocabulary(corpus.tokens), F.lit(math.log(corpus.tokens.count() + 1)), "doc_id", "title")


def hybrid(questions: DataFrame, corpus: Corpus, scope: Column | None = None, mismatch: Column | None = None, n: int | str = KEPT, history: bool = False) -> DataFrame:
    """query_id, place, doc_id, source, text: of the scope's candidates the best after R5, spread over sources (R8). n may be a column of questions."""
    r = R.rerank(candidates(questions, corpus, scope, mismatch), history)
    broad = F.exists(F.lit(list(BROAD)), lambda p: F.contains(F.lower("question"), p))
    r = r.withColumns({"score": F.col("rerank_score"), "__each": F.when(broad, PER_SOURCE_BROAD).otherwise(PER_SOURCE)})
    if isinstance(n, str):
        r = r.join(questions.select("query_id", F.col(n).alias("__n")), "query_id")
    kept = R.diversified(r, "doc_id", "__n" if isinstance(n, str) else n, "__each")
    return kept.join(r.select("query_id", "doc_id", "source", "text"), ["query_id", "doc_id"])


def balanced(questions: DataFrame, corpus: Corpus, n: int = KEPT, **how) -> DataFrame:
    """query_id, part, place, doc_id, entity: a comparison's parts are questions of their own with max(2, n // parts) passages each; a
    text that an earlier part brought is left out. Others are asked as they are."""
    parts = sub_queries(questions).withColumn("__parts", F.count("*").over(W.partitionBy("query_id")))
    parts = parts.select(F.struct("query_id", "part").alias("query_id"), "text", F.when(F.col("__parts") > 1, F.greatest(F.lit(2), F.floor(F.lit(n) / F.col("__parts")))).otherwise(n).cast("int").alias("quota"))
    flat = parts.withColumn("query_id", F.to_json("query_id"))  # a plain key while it is searched
    found = hybrid(flat, corpus, n="quota", **how).join(flat.select("query_id", F.col("text").alias("entity")), "query_id")
    kind = parts.schema["query_id"].dataType.simpleString()
    found = found.withColumn("__q", F.from_json("query_id", kind)).select("__q.query_id", "__q.part", "place", "doc_id", "entity", "text")
    first = W.partitionBy("query_id", F.sha2("text", 256)).orderBy("part", "place")
    return found.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r", "text")


def runs_of_three(text: str) -> Column:
    """Distinct runs of three words; of a shorter text, but not an empty one, all its words as one."""
    w = T.raw_tokens(text)
    return F.array_distinct(F.transform(F.array(w), lambda t: F.when(F.size(t) >= 3, F.transform(F.sequence(F.lit(1), F.size(t) - 2), lambda i: F.array_join(F.slice(t, i, 3), " "))).when(F.size(t) > 0, F.array(F.array_join(t, " "))).otherwise(F.array().cast("array<string>")))[0])


def locate_pages(passages: DataFrame, pages: DataFrame, key: str = "passage_id") -> DataFrame:
    """Key, page, score, main: the page of its file on which a passage(key, file, text, focus, hint) stands, and the pages next to it
    that have two of its runs of three words or more and a fifth of them. The page with the key sentence (focus) comes first where any
    has it, then the one that shares most runs, then the hinted one, then the first. Without any shared run the hinted page, if the
    file has it, with a score of 0. pages(file, page, text)."""
    grams = pages.select("file", "page", F.explode(runs_of_three("text")).alias("s"))
    own = passages.select(key, "file", F.explode(F.concat(F.transform(runs_of_three("text"), lambda s: F.struct(s.alias("s"), F.lit(0).alias("f"))), F.transform(F.coalesce(runs_of_three("focus"), F.array().cast("array<string>")), lambda s: F.struct(s.alias("s"), F.lit(1).alias("f"))))).alias("x"))
    shared = own.select(key, "file", "x.s", "x.f").join(grams, ["file", "s"]).groupBy(key, "page").agg(F.count_if(F.col("f") == 0).alias("score"), F.sum("f").alias("focus"))
    size = passages.select(key, F.size(runs_of_three("text")).alias("n"), "hint")
    scored = shared.join(size, key).withColumn("__any", F.max("score").over(W.partitionBy(key))).where("__any > 0")
    best = W.partitionBy(key).orderBy(F.desc("focus"), F.desc("score"), F.desc(F.coalesce(F.col("page") == F.col("hint"), F.lit(False))), "page")
    scored = scored.withColumn("__main", F.first("page").over(best))
    near = scored.where((F.col("page") == F.col("__main")) | (F.abs(F.col("page") - F.col("__main")) == 1) & (F.col("score") >= F.greatest(F.lit(2.0), F.lit(0.2) * F.col("n"))))
    found = near.select(key, "page", "score", (F.col("page") == F.col("__main")).alias("main"))
    hinted = passages.join(found.select(key).distinct(), key, "left_anti").select(key, "file", F.col("hint").alias("page")).join(pages.select("file", "page").distinct(), ["file", "page"], "left_semi")
    return found.unionByName(hinted.select(key, "page", F.lit(0).cast("long").alias("score"), F.lit(True).alias("main")))


def aligned_spans(pairs: DataFrame, key: str = "query_id", drift: int = 12, least: int = 3) -> DataFrame:
    """Key, begin, end, matched: the words of page that passage stands for, of pairs(key, page ARRAY, passage ARRAY); NULLs where too little matches.

    Blocks are runs of words that both have, as long as they go, of two words or more (of one for a passage of up to four). A block's
    lag is how much later it begins on the page than in the passage. A block that stands inside a longer one in the passage is
    left out; of the others those whose lags follow within `drift` of each other are one group, as the words between them may
    differ by that many. The group that has most of the passage's words wins, then the one
    that begins first; it needs three words, or all of a shorter passage. Pairs are those that R15 found, so a passage meets one
    page: words meet by an equi-join within a pair, blocks and groups are islands in windows.
    """
    empty = F.array().cast("array<string>")
    both = pairs.select(key, F.coalesce("page", empty).alias("page"), F.coalesce("passage", empty).alias("passage"))
    size = F.size("passage")
    gram = lambda words, n: F.transform(F.array(words), lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), "\0"))).otherwise(empty))[0]
    n = F.when(size <= 4, 1).otherwise(2)
    on = both.select(key, F.posexplode(gram(F.col("page"), n)).alias("a", "s"))
    in_ = both.select(key, size.alias("words"), n.alias("n"), F.posexplode(gram(F.col("passage"), n)).alias("b", "s"))
    hit = on.join(in_, [key, "s"]).select(key, "words", "n", "a", "b", (F.col("a") - F.col("b")).alias("lag"))
    hit = hit.withColumn("__g", F.col("a") - F.row_number().over(W.partitionBy(key, "lag").orderBy("a")))
    blocks = hit.groupBy(key, "words", "lag", "__g").agg(F.min("a").alias("a"), (F.max("a") + F.max("n")).alias("to"), F.min("b").alias("b"))
    blocks = blocks.withColumn("b_to", F.col("b") + F.col("to") - F.col("a"))
    earlier = F.max("b_to").over(W.partitionBy(key).orderBy("b").rangeBetween(W.unboundedPreceding, -1))
    with_ = F.max("b_to").over(W.partitionBy(key).orderBy("b").rangeBetween(W.unboundedPreceding, 0))
    blocks = blocks.withColumns({"__lt": F.coalesce(earlier, F.lit(-1)), "__le": with_}).where((F.col("__lt") < F.col("b_to")) & (F.col("__le") <= F.col("b_to")))
    step = F.col("lag") - F.lag("lag").over(W.partitionBy(key).orderBy("lag", "a"))
    blocks = blocks.withColumn("__new", F.when(F.coalesce(step, F.lit(drift + 1)) > drift, 1).otherwise(0)).withColumn("group", F.sum("__new").over(W.partitionBy(key).orderBy("lag", "a")))
    before = F.max("b_to").over(W.partitionBy(key, "group").orderBy("b", "b_to").rowsBetween(W.unboundedPreceding, -1))
    blocks = blocks.withColumn("__own", F.greatest(F.lit(0), F.col("b_to") - F.greatest("b", F.coalesce(before, F.lit(0)))))
    groups = blocks.groupBy(key, "words", "group").agg(F.min("a").alias("begin"), F.max("to").alias("end"), F.sum("__own").cast("int").alias("matched"))
    groups = groups.where(F.col("matched") >= F.least(F.lit(least), F.col("words")))
    best = groups.groupBy(key).agg(F.min_by(F.struct("begin", "end", "matched"), F.struct(-F.col("matched"), "begin", "group")).alias("x"))
    return both.select(key).join(best, key, "left").select(key, "x.begin", "x.end", "x.matched")
