"""More of metadata, graph and retrieval: roll-ups, labels, companions, scopes, allocation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusframe.functions import text as T
from corpusframe.operators.chunking import spread_sample
from corpusframe.operators.metadata import extract_numbers
from corpusframe.operators.retrieval import bm25_within


def recovered_offsets(chunks: DataFrame, docs: DataFrame, head: int = 60) -> DataFrame:
    """doc_id, seq, offset: where each chunk's first characters stand, searched from where the last one was found; then from the start; else there."""
    lists = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.substring("text", 1, head).alias("h")))).alias("c"))
    j = lists.join(docs.select("doc_id", F.col("text").alias("t")), "doc_id")

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"]
        on, again = F.call_function("locate", x["h"], F.col("t"), at), F.call_function("locate", x["h"], F.col("t"), F.lit(1))
        found = F.when(on > 0, on).when(again > 0, again).otherwise(at)
        return F.struct(found.alias("at"), F.array_append(acc["out"], F.struct(x["seq"].alias("seq"), (found - 1).alias("offset"))).alias("out"))

    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<seq:int,offset:int>>").alias("out"))
    return j.select("doc_id", F.explode(F.aggregate("c", start, step, lambda s: s["out"])).alias("x")).select("doc_id", "x.seq", "x.offset")


def queue_view(uploads: DataFrame, log: DataFrame) -> DataFrame:
    """uploads(id, hash, created) with their latest status of log(id, status, at); pending without one. An upload restored from the trash gives way to
    a pending one of the same content."""
    last = log.groupBy("id").agg(F.max_by("status", "at").alias("status"), F.max("at").alias("at"))
    q = uploads.join(last, "id", "left").withColumns({"status": F.coalesce("status", F.lit("pending"))})
    first = F.row_number().over(W.partitionBy("hash", "status").orderBy(F.desc("created"), "id"))
    return q.withColumn("superseded", (F.col("status") == "pending") & (first > 1))


def route(docs: DataFrame, rules: Sequence[tuple[Column, str]], default: str) -> DataFrame:
    """Docs with folder: that of the first rule that holds."""
    out = None
    for test, folder in rules:
        out = (F if out is None else out).when(test, folder)
    return docs.withColumn("folder", out.otherwise(default))


def build_profiles(docs: DataFrame, external: DataFrame) -> DataFrame:
    """M7: doc_id, number, origin: the number in the name, else after "Số:", else a model's where it is well formed and its digits stand in the text
    (M9); guessed where the field is missing and the first number of the text is all there is."""
    field = F.get(extract_numbers(F.regexp_extract("text", r"(?iu)(?:^|\n)\s*S[ốôoO0]\s*:?\s*([^\n]{0,60})", 1)), F.lit(0))
    j = docs.join(external.select("doc_id", F.col("number").alias("ext")), "doc_id", "left")
    lead = F.regexp_extract("ext", r"^(\d+)/", 1)
    good = F.col("ext").rlike(r"^\d{1,5}/(\d{4}/)?[^\s/]+$") & F.exists(F.regexp_extract_all("text", F.lit(r"\d+"), F.lit(0)), lambda d: F.contains(d, lead))
    name = T.fold_accents("name")
    from corpusframe.operators.metadata import number_from_name

    own = number_from_name(name)
    number = F.coalesce(own, field, F.when(good, F.col("ext")))
    origin = F.when(own.isNotNull(), "name").when(field.isNotNull(), "field").when(good, "model")
    return j.select("doc_id", number.alias("number"), origin.alias("origin"))


def amended_passages(chunks: DataFrame, key: str = "chunk_key") -> DataFrame:
    """Key, by: numbers after "theo quy định tại" in a clause that says it was amended or repealed."""
    c = chunks.select(key, F.explode(F.split("text", "[.;]")).alias("c"))
    # scanned texts break lines inside a sentence, so white space of any kind, or none, may stand between syllables
    said = r"(?isu)được\s*(?:sửa\s*đổi|bãi\s*bỏ|bổ\s*sung|thay\s*thế).*?theo\s*quy\s*định\s*tại(.*)$"
    return c.select(key, F.explode(extract_numbers(F.regexp_extract("c", said, 1))).alias("by")).distinct()


def rolled_up(chunks: DataFrame, by: str, order: str, most: int = 3000) -> DataFrame:
    """By, text: the first chunks of a file until so many characters are there."""
    w = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    rows = chunks.withColumn("__b", F.coalesce(F.sum(F.char_length("text")).over(w), F.lit(0))).where(F.col("__b") < most)
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), "\n").alias("text"))


def assign_nodes(profiles: DataFrame, curated: DataFrame) -> DataFrame:
    """G1: doc_id, node: as curated, else the number, else a name of its own for attachments; NULL otherwise."""
    j = profiles.join(F.broadcast(curated.select("doc_id", F.col("node").alias("c"))), "doc_id", "left")
    return j.select("doc_id", F.coalesce("c", "number", F.when(F.col("attached"), F.concat(F.lit("file:"), F.col("doc_id").cast("string")))).alias("node"))


#: Label of a passage, and how strongly it warns.
LABELS = {"draft": "high", "expired": "high", "expiring": "mid", "not_yet": "mid", "passage_amended": "mid", "partly": "mid", "amended": "low", "in_force": "low"}


def passage_labels(passages: DataFrame, status: DataFrame, amended: DataFrame) -> DataFrame:
    """chunk_key, label, level from passages(chunk_key, node, is_draft, attached)."""
    a = amended.select("chunk_key").distinct().withColumn("__a", F.lit(True))
    j = passages.join(status.select("node", "status"), "node", "left").join(a, "chunk_key", "left")
    s = F.col("status")
    label = F.when(F.col("is_draft"), "draft").when(F.col("node").isNull(), None).when(s.isin("expired", "expiring", "not_yet"), s).when(F.col("__a"), "passage_amended").when(s.isin("partly", "amended"), s).when(F.col("attached"), None).otherwise("in_force")
    table = F.create_map(*[x for k, v in LABELS.items() for x in (F.lit(k), F.lit(v))])
    return j.select("chunk_key", label.alias("label"), F.try_element_at(table, label).alias("level"))


def companions(related: DataFrame, files: DataFrame, expired: DataFrame) -> DataFrame:
    """Node, doc_id: files of related documents that are not expired."""
    return related.join(expired.select(F.col("node").alias("other")), "other", "left_anti").join(files.select(F.col("node").alias("other"), "doc_id"), "other").select("node", "doc_id").distinct()


def asked_numbers(questions: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id, node: full numbers that are known; a number and year alone if one node has them."""
    q = questions.select("query_id", "text", F.explode_outer(extract_numbers("text")).alias("n"))
    full = q.join(nodes.select(F.col("node").alias("n")), "n").select("query_id", F.col("n").alias("node"))
    short = questions.select("query_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?<![\d/])(\d{1,4}/\d{4})(?![\d/])"), F.lit(1))).alias("p"))
    known = nodes.select("node", F.regexp_extract("node", r"^(\d{1,4}/\d{4})/", 1).alias("p")).where("p <> ''")
    only = known.groupBy("p").agg(F.count("*").alias("k"), F.min("node").alias("node")).where("k = 1")
    return full.unionByName(short.join(only, "p").select("query_id", "node")).distinct()


def source_warnings(sources: DataFrame, labels: DataFrame) -> DataFrame:
    """query_id, node, label, place: one warning per document and answer, where it is first cited; documents in force give none."""
    j = sources.join(labels, "chunk_key").where("label is not null and label <> 'in_force'")
    w = W.partitionBy("query_id", "node").orderBy("rank")
    return j.withColumn("__r", F.row_number().over(w)).where("__r = 1").select("query_id", "node", "label", F.col("rank").alias("place"))


def sub_queries(questions: DataFrame) -> DataFrame:
    """query_id, part, text: one per "Điều n" if two or more are named; two for a comparison joined by "và"; else the question."""
    articles = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?iu)(điều\s+\d+)"), F.lit(1)))
    rest = F.trim(F.regexp_replace("text", r"(?iu)điều\s+\d+(\s*(,|và)\s*)?", ""))
    sides = F.split("text", r"(?iu)\s+và\s+", 2)
    compare = F.lower("text").rlike(r"(so sánh|khác nhau|giống nhau|compare)") & (F.size(sides) == 2)
    parts = F.when(F.size(articles) >= 2, F.transform(articles, lambda a: F.concat_ws(" ", a, rest))).when(compare, sides).otherwise(F.array("text"))
    return questions.select("query_id", F.posexplode(parts).alias("part", "text"))


def allocate(runs: DataFrame, files: int = 4, total: int = 4) -> DataFrame:
    """Of each question the first four files, and of each file max(2, total // files) passages."""
    w = W.partitionBy("query_id")
    r = runs.withColumn("__f", F.dense_rank().over(w.orderBy("file")))
    r = r.where(F.col("__f") <= files).withColumn("__n", F.max("__f").over(w))
    place = F.row_number().over(W.partitionBy("query_id", "file").orderBy("rank"))
    return r.withColumn("place", place).where(F.col("place") <= F.greatest(F.lit(2), F.floor(F.lit(total) / F.col("__n")))).drop("__f", "__n")


def within_document(questions: DataFrame, chunks: DataFrame, k: int = 4) -> DataFrame:
    """The best passages of each question's own document, by the statistics of that document alone; without a hit a sample spread over it."""
    asked = questions.select("query_id", "doc_id").distinct()
    hits = bm25_within(questions, chunks, "chunk_key", "doc_id", k).select("query_id", "chunk_key", F.col("rank").alias("place")).persist()  # k rows a question
    rest = asked.join(hits.select("query_id").distinct(), "query_id", "left_anti").join(chunks.select("chunk_key", "doc_id"), "doc_id")
    rest = spread_sample(rest.select("query_id", "chunk_key"), "query_id", "chunk_key", k)
    return hits.unionByName(rest.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("chunk_key"))))


def unreadable_match(questions: DataFrame, titles: DataFrame, least: int = 4, share: float = 0.7) -> DataFrame:
    """query_id, doc_id: a title with four of the question's words or more, and seven tenths of them; the best, ties to the smaller id."""
    q = questions.select("query_id", F.array_distinct(T.tokens("text")).alias("t")).where(F.size("t") >= least)
    x, y = q.select("query_id", F.size("t").alias("n"), F.explode("t").alias("w")), titles.select("doc_id", F.explode(F.array_distinct(T.tokens("title"))).alias("w"))
    hit = x.join(y, "w").groupBy("query_id", "doc_id", "n").agg(F.count("*").alias("o")).where((F.col("o") >= least) & (F.col("o") >= share * F.col("n")))
    return hit.groupBy("query_id").agg(F.max_by("doc_id", F.struct("o", -F.col("doc_id"))).alias("doc_id"))


def source_records(run: DataFrame, k: int = 5, excerpt: int = 280) -> DataFrame:
    """Per question a list of records: place, file, page, label, excerpt."""
    rec = F.struct("rank", "source", "page", "label", F.substring(F.regexp_replace("text", r"\s+", " "), 1, excerpt).alias("excerpt"))
    return run.where(F.col("rank") <= k).groupBy("query_id").agg(F.array_sort(F.collect_list(rec)).alias("sources"))


def decision_leaf() -> Column:
    """Q1: what a suggestion about a document (status, is_draft, n_articles, replaces, title) may say; NULL without a readable name."""
    leaf = F.when(F.col("status") == "expired", "replaced").when(F.col("status").isin("amended", "partly"), "amended").when(F.col("status") == "not_yet", "not_yet").when(F.col("is_draft"), "draft").when(F.col("n_articles") == 1, "one_article").when(F.col("replaces"), "replaces").otherwise("main")
    return F.when(T.readable_title("title").isNotNull(), leaf)


def same_subject(labels: DataFrame, subject: str, grade: int, n: int = 6) -> DataFrame:
    """Q4: distinct (subject, kind, level, grade) of a subject, the asked grade first, levels in turn."""
    d = labels.where(F.col("subject") == subject).select("subject", "kind", "level", "grade").dropDuplicates()
    turn = F.row_number().over(W.partitionBy("level").orderBy((F.col("grade") != grade), "grade", "kind"))
    return d.withColumn("turn", turn).orderBy("turn", (F.col("grade") != grade), "level").limit(n).drop("turn")


#: Where a phrase may come from, best first.
PHRASES: Mapping[str, str] = {
    "bold": r"\*\*([^*\n]{3,60})\*\*", "bullet": r"(?m)^\s*[-*•]\s+([^:\n]{3,60}):", "quote": r"[\"“]([^\"”\n]{3,60})[\"”]", "proper": r"(?<=[\p{Ll},] )((?:\p{Lu}\p{Ll}+ ){1,3}\p{Lu}\p{Ll}+)",
}


def key_phrases(answers: DataFrame, key: str, text: str, n: int = 3, words: int = 8) -> DataFrame:
    """Q6: key, place, phrase: phrases of up to eight words by kind, then as they come; each once."""
    parts = None
    for k, (kind, p) in enumerate(PHRASES.items()):
        part = answers.select(key, F.lit(k).alias("__k"), F.lit(kind).alias("kind"), F.posexplode(F.regexp_extract_all(text, F.lit(p), F.lit(1))).alias("pos", "phrase"))
        parts = part if parts is None else parts.unionByName(part)
    parts = parts.where(F.size(F.split(F.trim("phrase"), r"\s+")) <= words).groupBy(key, F.lower(F.trim("phrase")).alias("low")).agg(F.min(F.struct("__k", "pos", "phrase", "kind")).alias("m"))
    w = W.partitionBy(key).orderBy("m.__k", "m.pos", "low")
    return parts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select(key, "place", "m.kind", "m.phrase")


#: What is asked of attached files.
ATTACHED = {"about": "Nói rõ hơn về %s", "summary": "Tóm tắt tệp %s", "compare": "So sánh nội dung giữa các tệp đã đính kèm", "parts": "Tệp %s gồm những phần nào?", "meaning": "Ý nghĩa hoặc thông điệp chính của nội dung trong tệp là gì?"}


def attachment_followups(answers: DataFrame, files: DataFrame, key: str = "conv_id", n: int = 4) -> DataFrame:
    """Q11: key, place, text: what to ask next of files(key, place, name) that an answer (key, text) rests on: its two best phrases, a summary of the first
    two files, a comparison where there are more than one, their parts, the meaning; the first n, each text once."""
    told = lambda kind, c: F.format_string(ATTACHED[kind], c)
    near = files.withColumn("nth", F.row_number().over(W.partitionBy(key).orderBy("place", "name"))).where("nth <= 2")
    phrases = key_phrases(answers, key, "text", 2).select(key, told("about", F.col("phrase")).alias("text"), F.col("place").alias("pos"))
    per_file = lambda kind: near.select(key, told(kind, F.col("name")).alias("text"), F.col("nth").alias("pos"))
    many = near.where("nth = 2").select(key, F.lit(ATTACHED["compare"]).alias("text"), F.lit(1).alias("pos"))
    any_ = answers.select(key, F.lit(ATTACHED["meaning"]).alias("text"), F.lit(1).alias("pos"))
    return assembled([phrases, per_file("summary"), many, per_file("parts"), any_], key, n)


def assembled(parts: Sequence[DataFrame], key: str, n: int) -> DataFrame:
    """Q9-Q11: suggestions(key, text) of several tables in the order of the tables; the first n of each key, each text once."""
    union = None
    for k, p in enumerate(parts):
        p = p.select(key, "text", "pos", F.lit(k).alias("__k"))
        union = p if union is None else union.unionByName(p)
    first = union.groupBy(key, F.lower(F.trim("text")).alias("low")).agg(F.min(F.struct("__k", "pos", "text")).alias("m"))
    w = W.partitionBy(key).orderBy("m.__k", "m.pos", "low")
    return first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select(key, "place", "m.text")
