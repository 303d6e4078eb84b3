"""Sources and sinks."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

KINDS = {"pdf": "pdf", "doc": "word", "docx": "word", "ppt": "slides", "pptx": "slides", "xls": "sheet", "xlsx": "sheet", "csv": "sheet", "mp3": "audio", "wav": "audio", "m4a": "audio", "mp4": "video", "html": "web", "htm": "web", "srt": "subtitle", "txt": "text", "md": "text"}


def scan_catalog(spark: SparkSession, folder: str, hashed: bool = False) -> DataFrame:
    """Path, size, modified (and hash, where the contents are to be read) of the supported files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files = files.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(list(KINDS)))
    out = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *([F.sha2("content", 256).alias("hash")] if hashed else []))
    return out.orderBy("path")


def kind_of(path: Column) -> Column:
    """By extension; text where it is unknown."""
    table = F.create_map(*[x for k, v in KINDS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, F.lower(F.element_at(F.split(path, r"\."), -1))), F.lit("text"))


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """S3: path, text of whole files."""
    return spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


@F.pandas_udf(StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def html_to_text(pages: DataFrame, blocks: bool = False, key: str = "page_id", source: str = "html") -> DataFrame:
    """Key, title, text. Scripts and styles go, then tags; with blocks, ends of block elements become line ends, else white space is squeezed."""
    t = F.regexp_replace(source, r"(?is)<(script|style|head)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    if blocks:
        t = F.regexp_replace(t, r"(?i)</(p|div|li|h[1-6]|tr|table|section|article)\s*>|<br\s*/?>", "\n")
    t = unescaped(F.regexp_replace(t, r"(?s)<[^>]+>", " "))
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[ \t\x0b\f\r\xa0]+", " "), r" ?\n ?", "\n"), r"\n{3,}", "\n\n") if blocks else F.regexp_replace(t, r"\s+", " ")
    t = F.regexp_replace(t, r"^\s+|\s+$", "")
    head = F.coalesce(F.nullif(F.regexp_extract(source, r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>", 1), F.lit("")), F.regexp_extract(source, r"(?is)<title[^>]*>(.*?)</title>", 1))
    title = F.substring(F.trim(F.regexp_replace(unescaped(F.regexp_replace(head, r"<[^>]+>", " ")), r"\s+", " ")), 1, 80)
    return pages.select(key, title.alias("title"), t.alias("text"))


def table_to_blocks(rows: DataFrame, order: str, size: int = 40, name: str = "Sheet 1") -> DataFrame:
    """Block, label, text: empty columns and rows go, the header stands above every forty rows; labels only where there are more."""
    cols = [c for c in rows.columns if c != order]
    text = [F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) for c in cols]
    there = rows.agg(*[F.max(t != "").alias(c) for c, t in zip(cols, text, strict=True)]).first()
    cols = [c for c in cols if there[c]]
    line = F.concat_ws("\t", *[F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) for c in cols])
    kept = rows.select(order, line.alias("line")).where(F.translate("line", "\t", "") != "")
    from corpusframe.operators.order import row_numbers

    numbered = row_numbers(kept, order)
    total = kept.agg(F.count("*").alias("total"))
    b = numbered.withColumn("block", F.floor(F.col("row_no") / size))
    body = b.groupBy("block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "line"))), lambda x: x["line"]), "\n").alias("body"), (F.min("row_no") + 1).alias("a"), (F.max("row_no") + 1).alias("b"))
    out = body.crossJoin(F.broadcast(total))
    label = F.when(F.col("total") > size, F.format_string(name + " · rows %d-%d/%d", "a", "b", "total"))
    return out.select("block", label.alias("label"), F.concat(F.lit("\t".join(cols) + "\n"), F.col("body")).alias("text"))


def subtitle_cues(files: DataFrame) -> DataFrame:
    """Path, cue, start, end (seconds), text of subtitle files(path, text). A timing line (hours of one or two digits, one to three of
    milliseconds) opens a cue, a blank line ends one; what follows without a new timing line keeps the last times. Lines of digits
    alone and those that begin with WEBVTT are no text; tags go. Lines are numbered inside their file, cues are islands between
    such lines. cue counts a file's cues from 0."""
    stamp = r"(\d{1,2}):(\d{2}):(\d{2})[,.](\d{1,3})"
    bare = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    parts = files.select("path", F.posexplode(F.split(F.regexp_replace("text", "^\ufeff", ""), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")).alias("i", "line"))
    g = lambda k: F.regexp_extract("line", stamp + r"\s*-->\s*" + stamp, k).try_cast("double")
    sec = lambda k: g(k) * 3600 + g(k + 1) * 60 + g(k + 2) + g(k + 3) / 1000
    parts = parts.select("path", "i", "line", bare(F.col("line")).alias("words"), F.when(sec(1).isNotNull(), F.struct(sec(1).alias("start"), sec(5).alias("end"))).alias("at"))
    order = W.partitionBy("path").orderBy("i")
    opens = F.col("at").isNotNull() | (F.col("words") == "")
    parts = parts.withColumns({"island": F.sum(opens.cast("int")).over(order), "at": F.last("at", True).over(order), "timing": F.col("at").isNotNull()})
    parts = parts.where(~F.col("timing") & F.col("at").isNotNull() & (F.col("words") != "") & ~F.col("words").rlike(r"^\p{Nd}+$") & ~F.startswith("line", F.lit("WEBVTT")))
    lists = parts.groupBy("path", "island").agg(F.first("at").alias("at"), F.array_sort(F.collect_list(F.struct("i", "words"))).alias("l"))  # a cue's lines
    text = bare(F.regexp_replace(F.array_join(F.transform("l", lambda x: x["words"]), " "), "<[^>]+>", ""))
    cues = lists.select("path", "island", "at.start", "at.end", text.alias("text")).where("text <> ''")
    return cues.withColumn("cue", F.row_number().over(W.partitionBy("path").orderBy("island")) - 1).select("path", "cue", "start", "end", "text")


def subtitle_blocks(cues: DataFrame, least: int = 900) -> DataFrame:
    """Cues joined until a block has so many characters (a blank each); the last block may be shorter. A fold over a file's cues."""
    item = F.struct("cue", "start", "end", "text")
    lists = cues.groupBy("path").agg(F.array_sort(F.collect_list(item)).alias("c"))
    kind = "array<struct<start:double,end:double,text:string>>"

    def step(acc: Column, x: Column) -> Column:
        new = F.array_append(acc, F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text")))
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), x["end"].alias("end"), F.concat_ws(" ", last["text"], x["text"]).alias("text"))))
        return F.when((F.size(acc) == 0), new).when(F.char_length(last["text"]) + 1 >= least, new).otherwise(grown)

    safe = F.aggregate("c", F.array().cast(kind), lambda a, x: F.when(F.size(a) == 0, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text")))).otherwise(step(a, x)))
    return lists.select("path", F.posexplode(safe).alias("block", "b")).select("path", "block", "b.start", "b.end", "b.text")


def read_register(spark: SparkSession, path: str, schema: str, key: str | None = None, order: str | None = None) -> DataFrame:
    """JSON lines; broken lines drop out, a missing file is an empty table; with a key the last record of each wins."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    if key:
        rows = rows.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("__r = 1").drop("__r")
    return rows


def write_report(rows: DataFrame, path: str, *order: str) -> None:
    """A CSV report with a header, sorted."""
    rows.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def markdown_table(metrics: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """One text: fixed columns, a row per group, numbers with three places."""
    cell = [F.when(F.col(c).isNull(), "total").otherwise(F.col(c)) if dict(metrics.dtypes)[c] == "string" else F.format_string("%.3f", F.col(c).cast("double")) for c in columns]
    rows = metrics.select(F.struct(*[F.col(c).isNull() for c in order], *order).alias("o"), F.concat(F.lit("| "), F.concat_ws(" | ", *cell), F.lit(" |")).alias("r"))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns) + "\n"
    return rows.agg(F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "r"))), lambda x: x["r"]), "\n")).alias("table"))


def remote_listing(spark: SparkSession, path: str) -> DataFrame:
    """Id, name, mime, size, md5, modified of a JSON manifest."""
    m = spark.read.option("multiLine", True).schema("files array<struct<id:string,name:string,mimeType:string,size:bigint,md5Checksum:string,modifiedTime:string>>").json(path)
    return m.select(F.explode("files").alias("f")).select("f.id", "f.name", F.col("f.mimeType").alias("mime"), "f.size", F.col("f.md5Checksum").alias("md5"), F.col("f.modifiedTime").alias("modified"))
