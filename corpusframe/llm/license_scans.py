"""License scans: a positional index of rare words finds where licence templates stand in a text.

For every template the two words of its mandatory phrases that are rarest in the corpus are indexed with their places. A
file's postings for the rarest words are intersected with those for the second by (template, place in the text); what is
left is verified by the mandatory phrases and scored by the share of the template, weighted by idf, that stands there.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusframe.llm.common import ascii_lower, read

WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"


class Template(NamedTuple):
    """words stand at consecutive places; a text carries the template where all mandatory phrases, given as runs of its words, do."""

    label: str
    words: str
    mandatory: tuple[str, ...]
    base: bool = False


#: Texts of short public licences, as words.
MIT_TEXT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
    "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
ISC_TEXT = (
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
    "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
)
BSD_TEXT = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
ZLIB_TEXT = (
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"
)
#: The three base phrases, then lines and texts by which public licences are known.
TEMPLATES = (
    Template("mit", "mit license", ("mit license",), True),
    Template("apache", "apache license", ("apache license",), True),
    Template("gpl", "general public license", ("general public license",), True),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    Template("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("zlib", ZLIB_TEXT, ("provided as is", "alter it and redistribute it freely")),
    Template("mit-text", MIT_TEXT, ("permission is hereby granted", "free of charge")),
    Template("isc", ISC_TEXT, ("distribute this software", "with or without fee")),
    Template("bsd", BSD_TEXT, ("redistribution and use", "source and binary forms")),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)


def _runs(t: Template) -> list[tuple[int, list[str]]]:
    """(place in the template, words) of its mandatory phrases."""
    words, out = t.words.split(), []
    for phrase in t.mandatory:
        p = phrase.split()
        out.append((next(i for i in range(len(words)) if words[i : i + len(p)] == p), p))
    return out


def words_column(text: str = "text") -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))


def template_idf(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, float]:
    """ln((N + 1) / (df + 1)) of every template word over all rows; as many rows reach the driver as templates have words."""
    vocabulary = sorted({w for t in templates for w in t.words.split()})
    own = F.array_intersect(words_column(), F.lit(vocabulary))
    counts = docs.select(F.explode(F.concat(own, F.array(F.lit("")))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    df = {r["w"]: r["n"] for r in counts}
    return {w: math.log((df.get("", 0) + 1) / (df.get(w, 0) + 1)) for w in vocabulary}


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """A file's highest-IDF licence words are looked up per template: a place needs all words of the template's mandatory phrases, so
    of those the two rarest over all documents are also the file's two rarest, and no place is missed.

    Per row of docs(doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places.

    places holds (label, word, base, score) of every verified place; word may be negative where a text begins inside a
    template. n_base, first_word and last_word cover the base templates alone. A null text counts as empty: no words, null
    places of words, empty labels, score 0. Rows stay one to one (repeated ones are judged alike); other columns are not
    read. Nothing is exchanged but the document frequencies of the template words.
    """
    idf = template_idf(docs, templates)
    rare: tuple[dict, dict] = {}, {}
    longest = max(len(t.words.split()) for t in templates)  # no place lies further before the text
    for k, t in enumerate(templates):
        anchors = sorted({(-idf[w], w, at + i) for at, run in _runs(t) for i, w in enumerate(run)})[:2]
        for place, (_, w, p) in zip(rare, anchors, strict=True):
            place.setdefault(w, []).append((k, p))

    def index(of: dict) -> Column:
        return F.create_map(*[x for w in sorted(of) for x in (F.lit(w), F.array(*[F.struct(F.lit(k).alias("t"), F.lit(p).alias("p")) for k, p in of[w]]))])

    def postings(of: dict) -> Column:
        known, table = F.lit(sorted(of)), index(of)
        hits = F.filter(F.transform("w", lambda x, i: F.when(F.array_contains(known, x), F.struct(i.alias("i"), x.alias("x")))), lambda h: h.isNotNull())
        # template and place in one whole number: those are intersected by hash, structs would be by all pairs
        return F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(table, h["x"]), lambda q: F.shiftleft(q["t"].cast("long"), 32) + (h["i"] - q["p"] + longest))))

    opened = lambda c: F.struct(F.shiftright(c, 32).cast("int").alias("t"), (c.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int") - longest).alias("s"))
    array = lambda xs: F.array(*xs)
    runs = array([array([F.struct(F.lit(at).alias("at"), F.lit(run).alias("run")) for at, run in _runs(t)]) for t in templates])
    body = array([array([F.struct(F.lit(w).alias("w"), F.lit(idf[w]).alias("idf")) for w in t.words.split()]) for t in templates])
    weight = F.lit([max(sum(idf[w] for w in t.words.split()), 1e-9) for t in templates])
    stands = lambda c: F.forall(runs[c["t"]], lambda k: F.when(c["s"] + k["at"] < 0, False).otherwise(F.slice("w", c["s"] + k["at"] + 1, F.size(k["run"])) == k["run"]))
    share = lambda c: F.aggregate(F.transform(body[c["t"]], lambda q, j: F.when(F.get("w", c["s"] + j) == q["w"], q["idf"]).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x) / weight[c["t"]]

    rows = docs.select("doc_id", words_column().alias("w"))
    found = F.filter(F.transform(F.array_intersect(postings(rare[0]), postings(rare[1])), opened), stands)
    rows = rows.withColumn("c", F.when(F.arrays_overlap("w", F.lit(sorted(rare[0]))), found))
    place = lambda c: F.struct(F.lit([t.label for t in templates])[c["t"]].alias("label"), c["s"].cast("long").alias("word"), F.lit([t.base for t in templates])[c["t"]].alias("base"), F.round(share(c), 6).alias("score"))
    rows = rows.select("doc_id", F.size("w").cast("long").alias("n_words"), F.transform("c", place).alias("places"))
    base = F.filter("places", lambda p: p["base"])
    joined = lambda of: F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda p: p["label"]))), ","), F.lit(""))
    at = F.transform(base, lambda p: p["word"])
    return rows.select(
        "doc_id", "n_words", F.when(F.col("places").isNull(), 0).otherwise(F.size(base)).cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), joined(base).alias("base_labels"), joined(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"), F.coalesce("places", F.array().cast("array<struct<label:string,word:bigint,base:boolean,score:double>>")).alias("places"),
    )


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents")).drop("places")


def oracle() -> str:
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    values = ", ".join(
        f"({k}, '{t.label}', {t.base}, {quoted(t.words.split())}, {runs[0][0]}, '{runs[0][1][0]}', [{', '.join(f'{{pos: {at}, run: {quoted(run)}}}' for at, run in runs)}])"
        for k, t in enumerate(TEMPLATES) for runs in [_runs(t)]
    )
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(replace(coalesce(text, ''), chr(8490), 'ĸ')), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
    t(t, label, base, words, pos, word, runs) AS (VALUES {values}),
    v AS (SELECT DISTINCT unnest(words) AS x FROM t),
    u AS (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM d),
    h AS (SELECT u.* FROM u SEMI JOIN v ON u.x = v.x),
    idf AS (SELECT v.x, ln(((SELECT count(*) FROM d) + 1) / (count(DISTINCT rid) + 1)) AS idf FROM v LEFT JOIN h ON v.x = h.x GROUP BY v.x),
    p AS (SELECT d.rid, d.w, t.*, h.i - t.pos AS s FROM h JOIN t ON h.x = t.word JOIN d ON d.rid = h.rid),
    ok AS (SELECT * FROM p WHERE len(list_filter(runs, lambda k: w[s + k.pos + 1 : s + k.pos + len(k.run)] = k.run AND s + k.pos >= 0)) = len(runs)),
    tw AS (SELECT t, unnest(words) AS x, generate_subscripts(words, 1) - 1 AS j FROM t),
    sc AS (SELECT ok.rid, ok.t, ok.s, round(sum(CASE WHEN h.i IS NOT NULL THEN idf.idf ELSE 0 END) / greatest(sum(idf.idf), 1e-9), 6) AS score
           FROM ok JOIN tw ON tw.t = ok.t JOIN idf ON idf.x = tw.x LEFT JOIN h ON h.rid = ok.rid AND h.i = ok.s + tw.j AND h.x = tw.x GROUP BY ALL),
    g AS (SELECT ok.rid, count(*) FILTER (base) AS n_base, min(ok.s) FILTER (base) AS first_word, max(ok.s) FILTER (base) AS last_word,
                 array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(score) AS score
          FROM ok JOIN sc ON ok.rid = sc.rid AND ok.t = sc.t AND ok.s = sc.s GROUP BY ok.rid)
    SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
    FROM d LEFT JOIN g ON d.rid = g.rid"""
