"""Queries T1-T20 over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusframe.functions import text as T
from corpusframe.operators import text_jobs as J
from corpusframe.plans.inputs import PARAGRAPHS, paragraphs, table

BLOCK = {"insult": ("idiot", "moron", "scum", "worthless"), "waste": ("trash", "loser of the", "que la")}
ALLOWED = ("moron from",)
MARKERS = ("it", "that", "this", "que", "das")


def _digest(words, name="words"):
    return F.md5(F.array_join(words, " ")).alias(name)


def q(f):
    return lambda s, d: f(table(s, d, "documents"))


QUERIES = {
    "T1_tokens": q(lambda d: d.select("doc_id", F.size(T.tokens("text")).alias("n"), _digest(T.tokens("text")))),
    "T2_fold_accents": q(lambda d: d.select("doc_id", F.md5(T.fold_accents("text")).alias("folded"))),
    "T3_split_camel_num": q(lambda d: d.select("doc_id", F.md5(T.split_camel_num("text")).alias("parts"))),
    "T4_tokens_expanded": q(lambda d: d.select("doc_id", F.size(T.tokens_expanded("text")).alias("n"), _digest(T.tokens_expanded("text")))),
    "T4_postings": lambda s, d: J.tokenize_documents(table(s, d, "documents"), "doc_id", "text"),
    "T5_expand_query": lambda s, d: table(s, d, "conversations").where("role = 'user'").select("conv_id", "turn", _digest(T.expand_query(F.concat(F.lit("TKB cấp 2 AI "), "text")))),
    "T6_spell_out": lambda s, d: table(s, d, "conversations").select("conv_id", "turn", F.md5(T.spell_out(F.concat(F.lit("GV  thpt cấp 3 "), "text"))).alias("said")),
    "T7_compact": q(lambda d: d.select("doc_id", F.md5(T.compact("text")).alias("packed"), F.char_length(T.compact("text")).alias("n"))),
    "T7_positions": lambda s, d: table(s, d, "benchmark").select("item_id", F.size(T.compact_positions("text")).alias("n"), F.array_max(T.compact_positions("text")).alias("last")),
    "T8_clean_ocr": q(lambda d: d.select("doc_id", F.md5(T.clean_ocr("text")).alias("cleaned"))),
    "T9_thin_text": lambda s, d: J.thin_texts(paragraphs(s, d), "doc_id", "seq", "text"),
    "T10_detect_language": q(lambda d: d.select("doc_id", J.detect_language().alias("language"))),
    "T8_T10_profile": q(J.profile_text),
    "T11_numbers": lambda s, d: table(s, d, "orders").select("o_orderkey", T.format_vn_number(F.col("o_totalprice")).alias("shown"), T.parse_vn_number(T.format_vn_number(F.col("o_totalprice"))).alias("read")),
    "T13_flag_blocked": lambda s, d: (lambda r: r.select("doc_id", F.array_join("groups", ",").alias("groups"), F.array_join(F.array_sort("matched"), ",").alias("matched")))(J.flag_blocked(table(s, d, "documents").select("doc_id", "text"), BLOCK, allowed=ALLOWED)),
    "T15_fingerprints": q(lambda d: d.select("doc_id", T.content_hash("text").alias("content"), T.chunk_key("source", "lang", "text").alias("chunk_key"))),
    "T17_readable_title": lambda s, d: table(s, d, "pages").select("page_id", T.readable_title(F.regexp_extract("html", "<title>([^<]*)", 1)).alias("title")),
    "T18_first_url": lambda s, d: table(s, d, "pages").select("page_id", T.first_url(F.concat(F.lit("see "), "url", F.lit("). ok"))).alias("found")),
    "T19_short_title": lambda s, d: table(s, d, "conversations").select("conv_id", "turn", T.short_title("text").alias("title")),
    "T16_key_sentences": lambda s, d: J.key_sentences(table(s, d, "conversations").where("role = 'assistant'").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("passage_id"), "text").join(table(s, d, "conversations").where("role = 'user' and turn = 0").select(F.col("conv_id").alias("query_id"), F.col("text").alias("question")), "query_id")),
    "T20_followup": lambda s, d: J.followup_queries(table(s, d, "conversations"), MARKERS),
    "T14_preview_term": lambda s, d: J.preview_term(table(s, d, "documents").select("doc_id", "text"), "pathetic", BLOCK, "doc_id", 500).select("blocked", F.size("examples").alias("shown")),
}


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def tok(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 1 AND NOT list_contains({_list(T.STOP_WORDS)}, x))"


def fold(c: str) -> str:
    return f"translate({c}, '{T.FOLD_FROM}', '{T.FOLD_TO}')"


def camel(c: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({c}, '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g'), '(\\p{{L}})(\\p{{Nd}})', '\\1 \\2', 'g'), '(\\p{{Nd}})(\\p{{L}})', '\\1 \\2', 'g')"


def expanded(c: str, table_: str, key: str) -> str:
    """CTE x(key, i, w): the T4 tokens and their order."""
    return f"""x0 AS (SELECT {key}, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM (SELECT {key}, {tok(camel(c))} AS t FROM {table_})),
      x1 AS (SELECT {key}, {fold('w')} AS w, min(i) + 1000000 AS i FROM x0 GROUP BY ALL), x AS (SELECT {key}, i, w FROM x0 UNION ALL SELECT {key}, i, w FROM x1 ANTI JOIN x0 USING ({key}, w))"""


def sql_lang() -> str:
    words = f"list_distinct(regexp_extract_all({fold('lower(text)')}, '[a-z]+'))"
    extra = {lang: f" + CASE WHEN regexp_matches(lower(text), '{p}') THEN 2 ELSE 0 END" for p, lang in J.TELLING_LETTERS}
    scores = "[" + ", ".join(f"len(list_intersect({words}, {_list(sorted(set(v.split())))})){extra.get(k, '')}" for k, v in J.FREQUENT_WORDS.items()) + "]"
    scripts = " ".join(f"WHEN regexp_matches(text, '{p.replace('(?iu)', '(?i)')}') THEN '{lang}'" for p, lang in J.SCRIPTS)
    return f"SELECT doc_id, source, text, CASE {scripts} WHEN list_max(s) = s[1] THEN 'en' ELSE {_list(J.FREQUENT_WORDS)}[list_position(s, list_max(s))] END AS language FROM (SELECT doc_id, source, text, {scores} AS s FROM documents)"


_LOST = f"""(length(regexp_replace(lower(text), '[^\\p{{L}}]', '', 'g')) >= 300 AND length(regexp_replace(lower(text), '[^{T.VIETNAMESE_ACCENTED}]', '', 'g')) / length(regexp_replace(lower(text), '[^\\p{{L}}]', '', 'g')) < 0.03
 AND len(regexp_extract_all(lower(text), '[a-z]+')) > 0 AND len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: list_contains({_list(T.BARE_FUNCTION_WORDS)}, w))) / len(regexp_extract_all(lower(text), '[a-z]+')) > 0.08)"""
_CLEAN = f"""regexp_replace(regexp_replace(translate(text, '{T.OCR_JUNK}', '{" " * len(T.OCR_JUNK)}'), '[ \\t]{{2,}}', ' ', 'g'), '(?m)[ \\t]+$', '', 'g')"""

ORACLE_SQL = {
    "T1_tokens": f"SELECT doc_id, CAST(len(t) AS INT) AS n, md5(array_to_string(t, ' ')) AS words FROM (SELECT doc_id, {tok('text')} AS t FROM documents)",
    "T2_fold_accents": "SELECT doc_id, md5(replace(replace(strip_accents(text), 'đ', 'd'), 'Đ', 'D')) AS folded FROM documents",
    "T3_split_camel_num": f"SELECT doc_id, md5({camel('text')}) AS parts FROM documents",
    "T4_tokens_expanded": f"WITH {expanded('text', 'documents', 'doc_id')} SELECT doc_id, CAST(count(w) AS INT) AS n, md5(coalesce(string_agg(w, ' ' ORDER BY i), '')) AS words FROM documents LEFT JOIN x USING (doc_id) GROUP BY doc_id",
    "T4_postings": f"WITH {expanded('text', 'documents', 'doc_id')} SELECT doc_id, w AS term, count(*) AS tf FROM x GROUP BY ALL",
    "T7_compact": f"SELECT doc_id, md5(p) AS packed, CAST(length(p) AS INT) AS n FROM (SELECT doc_id, regexp_replace(lower({fold('text')}), '\\s+', '', 'g') AS p FROM documents)",
    "T7_positions": "SELECT item_id, CAST(length(regexp_replace(text, '\\s', '', 'g')) AS INT) AS n, CAST(length(regexp_replace(text, '\\s+$', '')) - 1 AS INT) AS last FROM benchmark",
    "T8_clean_ocr": f"SELECT doc_id, md5({_CLEAN}) AS cleaned FROM documents",
    "T9_thin_text": f"WITH {PARAGRAPHS} SELECT doc_id, CAST(sum(length(trim(text))) AS BIGINT) AS chars, count(DISTINCT seq) AS pages, sum(length(trim(text))) < 80 * count(DISTINCT seq) AS thin FROM paragraphs GROUP BY doc_id",
    "T10_detect_language": f"SELECT doc_id, language FROM ({sql_lang()})",
    "T8_T10_profile": f"SELECT source, language, lost, count(*) AS texts, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (WHERE dirty) AS dirty FROM (SELECT *, {_LOST} AS lost, {_CLEAN} <> text AS dirty FROM ({sql_lang()})) GROUP BY ALL",
    "T11_numbers": "SELECT o_orderkey, translate(regexp_replace(regexp_replace(format('{:,.6f}', round(o_totalprice, 6)), '0+$', ''), '\\.$', ''), ',.', '.,') AS shown, o_totalprice AS read FROM orders",
    "T15_fingerprints": "SELECT doc_id, sha256(text) AS content, sha1(source || chr(31) || lang || chr(31) || text) AS chunk_key FROM documents",
    "T18_first_url": "SELECT page_id, url AS found FROM pages",
    "T19_short_title": "SELECT conv_id, turn, CASE WHEN length(t) <= 80 THEN t ELSE rtrim(t[1:79]) || '…' END AS title FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations)",
    "T20_followup": f"""WITH p AS (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS previous, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM conversations),
      f AS (SELECT *, previous IS NOT NULL AND (len(w) <= 12 OR list_has_any(w, {_list(MARKERS)})) AS follows FROM p WHERE role = 'user')
      SELECT conv_id, turn, follows, CASE WHEN follows THEN previous || ' ' || text ELSE text END AS query FROM f""",
}
