"""Queries U1-U13, Q2-Q8 over events as turns and over conversations."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from corpusframe.functions import text as T
from corpusframe.operators import usage as U
from corpusframe.plans.inputs import TURNS, table, turns

CUT = "timestamp'2024-01-20 00:00:00'"
GROUPS = ["error", "click", "purchase", "none"]


def _convs(s, d):
    t = turns(s, d)
    return t.groupBy("conv_id").agg(F.min_by("question", F.struct("at", "turn_id")).alias("title"), F.min("at").alias("at"), F.first("client").alias("client"))


def _long(s, d):
    """Conversations that last as long as their client is there."""
    t = turns(s, d).withColumn("conv_id", F.col("client"))
    return t, t.groupBy("conv_id").agg(F.min_by("question", F.struct("at", "turn_id")).alias("title"), F.min("at").alias("at"))


def _blocks(s, d):
    e = table(s, d, "events")
    return e.select(F.when(F.col("value") > 50, F.array("event_type", F.lit("click"))).otherwise(F.array("event_type")).alias("groups"), F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("role"), F.col("ts").alias("at"))


def _pairs():
    w = T.raw_tokens(T.fold_accents("text"))
    return F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


QUERIES = {
    "U1_totals": lambda s, d: U.usage_totals(turns(s, d), F.expr(CUT)),
    "U2_slowest": lambda s, d: U.slowest(turns(s, d)),
    "U3_repeated": lambda s, d: U.repeated(turns(s, d)),
    "U4_refused": lambda s, d: U.repeated(turns(s, d).where("refused"), least=1),
    "U5_per_role": lambda s, d: U.per_role(turns(s, d)).withColumn("top", F.array_join("top", "|")),
    "U6_labels": lambda s, d: U.label_counts(turns(s, d)),
    "U7_blocks": lambda s, d: U.block_statistics(_blocks(s, d), GROUPS),
    "U8_conversations": lambda s, d: U.conversation_list(_convs(s, d).select("conv_id", "title", "at"), turns(s, d)),
    "U9_detail": lambda s, d: U.conversation_detail(turns(s, d)).withColumn("questions", F.array_join("questions", "|")),
    "U10_latest": lambda s, d: U.latest_questions(turns(s, d), 500),
    "U11_delete": lambda s, d: U.delete_owner(turns(s, d), turns(s, d).where("seconds > 250").select("client").distinct()).select("turn_id"),
    "U11_transfer": lambda s, d: U.transfer(turns(s, d), turns(s, d).where("seconds > 250").groupBy("client").agg(F.lit("merged").alias("new_client"))).groupBy("client").agg(F.count("*").alias("n")),
    "U12_retention": lambda s, d: U.retention(*_long(s, d), F.expr(CUT)),
    "U13_upsert": lambda s, d: U.upsert_turns(turns(s, d), _convs(s, d)),
    "Q2_round_robin": lambda s, d: U.round_robin(table(s, d, "documents"), "source", "doc_id", "text").select("source", "round", "place", F.md5("text").alias("text")),
    "Q3_fuzzy_unique": lambda s, d: U.fuzzy_unique(table(s, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("t")))), lambda x: x["t"]).alias("texts")), "conv_id", "texts").select("conv_id", F.array_join("kept", "|").alias("kept")),
    "Q5_title_overlap": lambda s, d: U.title_overlap(table(s, d, "benchmark").select("item_id", "text"), table(s, d, "conversations").where("turn = 0").select("conv_id", "text"), "item_id", "conv_id", _pairs()),
    "Q8_cited": lambda s, d: U.cited_sources(table(s, d, "documents").select("doc_id", F.concat(F.lit("as in ["), F.length("lang") + F.col("n_chars") % 3, F.lit("]")).alias("answer"), F.array("source", "lang", F.lit("z")).alias("sources"))).select("doc_id", F.array_join("kept", ",").alias("kept")),
}
_CONVS = f"{TURNS}, convs AS (SELECT conv_id, arg_min(question, (at, turn_id)) AS title, min(at) AS at, any_value(client) AS client FROM turns GROUP BY conv_id)"
_PAIR = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
ORACLE_SQL = {
    "U1_totals": f"WITH {TURNS} SELECT count(*) AS turns, count(DISTINCT conv_id) AS conversations, round(avg(seconds), 3) AS avg_seconds, count(*) FILTER (WHERE refused) AS refused, count(*) FILTER (WHERE from_cache) AS cached, count(*) FILTER (WHERE NOT citation_ok) AS bad_citations, count(*) FILTER (WHERE NOT figures_ok) AS bad_figures, round(count(*) FILTER (WHERE refused) / count(*), 3) AS refusal_rate, round(count(*) FILTER (WHERE from_cache) / count(*), 3) AS cache_rate FROM turns WHERE at >= TIMESTAMP '2024-01-20'",
    "U2_slowest": f"WITH {TURNS} SELECT turn_id, question, seconds FROM turns ORDER BY seconds DESC, turn_id LIMIT 10",
    "U3_repeated": f"WITH {TURNS} SELECT arg_min(question, (at, turn_id)) AS question, count(*) AS n FROM turns GROUP BY lower(trim(question)) HAVING count(*) > 1 ORDER BY count(*) DESC, lower(trim(question)) LIMIT 15".replace("GROUP BY lower(trim(question))", "GROUP BY lower(trim(turns.question))").replace("count(*) DESC, lower(trim(question))", "count(*) DESC, lower(trim(turns.question))"),
    "U4_refused": f"WITH {TURNS} SELECT arg_min(question, (at, turn_id)) AS question, count(*) AS n FROM turns WHERE refused GROUP BY lower(trim(turns.question)) ORDER BY count(*) DESC, lower(trim(turns.question)) LIMIT 15",
    "U5_per_role": f"WITH {TURNS}, q AS (SELECT role, question, row_number() OVER (PARTITION BY role ORDER BY count(*) DESC, max(at) DESC, question) AS r FROM turns GROUP BY role, question), t AS (SELECT role, string_agg(question, '|' ORDER BY r) AS top FROM q WHERE r <= 5 GROUP BY role) SELECT role, count(*) AS turns, round(count(*) FILTER (WHERE refused) / count(*), 3) AS refusal_rate, round(avg(seconds), 3) AS avg_seconds, any_value(top) AS top FROM turns JOIN t USING (role) GROUP BY role",
    "U6_labels": f"WITH {TURNS} SELECT json_extract_string(detail, '$.k') AS label, count(*) AS n FROM turns GROUP BY 1 HAVING label IS NOT NULL",
    "U7_blocks": """WITH b AS (SELECT CASE WHEN value > 50 THEN [event_type, 'click'] ELSE [event_type] END AS groups, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS role, ts AS at FROM events),
      g AS (SELECT name, count(*) AS n FROM (SELECT unnest(list_distinct(groups)) AS name FROM b) GROUP BY name) SELECT 'total' AS kind, '' AS name, count(*) AS n FROM b UNION ALL SELECT 'group', x.name, coalesce(n, 0) FROM (SELECT unnest(['error', 'click', 'purchase', 'none']) AS name) x LEFT JOIN g USING (name)
      UNION ALL SELECT 'role', role, count(*) FROM b GROUP BY role UNION ALL SELECT 'day', strftime(at, '%Y-%m-%d'), count(*) FROM b GROUP BY 2""",
    "U8_conversations": f"WITH {_CONVS} SELECT c.conv_id, title, c.at, count(t.turn_id) AS turns FROM convs c LEFT JOIN turns t USING (conv_id) GROUP BY ALL ORDER BY c.at DESC, c.conv_id LIMIT 200",
    "U9_detail": f"WITH {TURNS} SELECT conv_id, string_agg(question, '|' ORDER BY at, turn_id) AS questions FROM turns GROUP BY conv_id",
    "U10_latest": f"WITH {TURNS} SELECT turn_id, question FROM turns ORDER BY at DESC, turn_id DESC LIMIT 500",
    "U11_delete": f"WITH {TURNS} SELECT turn_id FROM turns WHERE client NOT IN (SELECT client FROM turns WHERE seconds > 250)",
    "U11_transfer": f"WITH {TURNS} SELECT CASE WHEN client IN (SELECT client FROM turns WHERE seconds > 250) THEN 'merged' ELSE client END AS client, count(*) AS n FROM turns GROUP BY 1".replace("GROUP BY 1", "GROUP BY CASE WHEN client IN (SELECT client FROM turns WHERE seconds > 250) THEN 'merged' ELSE client END"),
    "U12_retention": f"WITH {TURNS}, c AS (SELECT client AS conv_id, arg_min(question, (at, turn_id)) AS title, min(at) AS at FROM turns GROUP BY client), f AS (SELECT client AS conv_id, arg_min(question, (at, turn_id)) AS t, min(at) AS f FROM turns WHERE at >= TIMESTAMP '2024-01-20' GROUP BY client) SELECT conv_id, CASE WHEN at < TIMESTAMP '2024-01-20' AND f IS NOT NULL THEN t ELSE title END AS title, CASE WHEN at < TIMESTAMP '2024-01-20' AND f IS NOT NULL THEN f ELSE at END AS at FROM c LEFT JOIN f USING (conv_id) WHERE f IS NOT NULL OR at >= TIMESTAMP '2024-01-20'",
    "U13_upsert": f"WITH {_CONVS} SELECT turn_id, CASE WHEN regexp_matches(t.conv_id, '^[A-Za-z0-9_-]{{8,64}}$') AND c.client = t.client THEN t.conv_id ELSE 'new-' || turn_id END AS goes_to FROM turns t LEFT JOIN convs c USING (conv_id)",
    "Q2_round_robin": "WITH r AS (SELECT source, md5(text[1:120]) AS text, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS round FROM documents) SELECT *, CAST(row_number() OVER (PARTITION BY round ORDER BY source) AS INT) AS place FROM r",
    "Q5_title_overlap": f"WITH a AS (SELECT item_id, unnest({_PAIR}) AS p FROM (SELECT item_id, regexp_extract_all(lower(replace(strip_accents(text), 'đ', 'd')), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark)), b AS (SELECT conv_id, unnest({_PAIR}) AS p FROM (SELECT conv_id, regexp_extract_all(lower(replace(strip_accents(text), 'đ', 'd')), '[\\p{{L}}\\p{{N}}]+') AS w FROM conversations WHERE turn = 0)) SELECT item_id, conv_id, count(*) AS shared FROM a JOIN b USING (p) GROUP BY ALL HAVING count(*) >= 2",
    "Q8_cited": "SELECT doc_id, CASE length(lang) + n_chars % 3 WHEN 1 THEN source WHEN 2 THEN lang WHEN 3 THEN 'z' ELSE source || ',' || lang || ',z' END AS kept FROM documents",
}
#: "at" is a word of DuckDB's own.
ORACLE_SQL = {k: re.sub(r"(?<![\w\"'])at(?![\w\"'])", '"at"', v) for k, v in ORACLE_SQL.items()}
