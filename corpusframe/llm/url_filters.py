"""URL filters: host rules first, then a weighted vocabulary found by Aho-Corasick.

Terms count only between characters that are neither letters nor digits. One strict term rejects; soft terms reject when
at least two different ones are there and their weights reach the limit.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusframe.llm.common import read

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Default vocabulary: words one of which rejects an address, by kind; and words that reject two together, with their weights. Both are parameters of judge_urls.
STRICT = tuple(
    "porn porno pornhub xxx xvideos hentai milf camgirl camgirls sexcam escort escorts hookup hookups nudes "
    "casino sportsbook betting slotmachine viagra cialis levitra xanax tramadol "
    "warez keygen malware ransomware phishing botnet carding counterfeit".split()
)
SOFT = {
    "free": 0.5, "win": 0.5, "farm": 0.5, "deal": 0.5, "deals": 0.5, "sale": 0.5, "bonus": 0.5, "promo": 0.5, "coupon": 0.5, "click": 0.5, "offer": 0.5, "prize": 0.5,
    "cheap": 1.0, "pills": 1.0, "pill": 1.0, "pharmacy": 1.0, "ads": 1.0, "adserver": 1.0, "track": 1.0, "tracker": 1.0, "loan": 1.0, "loans": 1.0, "payday": 1.0, "credit": 0.5, "adult": 1.0, "sexy": 1.0, "sex": 1.0, "nude": 1.0,
    "crack": 1.0, "cracked": 1.0, "serial": 0.5, "torrent": 1.0, "torrents": 1.0, "proxy": 0.5, "replica": 1.0, "replicas": 1.0, "lottery": 1.0, "jackpot": 1.0, "slots": 1.0, "roulette": 1.0,
    "bet": 1.5, "bets": 1.5, "poker": 1.5, "spam": 1.5, "seo": 1.0, "backlink": 1.0, "backlinks": 1.0, "dating": 1.0, "singles": 1.0, "webcam": 1.0, "dieting": 0.5, "forex": 1.0, "bitcoin": 0.5, "miner": 1.0,
}
SOFT_LIMIT = 2.0
AZ, az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary_hits(strict: Sequence[str], soft: Mapping[str, float]):
    """A vectorised function: url -> n_strict, n_soft (different terms), soft_weight."""
    terms = {**{t: (t, 0.0, True) for t in strict}, **{t: (t, float(w), False) for t, w in soft.items()}}

    @F.pandas_udf("n_strict int, n_soft int, soft_weight double")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick  # needed by this operator alone, on executors

        find = ahocorasick.Automaton()
        for term, value in terms.items():
            find.add_word(term, value)
        find.make_automaton()
        free = lambda text, i: not (0 <= i < len(text)) or not (text[i].isascii() and text[i].isalnum())
        for urls in batches:
            out = []
            for url in urls.fillna(""):
                found = {v for end, v in find.iter(url) if free(url, end + 1) and free(url, end - len(v[0]))}
                soft_found = sorted(v[1] for v in found if not v[2])
                out.append((len(found) - len(soft_found), len(soft_found), sum(soft_found)))
            yield pd.DataFrame(out, columns=["n_strict", "n_soft", "soft_weight"])

    return hits


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, strict: Sequence[str] = STRICT, soft: Mapping[str, float] = SOFT, soft_limit: float = SOFT_LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, n_strict, n_soft of every row of pages(page_id, url).

    A rule (verdict, host, path) fits its host and all subdomains when the url's path starts with the rule's; the longest
    wins and overrides the vocabulary. A null url, or one without ``://``, has empty host and path, fits no rule and is
    judged by its text alone (null: allow). Rows stay one to one: repeated rows are judged alike, other columns are not
    read. Rules and terms are parameters of the job, so they are small whatever the table's size.
    """
    rest = r"(?s)://([^/?#]*)([^?#]*)"
    urls = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"))
    urls = urls.select("page_id", "url", F.translate(F.regexp_extract("url", rest, 1), AZ, az).alias("host"), F.regexp_extract("url", rest, 2).alias("path"))
    rule = verdict = F.lit(None).cast("string")
    for said, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    judged = urls.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), vocabulary_hits(strict, soft)(F.translate("url", AZ, az)).alias("v"))
    bad = (F.col("v.n_strict") > 0) | (F.col("v.n_soft") >= 2) & (F.col("v.soft_weight") >= soft_limit)
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(bad, "block").otherwise("allow")).alias("verdict"), "v.n_strict", "v.n_soft")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"))


def oracle() -> str:
    has = lambda t: f"CAST(regexp_matches(low, '(^|[^0-9a-z]){t}([^0-9a-z]|$)') AS INT)"
    n_strict, n_soft = " + ".join(map(has, STRICT)), " + ".join(map(has, SOFT))
    weight = " + ".join(f"{w} * {has(t)}" for t, w in SOFT.items())
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in sorted(RULES, key=lambda r: -len(r[1]) - len(r[2]))]
    pick = lambda i, other: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[i]}'" for f in fits) + f" ELSE {other} END"
    return f"""
    WITH u AS (SELECT page_id, translate(coalesce(url, ''), '{AZ}', '{az}') AS low,
             translate(regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)([^?#]*)', 1), '{AZ}', '{az}') AS host,
             regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
    v AS (SELECT *, CAST({n_strict} AS INT) AS n_strict, CAST({n_soft} AS INT) AS n_soft, {weight} AS w FROM u)
    SELECT page_id, host, path, {pick(1, "NULL")} AS rule,
           {pick(2, f"CASE WHEN n_strict > 0 OR (n_soft >= 2 AND w >= {SOFT_LIMIT}) THEN 'block' ELSE 'allow' END")} AS verdict, n_strict, n_soft FROM v"""
