"""Document fingerprints: consistent weighted sampling of word pairs, in DataFrame functions alone.

Terms are pairs of neighbouring words (a lone word where a text has one), weighted by how often they occur. Sample j draws for
each term r and c, gamma variates of shape 2, and beta, uniform; a term of weight S is at step t = floor(ln S / r + beta) and
scores c exp(-r (t - beta + 1)); the sample is the least score's (term, t). Two texts agree in it with a chance equal to their
generalised Jaccard similarity, the sum of minima over the sum of maxima of their weights.

A gamma variate of shape 2 is the sum of two exponential ones, and the share of one in the sum is uniform and independent of
it. So r = s + s' and beta = s' / r for exponential s, s', and c = x + x' with exp(-s) = x / c for exponential x, x'. The score
becomes x exp(-r t): for weight 1, where t is 0, it is x alone, an exponential that grows with a uniform number, and that number
is compared as it comes from the hash. Only other weights need logarithms. With u = exp(-s') the step is
floor(ln(S / u) / r), where exp(-r) = u / (1 + x' / x); it is 0 where S >= u and x' > (S - 1) x.

A text and its edited text share most terms, and what both have with one weight is scored once.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusframe.llm.common import ascii_lower, read

#: Of the query: a standard error of 0.038 at a similarity of 0.75.
SAMPLES = 128

#: Terms that one row brings to the aggregation, as a minimum of many costs little more than one of one.
ABREAST = 8


def salts(samples: int) -> list[int]:
    return [int.from_bytes(hashlib.sha256(b"%d" % j).digest()[:8], "big") >> 1 for j in range(samples)]


def uniform(h: Column) -> Column:
    """62 bits of a term's hash in a sample: the score of a term of weight 1, in the order of the share of smaller ones; least hashes come first."""
    return F.shiftright(h, 2) + F.lit(2**61)


def scores(weighted: Column, samples: int) -> Column:
    """The least scores of an array of (term, weight) in every sample, as longs in the order of scores; null for weights that are not above 0."""
    share = lambda bits: (bits.cast("double") + 0.5) * 2.0**-32

    def drawn(s: Column) -> Column:
        x = -F.log1p((s["first"].cast("double") + 0.5) * -(2.0**-62) * (1 - 2.0**-52))
        return F.struct(s["first"], s["weight"], x.alias("x"), (-F.log1p(-share(F.shiftrightunsigned(s["more"], 32)))).alias("x2"), share(s["more"].bitwiseAND(F.lit(0xFFFFFFFF))).alias("u"))

    def score(s: Column) -> Column:
        x, u, weight = s["x"], s["u"], s["weight"]
        shrink = u / (s["x2"] / x + 1.0)
        y = x * F.pow(shrink, F.floor(F.ln(weight / u) / -F.ln(shrink)))
        part = (F.least(-F.expm1(-y), F.lit(1 - 2.0**-52)) * 2.0**62).cast("long")
        # weights below 1 score up to any height, where the share of smaller scores is 1 to the last bit: they go on by their logarithm
        above = F.when(y < 30.0, part).otherwise((F.least(F.ln(y), F.lit(4000.0)) * 2.0**50).cast("long") + F.lit(2**62))
        return F.when((weight >= u) & (s["x2"] > (weight - 1.0) * x), s["first"]).when(weight >= u, part).when(weight > 0, above)

    def least(salt: Column) -> Column:
        hashes = lambda t: F.struct(t["weight"].alias("weight"), uniform(F.xxhash64(t["term"].bitwiseXOR(salt))).alias("first"), F.xxhash64(t["term"].bitwiseXOR(F.bitwise_not(salt))).alias("more"))
        return F.array_min(F.transform(F.transform(F.transform(weighted, hashes), drawn), score))

    return F.transform(F.lit(salts(samples)), least)


def minima(rows: DataFrame, by: list[str], terms: list[str], samples: int) -> DataFrame:
    """by, m: an array of the least scores of every sample over a group's rows, null where it has none. A row has terms of weight 1, or
    where ws is not null an array of scores, which may be empty."""
    # each sample inside its own aggregate: the generated code is then split into methods small enough to be compiled
    def of(j: int, salt: int) -> Column:
        own = [f"xxhash64({t} ^ {salt}L)" for t in terms]
        return F.when(F.col("ws").isNull(), uniform(F.expr(f"least({', '.join(own)})" if len(own) > 1 else own[0]))).otherwise(F.get("ws", F.lit(j)))

    found = rows.groupBy(*by).agg(*[F.min(of(j, salt)).alias(f"m{j}") for j, salt in enumerate(salts(samples))])
    return found.select(*by, F.when(F.col("m0").isNotNull(), F.array(*[f"m{j}" for j in range(samples)])).alias("m"))


def signatures(weighted: DataFrame, by: list[str], term: str = "term", weight: str = "weight", samples: int = SAMPLES) -> DataFrame:
    """by, m0 .. m(samples-1): the least score of every sample over the weighted terms of a group. Weights are any numbers above 0; terms
    of other or null weights count for nothing, and a group without terms has nulls."""
    rows = weighted.select(*by, F.col(term).alias("term"), F.col(weight).cast("double").alias("weight"))
    none = F.array().cast("array<bigint>")
    ws = F.when(F.col("term").isNull() | F.col("weight").isNull(), none).when(F.col("weight") != 1, scores(F.array(F.struct("term", "weight")), samples))
    found = minima(rows.select(*by, "term", ws.alias("ws")), by, ["term"], samples)
    return found.select(*by, *[F.get("m", F.lit(j)).alias(f"m{j}") for j in range(samples)])


def with_terms(docs: DataFrame, text: str, once: str, often: str) -> DataFrame:
    """docs with two columns in place of text: its terms of weight 1, sorted, as an array of longs, and its others as one of (term, weight).

    Each step is a column of its own, as what a lambda looks up is otherwise worked out anew for every element.
    """
    rest = [c for c in docs.columns if c != text]
    docs = docs.select(*rest, F.array_remove(F.split(ascii_lower(F.col(text)), r"[\x20\x09-\x0D]+"), "").alias("_w"))
    pairs = F.transform("_w", lambda x, i: F.xxhash64(x, F.get("_w", i + 1)))  # the last word's is cut off, unless it is alone
    docs = docs.select(*rest, F.sort_array(F.slice(pairs, 1, F.greatest(F.size("_w") - 1, F.lit(1)))).alias("_t"))
    at = lambda c, i: F.get(F.col(c), i)
    again = lambda x, i: F.coalesce((at("_t", i + 1) == x) | (at("_t", i - 1) == x), at("_t", i + 1) == x, at("_t", i - 1) == x, F.lit(False))
    docs = docs.select(*rest, F.filter("_t", lambda x, i: ~again(x, i)).alias(once), F.filter("_t", again).alias("_t"))
    begin = F.filter(F.transform("_t", lambda x, i: i), lambda i: F.coalesce(at("_t", i) != at("_t", i - 1), F.lit(True)))
    docs = docs.select(*rest, once, "_t", begin.alias("_b"))
    counted = F.transform("_b", lambda b, i: F.struct(at("_t", b).alias("term"), (F.coalesce(at("_b", i + 1), F.size("_t")) - b).cast("double").alias("weight")))
    return docs.select(*rest, once, counted.alias(often))


def starts_of_runs(docs: DataFrame, rows_per_run: int) -> list[int]:
    """Ids at which runs of about so many neighbouring ids begin, each the id of a row; exact minima of approximate quantiles."""
    ids = docs.where("doc_id is not null").select("doc_id")
    n = ids.count()
    if not n:
        return []
    parts = max(1, min(20_000, n // rows_per_run))
    cuts = ids.agg(F.percentile_approx("doc_id", F.lit([i / parts for i in range(parts)]), max(10_000, 4 * parts))).first()[0]
    cuts = sorted(set(cuts))
    firsts = ids.groupBy(run_of(F.col("doc_id"), cuts).alias("run")).agg(F.min("doc_id").alias("first")).collect()
    return sorted(r["first"] for r in firsts)


def run_of(key: Column, firsts: list[int]) -> Column:
    """Number of the last of these sorted values that is not above key (0 for lower keys), by bisection."""
    table, steps = F.lit(firsts), [1 << b for b in reversed(range(len(firsts).bit_length()))]
    lower = F.aggregate(F.lit(steps), F.lit(0), lambda at, s: F.when((at + s < F.lit(len(firsts))) & (F.get(table, at + s) <= key), at + s).otherwise(at))
    return F.coalesce(lower, F.lit(0))


def with_next_text(docs: DataFrame, rows_per_run: int) -> DataFrame:
    """run, row, doc_id, text, next_text, guest of docs(doc_id, text) in ascending doc_id, after the last the first; null ids come first.

    Ids are cut into runs of neighbouring ids; the first row of a run is also a guest at the end of the run before it (of
    the last run for the first). One exchange of the texts; rows that are guests carry guest = true and are to be left out.
    Rows of one id stand in the order of their text's hash, and stay in one run.
    """
    ids = docs.select("doc_id")
    firsts = starts_of_runs(ids, rows_per_run)
    nulls = not ids.where("doc_id is null").isEmpty()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    run = run_of(F.col("doc_id"), firsts)
    leads = F.lit(False) if not firsts else F.get(F.lit(firsts), run) == F.col("doc_id")
    before = F.when(run == 0, max(len(firsts), 1) - 1).otherwise(run - 1)
    # with null ids about, they are the first rows of run 0 and visit the last run in place of its smallest id
    visits = F.col("doc_id").isNull() if nulls else F.lit(False)
    visits = visits | leads & ((run > 0) | F.lit(not nulls))
    rows = rows.withColumns({"h": F.xxhash64("text"), "own": run, "visits": F.coalesce(visits, F.lit(False)), "prior": before})
    at = F.when(F.col("visits"), F.array(F.struct(F.col("own").alias("run"), F.lit(False).alias("guest")), F.struct(F.col("prior").alias("run"), F.lit(True).alias("guest")))).otherwise(F.array(F.struct(F.col("own").alias("run"), F.lit(False).alias("guest"))))
    rows = rows.select("doc_id", "text", "h", F.explode(at).alias("at")).select("at.run", "at.guest", "doc_id", "text", "h")
    order = W.partitionBy("run").orderBy("guest", F.asc_nulls_first("doc_id"), "h")
    return rows.select("run", "guest", "doc_id", "text", F.row_number().over(order).alias("row"), F.lead("text").over(order).alias("next_text"))


def fingerprinted(docs: DataFrame, samples: int = 16, rows_per_run: int = 1000) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last quarter replaced by the beginning of the next document. A fingerprint is eight hex digits
    a sample; a text without words has all f. Likeness is the share of equal samples; two texts without words are alike
    (1), one with and one without are not (0). Its standard error at a similarity s is sqrt(s (1 - s) / samples). A null text counts as empty; repeated rows are each other's neighbours; one
    row is its own next. Equal texts have equal fingerprints. Other columns are not read; an empty table gives no rows.
    """
    near = with_next_text(docs, rows_per_run)
    n, follow = F.char_length("text"), F.coalesce("next_text", "text")
    cut = F.floor(n / 4).cast("int")
    near = near.select("run", "row", "guest", "doc_id", "text", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - cut), F.substring(follow, F.lit(1), cut)).alias("edited"))
    head = ["run", "row", "guest", "doc_id", "n_chars", "edited_sha256"]
    near = near.select(*head[:-1], F.sha2("edited", 256).alias("edited_sha256"), "text", "edited")
    near = with_terms(with_terms(near, "text", "a", "wa"), "edited", "b", "wb")
    none = F.array().cast("array<bigint>")
    sides = [(0, F.array_intersect("a", "b"), None), (1, F.array_except("a", "b"), None), (2, F.array_except("b", "a"), None), (1, none, "wa"), (2, none, "wb")]
    scored = lambda w: F.when(F.size(w) > 0, scores(F.col(w), samples)).otherwise(none) if w else F.lit(None).cast("array<bigint>")
    sides = F.array(*[F.struct(F.lit(side).alias("side"), at.alias("at"), scored(w).alias("ws")) for side, at, w in sides])
    rows = near.select(*head, F.explode(sides).alias("s")).select(*head, "s.side", "s.at", F.when(F.size("s.at") > 0, F.col("s.ws")).otherwise(F.coalesce("s.ws", none)).alias("ws"))
    rows = rows.select(*head, "side", "at", "ws", F.explode(F.sequence(F.lit(0), F.greatest(F.size("at") - 1, F.lit(0)), F.lit(ABREAST))).alias("k"))
    terms = [f"t{i}" for i in range(ABREAST)]
    rows = rows.select(*head, "side", "ws", *[F.coalesce(F.get("at", F.col("k") + i), F.get("at", "k")).alias(t) for i, t in enumerate(terms)])
    only = [F.max(F.when(F.col("side") == k, F.col("m"))).alias(name) for k, name in enumerate(("both", "a", "b"))]
    rows = minima(rows, [*head, "side"], terms, samples).groupBy(*head).agg(*only)
    code = lambda side: F.transform(F.coalesce(F.zip_with("both", side, lambda x, y: F.least(x, y)), "both", side), lambda m: F.hash(m))
    rows = rows.select(*head, code("a").alias("own"), code("b").alias("edited"))
    follow = F.lead(F.struct("own")).over(W.partitionBy("run").orderBy("row"))
    rows = rows.withColumn("next", F.coalesce(follow, F.struct("own"))["own"]).where(~F.col("guest"))

    def likeness(a: Column, b: Column) -> Column:
        same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(samples))
        return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same)

    digits = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(F.expr("4294967295L"))), 8, "0"))), ""), F.lit("f" * 8 * samples))
    own, edited = F.col("own"), F.col("edited")
    return rows.select("doc_id", "n_chars", "edited_sha256", digits(own).alias("fingerprint"), digits(edited).alias("edited_fingerprint"), likeness(own, edited).alias("near_edited"), likeness(own, F.col("next")).alias("near_next"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(read(spark, sf_dir, "documents"), SAMPLES)
