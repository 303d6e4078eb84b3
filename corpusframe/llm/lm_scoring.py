"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

log P(word | words before) = log P(class | features of the two words before) + log P(word | class). Frequent words are
classes of their own; all others are grouped by their last bytes, the groups being clusters of what such words follow. The
first factor is a softmax whose features are the word before, the word before that (a skip) and, hashed, both; the second
is the count of the word, plus one, over those of its class, where each class keeps one count for words never seen.

Counts cover all training texts. Weights are fitted by distributed gradient updates: in every round each task takes its own
steps from the common weights over its share of the round's texts, and the changes are averaged, feature by feature, by the
tokens that had the feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusframe.llm.common import id_hash, opened, read, shipped, stored
from corpusframe.llm.words import SPACE, Words, _mixed, column, slices, words_of

#: Words with classes of their own; groups of the others; buckets of last bytes; words that features know by name.
SINGLE, GROUPS, BUCKETS, NAMED = 31, 32, 4096, 2000
CLASSES = SINGLE + 1 + GROUPS
SYMBOLS = NAMED + BUCKETS + 2
PAIRS = 1 << 15
#: Most frequent words, and their counts, that every task gets; rarer ones are looked up by a join.
HEAD_WORDS = 1 << 20
ROUNDS, STEP_TOKENS, RATE = 2, 2048, 0.15
#: Tasks that train at once at most, so that what is averaged has a bound.
TRAINERS, TRAINER_TOKENS = 1024, 2_000_000
_PART = 128
END = -1
_LOG10 = float(np.log(10))


def buckets(w: Words) -> np.ndarray:
    """A bucket per word by its last three bytes."""
    h = np.zeros(len(w.start), np.uint64)
    with np.errstate(over="ignore"):
        for back in (1, 2, 3):
            at = w.end - back
            byte = np.where(at >= w.start, w.data[np.maximum(at, 0)], 0).astype(np.uint64) if len(at) else h
            byte = np.where((byte >= 65) & (byte <= 90), byte + np.uint64(32), byte)
            h = h * np.uint64(257) + byte
        return (_mixed(h + np.uint64(1)) >> np.uint64(52)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """token, bucket, n of every batch; bucket -1 is the end of a text."""
    for b in batches:
        hashes, own = [], []
        for _, part in slices(column(b, "text")):
            w = words_of(part, SPACE)
            hashes.append(w.hash)
            own.append(buckets(w))
        h, at, n = np.unique(np.concatenate(hashes), return_index=True, return_counts=True) if hashes else (np.empty(0, np.uint64),) * 3
        bucket = np.concatenate(own)[at] if len(h) else np.empty(0, np.int64)
        out = [np.append(h.view(np.int64), END), np.append(bucket, -1).astype(np.int32), np.append(n, len(b)).astype(np.int64)]
        for i in range(0, len(out[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in out], ["token", "bucket", "n"])


class Vocabulary:
    """Frequent words: hashes, their counts, their rank (NAMED and above: unnamed); the group of each bucket.

    A slot per leading bits of a hash holds one word; the few words whose slot is taken stand in a sorted list of their own.
    """

    def __init__(self, hash: np.ndarray, count: np.ndarray, rank: np.ndarray):
        self.hash, self.count, self.rank, self.group = hash, count, rank, np.zeros(BUCKETS, np.int64)
        self.shift = np.uint64(64 - max(10, (4 * len(hash)).bit_length()))
        self.slot = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        at = (hash >> self.shift).astype(np.int64)
        self.slot[at] = np.arange(len(hash))
        rest = np.flatnonzero(self.slot[at] != np.arange(len(hash)))
        self.rest = rest[np.argsort(hash[rest])]
        self.rest_hash = hash[self.rest]

    def known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is there) of each hash among the frequent words."""
        if not len(self.hash):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        place = self.slot[h >> self.shift]
        there = (place >= 0) & (self.hash[place] == h)
        if len(self.rest):
            other = np.flatnonzero(~there & (place >= 0))
            at = np.minimum(np.searchsorted(self.rest_hash, h[other]), len(self.rest) - 1)
            hit = self.rest_hash[at] == h[other]
            place[other[hit]], there[other[hit]] = self.rest[at[hit]], True
        return place, there


class Tokens(NamedTuple):
    """Words and ends of a slice in order: row, class, the two symbols before, whether an end."""

    row: np.ndarray
    cls: np.ndarray
    one: np.ndarray
    two: np.ndarray


def tokens_of(w: Words, v: Vocabulary, place: np.ndarray, known: np.ndarray) -> Tokens:
    bucket = buckets(w)
    rank = np.where(known, v.rank[place] if len(v.rank) else NAMED, NAMED)
    symbol = np.where(rank < NAMED, rank, NAMED + bucket)
    cls = np.where(rank < SINGLE, rank, SINGLE + 1 + v.group[bucket])
    rows = len(w.first) - 1
    n = len(w.hash) + rows
    at, ends = np.arange(len(w.hash)) + w.row, w.first[1:] + np.arange(rows)
    row, out, sym = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
    row[at], row[ends] = w.row, np.arange(rows)
    out[at], out[ends] = cls, SINGLE
    sym[at], sym[ends] = symbol, SYMBOLS - 1  # the symbol of an end also stands before the first word
    one, two = np.full(n, SYMBOLS - 1), np.full(n, SYMBOLS - 1)
    one[1:], two[2:] = sym[:-1], sym[:-2]
    first = np.concatenate([[0], ends[:-1] + 1]) if rows else np.empty(0, np.int64)
    two[first] = SYMBOLS - 1
    return Tokens(row, out, one, two)


class Weights:
    """Three tables of a row per feature and a column per class, and the logarithms of the classes' shares."""

    def __init__(self, bias: np.ndarray):
        self.bias = bias.astype(np.float32)
        self.tables = [np.zeros((size, CLASSES), np.float32) for size in (SYMBOLS, SYMBOLS, PAIRS)]

    @staticmethod
    def features(one: np.ndarray, two: np.ndarray) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            pair = _mixed(one.astype(np.uint64) * np.uint64(SYMBOLS) + two.astype(np.uint64) + np.uint64(1))
        return [one, two, (pair & np.uint64(PAIRS - 1)).astype(np.int64)]

    def exponentials(self, features: list[np.ndarray], cls: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(exp of each class's logit, logit of the given class), both less the row's largest where a logit is large."""
        z = np.take(self.tables[0], features[0], axis=0)
        z += np.take(self.tables[1], features[1], axis=0)
        z += np.take(self.tables[2], features[2], axis=0)
        z += self.bias
        if z.max(initial=0) > 40:
            z -= z.max(1, keepdims=True)
        own = z[np.arange(len(z)), cls] if cls is not None else z[:, 0]
        return np.exp(z, out=z), own


def _cooccurrence(vocabulary):
    """part, counts: for every bucket of last bytes, the frequent words (or an end) that its words follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = opened(vocabulary)
        n = np.zeros((BUCKETS, 65), np.int64)
        for b in batches:
            for _, part in slices(column(b, "text")):
                w = words_of(part, SPACE)
                place, known = v.known(w.hash)
                rank = np.where(known, v.rank[place] if len(v.rank) else NAMED, NAMED)
                ok = (w.row[1:] == w.row[:-1]) & (rank[:-1] < 64)
                n += np.bincount(buckets(w)[1:][ok] * 65 + rank[:-1][ok], minlength=BUCKETS * 65).reshape(BUCKETS, 65)
        yield pa.RecordBatch.from_arrays([pa.array(range(0, BUCKETS, _PART), pa.int32()), pa.array([n[i : i + _PART].astype("<f4").tobytes() for i in range(0, BUCKETS, _PART)], pa.binary())], ["part", "data"])

    return run


def _summed(rows: pa.Table) -> pa.Table:
    """The sum of the arrays of one part; a row per task that made some."""
    total = None
    for x in rows.column("data").combine_chunks():
        own = np.frombuffer(x.as_buffer(), "<f4").astype(np.float64)
        total = own if total is None else total + own
    return pa.table([rows.column("part")[:1], pa.array([total.astype("<f4").tobytes()], pa.binary())], ["part", "data"])


def clusters(n: np.ndarray) -> np.ndarray:
    """A group for each row of counts: spherical k-means on square roots, from seeds that are far from each other."""
    x = np.sqrt(n / np.maximum(n.sum(1, keepdims=True), 1)).astype(np.float64)
    size = n.sum(1)
    centres = x[[int(size.argmax())]]
    while len(centres) < GROUPS:
        far = (1 - (x @ centres.T).max(1)) * np.sqrt(size)
        centres = np.vstack([centres, x[[int(far.argmax())]]])
    for _ in range(12):
        group = (x @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, group, x * size[:, None])
        norm = np.sqrt((total**2).sum(1, keepdims=True))
        centres = np.where(norm > 0, total / np.maximum(norm, 1e-12), centres)
    return group


def _trainer(vocabulary, weights, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = opened(vocabulary)
        common: Weights = opened(weights)
        own = Weights(common.bias)
        own.tables = [t.copy() for t in common.tables]
        squares = [np.full(len(t), 1e-2, np.float32) for t in own.tables]
        seen = [np.zeros(len(t), np.int64) for t in own.tables]
        for b in batches:
            for _, part in slices(column(b, "text")):
                w = words_of(part, SPACE)
                t = tokens_of(w, v, *v.known(w.hash))
                features = Weights.features(t.one, t.two)
                for i in range(0, len(t.cls), STEP_TOKENS):
                    f = [x[i : i + STEP_TOKENS] for x in features]
                    g, _ = own.exponentials(f)
                    g /= g.sum(1, keepdims=True)
                    g[np.arange(len(g)), t.cls[i : i + STEP_TOKENS]] -= 1
                    for k, x in enumerate(f):
                        order = np.argsort(x, kind="stable")
                        x = x[order]
                        at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
                        pull, x, n = np.add.reduceat(g[order], at, axis=0), x[at], np.diff(np.append(at, len(x)))
                        squares[k][x] += (pull**2).mean(1)
                        own.tables[k][x] -= rate * pull / np.sqrt(squares[k][x])[:, None]
                        seen[k][x] += n
        part = 0
        for k, table in enumerate(own.tables):
            for i in range(0, len(table), _PART):
                n = seen[k][i : i + _PART].astype(np.float32)
                if n.any():
                    change = (table[i : i + _PART] - common.tables[k][i : i + _PART]) * n[:, None]
                    data = np.concatenate([change, n[:, None]], axis=1).astype("<f4").tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([data], pa.binary())], ["part", "data"])
                part += 1

    return run


def _scorer(vocabulary, weights, mass):
    """doc_id, held_out, row, n_tokens, known, log_count (sum of log10(count + 1)), model, tail (hashes of words not among the frequent)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, own = opened(vocabulary), opened(weights)
        log_count, log_mass = np.log10(v.count + 1.0), np.log10(mass)
        for b in batches:
            size = len(b)
            n, known_n, base, model, tail = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size), np.zeros(size), []
            for first, part in slices(column(b, "text")):
                w = words_of(part, SPACE)
                place, known = v.known(w.hash)
                here = slice(first, first + len(part))
                n[here] = np.diff(w.first) + 1
                known_n[here] = np.bincount(w.row[known], minlength=len(part))
                base[here] = np.bincount(w.row[known], log_count[place[known]], len(part)) if known.any() else 0
                t = tokens_of(w, v, place, known)
                score = np.empty(len(t.cls))
                features = Weights.features(t.one, t.two)
                for i in range(0, len(t.cls), STEP_TOKENS):
                    c = t.cls[i : i + STEP_TOKENS]
                    e, own_logit = own.exponentials([x[i : i + STEP_TOKENS] for x in features], c)
                    score[i : i + STEP_TOKENS] = (own_logit - np.log(e.sum(1))) / _LOG10
                score -= log_mass[t.cls]
                model[here] = np.bincount(t.row, score, len(part))
                rest, bounds = w.hash[~known].view(np.int64), np.searchsorted(w.row[~known], np.arange(len(part) + 1))
                tail += [rest[bounds[i] : bounds[i + 1]] for i in range(len(part))]
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in ("doc_id", "held_out", "row")), *map(pa.array, (n, known_n, base, model)), pa.array(tail, pa.list_(pa.int64()))], ["doc_id", "held_out", "row", "n_tokens", "known", "log_count", "model", "tail"])

    return run


def scored(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Per row of docs(doc_id, text, held_out): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose held_out is false. Words lie between white space, A-Z as a-z, and every text has an end for
    a last token, so a null, empty or blank text has that one token. n_known counts tokens seen in training. Without
    training rows all counts are 0 and scores are those of one unknown word. Rows stay one to one, repeated ones alike;
    other columns are not read; an empty table gives no rows. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "held_out")
    train = rows.where("not held_out").select("text", F.pmod(F.xxhash64("text", "doc_id"), F.lit(rounds)).alias("round"))
    counts = stored(train.select("text").mapInArrow(_count, "token long, bucket int, n long").groupBy("token", "bucket").agg(F.sum("n").alias("n")))
    totals = counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect()  # a row per bucket
    n_tokens, n_types = sum(r["n"] for r in totals), sum(r["types"] for r in totals)
    # the frequent words: all above the least count that leaves no more than HEAD_WORDS
    by_count = counts.where("bucket >= 0").groupBy(F.least("n", F.lit(1 << 16)).alias("n")).agg(F.count("*").alias("types")).collect()
    least, room = 1 << 62, HEAD_WORDS
    for r in sorted(by_count, key=lambda r: -r["n"]):
        if r["types"] > room:
            break
        least, room = r["n"], room - r["types"]
    frequent = counts.where((F.col("bucket") >= 0) & (F.col("n") >= least)).select("token", "n").toArrow()
    h, n = frequent.column("token").to_numpy().view(np.uint64), frequent.column("n").to_numpy()
    order = np.lexsort((h, -n))
    rank = np.full(len(h), NAMED)
    rank[order[:NAMED]] = np.arange(min(NAMED, len(h)))
    vocabulary = Vocabulary(h, n, rank)
    # a task trains on two million tokens or more: what it sends to be averaged is then small against what it reads
    trainers = int(max(1, min(TRAINERS, n_tokens // TRAINER_TOKENS)))

    follows = np.zeros((BUCKETS, 65))
    words = shipped(spark, vocabulary)
    for r in train.select("text").coalesce(trainers).mapInArrow(_cooccurrence(words), "part int, data binary").groupBy("part").applyInArrow(_summed, "part int, data binary").toLocalIterator():
        follows[r["part"] : r["part"] + _PART] = np.frombuffer(bytes(r["data"]), "<f4").reshape(_PART, 65)
    vocabulary.group = clusters(follows)
    # tokens plus types of each class, plus one for words never seen; words with classes of their own leave their group
    mass = np.ones(CLASSES)
    for r in totals:
        mass[SINGLE if r["bucket"] < 0 else SINGLE + 1 + vocabulary.group[r["bucket"]]] += r["n"] + r["types"]
    named = [(int(k), int(c)) for k, c in zip(vocabulary.rank, vocabulary.count, strict=True) if k < SINGLE]
    if named:
        top = {int(x): int(k) for x, k in zip(vocabulary.hash.view(np.int64), vocabulary.rank, strict=True) if k < SINGLE}
        for r in counts.where(F.col("token").isin(list(top)) & (F.col("bucket") >= 0)).collect():
            mass[top[r["token"]]] += r["n"] + 1
            mass[SINGLE + 1 + vocabulary.group[r["bucket"]]] -= r["n"] + 1
    words = shipped(spark, vocabulary)
    weights = Weights(np.log(mass / mass.sum()))
    for k in range(rounds):
        common = shipped(spark, weights)
        changes = train.where(F.col("round") == k).select("text").coalesce(trainers).mapInArrow(_trainer(words, common, RATE), "part int, data binary").groupBy("part").applyInArrow(_summed, "part int, data binary")
        after = Weights(weights.bias)
        after.tables = [t.copy() for t in weights.tables]
        places = [(t, i) for t in range(3) for i in range(0, len(weights.tables[t]), _PART)]
        for r in changes.toLocalIterator():
            t, i = places[r["part"]]
            data = np.frombuffer(bytes(r["data"]), "<f4").reshape(-1, CLASSES + 1)
            after.tables[t][i : i + len(data)] += data[:, :CLASSES] / np.maximum(data[:, CLASSES:], 1)
        weights = after
    final = shipped(spark, weights)
    schema = f"doc_id {kind}, held_out boolean, row long, n_tokens long, known long, log_count double, model double, tail array<long>"
    known = stored(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_scorer(words, final, mass), schema))
    rare = counts.where((F.col("bucket") >= 0) & (F.col("n") < least)).select("token", "n")
    rare = known.select("row", F.explode("tail").alias("token")).join(rare, "token").groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("rare_count"))
    ends = next((r["n"] for r in totals if r["bucket"] < 0), 0)
    out = known.drop("tail").join(rare, "row", "left")
    count = F.col("log_count") + F.coalesce("rare_count", F.lit(0.0)) + float(np.log10(ends + 1.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0)) + int(ends > 0)).alias("n_known"), F.lit(n_tokens).cast("long").alias("train_tokens"),
        (count - F.col("n_tokens") * float(np.log10(n_tokens + n_types + 1.0))).alias("base_score"), (count + F.col("model")).alias("score"),
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(read(spark, sf_dir, "documents").select("doc_id", "text", (id_hash() % 7 == 2).alias("held_out")))
