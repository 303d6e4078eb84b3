"""Toxicity by multiple-instance learning: labels stand on documents, blame falls on sentences.

A sentence is toxic with probability sigmoid(bias + weights of its words); a document is toxic unless all its sentences are
clean (noisy-or). Weights are fitted to document labels only, and then point to the sentences at fault.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusframe.llm.common import id_hash, opened, read, shipped
from corpusframe.llm.words import NOT_ALNUM, Words, column, prefix_hashes, slices, words_of

#: Labelled documents the model is fitted on, at most; drawn by a hash of the id.
FIT_ROWS = 10_000
#: Bytes of their texts, in total and of one, at most: the sample is held by one task.
FIT_BYTES, FIT_TEXT = 64 << 20, 1 << 20
#: A feature is tried if so many toxic documents of the sample have it, and their share is so many times that of clean ones.
LEAST_TOXIC, LEAST_RATIO = 6, 4.0
#: Where the bias starts, and stays without labelled documents: a sentence is taken for clean.
BIAS = -6.0
STEPS, RATE, SPARSITY = 250, 0.1, 1e-4
#: Words count whole and by their first bytes, so that inflected forms share what they teach.
PREFIXES = (4, 5, 6)
_BINS = 22
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63]] = True


def sentences(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """For each word the number of its sentence (over all rows), for each sentence its row; sentences end at . ! ? or a newline, and have a word at least."""
    before = np.cumsum(_STOP[w.data])[w.start] if len(w.start) else np.empty(0, np.int64)
    new = np.ones(len(before), bool)
    new[1:] = (before[1:] != before[:-1]) | (w.row[1:] != w.row[:-1])
    return np.cumsum(new) - 1, w.row[new]


def _log_clean(z: np.ndarray) -> np.ndarray:
    """log(1 - sigmoid(z))."""
    return -np.logaddexp(0, z)


def features(w: Words) -> Iterator[np.ndarray]:
    """A hash per word, or 0 for none: of the word, then of each prefix."""
    yield w.hash
    yield from prefix_hashes(w, PREFIXES)


def _bin(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - _BINS)).astype(np.int64)


def _screen(sample: list[tuple[pa.Array, np.ndarray]]) -> np.ndarray:
    """Bins of features that stand in toxic documents far more often than in clean ones."""
    n = np.zeros((2, 1 << _BINS), np.int32)
    size = np.ones(2)
    for texts, y in sample:
        for at, part in slices(texts):
            w = words_of(part, NOT_ALNUM)
            toxic = y[at : at + len(part)] > 0
            size += [(~toxic).sum(), toxic.sum()]
            for h in features(w):
                pair = np.unique(_bin(h)[h != 0] * len(part) + w.row[h != 0])
                own = toxic[pair % len(part)]
                for k in (0, 1):
                    n[k] += np.bincount(pair[own == k] // len(part), minlength=1 << _BINS).astype(np.int32)
    share = (n[1] / size[1]) / ((n[0] + 0.5) / size[0])
    return (n[1] >= LEAST_TOXIC) & (share >= LEAST_RATIO)


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task over a bounded sample: screened features, then proximal gradient steps (Adam) on the noisy-or likelihood with an L1 penalty."""
    sample, room = [], FIT_BYTES
    for b in batches:
        size = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in column(b, "text").cast(pa.binary())])
        b = b.slice(0, int(np.searchsorted(size, room, "right")))
        room -= int(size[-1]) if len(size) else 0
        if len(b):
            sample.append((column(b, "text"), column(b, "toxic").to_numpy(zero_copy_only=False).astype(np.float64)))
        if room <= 0:
            break
    useful = _screen(sample)
    word, at, doc = [], [], []
    n_sent = n_doc = 0
    for texts, _ in sample:
        for first, part in slices(texts):
            w = words_of(part, NOT_ALNUM)
            sent, row = sentences(w)
            for h in features(w):
                near = np.flatnonzero(useful[_bin(h)] & (h != 0))
                word.append(h[near])
                at.append(sent[near] + n_sent)
            doc.append(row + first + n_doc)
            n_sent += len(row)
        n_doc += len(texts)
    cat = lambda xs, kind: np.concatenate(xs) if xs else np.empty(0, kind)
    doc, at, y = cat(doc, np.int64), cat(at, np.int64), cat([y for _, y in sample], np.float64)
    vocabulary, index = np.unique(cat(word, np.uint64), return_inverse=True)
    weight, bias = np.zeros(len(vocabulary)), BIAS
    m, v = np.zeros(len(vocabulary) + 1), np.zeros(len(vocabulary) + 1)
    has = np.bincount(doc, minlength=n_doc) > 0
    for step in range(1, STEPS + 1 if has.any() else 1):
        z = bias + np.bincount(at, weight[index], n_sent)
        clean = np.minimum(np.bincount(doc, _log_clean(z), n_doc), -1e-12)
        # d log-likelihood / dz of a sentence: -p for a clean document, p (1 - P) / P for a toxic one
        pull = np.where(y > 0, np.exp(clean) / -np.expm1(clean), -1.0)
        dz = -pull[doc] * np.exp(-np.logaddexp(0, -z)) / has.sum()
        g = np.append(np.bincount(index, dz[at], len(vocabulary)), dz.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        scale = np.sqrt(v / (1 - 0.99**step)) + 1e-5
        move = RATE * (m / (1 - 0.9**step)) / scale
        bias -= move[-1]
        weight -= move[:-1]
        weight = np.sign(weight) * np.maximum(np.abs(weight) - RATE * SPARSITY / (scale[:-1] + 1e-3), 0)
    used = weight != 0
    yield pa.RecordBatch.from_arrays([pa.array(np.append(vocabulary[used], np.uint64(0)).view(np.int64)), pa.array(np.append(weight[used], bias)), pa.array([False] * int(used.sum()) + [True])], ["word", "weight", "is_bias"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> list:
    """Rows (word, weight, is_bias) of a model fitted to at most so many labelled documents; their number is bounded by the sample.

    Documents are drawn in the order of a hash of their id, until rows or FIT_BYTES are reached; those of more than FIT_TEXT
    bytes are not learnt from. A document labelled twice is toxic if a label says so; null labels count for nothing. Without labelled documents the
    model has its bias alone.
    """
    label = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("double").alias("toxic"))
    drawn = label.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
    # a repeated id could bring in more rows than were drawn
    sample = sample.where(F.octet_length("text") <= FIT_TEXT).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return sample.select("text", "toxic").coalesce(1).mapInArrow(_fit, "word long, weight double, is_bias boolean").collect()


class Model:
    def __init__(self, rows: list):
        self.bias = float(next((r["weight"] for r in rows if r["is_bias"]), BIAS))
        own = sorted((r["word"] % (1 << 64), r["weight"]) for r in rows if not r["is_bias"])
        self.word, self.weight = np.array([x[0] for x in own], np.uint64), np.array([x[1] for x in own], np.float64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.word >> np.uint64(44)] = True

    def of(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word its sentence, for each sentence its row and its logit."""
        sent, row = sentences(w)
        z = np.full(len(row), self.bias)
        for h in features(w):
            near = np.flatnonzero(self.seen[h >> np.uint64(44)])
            if len(near):
                at = np.minimum(np.searchsorted(self.word, h[near]), len(self.word) - 1)
                hit = self.word[at] == h[near]
                z += np.bincount(sent[near[hit]], self.weight[at[hit]], len(row))
        return sent, row, z


def _scorer(model, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = opened(model)
        for batch in batches:
            score, worst = np.empty(len(batch)), [[] for _ in range(len(batch))]
            for at, part in slices(column(batch, "text")):
                w = words_of(part, NOT_ALNUM)
                sent, row, z = own.of(w)
                clean = np.bincount(row, _log_clean(z), len(part))
                clean[np.diff(w.first) == 0] = _log_clean(np.array([own.bias]))[0]  # no words: one empty sentence
                score[at : at + len(part)] = -np.expm1(clean)
                if len(bad := np.flatnonzero(z >= 0)):
                    first, last = np.searchsorted(sent, bad), np.searchsorted(sent, bad, "right") - 1
                    for s, a, b in zip(bad, first, last, strict=True):
                        worst[at + row[s]].append({"sentence": w.data[w.start[a] : w.end[b]].tobytes().decode("utf-8", "replace"), "score": float(1 / (1 + np.exp(-z[s])))})
            kind = pa.list_(pa.struct([("sentence", pa.string()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in columns), pa.array(np.clip(score, 0, 1)), pa.array(worst, kind)], [*columns, "score", "offending"])

    return run


def scored(docs: DataFrame, model: list) -> DataFrame:
    """docs with score (0 to 1) and offending, the sentences that are toxic in themselves (columns of those names are replaced).

    Scores use the text alone. A null or wordless text scores as one empty sentence, the rarest kind of toxic. Rows stay one
    to one, in the tasks that read them.
    """
    docs = docs.drop("score", "offending")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "score double", "offending array<struct<sentence:string,score:double>>"])
    return docs.mapInArrow(_scorer(shipped(docs.sparkSession, Model(model)), docs.columns), schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    model = fit(docs, labels.where(id_hash() % 5 != 0))
    out = scored(docs, model)
    return out.select("doc_id", (id_hash() % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))
