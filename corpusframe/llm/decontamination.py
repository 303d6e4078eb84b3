"""Benchmark decontamination: a generalised suffix automaton of the test items reads every training text.

The automaton gives, at each word, the longest run of words ending there that some item has. Runs that reach the window mark
their words; whole items shorter than the window do so too. Only stretches whose neighbouring words all stand next to each
other in some item are streamed through the automaton, as nothing else can reach a window.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusframe.llm.common import opened, read, shipped, stored
from corpusframe.llm.words import NOT_ALNUM, Words, column, slices, words_of

WINDOW = 10
#: Words of items that one automaton holds (some 0.7 KB each, in the driver and in every worker); a larger benchmark is read in blocks, one pass over the texts for each.
BLOCK_WORDS = 250_000
_BITS = 22
_PAIR = np.uint64(0xD6E8FEB86659FD93)


class Automaton:
    """Suffix automaton of several word sequences. For each state: the items that have its words, and the short items that end in it."""

    def __init__(self, items: Sequence[tuple[str, list[int]]], window: int):
        self.window, self.next, self.link, self.length = window, [{}], [-1], [0]
        self.items: list[set[str]] = [set()]
        self.short: list[list[tuple[int, str]]] = [[]]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        for name, words in items:
            at = 0
            for w in words:
                at = self.next[at][w]
                up = at
                while up > 0 and name not in self.items[up]:
                    self.items[up].add(name)
                    up = self.link[up]
            if 0 < len(words) < window:
                self.short[at].append((len(words), name))
        self.least = min([window, *(len(w) for _, w in items if w)])
        # of each state: the state on its way to the root that has its last `window` words, and the next one, itself first, that a short item ends in
        self.whole, self.ends = [0] * len(self.link), [0] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            up = self.link[s]
            if self.length[s] >= window:
                self.whole[s] = s if self.length[up] < window else self.whole[up]
            self.ends[s] = s if self.short[s] else self.ends[up]

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.items.append(set())
        self.short.append([])
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state for the words of q that p reaches by w; q keeps its longer ones."""
        half = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = half
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = half
            p = self.link[p]
        return half

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def matches(self, words: Sequence[int]) -> Iterator[tuple[int, int, set[str]]]:
        """(place of the last word, words, items) of every window that ends in these words."""
        at = matched = 0
        for i, w in enumerate(words):
            while at and w not in self.next[at]:
                at = self.link[at]
                matched = self.length[at]
            if w in self.next[at]:
                at, matched = self.next[at][w], matched + 1
            if matched >= self.window:
                yield i, self.window, self.items[self.whole[at]]
            up = self.ends[at]
            while up > 0:  # as many as short items have lengths, at most
                for m, name in self.short[up]:
                    if up != at or matched >= m:
                        yield i, m, {name}
                up = self.ends[self.link[up]]


class Reader:
    """An automaton with bitmaps of the words and the word pairs of its items."""

    def __init__(self, items: Sequence[tuple[str, list[int]]], window: int):
        self.automaton = Automaton(items, window)
        self.words, self.pairs = np.zeros(1 << _BITS, bool), np.zeros(1 << _BITS, bool)
        with np.errstate(over="ignore"):
            for _, words in items:
                w = np.array(words, np.uint64)
                self.words[w >> np.uint64(64 - _BITS)] = True
                self.pairs[self._pair(w)] = True

    @staticmethod
    def _pair(w: np.ndarray) -> np.ndarray:
        x = w[:-1] * _PAIR + w[1:]
        x ^= x >> np.uint64(31)
        return (x * _PAIR) >> np.uint64(64 - _BITS)

    def stretches(self, w: Words) -> Iterator[tuple[int, int]]:
        """(first word, word after the last) of stretches in which a window may stand."""
        n = len(w.hash)
        if not n:
            return
        with np.errstate(over="ignore"):
            joined = self.pairs[self._pair(w.hash)] & (w.row[:-1] == w.row[1:])
        begin = np.flatnonzero(np.concatenate([[True], ~joined]))
        end = np.append(begin[1:], n)
        keep = end - begin >= self.automaton.least
        if self.automaton.least == 1:
            keep &= (end - begin > 1) | self.words[w.hash[begin] >> np.uint64(64 - _BITS)]
        yield from zip(begin[keep].tolist(), end[keep].tolist(), strict=True)


SPANS = "array<struct<begin:int,end:int,short:boolean>>"
FOUND = f"n_words long, spans {SPANS}, items array<string>, longest int"


def _scanner(reader, columns: list[str]):
    """Arrow batches with text -> the same with n_words, spans (of hit words: first, after the last, whether a short item stands in it), items and the longest hit run."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Reader = opened(reader)
        for batch in batches:
            n, spans, items = np.zeros(len(batch), np.int64), {}, {}
            for at, part in slices(column(batch, "text")):
                w = words_of(part, NOT_ALNUM)
                n[at : at + len(part)] = np.diff(w.first)
                for a, b in own.stretches(w):
                    row = at + int(w.row[a])
                    base = a - int(w.first[w.row[a]])
                    for i, size, names in own.automaton.matches(w.hash[a:b].tolist()):
                        end = base + i + 1
                        runs = spans.setdefault(row, [])
                        short = size < own.automaton.window
                        if runs and end - size <= runs[-1][1]:
                            runs[-1] = (min(runs[-1][0], end - size), max(end, runs[-1][1]), runs[-1][2] or short)
                        else:
                            runs.append((end - size, end, short))
                        items.setdefault(row, set()).update(names)
            for runs in spans.values():  # a short item may begin before the run that was open when it ended
                runs[:] = merged(runs)
            found = [[{"begin": a, "end": b, "short": s} for a, b, s in spans.get(i, ())] for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays(
                [*(column(batch, c) for c in columns), pa.array(n), pa.array(found, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("short", pa.bool_())]))), pa.array([sorted(items.get(i, ())) for i in range(len(batch))], pa.list_(pa.string())), pa.array([max((b - a for a, b, _ in spans.get(i, ())), default=0) for i in range(len(batch))], pa.int32())],
                [*columns, "n_words", "spans", "items", "longest"],
            )

    return scan


def merged(runs: list[tuple[int, int, bool]]) -> list[tuple[int, int, bool]]:
    out: list[tuple[int, int, bool]] = []
    for a, b, short in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), out[-1][2] or short)
        else:
            out.append((a, b, short))
    return out


def _joined(spans: Column) -> Column:
    """Spans of several blocks in order, those that touch made one."""

    def step(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        both = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], s["end"]).alias("end"), (last["short"] | s["short"]).alias("short"))
        return F.when(F.coalesce(s["begin"] <= last["end"], F.lit(False)), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(both))).otherwise(F.concat(done, F.array(s)))

    return F.when(F.size(spans) == 0, spans).otherwise(F.aggregate(F.array_sort(spans), F.array().cast(SPANS), step))


def _with_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for _, part in slices(column(batch, "text")):
            w = words_of(part, NOT_ALNUM)
            rows += [w.hash[w.first[i] : w.first[i + 1]].view(np.int64) for i in range(len(part))]
        yield pa.RecordBatch.from_arrays([column(batch, "item").cast(pa.string()), pa.array(rows, pa.list_(pa.int64()))], ["item", "words"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with n_words, spans, items and longest (columns of those names are replaced).

    Words are what lies between ASCII characters other than letters and digits, A-Z as a-z. spans are runs of hit words
    (first, after the last, whether an item shorter than the window stands in it) in the order of the text, items the sorted ids, as text, of items with a window in it. Null
    texts have no words; items with null or wordless texts have no windows; a null item id is the empty text; repeated
    items count once by id. Empty tables are fine on either side. Texts are never exchanged. The items' words are counted
    first: beyond block_words the items are dealt into blocks and the texts are read once for each, so that a task holds one
    block's automaton at a time; what the further blocks find is stored by the text's hash (128 bits) and joined to the rows,
    the one case in which texts may be exchanged.
    """
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c not in ("n_words", "spans", "items", "longest")]
    docs = docs.select(*columns)
    listed = stored(items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_with_words, "item string, words array<long>").where("size(words) > 0"))
    total = listed.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = -(-total // block_words) or 1
    kind = docs.schema.simpleString()[7:-1]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), FOUND]) if kind else FOUND
    def reader(k: int):
        block = listed if blocks == 1 else listed.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        return shipped(spark, Reader([(r["item"], [x % (1 << 64) for x in r["words"]]) for r in block.toLocalIterator()], window))

    out = docs.mapInArrow(_scanner(reader(0), columns), schema)
    if blocks == 1:
        return out
    # what the other blocks find follows from the text alone: it is kept by the text's hash, once for all copies
    texts = docs.select(_text_key().alias("key"), "text")
    more = None
    for k in range(1, blocks):
        found = texts.mapInArrow(_scanner(reader(k), ["key"]), f"key struct<a:long,b:long>, {FOUND}").where("size(spans) > 0").groupBy("key").agg(F.first("spans").alias("spans"), F.first("items").alias("items"))
        found = stored(found)
        more = found if more is None else more.union(found)
    more = more.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("__spans"), F.flatten(F.collect_list("items")).alias("__items"))  # a row per block at most
    both = out.withColumn("__key", _text_key()).join(more.withColumnRenamed("key", "__key"), "__key", "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    both = both.withColumns({"items": F.array_sort(F.array_union("items", none(F.col("__items"), "array<string>"))), "spans": _joined(F.concat("spans", none(F.col("__spans"), SPANS)))})
    both = both.withColumn("longest", F.coalesce(F.array_max(F.transform("spans", lambda s: s["end"] - s["begin"])), F.lit(0)))
    return both.select(*columns, "n_words", "spans", "items", "longest")


def _text_key() -> Column:
    text = F.coalesce("text", F.lit(""))
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])


def _without_spans(columns: list[str]):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = column(batch, "text"), column(batch, "spans").to_pylist()
            if any(spans):
                new = texts.to_pylist()
                for i, own in enumerate(spans):
                    if own:
                        w = words_of(next(slices(texts.slice(i, 1)))[1], NOT_ALNUM)
                        raw, kept, at = w.data, [], 0
                        for s in own:
                            kept.append(raw[at : w.start[s["begin"]]].tobytes())
                            at = int(w.end[s["end"] - 1])
                        new[i] = b"".join([*kept, raw[at:].tobytes()]).decode()
                texts = pa.array(new, texts.type)
            yield pa.RecordBatch.from_arrays([texts if c == "text" else column(batch, c) for c in columns], columns)

    return cut


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, min_run: int = WINDOW, max_coverage: float = 0.5, **more) -> DataFrame:
    """docs (same columns) without what they share with the items.

    A document whose words are hit to a share above max_coverage goes; from the others every hit run of min_run words or
    more, or that is a whole short item, is cut out of the text. Untouched texts come out as they were, nulls included.
    """
    names = docs.columns
    aside = {c: f"__own_{c}" for c in names if c in ("n_words", "spans", "items", "longest")}
    docs = docs.withColumnsRenamed(aside)
    schema = docs.schema
    found = contamination(docs, items, window, **more)
    found = found.where(n_hit() <= F.col("n_words") * max_coverage)
    if min_run > window:
        found = found.withColumn("spans", F.filter("spans", lambda s: s["short"] | (s["end"] - s["begin"] >= min_run)))
    return found.mapInArrow(_without_spans(schema.names), schema).withColumnsRenamed({b: a for a, b in aside.items()}).select(*names)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "longest")
