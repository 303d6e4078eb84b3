"""N-gram Jaccard join by T-occurrence search, and the components of its links.

Two texts link when their sets of 5-word shingles have a Jaccard similarity of 0.75 or more. The steps:

1. every text becomes a set of 64-bit shingle hashes; texts with equal sets form a class and go on as one;
2. the lowest-hashed part of each set is dealt by hash; a set goes on only if enough of that part is also in other sets
   (a partner has to share as much of it), which most texts of a corpus are not;
3. of the sets that remain every shingle is counted; two that link share one of their rarest, and so both meet that shingle's
   hub, the set that is tied most;
4. among the sets that meet a hub, DivideSkip solves the T-occurrence problem for a set: its short inverted lists are merged
   by a heap, the long ones are only probed by binary search for what the merge left over. Sets that are already connected
   are not compared again, so a group of near copies costs a search for its hub instead of all pairs. Where many meet a hub
   they are cut into chunks, the hub in each;
5. links become components, components take the smallest doc_id.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusframe.llm.common import arrow_bytes, components, read, stored
from corpusframe.llm.words import SPACE, _mixed, column, shingle_hashes, slices, words_of

SHINGLE = 5
#: Step 2 asks for this part of a set to be shared on top of the one shingle that a prefix filter asks for.
EXTRA = 10
#: Sets, and shingles, that one unit of comparison holds, about; of a hub that more sets meet there are several.
CHUNK_SETS, CHUNK_SHINGLES = 500, 1_000_000
#: A shingle of so many sets or more counts as common; the order of rarity takes no note of how common.
COMMON = 10_000
#: Lists that are counted together before the heap merges them.
RUN = 64
#: Largest Bloom filter (64 MB); where it would not do, rows are joined.
FILTER_BITS = 29
#: Of texts and sets that pass through Python at once, one row at least.
BATCH_BYTES = 4 << 20
HUB, MEMBER, ASKER = 0, 1, 2
#: From the experiments of the authors of DivideSkip: weight of a probe against a merge step.
_MU = 0.0085


def least_overlap(n: int) -> int:
    """Shingles that a set of n shares with any partner: 0.75 of the union is 0.75 n at least."""
    return (3 * n + 3) // 4


def links(overlap: int, a: int, b: int) -> bool:
    return 100 * overlap >= 75 * (a + b - overlap)


def _extra(n: int) -> int:
    return max(1, n // EXTRA)


def sets_of(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text of an Arrow column."""
    for at, part in slices(texts):
        w = words_of(part, SPACE)
        row, h = shingle_hashes(w, SHINGLE)
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        row, h = row[new], h[new]
        bounds = np.searchsorted(row, np.arange(len(part) + 1))
        for i in range(len(part)):
            yield at + i, h[bounds[i] : bounds[i + 1]]


def class_of(own: np.ndarray) -> int:
    """A 64-bit name of a set, above 0 in Spark's signed view, and 0 for the empty set."""
    if not len(own):
        return 0
    with np.errstate(over="ignore"):
        x = _mixed(np.array([np.bitwise_xor.reduce(_mixed(own + np.uint64(1))) + np.add.reduce(own * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(len(own))], np.uint64))
    return int(x[0] >> np.uint64(1)) or 1


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own = [(len(s), class_of(s)) for _, s in sets_of(column(b, "text"))]
        yield pa.RecordBatch.from_arrays([column(b, "doc_id"), column(b, "row_key"), pa.array([x[0] for x in own], pa.int64()), pa.array([x[1] for x in own], pa.int64())], ["doc_id", "row_key", "n", "cls"])


def _low_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, cls) of the lowest-hashed part of each set; copies in one batch count once."""
    for b in batches:
        seen, keys, owner = set(), [], []
        for _, s in sets_of(column(b, "text")):
            if len(s) and (c := class_of(s)) not in seen:
                seen.add(c)
                part = s[: len(s) - least_overlap(len(s)) + _extra(len(s))]
                keys.append(part)
                owner.append(np.full(len(part), c, np.int64))
        if keys:
            keys, owner = np.concatenate(keys).view(np.int64), np.concatenate(owner)
            for i in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000]), pa.array(owner[i : i + 100_000])], ["key", "cls"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cls, shared from rows sorted by (key, cls): how many keys of a class are also another's. One row is carried over between batches."""
    kept_key = kept_cls = np.empty(0, np.int64)
    kept_tied = False

    def told(cls: np.ndarray) -> pa.RecordBatch:
        c, n = np.unique(cls, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(c), pa.array(n.astype(np.int64))], ["cls", "shared"])

    for b in batches:
        key = np.concatenate([kept_key, column(b, "key").to_numpy()])
        cls = np.concatenate([kept_cls, column(b, "cls").to_numpy()])
        if not len(key):
            continue
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
        key, cls = key[new], cls[new]
        same = key[1:] == key[:-1]
        tied = np.zeros(len(key), bool)
        tied[1:] |= same
        tied[:-1] |= same
        tied[0] |= kept_tied
        yield told(cls[:-1][tied[:-1]])
        kept_key, kept_cls, kept_tied = key[-1:], cls[-1:], bool(tied[-1])
    if kept_tied:
        yield told(kept_cls)


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each key in a Bloom filter."""
    h = _mixed(keys.view(np.uint64))
    return (h >> np.uint64(64 - bits)).astype(np.int64), (h & np.uint64((1 << bits) - 1)).astype(np.int64)


def _marker(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, part = np.zeros(1 << (bits - 3), np.uint8), 1 << 13
        for b in batches:
            for at in _places(b.column(0).to_numpy(), bits):
                np.bitwise_or.at(marks, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        for i in range(0, len(marks), part):
            if marks[i : i + part].any():
                yield pa.RecordBatch.from_arrays([pa.array([i // part], pa.int32()), pa.array([marks[i : i + part].tobytes()], pa.binary())], ["part", "marks"])

    return run


def _joined_marks(rows: pa.Table) -> pa.Table:
    """One part of the filter; as many rows as the earlier stage had tasks."""
    total = np.zeros(1 << 13, np.uint8)
    for x in rows.column("marks").combine_chunks():
        total |= np.frombuffer(x.as_buffer(), np.uint8)
    return pa.table([rows.column("part")[:1], pa.array([total.tobytes()], pa.binary())], ["part", "marks"])


def bloom(keys: DataFrame) -> tuple[np.ndarray, int] | None:
    """Packed marks of a Bloom filter over one column of keys, sixteen bits a key, and the number of its bits as a power of two.

    None where that is above FILTER_BITS: the caller then joins instead. Only the marks reach the driver, 64 MB at most.
    """
    bits = max(16, (16 * keys.count()).bit_length())
    if bits > FILTER_BITS:
        return None
    marks, part = np.zeros(1 << (bits - 3), np.uint8), 1 << 13
    for r in keys.mapInArrow(_marker(bits), "part int, marks binary").groupBy("part").applyInArrow(_joined_marks, "part int, marks binary").toLocalIterator():
        marks[r["part"] * part : (r["part"] + 1) * part] = np.frombuffer(bytes(r["marks"]), np.uint8)
    return marks, bits


def _marked(filter_: tuple[np.ndarray, int] | None, keys: np.ndarray) -> np.ndarray:
    """Which keys may be among those of the filter; without one all."""
    if filter_ is None:
        return np.ones(len(keys), bool)
    marks, bits = filter_
    one, two = _places(keys, bits)
    return (marks[one >> 3] >> (one & 7).astype(np.uint8) & marks[two >> 3] >> (two & 7).astype(np.uint8) & 1).astype(bool)


def _arrays(filter_):
    """cls, shingles of the rows that pass the filter, which are those asked for and a few more; each class once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = filter_.value
        for b in batches:
            seen, own = set(), []
            for _, s in sets_of(column(b, "text").filter(pa.array(_marked(marks, column(b, "row_key").to_numpy())))):
                if len(s) and (c := class_of(s)) not in seen:
                    seen.add(c)
                    own.append((c, s.view(np.int64)))
            for i in range(0, len(own), 500):
                part = own[i : i + 500]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.list_(pa.int64()))], ["cls", "shingles"])

    return run


def _only(filter_):
    """The sets whose class passes the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = filter_.value
        for b in batches:
            yield b.filter(pa.array(_marked(marks, column(b, "cls").to_numpy())))

    return run


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, bounds) of a list column."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    bounds = lists.offsets.to_numpy()
    return lists.values.to_numpy()[bounds[0] : bounds[-1]], bounds - bounds[0]


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, cls of every shingle."""
    for b in batches:
        keys, bounds = _flat(column(b, "shingles"))
        cls = np.repeat(column(b, "cls").to_numpy(), np.diff(bounds))
        for i in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000]), pa.array(cls[i : i + 100_000])], ["key", "cls"])


def _tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cls, key, f from rows sorted by (key, cls): shingles of two classes or more, f in how many, COMMON standing for more.

    A key's rows are held until the next key, or until they are COMMON many; the order by (f, key) is the same for all sets.
    """
    kept_key = kept_cls = np.empty(0, np.int64)
    told = False  # the one row kept is there to be told from its copies; its key is known to be common

    def out(key: np.ndarray, cls: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(key):
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(key), pa.array(np.minimum(f, COMMON).astype(np.int32))], ["cls", "key", "f"])

    for b in batches:
        key, cls = np.concatenate([kept_key, column(b, "key").to_numpy()]), np.concatenate([kept_cls, column(b, "cls").to_numpy()])
        if not len(key):
            continue
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
        key, cls = key[new], cls[new]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        f = np.diff(np.append(begin, len(key)))
        if told:
            f[0] = COMMON
        last = begin[-1]
        common = f[-1] >= COMMON
        upto = len(key) if common else last
        f = np.repeat(f, np.diff(np.append(begin, len(key))))[:upto]
        shown = f > 1
        shown[: int(told)] = False
        yield from out(key[:upto][shown], cls[:upto][shown], f[shown])
        kept_key, kept_cls, told = (key[-1:], cls[-1:], True) if common else (key[last:], cls[last:], False)
    if not told and len(kept_key) > 1:
        yield from out(kept_key, kept_cls, np.full(len(kept_key), len(kept_key)))


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, cls, n, w from rows (cls, key, f, n) sorted by cls: the shingles of which a partner has to share one, w how many they are.

    Two sets that link share 0.75 n of their shingles at least, all of them tied; so they share one of those that are left when
    each takes away its most frequent ones, one less than that.
    """
    kept: dict[str, np.ndarray] = {}

    def chosen(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        order = np.lexsort((rows["key"], rows["f"], rows["cls"]))
        cls, key, n = rows["cls"][order], rows["key"][order], rows["n"][order]
        begin = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
        size = np.diff(np.append(begin, len(cls)))
        w = size - (3 * n[begin] + 3) // 4 + 1
        keep = np.arange(len(cls)) - np.repeat(begin, size) < np.repeat(w, size)
        return pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(cls[keep]), pa.array(n[keep]), pa.array(np.repeat(w, size)[keep])], ["key", "cls", "n", "w"])

    for b in batches:
        rows = {c: column(b, c).to_numpy() for c in ("cls", "key", "f", "n")}
        if kept:
            rows = {c: np.concatenate([kept[c], rows[c]]) for c in rows}
        if not len(rows["cls"]):
            continue
        last = int(np.searchsorted(rows["cls"], rows["cls"][-1]))
        kept = {c: x[last:] for c, x in rows.items()}
        if last:
            yield chosen({c: x[:last] for c, x in rows.items()})
    if kept:
        yield chosen(kept)


class Block:
    """Sets that may link with their inverted lists, and what is known of their connections."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        owner, flat = np.repeat(np.arange(len(sets)), self.size), np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        new = np.ones(len(flat), bool)
        new[1:] = flat[order][1:] != flat[order][:-1]
        number = np.cumsum(new) - 1
        self.owner, self.begin = owner[order], np.append(np.flatnonzero(new), len(flat))
        self.postings = number * len(sets) + self.owner  # ascending: a probe is one binary search
        self.lists = np.empty(len(flat), np.int64)
        self.lists[order] = number
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.parent = list(range(len(sets)))
        self.members = Counter(self.parent)

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = sorted((self.root(x), self.root(y)))
        if x != y:
            self.parent[y] = x
            self.members[x] += self.members.pop(y)

    def merged(self, lists: np.ndarray) -> Iterator[tuple[int, int]]:
        """(set, lists it is in): a heap over runs, each run the count of RUN lists."""
        runs = []
        for i in range(0, len(lists), RUN):
            at, n = np.unique(np.concatenate([self.owner[self.begin[k] : self.begin[k + 1]] for k in lists[i : i + RUN]]), return_counts=True)
            runs.append(zip(at.tolist(), n.tolist(), strict=True))
        for y, same in groupby(heapq.merge(*runs), itemgetter(0)):
            yield y, sum(n for _, n in same)

    def search(self, x: int) -> None:
        """Connect x with all sets that it links to."""
        n, need = int(self.size[x]), least_overlap(int(self.size[x]))
        lists = self.lists[self.first[x] : self.first[x + 1]]
        length = self.begin[lists + 1] - self.begin[lists]
        lists, length = lists[length > 1], length[length > 1]
        if len(lists) < need:
            return
        lists = lists[np.argsort(length, kind="stable")]
        long = min(need - 1, int(need / (_MU * math.log2(max(2, length.max())) + 1)))
        short, probed = lists[: len(lists) - long], lists[len(lists) - long :]
        own = self.root(x)
        for y, count in self.merged(short):
            if y == x or count < need - long or self.root(y) == own:
                continue
            wanted = probed * len(self.size) + y
            at = np.minimum(np.searchsorted(self.postings, wanted), len(self.postings) - 1)
            if links(count + int((self.postings[at] == wanted).sum()), n, int(self.size[y])):
                self.join(x, y)
                own = self.root(x)

    def connect(self, queries: list[int] | None = None) -> None:
        """Search for every query; with none given, until every set outside the largest component has been searched for.

        A link between two components has an end outside the largest one, so nothing is missed.
        """
        if queries is not None:
            for x in queries:
                self.search(x)
            return
        done, waiting = set(), list(range(len(self.parent)))
        while waiting:
            for x in waiting:
                if not done or self.root(x) != self.members.most_common(1)[0][0]:
                    self.search(x)
                    done.add(x)
            largest = self.members.most_common(1)[0][0]
            waiting = [x for x in waiting if x not in done and self.root(x) != largest]


def _connected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): each set of a unit and the first of its component. Rows come sorted by (unit, role): hub, member, asker; a set counts once."""
    unit, sets, asks = None, {}, set()

    def flush() -> Iterator[pa.RecordBatch]:
        if len(sets) > 1:
            cls = list(sets)
            block = Block(list(sets.values()))
            block.connect([i for i, c in enumerate(cls) if c in asks] if asks else None)
            pairs = [(c, cls[block.root(i)]) for i, c in enumerate(cls) if block.root(i) != i]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    for b in batches:
        values, bounds = _flat(column(b, "shingles"))
        for i, (u, c, role) in enumerate(zip(column(b, "unit").to_pylist(), column(b, "cls").to_pylist(), column(b, "role").to_pylist(), strict=True)):
            if u != unit:
                yield from flush()
                unit, sets, asks = u, {}, set()
            if c not in sets:
                sets[c] = values[bounds[i] : bounds[i + 1]].copy()  # or the whole batch would stay
            if role == ASKER:
                asks.add(c)
    yield from flush()


def _searched(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """links (a, b) of rows(unit, cls, role), stored. All that is known of a set is joined before its shingles move."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = sets.join(rows.hint("merge"), "cls").select("unit", "role", "cls", "shingles")
    return stored(whole.repartition(tasks, "unit").sortWithinPartitions("unit", "role", "cls").mapInArrow(_connected, "a long, b long"))


def survivors(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """cls, n of the sets that share enough of their lowest-hashed part with others (step 2)."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = docs.select("text").mapInArrow(_low_keys, "key long, cls long")
    shared = keys.repartition(tasks, "key").sortWithinPartitions("key", "cls").mapInArrow(_shared, "cls long, shared long")
    shared = shared.groupBy("cls").agg(F.sum("shared").alias("shared"))
    # a partner of a set of n has 0.75 n shingles at least, and both share the smaller one's extra part
    least = F.greatest(F.lit(1), F.floor(F.floor((F.col("n") * 3 + 3) / 4) / EXTRA))
    return classes.join(shared, "cls").where(F.col("shared") >= least).select("cls", "n")


def candidates(sets: DataFrame, sizes: DataFrame) -> DataFrame:
    """cls, hub, n: each set and the hubs it meets (step 3), of sets(cls, shingles) and sizes(cls, n), stored.

    Two sets that link share a rare shingle, and both meet the hub of that: the set with most such shingles, of equal ones
    the one of the highest class.
    """
    tasks = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = sets.mapInArrow(_postings, "key long, cls long").repartition(tasks, "key").sortWithinPartitions("key", "cls")
    tied = keys.mapInArrow(_tied, "cls long, key long, f int").repartition(tasks, "cls").join(sizes, "cls").select("cls", "key", "f", "n")
    rare = stored(tied.sortWithinPartitions("cls").mapInArrow(_prefixes, "key long, cls long, n long, w long"))
    hubs = rare.groupBy("key").agg(F.max(F.struct("w", "cls"))["cls"].alias("hub"), F.count("*").alias("c")).where("c > 1").select("key", "hub")
    return stored(rare.join(hubs, "key").groupBy("cls", "hub").agg(F.first("n").alias("n")))


def similar_classes(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """links (a, b) that connect the classes of listed(doc_id, row_key, n, cls) as all their links do."""
    spark = docs.sparkSession
    classes = listed.where("n > 0").groupBy("cls").agg(F.min("row_key").alias("row_key"), F.first("n").alias("n"))
    chosen = stored(survivors(docs, classes.select("cls", "n")))
    picked = stored(classes.join(chosen.select("cls"), "cls").select("row_key"))
    # texts are filtered where they are read: exchanging them all would cost more than what they are worth here. A class may
    # come more than once, from repeated rows or past the filter; it then only meets itself
    marks = bloom(picked)
    if marks is None:
        docs = docs.join(picked, "row_key", "left_semi")
    sets = stored(docs.mapInArrow(_arrays(spark.sparkContext.broadcast(marks)), "cls long, shingles array<long>"))
    met = candidates(sets, chosen)
    marks = bloom(met.select("cls").distinct())
    return _linked(sets.mapInArrow(_only(spark.sparkContext.broadcast(marks)), sets.schema), met)


def _linked(sets: DataFrame, met: DataFrame) -> DataFrame:
    """links (a, b) of sets(cls, shingles) that meet at hubs: met(cls, hub, n) (step 4)."""
    totals = met.groupBy("hub").agg(F.greatest(F.ceil(F.count("*") / CHUNK_SETS), F.ceil(F.sum("n") / CHUNK_SHINGLES)).cast("int").alias("chunks"))
    role = F.when(F.col("cls") == F.col("hub"), HUB).otherwise(MEMBER)
    placed = met.join(totals, "hub").withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int"))
    # sizes of sets that link differ by a third at most: they are in the same band or in neighbouring ones
    placed = placed.withColumn("band", F.when(F.col("chunks") > 1, F.floor(F.log(F.col("n").cast("double")) / math.log(4 / 3) + 1e-9)).otherwise(0).cast("int"))
    placed = stored(placed.withColumn("unit", F.concat_ws(":", "hub", "band", "chunk")))
    large = placed.where("chunks > 1")
    places = stored(large.select("hub", "band", "unit").distinct())
    # the hub sits in every chunk
    rows = placed.select("unit", "cls", role.alias("role")).union(places.select("unit", F.col("hub").alias("cls"), F.lit(HUB).alias("role")))
    found = _searched(rows, sets)
    if places.isEmpty():
        return found
    # units of several chunks: what is not connected with the hub yet is searched for in the chunks of near sizes
    known = components(found)
    name = lambda of, to: known.select(F.col("node").alias(of), F.col("component").alias(to))
    rest = large.join(name("cls", "own"), "cls", "left").join(name("hub", "its"), "hub", "left")
    rest = stored(rest.where(F.coalesce("own", "cls") != F.coalesce("its", "hub")).select("hub", "band", "cls"))
    if rest.isEmpty():
        return found
    slices_ = rest.groupBy("hub", "band").agg(F.ceil(F.count("*") / CHUNK_SETS).cast("int").alias("slices"))
    asks = rest.join(slices_, ["hub", "band"]).withColumn("slice", F.concat_ws(":", "band", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("slices")).cast("int")))
    asks = asks.withColumn("near", F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)]))).drop("band")
    asks = asks.join(places.withColumnRenamed("band", "near"), ["hub", "near"]).select(F.concat_ws("/", "unit", "slice").alias("unit"), "cls", F.lit(ASKER).alias("role"))
    near = slices_.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).withColumn("slice", F.concat_ws(":", "band", "slice"))
    near = near.select("hub", "slice", F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])).alias("band"))
    asked = large.join(near, ["hub", "band"]).select(F.concat_ws("/", "unit", "slice").alias("unit"), "cls", F.lit(MEMBER).alias("role"))
    return found.union(_searched(asks.union(asked), sets))


def clustered(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_shingles, component_id, component (a name that needs no id), row_key.

    component_id is the smallest doc_id that links reach. A text of fewer than five words, but not none, has its words as one
    shingle; a null, empty or blank text has an empty set, no links and its own id. Null ids count for nothing in minima: a
    component of null ids alone has a null id. Repeated rows are copies. Other columns are not read, and an empty table
    gives no rows. Shingles, and sets of equal shingles, are told apart by 64-bit hashes.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("row_key"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    with arrow_bytes(docs.sparkSession, BATCH_BYTES):  # every step with Python ends in a stored table before this does
        listed = stored(rows.mapInArrow(_classes, f"doc_id {kind}, row_key long, n long, cls long"))
        found = components(similar_classes(rows.select("row_key", "text"), listed))
    classes = listed.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    whole = classes.join(found, F.col("cls") == F.col("node"), "left").select("cls", "least", "rows", "component")
    least = whole.where("component is not null").groupBy("component").agg(F.min("least").alias("lowest"))
    named = whole.join(least, "component", "left").where("component is not null or rows > 1").select("cls", F.coalesce("lowest", "least").alias("component_id"), "component")
    out = listed.join(named, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("component", "cls").alias("component"), "row_key")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs (same columns) with one row of each component: that of the smallest id, of the smaller hash among equal ids.

    Rows without words are all kept, as they are linked with nothing. Texts are exchanged once, to meet the rows that stay.
    """
    found = stored(clustered(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row_key"))
    kept = found.where("n_shingles > 0").groupBy("component").agg(first.alias("f")).select("f.row_key", F.lit(True).alias("single"))
    kept = kept.union(found.where("n_shingles = 0").select("row_key", F.lit(False).alias("single")).distinct())
    keyed = docs.withColumn("__row_key", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    kept = stored(kept.withColumnRenamed("row_key", "__row_key"))
    repeated = found.where("n_shingles > 0").groupBy("row_key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("row_key").alias("__row_key"))
    repeated = stored(repeated.join(kept, "__row_key", "left_semi"))
    out = keyed.join(kept.select("__row_key"), "__row_key", "left_semi")
    if not repeated.isEmpty():  # the very same row several times
        again = out.join(repeated, "__row_key", "left_semi").dropDuplicates(["__row_key"])
        out = out.join(repeated, "__row_key", "left_anti").unionByName(again)
    return out.select(*docs.columns)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")
