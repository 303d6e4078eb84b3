"""Periodic run detection: a suffix automaton whose suffix links are accessed as in a link-cut tree.

The link tree of the automaton's states is cut into paths of one colour, the place where their words last ended. Appending a
word recolours the path from its prefix's state to the root. Each stretch of one colour on that path says that the words of
its deepest state ended there before; where the distance is within their number, two equal blocks stand side by side, a
square. Squares of one distance at successive words are one run. As the tree stands still once all words are in, the
preferred paths of the accesses are kept as stacks along heavy paths: an access costs amortised O(log^2 n).

Only stretches all of whose words stand in a run of six words that the stretch has twice go through the automaton: a run of
12 words or more has every word in one.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corpusframe.llm.common import read
from corpusframe.llm.words import _mixed, column, slices

LEAST, GRAM = 12, 6
#: Bytes of a text that are cut into words at once, and words that are joined at once.
PART_BYTES, PART_WORDS = 4 << 20, 1 << 18
#: Times that stretches are looked through for smaller ones; more would only spare the automaton work.
ROUNDS = 4
_GAP = re.compile(rb"[\x09-\x0d\x20]")


class Automaton:
    """Suffix automaton of one sequence of numbers. Of a state's moves the first is in arrays, others in a dictionary."""

    def __init__(self, words: list[int]):
        self.link, self.length, self.by, self.to, self.more = array("i", [-1]), array("i", [0]), array("i", [-1]), array("i", [0]), {}
        self.state_of = array("i", [0]) * len(words)
        last = 0
        for i, w in enumerate(words):
            last = self.state_of[i] = self._extend(last, w)

    def _move(self, s: int, w: int) -> int:
        return self.to[s] if self.by[s] == w else self.more[s].get(w, -1) if s in self.more else -1

    def _set(self, s: int, w: int, to: int) -> None:
        if self.by[s] < 0 or self.by[s] == w:
            self.by[s], self.to[s] = w, to
        else:
            self.more.setdefault(s, {})[w] = to

    def _state(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.by.append(-1)
        self.to.append(0)
        return len(self.length) - 1

    def _extend(self, last: int, w: int) -> int:
        new, p = self._state(self.length[last] + 1, 0), last
        while p >= 0 and (q := self._move(p, w)) < 0:
            self._set(p, w, new)
            p = self.link[p]
        if p >= 0:
            if self.length[q] > self.length[p] + 1:
                q = self._split(p, w, q)
            self.link[new] = q
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        """A state for the words of q that p reaches by w; q keeps its longer ones."""
        half = self._state(self.length[p] + 1, self.link[q])
        self.by[half], self.to[half] = self.by[q], self.to[q]
        if q in self.more:
            self.more[half] = dict(self.more[q])
        self.link[q] = half
        while p >= 0 and self._move(p, w) == q:
            self._set(p, w, half)
            p = self.link[p]
        return half


def heavy_tops(link: list[int], length: list[int]) -> list[int]:
    """For each state the top of its heavy path in the link tree."""
    order = np.argsort(np.array(length), kind="stable").tolist()  # parents are shorter
    size, heavy = [1] * len(link), [-1] * len(link)
    for s in reversed(order[1:]):
        size[link[s]] += size[s]
    for s in order[1:]:
        if heavy[link[s]] < 0 or size[s] > size[heavy[link[s]]]:
            heavy[link[s]] = s
    top = list(range(len(link)))
    for s in order[1:]:
        if heavy[link[s]] == s:
            top[s] = top[link[s]]
    return top


def squares(words: list[int]) -> Iterator[tuple[int, int]]:
    """(place of the last word, period) of squares: for each place and run that reaches twice its period there, one."""
    a = Automaton(words)
    link, length = a.link.tolist(), a.length.tolist()
    top = heavy_tops(link, length)
    colours: dict[int, list[tuple[int, int]]] = {}  # by path: (length of the deepest state, colour), the stretch next to the root last
    for i, s in enumerate(a.state_of):
        while s > 0:
            t, deep = top[s], length[s]
            path, reach = colours.setdefault(t, []), 0
            while path and path[-1][0] <= deep:
                reach, before = path.pop()
                if i - before <= reach:
                    yield i, i - before
            if path and reach < deep and i - path[-1][1] <= deep:  # a stretch that goes on below this state
                yield i, i - path[-1][1]
            path.append((deep, i))
            s = link[t]


def runs_of(words: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs: squares of one period at successive places are one run, which begins two periods before."""
    open_: dict[int, tuple[int, int]] = {}
    out = []
    for i, d in squares(words):
        first, last = open_.get(d, (i, i))
        if last < i - 1:
            out.append((first - 2 * d + 1, last - first + 2 * d, d))
            first = i
        open_[d] = (first, i)
    return out + [(first - 2 * d + 1, last - first + 2 * d, d) for d, (first, last) in open_.items()]


def stretches(words: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, after the last) of stretches that hold all runs of LEAST words and twice their period."""
    todo = [(0, len(words), 0)]
    while todo:
        begin, end, done = todo.pop()
        if end - begin < LEAST:
            continue
        if done == ROUNDS:
            yield begin, end
            continue
        with np.errstate(over="ignore"):
            x = _mixed(words[begin:end].astype(np.uint64) + np.uint64(1))
            g = x[: len(x) - GRAM + 1].copy()
            for j in range(1, GRAM):
                g = g * np.uint64(0xD6E8FEB86659FD93) + x[j : len(x) - GRAM + 1 + j]
        order = np.argsort(g, kind="stable")
        same = g[order[1:]] == g[order[:-1]]
        if not same.any():
            continue
        edge = np.zeros(end - begin + 1, int)
        twice = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + GRAM, -1)
        inside = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
        bounds = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2) + begin
        whole = len(bounds) == 1 and bounds[0][1] - bounds[0][0] == end - begin
        todo += [(int(b), int(e), ROUNDS if whole else done + 1) for b, e in bounds]


def _parts(raw: bytes) -> Iterator[list[bytes]]:
    at = 0
    while at < len(raw):
        gap = _GAP.search(raw, at + PART_BYTES)
        to = gap.start() if gap else len(raw)
        yield raw[at:to].split()
        at = to


def _hashed(words: Iterator[list[bytes]]) -> str:
    h, first = hashlib.sha256(), True
    for part in words:
        if part:
            h.update(b"" if first else b" ")
            h.update(b" ".join(part))
            first = False
    return h.hexdigest()


def dealt(n: int, doc_id) -> np.ndarray | None:
    """For one document in ten the places its words are taken from: from some place on they repeat with a period."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def examined(raw: bytes, at=dealt, doc_id=None) -> tuple:
    """n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 and the runs of one text. at: see dealt()."""
    known: dict[bytes, int] = {}
    places, parts, number = [], [], count()
    for part in _parts(raw):
        places.append(np.fromiter(map(known.setdefault, part, number), np.int32, len(part)))
        parts.append(part)
        if len(raw) > PART_BYTES:
            parts.clear()  # of a long text only the distinct words stay
    words = np.concatenate(places) if places else np.empty(0, np.int32)
    taken = at(len(words), doc_id)
    if taken is not None:
        words, parts = words[taken], []
    found = sorted((begin + s, n, q) for begin, end in stretches(words) for s, n, q in runs_of(words[begin:end].tolist()) if n >= LEAST)
    keep = np.ones(len(words), bool)
    for s, n, q in found:
        keep[s + q : s + n] = False
    if found or not parts:
        named = {i: w for w, i in known.items()}
        kept = words[keep]
        parts = (list(map(named.__getitem__, kept[i : i + PART_WORDS].tolist())) for i in range(0, len(kept), PART_WORDS))
    start, length, period = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    listed = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in sorted(found, key=lambda r: (r[0], r[2]))).encode()).hexdigest()
    return len(found), start, length, period, None if period is None else 1000 * length // period, listed, _hashed(iter(parts)), found


NAMES = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs"]
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_TYPES = [*[pa.int64()] * 5, pa.string(), pa.string(), _RUNS]
SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>"


def with_runs(docs: DataFrame, deal: bool = False) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, runs of every row of docs(doc_id, text).

    Words are what lies between ASCII white space, compared as they are. deal: first gives one document in ten a periodic end,
    as the crc32 of its id says (a null id counts as the empty text). A null, empty or blank text has no words and no runs: the
    hashes are those of the empty text, the four numbers of the longest run null. Repeated rows each come out; other columns
    are not read; an empty table gives no rows. Nothing is exchanged. A text of any length is worked on whole: some ten bytes
    for each of its words and a hundred for each word of its longest stretch of repeats.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = column(b, "doc_id")
            for first, part in slices(column(b, "text")):
                own = ids.slice(first, len(part))
                found = [examined(x, dealt if deal else lambda n, i: None, i) for x, i in zip(part.cast(pa.large_binary()).to_pylist(), own.to_pylist(), strict=True)]
                runs = [[{"start": s, "length": n, "period": q} for s, n, q in f[7]] for f in found]
                yield pa.RecordBatch.from_arrays([own, *(pa.array([f[k] for f in found], t) for k, t in enumerate(_TYPES[:7])), pa.array(runs, _RUNS)], ["doc_id", *NAMES])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_runs(read(spark, sf_dir, "documents"), deal=True).drop("runs")
