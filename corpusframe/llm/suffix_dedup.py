"""Suffix-array dedup: a logarithmic family of sampled suffix arrays finds every byte of a text that stands in a repeated string.

An array holds the suffixes at sampled places in the order of a fingerprint of their first GRAM bytes. A place is sampled if
its GRAM bytes hash lowest among those of some string of REACH bytes around it, so equal strings of REACH bytes hold the same
sampled suffix at the same distance from their start: two strings can be equal only where their suffixes meet in the arrays.

Inside a task every slice of texts gets such an array; arrays of equal size are merged, and what a merge meets twice is
reported and kept once, at its first place. The arrays of all tasks, and the stored levels of earlier batches, are cut at the
same fingerprints, dealt out packed and merge-scanned: a suffix with the very same surroundings as an earlier one is repeated
with all the strings that it stands for; of those whose surroundings agree in part the bytes are fetched, and their strings
compared one by one. A batch's array becomes a level, and two levels of equal size become one (IndexFamily).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusframe.llm.common import arrow_bytes, read, stored
from corpusframe.llm.jaccard_join import _marked, bloom
from corpusframe.llm.words import _BACK, _STEP, SLICE_BYTES, _mixed, _powers, column, slices

GRAM, REACH = 32, 100
SPAN = REACH - GRAM + 1
#: The strings of a suffix are told apart in so many parts, by where the suffix stands in them; what a part has in common is compared first.
PARTS = 4
PART = -(-SPAN // PARTS)
#: Suffixes that a task holds before it sends them off.
HELD = 1 << 19
#: One document in so many is looked through for fingerprints that many suffixes share; they are dealt out further. Only the dealing depends on it.
LOOK, OFTEN, MOST_OFTEN = 64, 16, 10_000
#: Suffixes of one piece of the dealt arrays, about: as few as that where it makes no more than sixteen pieces a task, and never so many as the second.
PIECE, LARGEST = 1 << 14, 1 << 20
#: Of texts and arrays that pass through Python at once, one row at least.
BATCH_BYTES = 4 << 20
_SENT = 100_000
_PLACE_BITS = 21
NO_ID = -(1 << 63)
#: kind 0: a piece k of an array; 1: bytes that stand earlier; both packed.
PACKED = "kind int, k long, packed binary"
#: kind 0: suffixes (a: place, b: fingerprint) whose strings are to be compared; 1: bytes a to b that stand earlier; 2: a piece of the batch's array.
FOUND = "kind int, id long, th long, a long, b long, k long, packed binary"
_FIELDS = ("g", "c", "id", "th", "at", "core")
_TYPES = {"core": np.int32}

with np.errstate(over="ignore"):
    _BYTE = _mixed((np.arange(256, dtype=np.uint64) + np.uint64(77)) * np.uint64(0x9E3779B97F4A7C15))


class Prefixes:
    """Hashes of the parts of a byte string: polynomials, from their sums up to each byte."""

    def __init__(self, data: np.ndarray):
        self.total = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE[data] * _powers(_STEP, len(data)), out=self.total[1:])
        self.back = _powers(_BACK, len(data) + 1)

    def of(self, begin: np.ndarray, end: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mixed((self.total[end] - self.total[begin]) * self.back[begin] + ((end - begin) + (np.asarray(salt) << 20)).astype(np.uint64))


def _lowest(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every size neighbours."""
    have = 1
    while 2 * have <= size:
        x, have = np.minimum(x[:-have], x[have:]), 2 * have
    return np.minimum(x[: len(x) - (size - have)], x[size - have :]) if have < size else x


def sampled(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """row, q, first, last, g, c, core of the sampled suffixes of rows data[bounds[i]:bounds[i + 1]].

    q is the suffix's place; the strings of REACH bytes that it stands for begin at first to last. g, c: fingerprints of its
    GRAM bytes and of all that those strings cover, with the place in it; core: a byte for each part that has strings, of what they share.
    """
    n = len(data)
    edge = np.zeros(max(n - REACH + 2, 1), np.int64)
    long = np.flatnonzero(np.diff(bounds) >= REACH)
    if not len(long):
        return {k: np.empty(0, np.int64) for k in ("row", "q", "first", "last", "g", "c", "core")}
    edge[bounds[long]] += 1
    np.add.at(edge, bounds[long + 1] - REACH + 1, -1)
    starts = np.flatnonzero(np.cumsum(edge[:-1]))
    p = Prefixes(data)
    every = np.arange(n - GRAM + 1)
    grams, low = p.of(every, every + GRAM), np.uint64((1 << _PLACE_BITS) - 1)
    lowest = (_lowest((grams & ~low) | every.astype(np.uint64), SPAN)[starts] & low).astype(np.int64)
    begin = np.flatnonzero(np.concatenate([[True], lowest[1:] != lowest[:-1]]))
    q, first, last = lowest[begin], starts[begin], starts[np.append(begin[1:], len(starts)) - 1]
    core = np.zeros(len(q), np.uint32)
    for j in range(PARTS):
        least, most = j * PART, min((j + 1) * PART, SPAN) - 1
        has = np.flatnonzero((q - last <= most) & (q - first >= least))
        h = p.of(q[has] - least, q[has] - most + REACH)
        core[has] |= ((h % np.uint64(255)).astype(np.uint32) + np.uint32(1)) << np.uint32(8 * j)
    c = p.of(first, last + REACH, q - first + 1)
    return {"row": np.searchsorted(bounds, q, "right") - 1, "q": q, "first": first, "last": last, "g": grams[q].view(np.int64), "c": c.view(np.int64), "core": core.view(np.int32)}


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, place in it, bytes, bounds of rows) of slices; a text longer than a slice comes in pieces that overlap by a string."""
    for at, part in slices(texts):
        bounds = np.frombuffer(part.buffers()[1], np.int64, len(part) + 1, part.offset * 8)
        raw = part.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.empty(0, np.uint8)
        if len(part) > 1 or len(data) <= SLICE_BYTES:
            yield at, 0, data, bounds - bounds[0]
        else:
            for i in range(0, len(data), SLICE_BYTES):
                piece = data[i : i + SLICE_BYTES + REACH - 1]
                yield at, i, piece, np.array([0, len(piece)])


def first_of_each(rows: dict[str, np.ndarray], *keys: str) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """rows in the order of keys and places; which are the first of their keys; which of the others stand elsewhere than the first."""
    order = np.argsort(rows[keys[-1]], kind="stable")
    key = rows[keys[-1]][order]
    same = key[1:] == key[:-1]
    several = np.zeros(len(key), bool)
    several[1:] = same
    several[:-1] |= same
    if several.any():
        sub = order[several]
        order[several] = sub[np.lexsort([rows[k][sub] for k in ("at", "th", "id", *reversed(keys))])]
    rows = {k: x[order] for k, x in rows.items()}
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([rows[k][1:] != rows[k][:-1] for k in keys], axis=0)
    lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    away = ~new & np.any([rows[k] != rows[k][lead] for k in ("id", "th", "at")], axis=0)
    return rows, new, away


def _covered(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """id, th, begin, end of the bytes that strings of rows cover, joined where they touch."""
    begin, end = (rows["at"] >> 14) - (rows["at"] >> 7 & 127), (rows["at"] >> 14) - (rows["at"] & 127) + REACH
    order = np.lexsort([begin, rows["th"], rows["id"]])
    id_, th, begin, end = rows["id"][order], rows["th"][order], begin[order], end[order]
    if not len(id_):
        return {"id": id_, "th": th, "begin": begin, "end": end}
    doc = np.concatenate([[True], (id_[1:] != id_[:-1]) | (th[1:] != th[:-1])])
    far = np.int64(1) << 40  # more than any text has bytes
    shift = np.cumsum(doc) * far
    reach = np.maximum.accumulate(end + shift)
    new = doc.copy()
    new[1:] |= begin[1:] + shift[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return {"id": id_[at], "th": th[at], "begin": begin[at], "end": (reach - shift)[np.append(at[1:], len(id_)) - 1]}


def _packed(rows: dict[str, np.ndarray], data: bytes = b"") -> bytes:
    """Columns of whole numbers as planes of bytes, compressed, with other bytes behind them."""
    planes = b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() for x in rows.values())
    body = planes + data
    return len(body).to_bytes(8, "little") + len(next(iter(rows.values()))).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True)


def _unpacked(packed: bytes, fields: tuple[str, ...]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    size, n = int.from_bytes(packed[:8], "little"), int.from_bytes(packed[8:16], "little")
    body = np.frombuffer(pa.decompress(packed[16:], size, "zstd", asbytes=True), np.uint8)
    rows, at = {}, 0
    for f in fields:
        kind = np.dtype(_TYPES.get(f, np.int64))
        rows[f] = np.ascontiguousarray(body[at : at + n * kind.itemsize].reshape(kind.itemsize, n).T).view(kind).ravel()
        at += n * kind.itemsize
    return rows, body[at:]


def _record(kind: int, k: list[int], packed: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(k), pa.int32()), pa.array(k, pa.int64()), pa.array(packed, pa.binary())], ["kind", "k", "packed"])


def piece_of(key: np.ndarray, pieces: int) -> np.ndarray:
    """Which of so many pieces a key is in. Sampled fingerprints are small ones, as they are the lowest around, so ranges are of a hash of the key."""
    with np.errstate(over="ignore"):
        spread = _mixed(key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return ((spread >> np.uint64(32)) * np.uint64(pieces) >> np.uint64(32)).astype(np.int64)


def _dealt(k: np.ndarray, rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """rows in pieces, in the order of their first column within each."""
    order = np.lexsort([next(iter(rows.values())), k])
    k, rows = k[order], {f: x[order] for f, x in rows.items()}
    if not len(k):
        return
    begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    ends = np.append(begin[1:], len(k))
    yield from _records(0, k[begin].tolist(), (_packed({f: x[a:b] for f, x in rows.items()}) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)))


def _records(kind: int, k: list[int], packed: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about BATCH_BYTES."""
    held, first, size = [], 0, 0
    for x in packed:
        held.append(x)
        size += len(x)
        if size > BATCH_BYTES:
            yield _record(kind, k[first : first + len(held)], held)
            held, first, size = [], first + len(held), 0
    if held:
        yield _record(kind, k[first:], held)


_SPAN_FIELDS = ("id", "th", "begin", "end")


class Levels:
    """The family inside a task: arrays of suffixes, with how many slices they come from; two of one size are merged."""

    def __init__(self, often: np.ndarray, pieces: int):
        self.levels, self.twice, self.often, self.pieces = [], [], often, pieces

    def _merged(self, parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
        rows, first, away = first_of_each({k: np.concatenate([p[k] for p in parts]) for k in _FIELDS}, "c")
        if away.any():
            self.twice.append({k: x[away] for k, x in rows.items()})
        return {k: x[first] for k, x in rows.items()}

    def add(self, rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        self.levels.append((1, self._merged([rows])))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, a), (m, b) = self.levels.pop(), self.levels.pop()
            self.levels.append((n + m, self._merged([b, a])))
        if sum(len(x["c"]) for _, x in self.levels) > HELD:
            yield from self.sent()

    def sent(self) -> Iterator[pa.RecordBatch]:
        if self.levels:
            rows = self._merged([x for _, x in self.levels])
            # suffixes of a frequent fingerprint are dealt by their surroundings, as those are many
            key = np.where(np.isin(rows["g"], self.often), rows["c"], rows["g"]) if len(self.often) else rows["g"]
            yield from _dealt(piece_of(key, self.pieces), rows)
        if self.twice:
            spans = _covered({k: np.concatenate([p[k] for p in self.twice]) for k in _FIELDS})
            # they only ride along: each bundle of them to a piece by its first row
            for i in range(0, len(spans["id"]), _SENT // 10):
                own = {f: spans[f][i : i + _SENT // 10] for f in _SPAN_FIELDS}
                key = _mixed(own["id"][:1].view(np.uint64) + own["begin"][:1].astype(np.uint64) * np.uint64(3)).view(np.int64)
                yield _record(1, piece_of(key, self.pieces).tolist(), [_packed(own)])
        self.levels, self.twice = [], []


def _suffixes_of(often, pieces: int):
    """Arrow batches (id, th, text) -> PACKED: sampled suffixes, each kind of surroundings once a task, and what the task has twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = Levels(often.value, pieces)
        for b in batches:
            id_, th = column(b, "id").to_numpy(), column(b, "th").to_numpy()
            for row, place, data, bounds in _pieces(column(b, "text")):
                s = sampled(data, bounds)
                q = s["q"] - bounds[s["row"]] + place
                doc = s["row"] + row
                yield from family.add({"g": s["g"], "c": s["c"], "id": id_[doc], "th": th[doc], "at": q << 14 | (s["q"] - s["first"]) << 7 | (s["q"] - s["last"]), "core": s["core"]})
        yield from family.sent()

    return run


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches (text) -> g of every sampled suffix."""
    for b in batches:
        for _, _, data, bounds in _pieces(column(b, "text")):
            yield pa.RecordBatch.from_arrays([pa.array(sampled(data, bounds)["g"])], ["g"])


_ASKED = ("g", "id", "th", "at")


def _ranges(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first, first + 1, .. of so many each, one after the other."""
    return np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())


def _surroundings_of(often, pieces: int):
    """Arrow batches (id, th, text, wanted) -> PACKED: for each suffix wanted the bytes around it that its strings cover, dealt by
    fingerprint. Of a frequent fingerprint's suffixes the strings go by a hash each, so that no piece gets them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = Levels(np.empty(0, np.int64), pieces)
        held, size = [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            rows = {f: np.concatenate([x[0][f] for x in held]) for f in _ASKED}
            data = np.concatenate([x[1] for x in held])
            many = (rows["at"] >> 7 & 127) - (rows["at"] & 127) + REACH
            begin = np.cumsum(many) - many
            k = piece_of(rows["g"], pieces)
            order = np.lexsort([rows["g"], k])
            k, bounds = k[order], np.flatnonzero(np.concatenate([[True], np.diff(k[order]) > 0, [True]]))
            pieces_ = [order[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield from _records(2, k[bounds[:-1]].tolist(), (_packed({f: x[own] for f, x in rows.items()}, data[_ranges(begin[own], many[own])].tobytes()) for own in pieces_))

        for b in batches:
            id_, th, wanted = column(b, "id").to_numpy(), column(b, "th").to_numpy(), column(b, "wanted")
            count, flat = np.diff(wanted.offsets.to_numpy()), wanted.flatten()
            at, g = flat.field("at").to_numpy(), flat.field("g").to_numpy()
            doc = np.repeat(np.arange(len(b)), count)
            first, last = (at >> 14) - (at >> 7 & 127), (at >> 14) - (at & 127)
            for row, place, data, bounds in _pieces(column(b, "text")):
                here = (doc >= row) & (doc < row + len(bounds) - 1)
                if len(bounds) == 2:  # maybe one piece of several; all strings of a suffix lie in one
                    here &= (first >= place) & (first < place + SLICE_BYTES) & (last - place + REACH <= len(data))
                own, base = np.flatnonzero(here), bounds[doc[here] - row] - place
                apart = np.isin(g[own], often.value) if len(often.value) else np.zeros(len(own), bool)
                if apart.any():
                    who, many = own[apart], (last - first + 1)[own[apart]]
                    start = _ranges(first[who], many)
                    h = Prefixes(data).of(start + np.repeat(base[apart], many), start + np.repeat(base[apart], many) + REACH).view(np.int64)
                    names = np.repeat(doc[who], many)
                    yield from family.add({"g": h, "c": h, "id": id_[names], "th": th[names], "at": start << 14, "core": np.zeros(len(h), np.int32)})
                own, base = own[~apart], base[~apart]
                if len(own):
                    bytes_ = data[_ranges(first[own] + base, (last - first)[own] + REACH)]
                    held.append(({"g": g[own], "id": id_[doc[own]], "th": th[doc[own]], "at": at[own]}, bytes_))
                    size += len(bytes_)
                    if size > 4 * SLICE_BYTES:
                        yield from sent()
                        held, size = [], 0
        if held:
            yield from sent()
        yield from family.sent()

    return run


def _spans_found(spans: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    yield from _found(1, spans["id"], spans["th"], spans["begin"], spans["end"])


def _found(kind: int, *rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows[0]), _SENT):
        part = [pa.array(x[i : i + _SENT]) for x in rows]
        n = len(part[0])
        yield pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), *part, pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], ["kind", "id", "th", "a", "b", "k", "packed"])


def _by_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """(k, its packed rows) of rows sorted by k."""
    at, own = None, []
    for b in batches:
        for kind, k, packed in zip(column(b, "kind").to_pylist(), column(b, "k").to_pylist(), column(b, "packed"), strict=True):
            if k != at and own:
                yield at, own
                own = []
            at = k
            own.append((kind, packed.as_py()))
    if own:
        yield at, own


def _rode_along(own: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for kind, packed in own:
        if kind == 1:
            yield from _spans_found(_unpacked(packed, _SPAN_FIELDS)[0])


def _scanned(often, since: int, keep: bool):
    """PACKED sorted by k -> FOUND. Only what concerns ids from since on is reported; pieces of the batch's array if kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, own in _by_piece(batches):
            yield from _rode_along(own)
            parts = [_unpacked(packed, _FIELDS)[0] for kind, packed in own if kind == 0]
            if not parts:
                continue
            rows, first, away = first_of_each({f: np.concatenate([x[f] for x in parts]) for f in _FIELDS}, "g", "c")
            del parts
            fresh = rows["id"] >= since
            if (again := away & fresh).any():
                yield from _spans_found(_covered({f: x[again] for f, x in rows.items()}))
            rows, fresh = {f: x[first] for f, x in rows.items()}, fresh[first]
            if keep and fresh.any():
                yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), *[pa.nulls(1, pa.int64())] * 4, pa.array([k], pa.int64()), pa.array([_packed({f: x[fresh] for f, x in rows.items()})], pa.binary())], ["kind", "id", "th", "a", "b", "k", "packed"])
            wanted = np.isin(rows["g"], often.value) if len(often.value) else np.zeros(len(rows["g"]), bool)
            for j in range(PARTS):
                core = rows["core"].view(np.uint32) >> np.uint32(8 * j) & np.uint32(255)
                has = np.flatnonzero(core)
                order = has[np.lexsort([core[has], rows["g"][has]])]
                g, x = rows["g"][order], core[order]
                begin = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (x[1:] != x[:-1])])) if len(g) else np.empty(0, int)
                if len(begin):
                    size = np.diff(np.append(begin, len(g)))
                    hit = (size > 1) & (np.add.reduceat(fresh[order].astype(int), begin) > 0)
                    wanted[order[np.repeat(hit, size)]] = True
            yield from _found(0, *(rows[f][wanted] for f in ("id", "th", "at", "g")))

    return run


def _compared(since: int):
    """PACKED sorted by k -> FOUND: the strings of surroundings, and those that came by a hash each, that stand earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in _by_piece(batches):
            yield from _rode_along(own)
            strings = [_unpacked(packed, _FIELDS)[0] for kind, packed in own if kind == 0]
            for kind, packed in own:
                if kind == 2:
                    rows, data = _unpacked(packed, _ASKED)
                    many = (rows["at"] >> 7 & 127) - (rows["at"] & 127) + 1
                    begin = np.cumsum(many + REACH - 1) - (many + REACH - 1)
                    start = _ranges(begin, many)
                    h = Prefixes(data).of(start, start + REACH).view(np.int64)
                    place = _ranges((rows["at"] >> 14) - (rows["at"] >> 7 & 127), many)
                    strings.append({"c": h, "id": np.repeat(rows["id"], many), "th": np.repeat(rows["th"], many), "at": place << 14})
            if strings:
                rows, _, away = first_of_each({f: np.concatenate([x[f] for x in strings]) for f in ("c", "id", "th", "at")}, "c")
                again = away & (rows["id"] >= since)
                yield from _spans_found(_covered({f: x[again] for f, x in rows.items()}))

    return run


def _one_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PACKED sorted by k -> one packed array for each piece."""
    for k, own in _by_piece(batches):
        parts = [_unpacked(packed, _FIELDS)[0] for _, packed in own]
        rows = first_of_each({f: np.concatenate([x[f] for x in parts]) for f in _FIELDS}, "g", "c")[0]
        yield _record(0, [k], [_packed(rows)])


def _only(marks, wanted: bool):
    """The rows whose key is, or is not, among those of a Bloom filter; the latter surely are not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = marks.value
        for b in batches:
            yield b.filter(pa.array(_marked(own, column(b, "key").to_numpy()) == wanted))

    return run


_CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin:int,end:int>>"


def _cut(kind: pa.DataType):
    """Arrow batches (doc_id, text, spans) -> _CUT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            spans = column(b, "spans")
            for first, part in slices(column(b, "text")):
                for i, raw in enumerate(part.cast(pa.large_binary())):
                    data, own = raw.as_buffer(), spans[first + i].values
                    joined: list[list[int]] = []
                    if own is not None and len(own):
                        begin, end = own.field("begin").to_numpy(), own.field("end").to_numpy()
                        order = np.argsort(begin, kind="stable")
                        begin, reach = begin[order], np.maximum.accumulate(end[order])
                        at = np.flatnonzero(np.concatenate([[True], begin[1:] > reach[:-1]]))
                        joined = np.stack([begin[at], reach[np.append(at[1:], len(begin)) - 1]], 1).tolist()
                    h, at = hashlib.sha256(), 0
                    for begin_, end_ in joined:
                        h.update(data[at:begin_])
                        at = end_
                    h.update(data[at:])
                    rows.append((len(data), sum(e - a for a, e in joined), len(joined), h.hexdigest(), [{"begin": a, "end": e} for a, e in joined]))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id").cast(kind), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


class Level(NamedTuple):
    batches: int
    suffixes: DataFrame
    docs: DataFrame


class IndexFamily:
    """Levels of stored suffix arrays. Batches are added in ascending order of their ids; each is told what it repeats of itself and of all before.

    keep=False leaves the last batch's own array out, where none follows.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.levels, self.last, self.pieces = spark, [], NO_ID, 0

    def add(self, docs: DataFrame, keep: bool = True) -> DataFrame:
        """A batch: see _added(), whose result is stored, so that texts pass through Python in short batches as long as they do."""
        with arrow_bytes(self.spark, BATCH_BYTES):
            return stored(self._added(docs, keep))

    def _added(self, docs: DataFrame, keep: bool) -> DataFrame:
        """Per row of docs(doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (begin, after the end of every removed run).

        A byte is removed if a string of REACH bytes over it stands earlier: in a document of a smaller id, or before in the
        same. A null id counts as the smallest; of several texts with one id the one of the smaller hash comes first, and rows
        with one id and one text are one document. A null text counts as empty; texts below REACH bytes stay whole. Other
        columns are not read; an empty table gives no rows. Hashes of 64 bits stand for strings.
        """
        id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
        rows = docs.select("doc_id", id_.alias("id"), F.coalesce("text", F.lit("")).alias("text"))
        ids = rows.groupBy("id").agg(F.count("*").alias("n")).agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max("n").alias("n")).first()
        if self.levels and ids["low"] is not None and ids["low"] <= self.last:
            raise ValueError("batches have to come in ascending order of their ids")
        since = self.last + 1 if self.levels else NO_ID
        # repeated ids are told apart by their texts' hashes; where there are none the hash would only be freight
        rows = rows.withColumn("th", F.lit(0).cast("long") if (ids["n"] or 1) == 1 else F.xxhash64("text"))
        rows = rows.select("doc_id", "id", "th", F.xxhash64("id", "th").alias("key"), "text")
        known = rows
        for level in self.levels:
            known = known.unionByName(level.docs)
        read_ = rows.select("id", "th", "text")
        if not self.pieces:
            looked = read_.where(F.pmod(F.xxhash64("id", "th", F.lit(1)), F.lit(LOOK)) == 0).select("text").mapInArrow(_fingerprints, "g long").groupBy("g").agg(F.count("*").alias("n"))
            looked = stored(looked)
            often = looked.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "g").limit(MOST_OFTEN).select("g").collect()
            self.often = self.spark.sparkContext.broadcast(np.array(sorted(r["g"] for r in often), np.int64))
            total = (looked.agg(F.sum("n")).first()[0] or 0) * LOOK
            self.pieces = max(2 * self.tasks, min(16 * self.tasks, total // PIECE), total // LARGEST)
        suffixes = read_.mapInArrow(_suffixes_of(self.often, self.pieces), PACKED)
        for level in self.levels:
            suffixes = suffixes.unionByName(level.suffixes)
        found = self._dealt(suffixes, _scanned(self.often, since, keep), FOUND)
        wanted = found.where("kind = 0").groupBy("id", "th").agg(F.collect_list(F.struct(F.col("a").alias("at"), F.col("b").alias("g"))).alias("wanted"))
        asked = self._with_texts(known, wanted).select("id", "th", "text", "wanted")
        more = self._dealt(asked.mapInArrow(_surroundings_of(self.often, self.pieces), PACKED), _compared(since), FOUND)
        spans = found.where("kind = 1").unionByName(more.where("kind = 1")).groupBy("id", "th").agg(F.collect_list(F.struct(F.col("a").cast("int").alias("begin"), F.col("b").cast("int").alias("end"))).alias("spans"))
        out = self._told(rows, stored(spans), docs)
        if keep:
            self._grown(Level(1, found.where("kind = 2").select(F.lit(0).alias("kind"), "k", "packed"), rows), ids["high"])
        return out

    @property
    def tasks(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _dealt(self, packed: DataFrame, then, schema: str) -> DataFrame:
        """Pieces of arrays brought together by their number and worked on one after the other."""
        return stored(packed.repartition(self.tasks, "k").sortWithinPartitions("k").mapInArrow(then, schema))

    def _with_texts(self, rows: DataFrame, of: DataFrame) -> DataFrame:
        """rows joined to what is known of(id, th): only texts that a Bloom filter of bounded size lets pass move, all where it would be too large."""
        of = stored(of)
        marks = self.spark.sparkContext.broadcast(bloom(of.select(F.xxhash64("id", "th").alias("key"))))
        return rows.mapInArrow(_only(marks, True), rows.schema).join(of.hint("merge"), ["id", "th"])

    def _told(self, rows: DataFrame, spans: DataFrame, docs: DataFrame) -> DataFrame:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = docs.schema["doc_id"].dataType
        schema = _CUT.replace("doc_id long", f"doc_id {kind.simpleString()}")
        marks = bloom(spans.select(F.xxhash64("id", "th").alias("key")))
        sent = self.spark.sparkContext.broadcast(marks)
        own = rows.mapInArrow(_only(sent, True), rows.schema) if marks is not None else rows
        cut = own.join(spans.hint("merge"), ["id", "th"], "left").select("doc_id", "text", "spans").mapInArrow(_cut(to_arrow_type(kind)), schema)
        if marks is None:
            return cut
        size, zero, none = F.octet_length("text").cast("long"), F.lit(0).cast("long"), F.array().cast("array<struct<begin:int,end:int>>")
        whole = rows.select("key", "doc_id", size.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
        whole = whole.mapInArrow(_only(sent, False), whole.schema).drop("key").withColumn("spans", none)
        return whole.unionByName(cut)

    def _grown(self, level: Level, last: int | None) -> None:
        """A level more; while the last two come from equally many batches they are written as one."""
        if last is None:
            return
        self.last = max(self.last, last)
        self.levels.append(level)
        while len(self.levels) > 1 and self.levels[-1].batches == self.levels[-2].batches:
            b, a = self.levels.pop(), self.levels.pop()
            both = self._dealt(a.suffixes.unionByName(b.suffixes), _one_piece, PACKED)
            self.levels.append(Level(a.batches + b.batches, both, a.docs.unionByName(b.docs)))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return IndexFamily(spark).add(read(spark, sf_dir, "documents"), keep=False).drop("spans")
