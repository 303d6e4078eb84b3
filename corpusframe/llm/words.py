"""Words of many texts at once: numpy over the bytes of an Arrow string column, inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


with np.errstate(over="ignore"):
    _FOLD = np.arange(256, dtype=np.uint8)
    _FOLD[65:91] += 32
    #: a random-looking value for each byte, the same for A-Z and a-z
    _VALUE = _mixed((_FOLD.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
_STEP = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_STEP, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}

#: bytes between words: white space only, or every ASCII byte but letters and digits
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
            have[0] = 1
            have = np.multiply.accumulate(have)
        if n <= 4 * SLICE_BYTES:
            _POWERS[base] = have
    return have[:n]


class Words(NamedTuple):
    """Of a slice of rows: bytes of all texts; of each word its first byte, the byte after it, its row, its 64-bit hash; of each row the first word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) with at most so many bytes, one row at least."""
    texts = texts.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, texts.slice(at, to - at)
        at = to


def _blocks(data: np.ndarray, between: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, bool]]:
    """(begin, end, whether it is one long word) of parts of about SLICE_BYTES that end between words, at a bound of a row or at a byte between words."""
    at = 0
    while at < len(data):
        to = min(len(data), at + SLICE_BYTES)
        if to < len(data) and to not in bounds[np.searchsorted(bounds, to) :][:1]:
            free = np.flatnonzero(between[data[at:to]])
            edge = bounds[np.searchsorted(bounds, to, "right") - 1]
            last = max(at + int(free[-1]) + 1 if len(free) else at, int(edge))
            if last <= at:  # a word that is longer than the part: up to the next byte between words or bound
                stop = int(bounds[np.searchsorted(bounds, at, "right")])
                while to < stop and not len(free := np.flatnonzero(between[data[to : min(to + SLICE_BYTES, stop)]])):
                    to = min(to + SLICE_BYTES, stop)
                yield at, to + int(free[0]) if len(free) else stop, True
                at = to + int(free[0]) if len(free) else stop
                continue
            to = last
        yield at, to, False
        at = to


def _long_hash(data: np.ndarray) -> np.uint64:
    """The hash of one word of any length, part by part."""
    total, factor = 0, 1
    step = pow(_STEP, SLICE_BYTES, 1 << 64)
    for i in range(0, len(data), SLICE_BYTES):
        part = data[i : i + SLICE_BYTES]
        total += int(np.add.reduce(_VALUE[part] * _powers(_STEP, len(part)))) * factor
        factor = factor * step % (1 << 64)
    return _mixed(np.array([(total + len(data)) % (1 << 64)], np.uint64))[0]


def words_of(texts: pa.Array, between: np.ndarray) -> Words:
    """Words of one slice from slices(); A-Z count as a-z in the hashes.

    What is needed for each byte exists for a part of about SLICE_BYTES at a time, so a very long text costs about forty
    bytes for each of its words.
    """
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.empty(0, np.uint8)
    bounds = bounds - bounds[0]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    with np.errstate(over="ignore"):
        for begin, stop, long in _blocks(data, between, bounds):
            if long:
                found.append((np.array([begin]), np.array([stop]), np.array([_long_hash(data[begin:stop])])))
                continue
            part = data[begin:stop]
            inside = ~between[part]
            begins, ends = inside.copy(), inside.copy()
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            edge = bounds[np.searchsorted(bounds, begin, "right") : np.searchsorted(bounds, stop)] - begin  # rows that begin within
            begins[edge] |= inside[edge]
            ends[edge - 1] |= inside[edge - 1]
            start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_VALUE[part] * _powers(_STEP, len(part)), out=total[1:])
            h = _mixed((total[end] - total[start]) * _powers(_BACK, len(part) + 1)[start] + (end - start).astype(np.uint64))
            found.append((start + begin, end + begin, h))
    start, end, h = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))
    first = np.searchsorted(start, bounds)
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(data, start, end, row, h, first)


def prefix_hashes(w: Words, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """For each size the hash of the first so many bytes of every word, 0 for words that are no longer than that."""
    out, size = [], w.end - w.start
    h = np.zeros(len(w.start), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(max(sizes)):
            at = np.minimum(w.start + j, max(len(w.data) - 1, 0))
            h = h * np.uint64(_STEP) + _VALUE[w.data[at]] if len(at) else h
            if j + 1 in sizes:
                out.append(np.where(size > j + 1, _mixed(h + np.uint64(j + 1)), np.uint64(0)))
    return out


def shingle_hashes(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of so many words; a row with fewer words, but not none, has its whole sequence as one run."""
    n = len(w.hash)
    with np.errstate(over="ignore"):
        factor = np.uint64(0xD6E8FEB86659FD93)
        if n >= size:
            h = w.hash[: n - size + 1].copy()
            for j in range(1, size):
                h = h * factor + w.hash[j : n - size + 1 + j]
            same = w.row[: n - size + 1] == w.row[size - 1 :]
            row, h = w.row[: n - size + 1][same], _mixed(h[same])
        else:
            row, h = np.empty(0, np.int64), np.empty(0, np.uint64)
        count = np.diff(w.first)
        short = np.flatnonzero((count > 0) & (count < size))
        if len(short):
            whole = np.zeros(len(short), np.uint64)
            for k, i in enumerate(short):
                x = np.uint64(count[i])
                for y in w.hash[w.first[i] : w.first[i + 1]]:
                    x = x * factor + y
                whole[k] = x
            row, h = np.concatenate([row, short]), np.concatenate([h, _mixed(whole)])
            order = np.argsort(row, kind="stable")
            row, h = row[order], h[order]
    return row, h


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
