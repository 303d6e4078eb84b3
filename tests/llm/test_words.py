"""Words of texts that are longer than what is looked at at once."""

import re

import numpy as np
import pyarrow as pa
import pytest

from corpusframe.llm import words

PATTERN = {"space": (words.SPACE, rb"[^\x20\x09-\x0d]+"), "alnum": (words.NOT_ALNUM, rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")}


@pytest.mark.parametrize("kind", PATTERN)
@pytest.mark.parametrize("size", [1 << 20, 64, 7, 1])
def test_words_do_not_depend_on_the_size_of_the_parts(monkeypatch, kind, size):
    between, pattern = PATTERN[kind]
    rng = np.random.default_rng(2)
    rows = ["", "a", None, " ", "x" * 300, "One two  three", "é" * 90 + " end", ".".join("ab" * k for k in range(40))]
    rows += ["".join(rng.choice(list("aB. \n-é"), rng.integers(0, 200))) for _ in range(80)]
    texts = next(words.slices(pa.array(rows), 1 << 30))[1]
    whole = words.words_of(texts, between)
    monkeypatch.setattr(words, "SLICE_BYTES", size)
    monkeypatch.setattr(words, "_POWERS", {})
    w = words.words_of(texts, between)
    for a, b in zip(whole, w, strict=True):
        assert np.array_equal(a, b)
    expected = [m.group().decode("utf-8", "replace").translate({c: c + 32 for c in range(65, 91)}) for r in rows for m in re.finditer(pattern, (r or "").encode().lower())]
    got = [w.text(i).translate({c: c + 32 for c in range(65, 91)}) for i in range(len(w.start))]
    assert got == expected
    names = {}
    assert all(names.setdefault(h, x) == x for h, x in zip(w.hash.tolist(), got, strict=True)) and len(names) == len(set(got))


def test_a_very_long_text_needs_memory_by_its_words_only():
    import tracemalloc

    text = pa.array(["lorem ipsum dolor " * 600_000 + "z" * 3_000_000])
    part = next(words.slices(text))[1]
    tracemalloc.start()
    w = words.words_of(part, words.SPACE)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(w.start) == 1_800_001 and peak < 60 * len(w.start) + 120_000_000
