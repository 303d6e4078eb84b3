"""Suffix-array dedup, periodic runs and whitening against brute force, and on awkward tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from corpusframe.llm import periodic_runs, suffix_dedup, whitening


# --- suffix-array dedup -----------------------------------------------------------------------------------------------------------


def repeated_bytes(rows):
    """doc_id -> (n_bytes, n_removed, n_spans, hash of what is kept), string by string."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        b = text.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        spans = sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def mixed_texts(n, seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 9))) for _ in range(30)]
    passages = [" ".join(rnd.choice(words) for _ in range(rnd.choice([8, 15, 20, 25, 40]))) for _ in range(10)]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(rnd.randint(0, 6)):
            text += rnd.choice(passages)[rnd.choice([0, 0, 0, 7, 13]) :] if rnd.random() < 0.6 else " ".join(str(rnd.random()) for _ in range(rnd.randint(1, 9)))
        rows.append((i, "ab" * rnd.randint(10, 200) if rnd.random() < 0.1 else text))
    return rows


def told(df):
    return {r[0]: tuple(r[1:5]) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}


def test_removed_bytes_are_those_of_brute_force_in_one_batch_and_in_several(spark):
    rows = mixed_texts(160, 5)
    table = lambda part: spark.createDataFrame(part, "doc_id long, text string").repartition(3)
    expected = repeated_bytes(rows)
    assert told(suffix_dedup.IndexFamily(spark).add(table(rows), keep=False)) == expected
    family, found, sizes = suffix_dedup.IndexFamily(spark), {}, []
    for i in range(0, 160, 40):
        found |= told(family.add(table(rows[i : i + 40])))
        sizes.append([level.batches for level in family.levels])
    assert found == expected and sizes == [[1], [2], [2, 1], [4]]  # equal levels merge
    with pytest.raises(ValueError):
        family.add(table(rows[:5]))


def test_frequent_suffixes_dealt_apart_change_nothing(spark, monkeypatch):
    rows = [(i, f"{i * 7919 % 10007:09d} " * 3 + "all rights reserved by the authors of this work and nobody else at all " + f"{i * 31337 % 10009:012d}" * 4) for i in range(120)]
    monkeypatch.setattr(suffix_dedup, "LOOK", 1)
    monkeypatch.setattr(suffix_dedup, "OFTEN", 10)
    assert told(suffix_dedup.IndexFamily(spark).add(spark.createDataFrame(rows, "doc_id long, text string"), keep=False)) == repeated_bytes(rows)


def test_a_text_longer_than_a_slice_is_worked_on_whole(spark):
    rnd = np.random.default_rng(3)
    text = rnd.integers(97, 123, 1_300_000, dtype=np.uint8).tobytes().decode()
    rows = [(1, text), (2, "x" + text[500_000:1_100_000] + "y")]
    found = told(suffix_dedup.IndexFamily(spark).add(spark.createDataFrame(rows, "doc_id long, text string"), keep=False))
    assert found[1][1:3] == (0, 0) and found[2] == (600_002, 600_000, 1, hashlib.sha256(b"xy").hexdigest())


def test_suffix_dedup_of_awkward_tables(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text, 1), (4, text, 2), (4, text, 3), (4, None, 4), (5, "", 5), (6, text[:99], 6), (7, text[:100], 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int").withColumnRenamed("spans", "key")
    found = suffix_dedup.IndexFamily(spark).add(df, keep=False).collect()
    n = len(text)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"]) for r in found) == [(False, 0, n, 0, 0), (True, 4, 0, 0, 0), (True, 4, n, n, 1), (True, 4, n, n, 1), (True, 5, 0, 0, 0), (True, 6, 99, 0, 0), (True, 7, 100, 100, 1)]
    assert suffix_dedup.IndexFamily(spark).add(df.limit(0), keep=False).count() == 0


def test_tasks_without_a_string_to_sample_send_nothing(spark):
    assert list(suffix_dedup._dealt(np.empty(0, np.int64), {f: np.empty(0, np.int64) for f in suffix_dedup._FIELDS})) == []
    short = spark.createDataFrame([(i, "x" * i) for i in range(20)], "doc_id long, text string").repartition(4)
    assert {r[1:3] for r in told(suffix_dedup.IndexFamily(spark).add(short, keep=False)).values()} == {(0, 0)}


# --- periodic runs ----------------------------------------------------------------------------------------------------------------


def all_runs(w):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= 2 * q and not any(all(w[k] == w[k + r] for k in range(s, e - r)) for r in range(1, q)):
                out.append((s, e - s, q))
            i = max(j, i + 1)
    return sorted(out)


def some_words(rnd):
    n, k = rnd.randint(0, 60), rnd.choice([1, 2, 3, 5, 30])
    w = [rnd.randrange(k) for _ in range(n)]
    if n > 4 and rnd.random() < 0.5:
        a, p = rnd.randrange(n), rnd.randint(1, n // 2)
        w = [w[i] if i < a or a + (i - a) % p >= n else w[a + (i - a) % p] for i in range(n)]
    return w


def test_runs_are_those_of_brute_force():
    rnd = random.Random(3)
    for _ in range(600):
        w = some_words(rnd)
        assert sorted(periodic_runs.runs_of(w)) == all_runs(w)
        kept = [(b + s, n, q) for b, e in periodic_runs.stretches(np.array(w, np.int32)) for s, n, q in periodic_runs.runs_of(w[b:e]) if n >= 12]
        assert sorted(kept) == [r for r in all_runs(w) if r[1] >= 12]


def expected_runs(doc_id, text):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = [r for r in all_runs(words) if r[1] >= max(12, 2 * r[2])]
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in sorted(runs, key=lambda r: (r[0], r[2])))
    return (len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], sha(listed), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_every_column_of_periodic_runs(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.choice([" ", "\n", "\t "]).join(rnd.choice(["É", "k", "K", " a"])[: rnd.randint(1, 3)] + str(x) for x in some_words(rnd))) for i in range(150)]
    rows += [(0, None), (None, "a b c d " * 9), (3, ""), (3, " \n"), (9, "x y " * 10), (9, "x y " * 10)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int")
    found = periodic_runs.with_runs(df, deal=True).drop("runs").collect()
    assert sorted((str(r[0]), *map(str, r[1:])) for r in found) == sorted((str(i), *map(str, expected_runs(i, t))) for i, t in rows)
    assert periodic_runs.with_runs(df.limit(0)).count() == 0


def test_long_periodic_texts_cost_a_little_each_word(monkeypatch):
    assert periodic_runs.runs_of([0] * 60_000) == [(0, 60_000, 1)]
    assert periodic_runs.runs_of([i % 977 for i in range(60_000)]) == [(0, 60_000, 977)]
    monkeypatch.setattr(periodic_runs, "PART_BYTES", 64)  # a text in many parts
    text = " ".join(["a b", *[f"w{i % 7}" for i in range(100)]])
    assert periodic_runs.examined(text.encode(), lambda n, i: None)[:7] == expected_runs(3, text)


# --- embedding whitening ----------------------------------------------------------------------------------------------------------


def test_leading_eigenvectors_also_of_clusters():
    rnd = np.random.default_rng(0)
    for n in (1, 2, 3, 7, 40):
        a = rnd.standard_normal((n, n))
        q = np.linalg.qr(a)[0]
        for m in (a @ a.T, q @ np.diag([5.0, 5, 5, 3, 3][:n] + [1.0] * (n - 5)) @ q.T, np.eye(n)):
            values, vectors = whitening.leading(m, min(8, n))
            assert np.allclose(values, np.linalg.eigvalsh(m)[::-1][: min(8, n)], atol=1e-12 * values[0])
            assert np.abs(m @ vectors - vectors * values).max() < 1e-12 * values[0] and np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12


def test_whitening_against_numpy(spark):
    rnd = np.random.default_rng(1)
    vectors = (rnd.standard_normal((300, 12)) * np.linspace(3, 1, 12)).astype(np.float32)
    rows = [(i, v.tolist(), i) for i, v in enumerate(vectors)]
    bad = [(900, None, 1), (901, [None] * 12, 1), (902, [float("nan")] + [0.0] * 11, 1), (903, [float("inf")] * 12, 1), (904, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, component int").repartition(5)
    p = whitening.whitened(df).toPandas().sort_values(["vec_id", "component"])
    x = np.floor(1024 * vectors.astype(float)).astype(int) + 100_000
    values, u = np.linalg.eigh(np.cov(x.T, bias=True))
    values, u = values[::-1][:8], u[:, ::-1][:, :8]
    expected = (x - x.sum(0) / 300) @ u / np.sqrt(values)
    got = p.whitened.to_numpy().reshape(300, 8)
    assert np.abs(np.abs(got) - np.abs(expected)).max() < 1e-9 and np.allclose(got * np.sign(got[0]), expected * np.sign(expected[0]))
    assert (p.deviation.to_numpy().reshape(300, 8) == ((300 * x - x.sum(0)) ** 2).sum(1)[:, None]).all() and set(p.n) == {300}
    assert np.allclose(p.explained.to_numpy()[:8], values / np.trace(np.cov(x.T, bias=True)), rtol=1e-9) and p.identity_error.max() < 1e-9


def test_whitening_without_variance_or_rows(spark):
    table = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (1, [1.0, 2.0])]):
        assert whitening.whitened(table(rows)).count() == 0
    two = whitening.whitened(table([(None, [0.0, 0.0]), (7, [1.0, 1.0])])).collect()
    assert [r["component"] for r in two] == [1, 1] and sorted(round(abs(r["whitened"]), 9) for r in two) == [1.0, 1.0]
