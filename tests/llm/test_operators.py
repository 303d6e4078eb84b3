"""The ten operators on small tables: brute force, nulls, empty and repeated rows, clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusframe.llm import decontamination, fingerprints, jaccard_join, license_scans, line_dedup, lm_scoring, mixing, sharding, toxicity, url_filters

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def alnum(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(ASCII_LOWER))


def spaced(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(ASCII_LOWER))


def texts(n=60, seed=1):
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in ("ka", "mo", "Ré", "tu", "si") for b in ("n", "la", "ß", "vo", "Y")]
    out = [" ".join(rng.choice(words, rng.integers(1, 90))) + "." for _ in range(n)]
    base = " ".join(rng.choice(words, 80))
    out += [base, base, base.replace("kan", "xxx", 1), base + " more", "", None, " \n ", "one two", "one two", "a b c d e", "MIT License\nApache license, GNU General Public License. mit  license"]
    return out


def table(spark, rows=None, extra=True):
    rows = texts() if rows is None else rows
    df = spark.createDataFrame([(i, t, "de" if i % 3 else None, f"src{i % 4}" if i % 7 else None, len(t or "")) for i, t in enumerate(rows)], SCHEMA)
    # names that the operators also use
    clash = ("score", "row", "cls", "shard", "labels", "tokens", "spans", "w", "epoch", "component_id")
    return df.withColumns({c: F.lit("x") for c in clash}) if extra else df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_license_places_match_brute_force(spark):
    got = {r.doc_id: r for r in license_scans.scan_licenses(table(spark)).collect()}
    base = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
    for i, text in enumerate(texts()):
        w, places, found = alnum(text), [], set()
        for label, phrase in base.items():
            p = phrase.split()
            at = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += at
            found |= {label} if at else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found)))
        assert found <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert license_scans.scan_licenses(empty(spark)).count() == 0


def test_license_template_needs_its_mandatory_phrase(spark):
    rows = ["Licensed under CC BY-NC 4.0.", "licensed under cc by", "a permission is hereby granted, free of charge to any person", "the Kmit license"]
    got = [r.labels for r in license_scans.scan_licenses(table(spark, rows)).orderBy("doc_id").collect()]
    assert got == ["cc-by-nc-4.0", "", "mit-text", ""]


def test_fingerprints(spark):
    rows = texts()
    got = {r.doc_id: r for r in fingerprints.fingerprinted(table(spark), rows_per_run=7).collect()}
    assert len(got) == len(rows)
    for i, text in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)] or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for j, other in enumerate(rows):
            if (other or "") == text:
                assert got[i].fingerprint == got[j].fingerprint
        a = got[i].fingerprint, got[(i + 1) % len(rows)].fingerprint
        assert got[i].near_next == (sum(a[0][s : s + 8] == a[1][s : s + 8] for s in range(0, len(a[0]), 8)) / 16)
    assert fingerprints.fingerprinted(empty(spark)).count() == 0
    one = fingerprints.fingerprinted(table(spark, ["a b c d"])).first()
    assert one.near_next == 1.0


def test_fingerprint_order_with_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "n1 n2 n3 n4"), (5, "five 5 5 5"), (5, "five 5 5 5"), (1, "one 1 1 1")], "doc_id long, text string")
    rows = fingerprints.fingerprinted(df, rows_per_run=1).collect()
    follow = {(r.doc_id, r.edited_sha256) for r in rows}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert follow == {(None, sha("n1 n2 n3 n4"[:9] + "on")), (1, sha("one 1 1"[:7] + "fi")), (5, sha("five 5 5"[:8] + "fi")), (5, sha("five 5 5"[:8] + "n1"))}


def test_signature_collisions_follow_generalised_jaccard(spark):
    a, b = {1: 4, 2: 1, 3: 2}, {1: 2, 2: 3, 4: 1}
    rows = [("a", t, float(w)) for t, w in a.items()] + [("b", t, float(w)) for t, w in b.items()]
    s = fingerprints.signatures(spark.createDataFrame(rows, "k string, term long, weight double"), ["k"], samples=128)
    x, y = s.orderBy("k").drop("k").collect()
    expected = sum(min(a.get(t, 0), b.get(t, 0)) for t in range(5)) / sum(max(a.get(t, 0), b.get(t, 0)) for t in range(5))
    assert abs(sum(p == q for p, q in zip(x, y, strict=True)) / 128 - expected) < 0.13


def test_fractional_weights_collide_as_generalised_jaccard_says(spark):
    kinds = [({0: 0.3, 1: 2.5, 3: 0.01}, {0: 0.9, 1: 1.75, 4: 0.5}), ({0: 300.0, 1: 7.5}, {0: 120.0, 1: 9.0, 2: 40.0}), ({0: 1.0, 1: 1.0, 2: 2.0}, {0: 1.0, 1: 3.5, 3: 1.0})]
    pairs = 24  # of each kind, over terms of their own
    rows = [(f"{n}|{p}|{side}", 100 * p + t, w) for n, kind in enumerate(kinds) for p in range(pairs) for side, own in enumerate(kind) for t, w in own.items()]
    rows += [("none", 1, 0.0), ("none", 2, None), ("none", None, 1.0)]
    s = {r[0]: r[1:] for r in fingerprints.signatures(spark.createDataFrame(rows, "k string, term long, weight double"), ["k"], samples=64).collect()}
    assert set(s["none"]) == {None}
    for n, (a, b) in enumerate(kinds):
        expected = sum(min(a.get(t, 0), b.get(t, 0)) for t in range(5)) / sum(max(a.get(t, 0), b.get(t, 0)) for t in range(5))
        found = np.mean([x == y for p in range(pairs) for x, y in zip(s[f"{n}|{p}|0"], s[f"{n}|{p}|1"], strict=True)])
        assert abs(found - expected) < 4 * (expected * (1 - expected) / (64 * pairs)) ** 0.5, (n, found, expected)


def test_weights_far_below_one_score_apart(spark):
    rows = [(f"{side}{p}", f"{side}{p}" if p % 2 else str(p), 1e-6) for p in range(20) for side in "ab"]  # every second pair shares its term
    s = {r[0]: r[1:] for r in fingerprints.signatures(spark.createDataFrame(rows, "k string, term string, weight double").selectExpr("k", "xxhash64(term) term", "weight"), ["k"], samples=16).collect()}
    assert all(sum(x == y for x, y in zip(s[f"a{p}"], s[f"b{p}"], strict=True)) == (0 if p % 2 else 16) for p in range(20))


def test_the_query_runs_no_python_on_executors(spark, tmp_path):
    spark.createDataFrame([(1, "a b a b c"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = fingerprints.op2_fingerprints(spark, str(tmp_path))
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
    assert [r.near_edited > 0 for r in df.orderBy("doc_id").collect()] == [True, True]


def test_pairs_and_their_counts(spark):
    rows = [("A b\ta B c",), (" one ",), ("",), ("x x x x",)]
    got = fingerprints.with_terms(spark.createDataFrame(rows, "text string").withColumn("t", F.col("text")), "t", "once", "often").collect()
    pair = lambda *w: spark.range(1).select(F.xxhash64(*[F.lit(x) for x in w])).first()[0]
    assert [(sorted(r.once), sorted((o.term, o.weight) for o in r.often)) for r in got] == [(sorted([pair("b", "a"), pair("b", "c")]), [(pair("a", "b"), 2.0)]), ([pair("one")], []), ([], []), ([], [(pair("x", "x"), 3.0)])]


def test_query_likeness_follows_generalised_jaccard(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [" ".join(f"w{k}" for k in rng.integers(0, 40 if i % 2 else 3000, 240)) for i in range(60)]
    rows += [" ".join([*rows[i].split()[: 240 - 20 * (i % 4)], *"abcdefgh"[: i % 8]]) for i in range(60)]
    rows = [t for pair in zip(rows[:60], rows[60:], strict=True) for t in pair]
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in fingerprints.op2_fingerprints(spark, str(tmp_path)).collect()}

    def likeness(a, b):
        a, b = (Counter(zip(w, w[1:], strict=False)) for w in (a.split(), b.split()))
        return (a & b).total() / (a | b).total()

    errors = []
    for i, text in enumerate(rows):
        after, k = rows[(i + 1) % len(rows)], len(text) // 4
        errors += [got[i].near_edited - likeness(text, text[: len(text) - k] + after[:k]), got[i].near_next - likeness(text, after)]
    errors = np.array(errors)
    # 128 samples: a standard error of 0.044 at most; with 16 it is 0.125
    assert np.abs(errors).max() < 0.16 and np.sqrt((errors**2).mean()) < 0.045 and abs(errors.mean()) < 0.015


@pytest.mark.parametrize("n", [0, 1, 2, 39, 41, 257])
def test_shards_are_even_and_slots_gapless(spark, n):
    df = sharding.measured(table(spark, [f"t{i % 5}" for i in range(n)]))
    rows = sharding.sharded(df, 40).collect()
    assert len(rows) == n
    shards = {}
    for r in rows:
        assert (r["size"], r.text_crc32) == (len(r.text.encode()) + 16, zlib.crc32(r.text.encode()))
        shards.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())
    counts = [len(shards.get(k, [])) for k in range(40)]
    assert max(counts) - min(counts) <= 1


def test_permutation_matches_brute_force(spark):
    n, seed = 103, 17
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)

    def long_hash(x, s):
        h = xxhash.xxh64(int(x).to_bytes(8, "little", signed=True), seed=s).intdigest()
        return h

    def once(x):
        left, right = x // b, x % b
        for i in range(sharding.ROUNDS):
            h = long_hash(right, 42)
            h = xxhash.xxh64(i.to_bytes(4, "little"), seed=h).intdigest()
            h = long_hash(seed, h)
            h -= (h >> 63) << 64
            m = a if i % 2 == 0 else b
            left, right = right, (left + h % m) % m
        return left * b + right

    def walk(x):
        x = once(x)
        while x >= n:
            x = once(x)
        return x

    got = [r.p for r in spark.range(n).select("id", sharding.permuted(F.col("id"), n, seed).alias("p")).orderBy("id").collect()]
    assert got == [walk(x) for x in range(n)] and sorted(got) == list(range(n))


def reference_components(rows):
    sets = []
    for t in rows:
        w = spaced(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("chunk", [2000, 3])
def test_jaccard_components_match_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard_join, "CHUNK_SETS", chunk)
    rng = np.random.default_rng(3)
    rows = texts(25)
    base = [f"w{i}" for i in rng.integers(0, 400, 120)]
    for _ in range(25):  # a chain of drifting copies
        base = list(base)
        for k in rng.integers(0, 120, 2):
            base[k] = f"z{rng.integers(1000)}"
        rows.append(" ".join(base))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.clustered(table(spark, rows)).collect()}
    assert [got[i] for i in range(len(rows))] == reference_components(rows)


@pytest.mark.parametrize("common", [10_000, 3])
def test_sets_that_meet_a_hub_without_linking_are_searched_in_all_chunks(spark, monkeypatch, common):
    monkeypatch.setattr(jaccard_join, "CHUNK_SETS", 2)
    monkeypatch.setattr(jaccard_join, "COMMON", common)
    rng = np.random.default_rng(8)
    passage = [f"p{i}" for i in range(80)]
    rows = []
    for g in range(6):  # groups of drifting copies around one passage; lengths of several bands
        own = [f"g{g}x{i}" for i in range(18 + 9 * (g % 3))]
        for _ in range(4):
            own = [w if rng.random() > 0.12 else f"z{rng.integers(1000)}" for w in own]
            rows.append(" ".join(passage + own))
    rows += [rows[5], rows[9] + " end", " ".join(passage)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.clustered(table(spark, rows)).collect()}
    assert [got[i] for i in range(len(rows))] == reference_components(rows)
    assert len({x for _, x in got.values()}) > 3


def test_one_of_each_component_stays(spark):
    rows = ["a b c d e f", "a b c d e f", "", None, "x y"]
    df = table(spark, rows).union(table(spark, rows).where("doc_id in (1, 4)"))
    kept = jaccard_join.one_of_each(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4]
    assert jaccard_join.clustered(empty(spark)).count() == 0


def test_divide_skip_finds_what_counting_finds():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(5, 45))) for _ in range(80)]
    block = jaccard_join.Block(sets)
    block.connect()
    other = jaccard_join.Block(sets)
    for i in range(80):
        for j in range(i):
            if jaccard_join.links(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j])):
                other.join(i, j)
    assert [block.root(i) for i in range(80)] == [other.root(i) for i in range(80)]


def test_line_dedup_matches_brute_force(spark):
    rows = [f"common\nown {i}\n\nhalf {i % 2}" for i in range(12)] + [None, "", "common"]
    df = spark.createDataFrame([(i, t, f"s{i % 6}" if i % 5 else None, "") for i, t in enumerate(rows)], "doc_id long, text string, source string, line string")
    for limit in (2, 3, 5, 7):
        sites = {}
        for i, t in enumerate(rows):
            for line in (t or "").split("\n"):
                sites.setdefault(line, set()).add(f"s{i % 6}" if i % 5 else None)
        gone = {x for x, s in sites.items() if x and len(s) >= limit}
        got = {r.doc_id: r for r in line_dedup.without_boilerplate(df, min_sites=limit).collect()}
        for i, t in enumerate(rows):
            lines = [] if t is None else t.split("\n")
            kept = [x for x in lines if x not in gone]
            assert (got[i].n_lines, got[i].n_removed, got[i].text) == (len(lines), len(lines) - len(kept), None if t is None else "\n".join(kept))
    assert line_dedup.without_boilerplate(df.limit(0)).count() == 0


def test_toxicity_learns_from_document_labels(spark):
    rng = np.random.default_rng(2)
    words = [f"word{i}" for i in range(80)]
    rows, labels = [], []
    for i in range(240):
        s = [" ".join(rng.choice(words, 8)) for _ in range(6)]
        bad = i % 4 == 0
        if bad:
            s[int(rng.integers(6))] += f" zorgle{rng.choice(['n', 'st', 'ish'])}"
        rows.append((i, ". ".join(s)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels[:160], "doc_id long, toxic int"))
    got = toxicity.scored(docs.where("doc_id >= 160").withColumn("score", F.lit("clash")), model).collect()
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 4 == 0) for r in got]) > 0.95
    assert all("zorgle" in s.sentence for r in got for s in r.offending) and any(r.offending for r in got)
    odd = toxicity.scored(spark.createDataFrame([(None, None), (1, ""), (1, "")], "doc_id long, text string"), model).collect()
    assert len({r.score for r in odd}) == 1 and 0 <= odd[0].score <= 1
    assert toxicity.scored(empty(spark), model).count() == 0
    bare = toxicity.fit(empty(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score < 0.5 for r in toxicity.scored(docs.limit(3), bare).collect()] == [True] * 3


def reference_hits(text, items, window=10):
    w, hit, found = alnum(text), set(), set()
    for name, t in items:
        own = alnum(t)
        size = min(window, len(own))
        for k in range(len(own) - size + 1 if size else 0):
            for i in range(len(w) - size + 1):
                if w[i : i + size] == own[k : k + size]:
                    hit |= set(range(i, i + size))
                    found.add(str(name))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [1_000_000, 12])
def test_contamination_matches_brute_force(spark, block):
    rng = np.random.default_rng(8)
    words = ["a", "b", "c"]
    items = [(i, " ".join(rng.choice(words, rng.integers(1, 16)))) for i in range(7, 12)] + [(20, None), (21, "--"), (3, "alpha beta"), (4, "beta gamma delta epsilon zeta eta theta iota kappa lambda mu")]
    rows = [" ".join(rng.choice(words, 40)) for _ in range(20)] + ["x alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "Alpha; BETA", None, "", "clean words only"]
    docs, bench = table(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.contamination(docs, bench, block_words=block).collect()}
    for i, t in enumerate(rows):
        n, hit, found = reference_hits(t, items)
        r = got[i]
        assert (r.n_words, sum(s.end - s.begin for s in r.spans), r["items"]) == (n, hit, found)
    assert decontamination.contamination(docs, bench.limit(0)).where("size(spans) > 0").count() == 0
    assert decontamination.contamination(docs.limit(0), bench).count() == 0


def test_decontaminated_cuts_spans_and_drops_covered_texts(spark):
    item = "beta gamma delta epsilon zeta eta theta iota kappa lambda"
    rows = [f"Start, one two three four five six seven eight. {item.title()}! The end of it", item, "untouched  text", None]
    out = {r.doc_id: r.text for r in decontamination.decontaminated(table(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert out == {0: "Start, one two three four five six seven eight. ! The end of it", 2: "untouched  text", 3: None}


def test_shares_fill_siblings_first():
    assert mixing.shares(100, {"a": 1, "b": 1}, {"a": 10, "b": 200}) == {"a": 10.0, "b": 90.0}
    got = mixing.budgets({("x", "p"): 10, ("x", "q"): 100, ("y", "p"): 100}, 100, ({"x": 1, "y": 1}, {}), 1)
    assert got == {("x", "p"): 10, ("x", "q"): 40, ("y", "p"): 50}
    got = mixing.budgets({("x", "p"): 10, ("x", "q"): 10, ("y", "p"): 100}, 100, ({"x": 1, "y": 1}, {}), 1)
    assert got == {("x", "p"): 10, ("x", "q"): 10, ("y", "p"): 80}


def poured(amount, weights, room):
    """Water filling by hand: the level at which siblings, each up to its room, take the amount."""
    lo, hi = 0.0, 1e9
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(room[k], mid * weights.get(k, 1)) for k in room) < amount else (lo, mid)
    return {k: min(room[k], hi * weights.get(k, 1)) for k in room}


def reference_mix(rows, weights, epochs, seed, share):
    """The multiset of (doc_id, epoch): budgets by hand down the tree, then each leaf's seeded order document by document."""
    h = lambda raw, seed: xxhash.xxh64_intdigest(raw, seed)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    long_ = lambda x: int(x).to_bytes(8, "little", signed=True)
    leaves = {}
    for r in rows:
        leaf = (f"d{int(re.search(r'[0-9]+$', r.source)[0]) % 4 if r.source else 0}", r.lang or "", r.source or "")
        key = h(long_(r.doc_id), 42)
        key = key if r.text is None else h(r.text.encode(), key)
        leaves.setdefault(leaf, []).append((r.doc_id, signed(key), len(spaced(r.text))))
    have = {k: sum(x[2] for x in v) for k, v in leaves.items()}
    given = {(): min(sum(have.values()) * share, sum(have.values()) * epochs)}
    for depth in range(3):
        given = {
            (*p, k): x for p, amount in given.items()
            for k, x in poured(amount, weights[depth], {leaf[depth]: sum(t * epochs for own, t in have.items() if own[: depth + 1] == (*p, leaf[depth])) for leaf in have if leaf[:depth] == p}).items()
        }
    out = Counter()
    for leaf, own in leaves.items():
        budget = math.floor(given[leaf] + 1e-4)
        full = min(epochs, budget // have[leaf]) if have[leaf] else 0
        rest = budget - full * have[leaf]
        place = lambda x: signed(h(long_(x[1]), h(int(full).to_bytes(4, "little"), h(long_(seed), 42))))  # noqa: B023, E731
        order, taken, cut, best = sorted({x[:2] for x in own}, key=place), 0, 0, rest
        tokens = Counter()
        for x in own:
            tokens[x[:2]] += x[2]
        for i, x in enumerate(order):
            taken += tokens[x]
            if taken <= rest or abs(taken - rest) < best:
                cut, best = i + 1, abs(taken - rest)
            if taken > rest:
                break
        more = set(order[:cut]) if rest > 0 else set()
        for x in own:
            for e in range(full + (x[:2] in more)):
                out[x[0], e] += 1
    return out


@pytest.mark.parametrize("epochs,share", [(1, 0.5), (3, 1.7), (1, 1.0), (2, 0.61)])
def test_mix_matches_a_reference_by_hand(spark, monkeypatch, epochs, share):
    monkeypatch.setattr(mixing, "CELL_ROWS", 2)
    docs = table(spark)
    docs = docs.union(docs.where("doc_id % 11 = 3"))  # repeated rows
    weights = ({"d1": 2}, {}, {"src1": 3})
    got = Counter((r.doc_id, r.epoch) for r in mixing.mixed(docs, None, weights, epochs, 5, share=share).collect())
    assert got == reference_mix(docs.collect(), weights, epochs, 5, share)
    total = sum(len(spaced(r.text)) for r in docs.collect())
    tokens = {r.doc_id: len(spaced(r.text)) for r in docs.collect()}
    assert abs(sum(tokens[i] * n for (i, _), n in got.items()) - total * share) <= 90 * 8


def test_mix_does_not_depend_on_partitions(spark):
    docs = table(spark)
    chosen = lambda df: sorted(r.doc_id for r in mixing.mixed(df, None, ({}, {}, {}), 1, 5, share=0.5).collect())
    assert chosen(docs.repartition(3)) == chosen(docs)
    assert mixing.mixed(empty(spark), None, ({}, {}, {}), 1, 5).count() == 0


def test_short_items_survive_a_longer_least_run(spark):
    item = "beta gamma delta epsilon zeta eta theta iota kappa lambda"
    items = spark.createDataFrame([(1, item), (2, "alpha beta")], "item_id long, text string")
    docs = table(spark, [f"one two three four five six seven eight nine ten eleven twelve {item} end", "say alpha beta to them all, and then nothing more"])
    out = {r.doc_id: r.text for r in decontamination.decontaminated(docs, items, min_run=12).collect()}
    assert out == {0: docs.first().text, 1: "say  to them all, and then nothing more"}


@pytest.mark.parametrize("head", [1 << 20, 5])
def test_lm_base_scores_match_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(lm_scoring, "HEAD_WORDS", head)
    rows = texts()
    docs = table(spark, rows).withColumn("held_out", F.col("doc_id") % 4 == 1)
    got = {r.doc_id: r for r in lm_scoring.scored(docs).collect()}
    counts = Counter()
    for i, t in enumerate(rows):
        if i % 4 != 1:
            counts.update([*spaced(t), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(rows):
        own = [*spaced(t), None]
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)) and r.score < 0
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())


def test_lm_without_training_rows(spark):
    docs = table(spark, ["a b", None]).withColumn("held_out", F.lit(True))
    assert [r.train_tokens for r in lm_scoring.scored(docs).collect()] == [0, 0]
    assert lm_scoring.scored(empty(spark).withColumn("held_out", F.lit(False))).count() == 0


def test_url_rules_and_words(spark):
    urls = {
        "http://Sub.Example.com/en/x?y": ("sub.example.com", "/en/x", "example.com/en/", "block"), "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://a.net/es/1": ("a.net", "/es/1", "net/es/", "block"), "http://a.org": ("a.org", "", None, "allow"), "http://a.com": ("a.com", "", None, "allow"), "http://xcom/": ("xcom", "/", None, "allow"),
        "http://casino.org/": ("casino.org", "/", None, "block"), "http://casinos.org/": ("casinos.org", "/", None, "allow"), "http://cheap.org/pills": ("cheap.org", "/pills", None, "block"), "http://cheap.org/cheap": ("cheap.org", "/cheap", None, "allow"),
        None: ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "": ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge_urls(df).collect()}
    assert got == dict(enumerate(urls.values()))
    assert url_filters.judge_urls(df.limit(0)).count() == 0


def test_toxicity_scores_are_the_noisy_or_of_sentences(spark):
    rng = np.random.default_rng(12)
    plain = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(300):
        toxic = i % 6 == 0
        said = [" ".join(rng.choice(plain, 7)) for _ in range(4)]
        if toxic:
            said[rng.integers(4)] += " blight " + ("scum" if i % 4 else "vermin")
        rows.append(". ".join(said) + ".")
        labels.append((i, 1, int(toxic)))
    rows += ["", None, "blight scum", "word1 word2"]
    docs = table(spark, rows)
    model = toxicity.fit(docs.where("doc_id % 5 <> 0"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    weights, bias = {r.word % (1 << 64): r.weight for r in model if not r.is_bias}, next(r.weight for r in model if r.is_bias)

    def reference(text):
        import pyarrow as pa

        from corpusframe.llm import words

        clean = 1.0
        for s in [x for x in re.split(r"[.!?\n]", text or "") if alnum(x)] or [""]:
            z = bias
            if alnum(s):
                w = words.words_of(next(words.slices(pa.array([s])))[1], words.NOT_ALNUM)
                z += sum(weights.get(int(h), 0) for f in toxicity.features(w) for h in f if h)
            clean *= 1 - 1 / (1 + math.exp(-z))
        return 1 - clean

    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    for i, t in enumerate(rows):
        assert abs(got[i].score - reference(t)) < 1e-9
    held = [i for i in range(0, 300, 5)]
    assert all((got[i].score >= 0.5) == (i % 6 == 0) for i in held)
    assert got[302].score >= 0.5 and all("blight" in s.sentence for i in range(0, 300, 6) for s in got[i].offending)


def test_soft_terms_need_two_and_their_weight(spark):
    urls = ["http://a.com/free-win", "http://a.com/bet-win", "http://a.com/bet-bet", "http://a.com/xbet-win", "http://a.com/porn", "http://a.com/pornx", "http://a.com/free/deal/win/sale"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").union(spark.createDataFrame([(1, urls[1])], "page_id long, url string"))
    got = [(r.page_id, r.verdict) for r in url_filters.judge_urls(rows, rules=()).orderBy("page_id").collect()]
    assert got == [(0, "allow"), (1, "block"), (1, "block"), (2, "allow"), (3, "allow"), (4, "block"), (5, "allow"), (6, "block")]
