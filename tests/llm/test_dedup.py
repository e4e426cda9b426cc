"""Duplicates of every kind against brute force."""

import hashlib
import random

import numpy as np
import pytest

from lakespan.llm import components, exact_dedup, near_dedup, substring_dedup


def _lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, keep_id string, places string")


ODD = [(1, "Same Text"), (2, "same text"), (9, "SAME TEXT"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "long " * 5000), (8, "long " * 5000), (8, "long " * 5000), (None, "same text"), (None, "alone")]


@pytest.mark.parametrize("width", [32, 1])
def test_exact_groups(spark, width):
    rows = ODD + [(100 + i, f"t{i % 40}") for i in range(120)]
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(_docs(spark, rows), digest_bytes=width).collect() if r.doc_id is not None)
    groups = {}
    for i, t in rows:
        groups.setdefault(_lower(t), []).append(i)
    want = sorted((i, max(x for x in g if x is not None), len(g), i == max(x for x in g if x is not None)) for g in groups.values() for i in g if i is not None)
    assert got == want


def test_exact_other_forms(spark):
    docs = _docs(spark, ODD)
    small = {r.doc_id: r.keep_id for r in exact_dedup.exact_groups(docs, keep="smallest").collect()}
    assert small[9] == 1 and small[4] == 3
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [4, 5, 6, 8, 8, 9]


def test_lsm_index_keeps_smallest_over_runs():
    rng = np.random.default_rng(0)
    lsm, want, n = exact_dedup.DigestLsm(memtable_rows=50, fanout=3), {}, {}
    for _ in range(41):
        keys = rng.integers(0, 500, 20)
        digests = np.array([hashlib.sha256(str(k).encode()).digest() for k in keys], "S32")
        idents = rng.integers(-1000, 1000, 20)
        if lsm.put(digests, idents):
            lsm.add(lsm.flushed())
        for k, v in zip(keys, idents, strict=True):
            want[k], n[k] = min(want.get(k, 10**6), v), n.get(k, 0) + 1
    lsm.add(lsm.flushed())
    assert 1 < len(lsm.runs) <= 2 * len(lsm.tiers) and sum(r.counts.sum() for r in lsm.runs) == 820
    hits, (asked, passed, found) = lsm.repeated()
    by = {d: (i, c) for d, i, c in zip(hits.digests, hits.idents, hits.counts, strict=True)}
    assert by == {np.array([hashlib.sha256(str(k).encode()).digest()], "S32")[0]: (want[k], c) for k, c in n.items() if c > 1}
    assert asked > passed >= found > 0
    run = lsm.runs[0]
    assert run.filter().maybe(run.digests).all() and (exact_dedup.Bloom(bits=run.filter().packed()).bits == run.filter().bits).all()


def test_filters_are_asked_before_runs(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BUCKET_ROWS", 500)
    rows = [(i, f"text {i % 1500}" if i % 3 else "hot") for i in range(6000)]
    counts = {}
    out = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), counts=counts).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    assert {(r.doc_id, r.keep_id, r.group_size) for r in out} == {(i, max(g), len(g)) for g in groups.values() for i in g} and len(out) == 6000
    assert counts["asked"] > counts["passed"] >= counts["found"] > 0
    alone = {}
    exact_dedup.exact_groups(spark.createDataFrame([(i, f"own {i}") for i in range(4000)], "doc_id long, text string").repartition(8), counts=alone)
    assert alone["found"] == 0 and alone["passed"] < alone["asked"] / 10


def _edited(rng, words, share):
    return [f"e{rng.random()}" if rng.random() < share else w for w in words]


def test_near_groups_against_brute_force(spark):
    rng = random.Random(7)
    rows, base = [], []
    for g in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([5, 8, 30, 120]))]
        rows += [" ".join(_edited(rng, base, rng.choice([0, 0.005, 0.02, 0.05]))) for _ in range(rng.choice([1, 3, 30]))]
    rows += ["", None, "one", "ONE", "one two", "one two three four", "word " * 300, " \t"]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    docs = _docs(spark, rows)
    sets = {}
    for i, t in rows:
        w = _lower(t).encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in sets:
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(docs).collect()}
    assert got == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}
    assert near_dedup.near_groups(docs.limit(0)).count() == 0
    assert near_dedup.near_groups(spark.createDataFrame([(None, "a b"), (1, None), (2, "a b"), (2, "a b")], "doc_id long, text string")).count() == 4


def test_near_groups_of_ids_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (2, b), (3, c), (4, a + " end"), (5, b + " end"), (6, None), (None, a), (3, c)]
    out = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {}
    for r in out:
        got.setdefault(r.doc_id, set()).add(r.component_id)
    assert len(out) == len(rows) and all(len(x) == 1 for x in got.values())
    # one of the texts of id 1 is compared: it joins 4, or 2 and 5
    assert got[3] == {3} and got[2] == got[5] and got[6] == {6} and got[None] == {None}
    assert (got[1] == got[4]) != (got[1] == got[2])


@pytest.mark.parametrize("kind", ["template", "chain"])
def test_near_groups_in_large_buckets(spark, kind):
    rng = random.Random(3)
    base = [f"t{k}" for k in range(200)]
    rows = []
    for i in range(120):
        words = list(base)
        if kind == "template":  # most share too little with each other, a few a lot
            own = i // 2 if i < 20 else i
            words[: 30 + (i % 3)] = [f"o{own}x{k}" for k in range(30 + (i % 3))]
        else:
            words = [f"t{k}" for k in range(i * 4, i * 4 + 200)]
        rows.append((i, " ".join(words)))
    rng.shuffle(rows)
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in sets:
        for j in range(i):
            n = len(sets[i] & sets[j])
            if 100 * n >= 75 * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                label[y] = x
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in sets}


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate((a[:750], rng.integers(0, 2**63, 250).astype(np.uint64)))
    one = a[:1]
    s = near_dedup.sketches(np.concatenate((a, b, one)), np.array([0, 1000, 2000, 2001]))
    assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.2


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(1000, x) for x in range(500, 600)] + [(k, k + 1) for k in range(2000, 2040)]
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        label[y] = x
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {x: find(x) for x in label if any(x in p and p[0] != p[1] for p in links)}
    assert got == want
    known = None
    for part in (links[:60], links[60:200], links[200:]):
        known = components.extended(known, spark.createDataFrame(part, "a long, b long"))
    assert {r.node: r.component for r in known.collect()} == want


def _kept(rows, window):
    seen, out = {}, {}
    for i, t in sorted(rows):
        w = [x.decode() for x in (t or "").encode().split()]
        cut = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[k : k + window]), (i, k)) != (i, k):
                cut[k : k + window] = [True] * window
        out[i] = (len(w), sum(cut), " ".join(x for x, c in zip(w, cut, strict=True) if not c))
    return out


@pytest.mark.parametrize("window", [20, 6])
def test_substring_against_brute_force(spark, window):
    rng = random.Random(window)
    passages = [[f"p{rng.randrange(60)}" for _ in range(rng.choice([19, 20, 21, 45, 60]))] for _ in range(6)]
    rows = []
    for i in range(90):
        words = [f"w{rng.randrange(30)}" for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(passages)
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(200, "same " * 300), (201, None), (202, ""), (203, "é\xa0x " * 30), (204, rows[0][1]), (205, "same " * 50)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.without_repeats(_docs(spark, rows), window).collect()}
    assert got == _kept(rows, window)


def test_substring_edges(spark):
    docs = _docs(spark, [(None, "a " * 40), (1, "a " * 25), (1, "a " * 25)])
    rows = substring_dedup.without_repeats(docs, digests=True).collect()
    assert sorted(r.n_removed for r in rows) == [24, 24, 40]
    assert substring_dedup.without_repeats(docs.limit(0)).count() == 0
