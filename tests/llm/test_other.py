"""Licenses, mixing, top-k and url filters against brute force; the pipeline on a small folder."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from lakespan.llm import license_scan, mixing, queries, topk, url_filter


def test_license_scan(spark):
    texts = [
        "Released under the MIT License.", "licensed under\nthe Apache-License, version 2.0 MIT LICENSE mit license", "CC-BY cc  by ccby", None, "", "plain words only",
        "x " * 300 + "GNU GENERAL PUBLIC LICENSE" + " y" * 300, "permission hereby granted, free of charge, to any person a copy of this software", "mıt license K mit licence", "admit license",
    ]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(0, texts[0], "z")], "doc_id long, text string, labels string")
    rows = license_scan.scanned(docs).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[r.doc_id] or ""))
        places = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        best, step = {}, license_scan.block_step()
        for s in range(0, max(len(words), 1), step):
            block, family = set(words[s : s + 2 * step]), {}
            for t in license_scan.TEMPLATES:
                own = set(t.words())
                if len(block & own) >= license_scan.CONTAINED * len(own) - 1e-9 and set(t.must) <= block:
                    family[t.family] = max(family.get(t.family, (0, 0, "")), (len(block & own) / len(own), len(own), t.label))
            for share, _, label in family.values():
                best[label] = max(best.get(label, 0), share)
        assert set(filter(None, r.labels.split(","))) == {x for _, x in places} | set(best)
        assert r.score == pytest.approx(1.0 if places else max(best.values(), default=0.0))
    assert license_scan.scanned(docs.limit(0)).count() == 0


def test_each_notice_gets_its_own_label_only(spark):
    rng = random.Random(4)
    rows = [(k, t.text.upper() if k % 2 else " ".join(f"f{rng.randrange(999)}" for _ in range(k * 13)) + " " + t.text + " tail" * k, t.label) for k, t in enumerate(license_scan.TEMPLATES)]
    more = [("licensed under the GNU General Public License", "gpl"), ("released under the terms of the gnu general public license", "gpl"), ("Licensed under the Mozilla Public License", "mpl"), ("Licensed under CC BY 4.0.", "cc-by")]
    rows += [(100 + k, t, label) for k, (t, label) in enumerate(more)] + [(None, "the license of the general public by a person under the terms", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    # the words "cc by" are a base phrase, whose label stays
    want = {k: ",".join(sorted({label} | ({"cc-by"} if " cc by " in t.lower() else set()))) for k, t, label in rows}
    assert {r.doc_id: r.labels for r in license_scan.scanned(docs.select("doc_id", "text")).collect()} == want


def test_a_long_template_is_found_at_any_offset(spark):
    long = license_scan.Template("it's", "own", " ".join(f"t{k}" for k in range(200)), ("t3",))
    rows = [(k, "x " * (37 * k) + long.text + " y" * 1000) for k in range(12)] + [(99, " ".join(f"t{k}" for k in range(3, 162))), (98, " ".join(f"t{k}" for k in range(3, 170)))]
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scanned(spark.createDataFrame(rows, "doc_id long, text string"), (long,)).collect()}
    assert got == {k: ("it's", 1.0) for k in range(12)} | {99: ("", 0.0), 98: ("it's", 167 / 200)}


def test_schedule_keeps_the_weights(spark):
    rows = [(i, ["a", "b", None, "d"][0 if i % 3 else i % 4]) for i in range(4000)] + [(5, "a"), (None, "b")]
    docs = spark.createDataFrame([(i, s, 1) for i, s in rows], "doc_id long, source string, slot int")
    out = mixing.scheduled(docs, block_rows=4).collect()
    assert len(out) == len(rows)
    assert Counter(r.source for r in out) == Counter(s or "" for _, s in rows)
    blocks = {(r.source, r.block): r for r in out}
    assert all(r.release <= r.slot < r.deadline for r in out)
    assert len({b.slot for b in blocks.values()}) == len(blocks)
    assert max(Counter((r.source, r.block) for r in out).values()) <= 4
    assert len({(r.slot, r.place) for r in out}) == len(rows)
    assert mixing.scheduled(docs.limit(0)).count() == 0


def test_mixed_keeps_rows_and_columns(spark):
    docs = spark.createDataFrame([(i % 50, f"s{i % 3}" if i % 7 else None, i) for i in range(100)], "doc_id long, source string, at int")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and sorted(r.at for r in out.collect()) == list(range(100))
    with pytest.raises(ValueError):
        mixing.scheduled(docs, spark.createDataFrame([("s0", 1.0)], "source string, weight double"))


@pytest.mark.parametrize("scale", [1, 1e12])
def test_topk_against_brute_force(spark, scale):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 12)) * 0.2
    x[100:400] = x[7]
    rows = [(i, [float(v) * scale for v in r], 0) for i, r in enumerate(x)]
    rows += [(2000, None, 0), (2001, [1.0, None], 0), (2100, [float("nan")] * 12, 0), (2200, [float("inf")] * 12, 0), (None, [0.1] * 12, 0), (2300, [0.5, 0.25], 0), (2400, [], 0)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    good = {i: [int(np.floor(1024 * v)) for v in r] for i, r, _ in rows if i is not None and r is not None and all(v is not None and np.isfinite(v) for v in r)}
    if scale > 1:
        good = {i: r for i, r in good.items()}
    got = {}
    from pyspark.sql import functions as F

    if scale > 1:
        docs = docs.where("vec_id < 300")
        good = {i: r for i, r in good.items() if i < 300}
        docs = docs.withColumn("embedding", F.transform("embedding", lambda v: v / 1e7))
        good = {i: [int(np.floor(1024 * (v / 1e7))) for v in dict((a, b) for a, b, _ in rows)[i]] for i in good}
    for r in topk.top_k(docs, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    queries_ = [i for i in good if i % 100 == 0]
    assert sorted(got) == sorted(q for q in queries_ if len(good) > 1)
    for q in queries_:
        scored = sorted((-sum(a * b for a, b in zip(good[q], good[c], strict=False)), c) for c in good if c != q)[:10]
        assert [got[q][k] for k in range(1, len(scored) + 1)] == [(c, -s) for s, c in scored]


def test_topk_edges(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id, r.score) for r in topk.top_k(docs, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 2048 * 1024)]
    assert topk.top_k(docs.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_url_filter(spark):
    urls = [
        "http://www.example.com/en/1", "https://EXAMPLE.com/en/2?x", "http://a.example.com/fr/", "http://b.net/es/3#y", "http://b.net/esx", "http://example.com", None, "no scheme", "://x.com/", "http://xcom/",
        "https://h.example.net/fr/9", "http://ads.bad.org/1",
    ]
    want = ["www.example.com/en/", "example.com/en/", "com/", "net/es/", None, None, None, None, "com/", None, "net/fr/", None]
    pages = spark.createDataFrame([(i, u, "q") for i, u in enumerate(urls)] + [(0, urls[0], "q")], "page_id long, url string, host string")
    rows = url_filter.judged(pages, queries.URL_RULES).collect()
    assert len(rows) == len(urls) + 1
    by = {r.page_id: r for r in rows}
    assert [by[i].rule for i in range(len(urls))] == want
    assert [by[i].verdict for i in (0, 1, 2, 3, 10)] == ["allow", "block", "allow", "block", "block"]
    assert (by[1].host, by[1].path) == ("example.com", "/en/2") and (by[5].host, by[5].path) == ("example.com", "") and (by[6].host, by[7].path) == ("", "")
    assert {r.verdict for r in rows} <= {"allow", "block"}
    assert url_filter.judged(pages.limit(0), queries.URL_RULES).count() == 0


def test_reputation_shrinks(spark):
    hosts = spark.createDataFrame([("spam.a.org", 50, 50, 50), ("one.a.org", 1, 1, 1), ("good.b.org", 50, 50, 0), ("new.b.org", 1, 0, 0), ("x.co.uk", 3, 3, 0)], "host string, pages long, n long, bad long")
    rows = {r.host: r for r in url_filter.reputations(hosts).collect()}
    assert rows["spam.a.org"].bound > 0.5 > rows["good.b.org"].bound
    assert rows["good.b.org"].mean < rows["new.b.org"].mean < rows["one.a.org"].mean < rows["spam.a.org"].mean


def _strength(units, m):
    units = [(n, b) for n, b in units if n]
    n, k = sum(n for n, _ in units), len(units)
    if k < 2:
        return 1.0
    s, spread = sum(n * (b / n - m) ** 2 for n, b in units), m * (1 - m)
    below = spread * (n - sum(x * x for x, _ in units) / n - (k - 1))
    r = min(max((s - spread * (k - 1)) / below if below > 0 else 0.5, 0.01), 0.99)
    return (1 - r) / r


def test_pages_against_brute_force(spark):
    rng = random.Random(9)
    shares = {"a.bad.org": 0.9, "b.bad.org": 0.8, "c.fine.org:80": 0.05, "u@d.fine.org": 0.0, "x.foo.co.nz": 0.7, "y.foo.co.nz": 0.2, "z.bar.co.nz": 0.5, "pills.shop.com": 0.0, "one.bad.org": 1.0, "lone.net": 1.0}
    rows = [(k, f"http://{h}/p{'x' * rng.choice([1, 5000])}", None if rng.random() < 0.1 else "<p>" + ("so### it%%% goes&amp;&amp;&amp;" if rng.random() < p else "so it goes") + "</p>", "q") for k, (h, p) in enumerate((h, p) for h, p in shares.items() for _ in range(1 if h in ("one.bad.org", "lone.net") else 25))]
    pages = spark.createDataFrame([*rows, (None, None, None, "q"), rows[0]], "page_id long, url string, html string, bad string")
    out = url_filter.judged(pages, []).collect()
    assert len(out) == len(rows) + 2
    seen = {}
    for _, url, html, _ in [*rows, (0, "", None, ""), rows[0]]:
        host = url.split("/")[2] if url else ""
        n, b = seen.get(host, (0, 0))
        bad = True if "pills" in host else None if html is None else "###" in html
        seen[host] = (n + (bad is not None), b + bool(bad))
    m = (sum(b for _, b in seen.values()) + 1) / (sum(n for n, _ in seen.values()) + 2)

    def domain(host):
        labels = host.split("@")[-1].split(":")[0].split(".")
        double = ".".join(labels[-2:]) in url_filter.SUFFIXES
        return ".".join(labels[-2:]) if double else labels[-1], ".".join(labels[-3:] if double else labels[-2:])

    def summed(key):
        out = {}
        for h, (n, b) in seen.items():
            a, c = out.get(key(h), (0, 0))
            out[key(h)] = (a + n, c + b)
        return out

    suffixes, domains = summed(lambda h: domain(h)[0]), summed(domain)
    ks, kd, kh = (_strength(u.values(), m) for u in (suffixes, domains, seen))
    by = {r.host: r for r in out}
    for h, (n, b) in seen.items():
        s, d = suffixes[domain(h)[0]], domains[domain(h)]
        prior = ((ks * m + s[1]) / (s[0] + ks) * kd + d[1]) / (d[0] + kd)
        share = (prior * kh + b) / (n + kh)
        bound = share - (share * (1 - share) / (n + kh + 1)) ** 0.5 * url_filter.DEVIATIONS
        assert by[h].reputation == pytest.approx(share, abs=2e-6) and by[h].verdict == ("block" if bound >= 0.5 else "allow")
    # shrinkage decides: a page alone on its host is bad each time, and so are most of x's
    assert by["a.bad.org"].verdict == by["pills.shop.com"].verdict == "block" and by["lone.net"].verdict == "allow"


def test_pipeline_on_a_small_folder(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(0)
    words = [f"word{i}" for i in range(200)]
    good = [" ".join(rng.choice(words) for _ in range(60)) + "." for _ in range(80)]
    junk = [" | ".join(rng.choice(words) + "###" for _ in range(60)) for _ in range(40)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(good + junk + good[:5] + [g + " more" for g in good[5:9]])]
    docs = spark.createDataFrame([*rows, (500, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 80), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out} - {500}
    assert ids <= (set(range(80)) - set(range(5))) | set(range(120, 125)) and len(ids) >= 76
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert len(corpus_pipeline.STAGES) == 5


def test_scratch_tables_are_cleared(spark):
    from lakespan.sources import scratch

    start = scratch.mark()
    one, two = scratch.written(spark.range(3), "one"), scratch.written(spark.range(4), "two")
    scratch.clear(spark, start, keep=("two",))
    assert two.count() == 4 and scratch.mark() != start
    with pytest.raises(Exception, match="(?i)not exist|no such|not found"):
        one.count()
    scratch.clear(spark, start)


def test_topk_reads_few_postings_and_stops_on_proof():
    rng = np.random.default_rng(11)
    x = rng.standard_normal((3000, 48)) ** 3
    x = np.floor(1024 * x / np.linalg.norm(x, axis=1)[:, None]).astype(np.int64)
    index = topk.ImpactIndex(np.arange(3000), x)
    assert len(index.rows) == (np.abs(x) >> index.shift > 0).sum()
    known = np.sort(x @ x[0])[-11]
    for threshold in (float("-inf"), float(known)):
        index.read = index.total = index.rescored = 0
        for q in range(0, 3000, 100):
            scores = x @ x[q]
            best = sorted((-s, i) for i, s in enumerate(scores) if i != q and (q == 0 or threshold < 0))[:10]
            ids, got = index.search(x[q], q, 10, threshold if q == 0 else float("-inf"))
            if best:
                assert [(-s, i) for i, s in zip(ids, got, strict=True)] == best
        assert 0 < index.read < 0.5 * index.total
        assert index.read + 48 * index.rescored < 0.7 * 30 * 3000 * 48
    assert len(index.search(x[0], 0, 10, float(x[0] @ x[0] * 4))[0]) == 0


def test_topk_repeated_ids(spark):
    from pyspark.sql import functions as F

    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [3.0])]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()]
    # the smaller vector of id 0 asks, and repeated rows are candidates each
    assert got == [(0, 1, 2, 512 * 3072), (0, 2, 1, 512 * 1024), (0, 3, 1, 512 * 1024)]
