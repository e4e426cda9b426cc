"""Batch helpers, tokenizer and classifiers against plain Python, the library and held-out rows."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from lakespan.llm import bpe, quality, text, toxicity
from lakespan.llm.queries import tokenizer_path

TEXTS = ["", " \t\n", "One two  three\x0bfour", "É " * 50, "a" * 5000, "naïve\xa0café", None]


def test_words_are_cut_at_ascii_white_space():
    flat, offsets = text.split_words(pa.array([t or "" for t in TEXTS], pa.large_string()))
    words = flat.to_pylist()
    for i, t in enumerate(TEXTS):
        assert words[offsets[i] : offsets[i + 1]] == [w.decode() for w in (t or "").encode().split()]


def test_parts_give_whole_texts_in_order():
    random.seed(3)
    rows = ["".join(random.choice("ABCdéÉ \n") for _ in range(random.randint(0, 400))) for _ in range(300)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows, pa.string())], ["doc_id", "text"])
    got = [x for _, _, part in text.parts(batch.slice(5, 280), 2000) for x in pc.ascii_lower(part).to_pylist()]
    assert got == ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r or "") for r in rows[5:285]]


def test_window_hashes_depend_on_words_only():
    words, offsets = text.word_hashes(pa.array(["a b c a b c", "x a b c"], pa.large_string()))
    h = text.window_hashes(words, 3)
    assert h[0] == h[3] == h[7] and h[0] != h[1]
    assert text.inside(offsets, 3).tolist() == [0, 1, 2, 3, 6, 7]


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    library.no_truncation()
    library.no_padding()
    random.seed(5)
    letters = "aabcAB 's'T'll<|endoftext|>éÉẞßΣσς٣5²\xa0\x85 \x1c😀漢字İ'\"!?\n\t…ﬁʼn"
    rows = ["".join(random.choice(letters) for _ in range(random.randint(0, 50))) for _ in range(1500)]
    rows += ["", "  ", "<|startoftext|>hi<|endoftext|> x", "ΑΣ Σ", "aaaa aaaaa", "a" * 2000]
    codes, chunks, offsets = text.coded_words(pa.array(rows, pa.large_string()))
    known = bpe.Encoder(tokenizer_path()).chunks(chunks.to_pylist())
    for i, row in enumerate(rows):
        own = [known[c] for c in codes[offsets[i] : offsets[i + 1]]]
        ids = library.encode(row, add_special_tokens=False).ids
        assert np.frombuffer(b"".join(x for x, _ in own), "<u4").tolist() == ids
        assert b" ".join(y for _, y in own if y).decode() == library.decode(ids, skip_special_tokens=False)


def test_bpe_rows(spark):
    docs = spark.createDataFrame([(1, "Hello hello", "x"), (2, None, None), (None, "", "y"), (1, "Hello hello", "x")], "doc_id long, text string, n_tokens string")
    rows = bpe.encoded(docs, tokenizer_path()).collect()
    assert len(rows) == 4 and sorted(r.n_tokens for r in rows) == [0, 0, 2, 2]
    assert all(r.decoded == "hello</w> hello</w>" for r in rows if r.n_tokens)
    assert bpe.encoded(docs.limit(0), tokenizer_path()).count() == 0


def _junk(rng, good):
    words = [rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(rng.integers(50)) for _ in range(60)]
    return " ".join(words) + "." if good else " | ".join(w + "###" for w in words)


def test_quality_separates_junk_and_scores_everything():
    rng = np.random.default_rng(1)
    y = np.array([i % 2 for i in range(400)], float)
    x = quality.features(pa.array([_junk(rng, k) for k in y], pa.large_string()))
    model = quality.fit(x[:300], y[:300])
    assert (((model.score(x[300:])) >= quality.THRESHOLD) == y[300:]).mean() > 0.97
    odd = model.score(quality.features(pa.array(["", " ", "a", "b" * 100_000], pa.large_string())))
    assert np.isfinite(odd).all() and ((odd >= 0) & (odd <= 1)).all()
    assert model.pairs and all(t.shape for _, _, t in model.pairs)


def test_quality_on_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, _junk(rng, i % 3 > 0), int(i % 3 > 0)) for i in range(300)] + [(None, None, 1), (5, "", 0)]
    both = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    docs, labels = both.select("doc_id", "text", both.quality.alias("score")), both.select("doc_id", "quality")
    model = quality.trained(docs, labels)
    out = quality.scored(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert quality.kept(docs, model).columns == docs.columns
    assert 150 < quality.kept(docs, model).count() < 250
    assert quality.scored(docs.limit(0), quality.trained(docs.limit(0), labels.limit(0))).count() == 0


def test_toxicity_learns_words_and_prefixes():
    rng = np.random.default_rng(4)
    plain = [f"w{i}" for i in range(300)]
    bad = ["idiot", *(f"vexu{k}" for k in range(400))]
    texts, y = [], []
    for i in range(360):
        words = list(rng.choice(plain, rng.integers(5, 200)))
        if i % 3 == 0:
            for _ in range(2):
                words.insert(rng.integers(len(words)), rng.choice(bad) if i % 2 else "Idiot!")
        texts.append(" ".join(words))
        y.append(int(i % 3 == 0))
    model = toxicity.fit(texts[:300], np.array(y[:300]))
    score = model.score(pa.array(texts[300:], pa.large_string()))
    assert ((score >= 0.5) == np.array(y[300:])).mean() > 0.9
    odd = model.score(pa.array(["", " ", "é" * 10_000], pa.large_string()))
    assert ((odd >= 0) & (odd <= 1)).all()
    assert toxicity.fit(["a"], np.array([0])).score(pa.array(["a", ""])).tolist() == [0, 0]


def _rows_of_models(spark, label):
    rng = np.random.default_rng(6)
    bad = [f"vexu{k}" for k in range(30)]
    rows = []
    for i in range(240):
        words = [f"w{k}" for k in rng.integers(0, 200, rng.integers(5, 120))]
        if i % 3 == 0:
            words[0:0] = list(rng.choice(bad, 3))
        text_ = " ".join(words) if label == "toxic" or i % 3 else " | ".join(w + "###" for w in words)
        rows.append((i, text_, int((i % 3 == 0) == (label == "toxic"))))
    rows += [(None, None, 1), (500, "", 0), (501, " \t", 0), (502, "é" * 30_000 + " w1" * 30_000, 0), (7, rows[7][1], rows[7][2]), (8, "another text w9", 0)]
    both = spark.createDataFrame([(*r, "z", 0.5) for r in rows], f"doc_id long, text string, {label} int, y string, score double")
    return rows, both.select("doc_id", "text", "y", "score"), both.select("doc_id", label)


def test_toxicity_on_rows_against_window_by_window(spark):
    rows, docs, labels = _rows_of_models(spark, "toxic")
    model = toxicity.trained(docs, labels)
    out = toxicity.scored(docs, model).collect()
    assert len(out) == len(rows) and all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in out)
    # each window alone, with the same model
    score = {(r.doc_id, round(r.score, 6)) for r in out}
    for i, t, _ in [rows[0], rows[1], rows[-4], rows[-6]]:
        words = [w.decode() for w in (t or "").encode().split()]
        starts = sorted({*range(0, max(1, len(words) - toxicity.WINDOW + 1), toxicity.STRIDE), max(0, len(words) - toxicity.WINDOW)})
        best = max(model.document_logits(pa.array([" ".join(words[s : s + toxicity.WINDOW])], pa.large_string()))[0][0] for s in starts)
        assert (i, round(float(1 / (1 + np.exp(-np.clip(model.slope * float(best) + model.shift, -30, 30)))), 6)) in {(a, b) for a, b in score} | {(a, round(b + d, 6)) for a, b in score for d in (1e-6, -1e-6)}
    assert toxicity.scored(docs.limit(0), toxicity.trained(docs.limit(0), labels.limit(0))).count() == 0


def test_sample_is_one_bounded_row_an_id(spark):
    from lakespan.llm.sample import held_out, labelled

    _, docs, labels = _rows_of_models(spark, "toxic")
    got = labelled(docs, labels, "toxic", 40, 2000).collect()
    assert len(got) == len({r.doc_id for r in got}) <= 80 and all(len(r.text.encode()) <= 2000 for r in got)
    held = {r.doc_id for r in docs.where(held_out()).collect()}
    assert held and not held & {r.doc_id for r in got}


def test_quality_on_rows_against_table_by_table(spark):
    rows, docs, labels = _rows_of_models(spark, "quality")
    model = quality.trained(docs, labels)
    out = quality.scored(docs, model).collect()
    assert len(out) == len(rows)
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(i, []).append(t or "")
    for r in out:
        able = []
        for t in texts[r.doc_id]:
            x = quality.features(pa.array([t], pa.large_string()))[0]
            bins = [sum(v >= e for e in edges) for v, edges in zip(x, model.edges, strict=True)]
            z = model.intercept + sum(table[b] for table, b in zip(model.tables, bins, strict=True))
            z += sum(table[bins[i] // model.coarse, bins[j] // model.coarse] for i, j, table in model.pairs)
            able.append(1 / (1 + np.exp(-min(max(z, -30), 30))))
        assert min(abs(r.score - a) for a in able) < 1e-9
    kept = quality.kept(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in out)


def test_toxicity_gradient():
    rng = np.random.default_rng(0)
    m = toxicity.Model(toxicity._start(rng, 4), {})
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    index, ids, offsets = np.array([1, 2, 3]), np.array([5, 9, 5, 7]), np.array([0, 2, 3, 4])
    codes = rng.integers(0, 3, (toxicity.WINDOW, 4))
    mask = np.arange(toxicity.WINDOW)[:, None] < np.array([32, 20, 1, 9])[None, :]
    y = np.array([1.0, 0, 1, 0])
    g, _ = toxicity._gradient(m, index, ids, offsets, codes, mask, y)
    for name in ("W", "Uf", "Ub", "att", "out", "cf"):
        at = (0,) * m.p[name].ndim
        old = m.p[name][at]
        step = 1e-2
        m.p[name][at] = old + step
        up = toxicity._gradient(m, index, ids, offsets, codes, mask, y)[1]
        m.p[name][at] = old - step
        down = toxicity._gradient(m, index, ids, offsets, codes, mask, y)[1]
        m.p[name][at] = old
        assert g[name][at] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-4), name


def test_windows_cover_each_text_and_overlap():
    offsets = np.cumsum([0, 0, 5, 32, 33, 100])
    doc, start = toxicity.windows(offsets)
    for i in range(5):
        own = start[doc == i] - offsets[i]
        n = offsets[i + 1] - offsets[i]
        assert own[0] == 0 and own[-1] == max(0, n - toxicity.WINDOW)
        assert (np.diff(own) <= toxicity.STRIDE).all()
