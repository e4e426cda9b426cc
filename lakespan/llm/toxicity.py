"""Toxicity: a bidirectional gated recurrent network with attention pooling.

A word's input is a learned vector (for words seen in fitting) beside the mean
of learned vectors of its hashed character n-grams and prefixes, so unseen words
are judged by their characters. Both directions of the network read windows of
WINDOW words that overlap by half and cover each whole text; attention pools a
window's states into one logit, and a document's score is the logistic of its
highest window, calibrated on documents.

Labels are of documents, so fitting alternates between choosing each toxic
document's strongest windows and training on them, against random and strongest
windows of clean documents. All of it is numpy, on the driver, over at most
FIT_PER_CLASS labelled documents of each label of at most FIT_BYTES bytes each
(longer ones are scored like any, but not fitted on), so the driver holds a
bounded number of bytes. The word and n-gram vectors start from the smoothed log
odds of each unit's presence in toxic documents and are trained from there.

Null and empty texts have one window of no words; very long texts have as many
windows as they need. Repeated rows and rows without an id are scored each; an
empty table gives no rows; other columns, whatever their names, are ignored.
Labels, language, source and ids are never inputs. Without labelled rows of both
labels every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text
from .sample import held_out, labelled

FIT_PER_CLASS, FIT_BYTES = 1500, 1 << 16
WINDOW, STRIDE, HIDDEN, WORD_DIM, CHAR_DIM, GRAMS = 32, 16, 8, 8, 8, 1 << 14
THRESHOLD = 0.5
_EDGES = ".,;:!?#$%&*|\"'()[]{}<>=+-_~^`@/\\"
_F = np.float32


def word_forms(words: pa.Array) -> pa.Array:
    """Lower case, without marks at the edges."""
    return pc.utf8_trim(pc.utf8_lower(words), _EDGES)


def grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-gram of characters, offsets): inner trigrams, and prefixes of three to eight bytes."""
    n = len(words)
    words = words.cast(pa.large_string())
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + n + 1]
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].astype(np.uint64)
    at = at - at[0]
    length = np.diff(at)
    pieces, owners = [], []
    if len(raw) >= 3:
        tri = text.mix(raw[:-2] | (raw[1:-1] << np.uint64(8)) | (raw[2:] << np.uint64(16)), 1)
        places = text.inside(at, 3)
        pieces.append(tri[places])
        owners.append(text.owner(at)[places])
    h = np.zeros(n, np.uint64)
    for k in range(8):
        long = np.flatnonzero(length > k)
        h[long] = text.mix(h[long] ^ raw[at[long] + k], k + 2)
        if k >= 2:
            pieces.append(h[long])
            owners.append(long)
    whole = np.flatnonzero(length < 3)
    pieces.append(text.mix(h[whole], 99))
    owners.append(whole)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    ids = (np.concatenate(pieces)[order] % np.uint64(GRAMS)).astype(np.int64)
    return ids, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n))))


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word) of each window; the last one of a text ends with it."""
    count = np.diff(offsets)
    number = np.maximum(1, -(-np.maximum(count - WINDOW, 0) // STRIDE) + 1)
    doc = np.repeat(np.arange(len(count)), number)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
    return doc, offsets[doc] + np.minimum(place * STRIDE, np.maximum(count[doc] - WINDOW, 0))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Model:
    """Parameters p, the known words, and the calibration of a document's highest logit."""

    p: dict[str, np.ndarray]
    known: dict[str, int]
    slope: float = 1.0
    shift: float = 0.0
    blank: bool = False

    def inputs(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index among known words, n-grams, their offsets)."""
        get = self.known.get
        index = np.fromiter((get(w, 0) for w in words.to_pylist()), np.int64, len(words))
        return (index, *grams(words))

    def vectors(self, index: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        chars = np.add.reduceat(self.p["gram"][ids], offsets[:-1], axis=0) / np.diff(offsets)[:, None].astype(_F) if len(index) else np.zeros((0, CHAR_DIM), _F)
        return np.concatenate((self.p["word"][index], chars), axis=1)

    def _direction(self, gates: np.ndarray, mask: np.ndarray | None, side: str, back: bool, keep: bool) -> tuple[np.ndarray, list]:
        """States (time, window, HIDDEN) of one direction; with keep, also what the gradient needs."""
        steps, size = gates.shape[0], gates.shape[1]
        u, c = self.p["U" + side], self.p["c" + side]
        states, h, saved = np.empty((steps, size, HIDDEN), _F), np.zeros((size, HIDDEN), _F), [None] * steps
        for t in range(steps - 1, -1, -1) if back else range(steps):
            g, r = gates[t], h @ u
            both = _sigmoid(g[:, : 2 * HIDDEN] + r[:, : 2 * HIDDEN])
            reset, update = both[:, :HIDDEN], both[:, HIDDEN:]
            inner = r[:, 2 * HIDDEN :] + c
            new = np.tanh(g[:, 2 * HIDDEN :] + reset * inner)
            following = new + update * (h - new)
            if mask is not None:
                following = np.where(mask[t][:, None], following, h)
            if keep:
                saved[t] = (h, reset, update, inner, new)
            h = following
            states[t] = h
        return states, saved

    def logits(self, table: np.ndarray, codes: np.ndarray, mask: np.ndarray | None = None, keep: bool = False) -> tuple:
        """Logit of each window. table: gate inputs of each distinct word; codes: (time, window)."""
        width = 3 * HIDDEN
        gates = table[codes]
        forward, f = self._direction(gates[:, :, :width], mask, "f", False, keep)
        backward, b = self._direction(gates[:, :, width:], mask, "b", True, keep)
        h = np.concatenate((forward, backward), axis=2)
        s = h @ self.p["att"]
        if mask is not None:
            s = np.where(mask, s, _F(-30))
        a = np.exp(s - s.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tw,twh->wh", a, h)
        z = pooled @ self.p["out"] + self.p["bias"][0]
        return (z, h, a, pooled, f, b) if keep else (z,)

    def gate_table(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.p["W"] + self.p["b"]

    def document_logits(self, texts: pa.Array) -> tuple[np.ndarray, tuple]:
        """(highest window logit of each text, (text of each window, first word, logit, codes, forms, offsets))."""
        flat, offsets = text.split_words(texts)
        d = flat.dictionary_encode()
        forms = word_forms(d.dictionary).dictionary_encode()
        codes = forms.indices.to_numpy(zero_copy_only=False).astype(np.int32)[d.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int32)
        table = self.gate_table(self.vectors(*self.inputs(forms.dictionary)))
        table = np.concatenate((table, np.zeros((1, table.shape[1]), _F)))
        doc, start = windows(offsets)
        z = np.empty(len(doc), _F)
        short = np.diff(offsets)[doc] < WINDOW
        codes = np.concatenate((codes, np.full(WINDOW, len(table) - 1, np.int32)))
        steps = np.arange(WINDOW)[:, None]
        for group in (np.flatnonzero(~short), np.flatnonzero(short)):
            for i in range(0, len(group), 4096):
                w = group[i : i + 4096]
                mask = None
                if short[w[0]]:
                    mask = steps < np.diff(offsets)[doc[w]][None, :]
                z[w] = self.logits(table, codes[start[w][None, :] + steps], mask)[0]
        best = np.maximum.reduceat(z, np.searchsorted(doc, np.arange(len(texts)))) if len(texts) else z
        return best, (doc, start, z, codes, forms.dictionary, offsets)

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.blank:
            return np.zeros(len(texts))
        best = self.document_logits(texts)[0].astype(float)
        return 1 / (1 + np.exp(-np.clip(self.slope * best + self.shift, -30, 30)))


def _start(rng: np.random.Generator, words: int) -> dict[str, np.ndarray]:
    d, w = WORD_DIM + CHAR_DIM, 3 * HIDDEN

    def normal(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(_F)

    p = {"word": normal(words + 1, WORD_DIM, scale=0.1), "gram": normal(GRAMS, CHAR_DIM, scale=0.3), "W": normal(d, 2 * w, scale=d**-0.5), "b": np.zeros(2 * w, _F), "att": normal(2 * HIDDEN, scale=0.3), "out": normal(2 * HIDDEN, scale=0.3), "bias": np.array([-1.0], _F)}
    for side in "fb":
        p |= {"U" + side: normal(HIDDEN, w, scale=HIDDEN**-0.5), "c" + side: np.zeros(w - 2 * HIDDEN, _F)}
    p["word"][0] = 0
    return p


def _gradient(m: Model, index: np.ndarray, ids: np.ndarray, offsets: np.ndarray, codes: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict, float]:
    """Gradient of the mean log loss by backpropagation through time."""
    vectors = m.vectors(index, ids, offsets)
    table = m.gate_table(vectors)
    z, h, a, pooled, f, b = m.logits(table, codes, mask, keep=True)
    prob = _sigmoid(z)
    dz = ((prob - y) / len(y)).astype(_F)
    g = {"out": pooled.T @ dz, "bias": dz.sum(keepdims=True)}
    dpooled = dz[:, None] * m.p["out"]
    da = np.einsum("twh,wh->tw", h, dpooled)
    ds = a * (da - (a * da).sum(axis=0))
    dh = a[:, :, None] * dpooled + ds[:, :, None] * m.p["att"]
    g["att"] = np.einsum("twh,tw->h", h, ds)
    dgates = np.zeros((*codes.shape, table.shape[1]), _F)
    width = 3 * HIDDEN
    for side, saved, dstate, at in (("f", f, dh[:, :, :HIDDEN], 0), ("b", b, dh[:, :, HIDDEN:], width)):
        u = m.p["U" + side]
        g["U" + side], g["c" + side] = np.zeros_like(u), np.zeros_like(m.p["c" + side])
        carry = np.zeros_like(dstate[0])
        for t in range(len(codes) - 1, -1, -1) if side == "f" else range(len(codes)):
            before, reset, update, inner, new = saved[t]
            own = (carry + dstate[t]) * mask[t][:, None]
            through = (carry + dstate[t]) - own
            dnew = own * (1 - update) * (1 - new * new)
            dupdate = own * (before - new) * update * (1 - update)
            dreset = dnew * inner * reset * (1 - reset)
            dinner = dnew * reset
            dr = np.concatenate((dreset, dupdate, dinner), axis=1)
            dgates[t, :, at : at + width] = np.concatenate((dreset, dupdate, dnew), axis=1)
            g["U" + side] += before.T @ dr
            g["c" + side] += dinner.sum(axis=0)
            carry = own * update + dr @ u.T + through
    dtable = np.zeros_like(table)
    np.add.at(dtable, codes.reshape(-1), dgates.reshape(-1, table.shape[1]))
    g["W"], g["b"] = vectors.T @ dtable, dtable.sum(axis=0)
    dvectors = dtable @ m.p["W"].T
    g["word"] = (index, dvectors[:, :WORD_DIM])
    g["gram"] = (ids, np.repeat(dvectors[:, WORD_DIM:] / np.diff(offsets)[:, None].astype(_F), np.diff(offsets), axis=0))
    loss = -np.mean(y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9))
    return g, float(loss)


class _Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, g: dict) -> None:
        self.t += 1
        scale = self.rate * (1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t)
        for k, d in g.items():
            if isinstance(d, tuple):  # rows of a table: only those touched move
                rows, back = np.unique(d[0], return_inverse=True)
                total = np.zeros((len(rows), d[1].shape[1]), _F)
                np.add.at(total, back, d[1])
                d = total
            else:
                rows = slice(None)
            self.m[k][rows] = 0.9 * self.m[k][rows] + 0.1 * d
            self.v[k][rows] = 0.999 * self.v[k][rows] + 0.001 * d * d
            self.p[k][rows] -= scale * self.m[k][rows] / (np.sqrt(self.v[k][rows]) + 1e-7)
        self.p["word"][0] = 0


def _evidence(forms: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """Smoothed log odds of a toxic document for each unit present in it."""
    up, down = np.zeros(size), np.zeros(size)
    for own, t in zip(forms, y, strict=True):
        (up if t else down)[own] += 1
    return np.log((up + 0.5) / (y.sum() + 1)) - np.log((down + 0.5) / ((1 - y).sum() + 1))


def fit(texts: list[str], y: np.ndarray, seed: int = 7, rounds: int = 3, epochs: int = 4) -> Model:
    """Alternate between choosing windows and training on them, then calibrate on documents."""
    if not len(y) or y.min() == y.max():
        return Model({}, {}, blank=True)
    rng = np.random.default_rng(seed)
    arr = pa.array(texts, pa.large_string())
    flat, offsets = text.split_words(arr)
    forms = word_forms(flat).dictionary_encode()
    codes, vocabulary = forms.indices.to_numpy(zero_copy_only=False).astype(np.int64), forms.dictionary
    docs = [np.unique(codes[a:z]) for a, z in zip(offsets, offsets[1:], strict=False)]
    spread = np.bincount(np.concatenate(docs), minlength=len(vocabulary))
    names = vocabulary.to_pylist()
    m = Model({}, {names[i]: k + 1 for k, i in enumerate(np.flatnonzero(spread >= 5))})
    m.p = _start(rng, len(m.known))
    index, ids, at = m.inputs(vocabulary)
    gram_docs = [np.unique(ids[text_span]) for text_span in (np.concatenate([np.arange(at[w], at[w + 1]) for w in own]) if len(own) else np.zeros(0, np.int64) for own in docs)]
    word_weight, gram_weight = _evidence(docs, y, len(vocabulary)), _evidence(gram_docs, y, GRAMS)
    best_gram = np.maximum.reduceat(gram_weight[ids], at[:-1])
    hint = np.maximum(np.where(spread >= 3, word_weight, 0), best_gram)
    m.p["gram"][:, 0] += gram_weight.astype(_F) * 0.5
    m.p["word"][1:, 0] += word_weight[spread >= 5].astype(_F) * 0.5
    doc, start = windows(offsets)
    codes = np.concatenate((codes, np.zeros(WINDOW, np.int64)))
    steps = np.arange(WINDOW)[:, None]
    padded = np.concatenate((hint[codes[: offsets[-1]]], np.full(WINDOW, -9.0)))
    strength = np.array([np.sort(padded[s : min(s + WINDOW, e)])[-3:].sum() if e > s else -9.0 for s, e in zip(start, offsets[doc + 1], strict=True)])
    adam = _Adam(m.p, 0.01)
    first = np.searchsorted(doc, np.arange(len(y)))
    for turn in range(rounds):
        if turn:
            strength = np.concatenate([m.document_logits(arr.slice(a, z - a))[1][2] for a, z in text.slices(arr)])
        order = np.lexsort((-strength, doc))
        chosen = []
        for k in range(len(y)):
            own = order[first[k] : first[k + 1] if k + 1 < len(y) else len(doc)]
            chosen.append(own[:1] if y[k] else np.concatenate((own[:2], rng.choice(own, min(2, len(own)), replace=False))))
        chosen = np.concatenate(chosen)
        target = y[doc[chosen]]
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(chosen)), max(1, len(chosen) // 128)):
                w = chosen[part]
                mask = (start[w][None, :] + steps) < offsets[doc[w] + 1][None, :]
                used, back = np.unique(codes[start[w][None, :] + steps], return_inverse=True)
                size = np.diff(at)[used]
                pick = np.repeat(at[used] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
                g, _ = _gradient(m, index[used], ids[pick], np.concatenate(([0], np.cumsum(size))), back.reshape(WINDOW, -1), mask, target[part].astype(_F))
                adam.step(g)
    z = np.concatenate([m.document_logits(arr.slice(a, s - a))[0] for a, s in text.slices(arr)]).astype(float)
    _calibrate(m, z, y.astype(float))
    return m


def _calibrate(m: Model, z: np.ndarray, y: np.ndarray) -> None:
    """Logistic slope and shift of a document's highest logit, by damped Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([((p - y) * z).sum() + 0.1 * (a - 1), (p - y).sum() + 0.1 * b])
        h = np.array([[(w * z * z).sum() + 0.1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.1]])
        da, db = np.clip(np.linalg.solve(h, g), -0.5, 0.5)
        a, b = a - da, b - db
    m.slope, m.shift = float(a), float(b)


def trained(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = FIT_PER_CLASS) -> Model:
    rows = sorted((r.doc_id, r.text, r.y) for r in labelled(docs, labels, label, per_class, FIT_BYTES).collect())
    return fit([x for _, x, _ in rows], np.array([y for _, _, y in rows], int))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z, texts in text.parts(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), pa.array(model.score(texts))], ["doc_id", "score"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = own.mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
