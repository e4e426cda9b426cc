"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the whole text are cut into quantile bins. Cyclic boosting visits
the features in turn; each visit fits a shallow tree on one feature's bins and
adds it to that feature's lookup table. Then the pairs with most remaining gain
get two-dimensional tables, fitted in the same way. A score is the logistic of
the intercept and the table entries of a document's bins, so scoring is a few
vectorised additions.

Null and empty texts have the features of no words and get a score like any
other; very long texts are read whole. Repeated rows and rows without an id are
scored (or kept) each; an empty table gives no rows; other columns, whatever
their names, are no inputs, and kept() returns them. Labels, language, source and ids are never inputs. With no labelled rows
the score is 0.5; with labels of one class it is near that class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text
from .sample import held_out, labelled

#: Documents of each label that the model is fitted on, at most.
FIT_PER_CLASS = 4000
THRESHOLD = 0.3
FEATURES = (
    "words", "bytes_per_word", "upper", "marks", "bars", "digits", "stops", "commas", "exclaims", "lines", "not_ascii",
    "distinct", "distinct_pairs", "same_as_before", "short_words", "capital_words", "longest",
)
_GROUPS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "marks": b"#$%&*@^~=+<>", "bars": b"|", "digits": b"0123456789", "stops": b".", "commas": b",;:", "exclaims": b"!?", "lines": b"\n", "not_ascii": bytes(range(128, 256))}


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text (large_string, no nulls)."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    size = np.diff(offsets).astype(float)

    def total(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        return (sums[at[1:]] - sums[at[:-1]]).astype(float)

    out = {}
    for name, chars in _GROUPS.items():
        table = np.zeros(256, bool)
        table[list(chars)] = True
        out[name] = total(table[raw], offsets) / np.maximum(size, 1)
    codes, vocabulary, starts = text.coded_words(texts)
    count = np.diff(starts)
    words = np.maximum(count, 1)
    at = np.frombuffer(vocabulary.buffers()[1], np.int64)[vocabulary.offset : vocabulary.offset + len(vocabulary) + 1]
    length = np.diff(at)
    first = np.frombuffer(vocabulary.buffers()[2] or b"", np.uint8)[at[:-1]] if len(vocabulary) else np.zeros(0, np.uint8)
    owner = text.owner(starts)
    lengths = length[codes] if len(codes) else np.zeros(0, np.int64)
    capital = ((first >= 65) & (first <= 90))[codes] if len(codes) else np.zeros(0, bool)
    same = np.zeros(len(codes), bool)
    same[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])

    def distinct(values: np.ndarray, own: np.ndarray) -> np.ndarray:
        order = np.argsort(values)
        order = order[np.argsort(own[order], kind="stable")]
        v, d = values[order], own[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
        return np.bincount(d[new], minlength=n).astype(float)

    pair = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, np.int64)
    out |= {
        "words": np.log1p(count), "bytes_per_word": total(lengths, starts) / words, "distinct": distinct(codes, owner) / words,
        "distinct_pairs": distinct(codes[pair] * (len(vocabulary) + 1) + codes[pair + 1], owner[pair]) / np.maximum(count - 1, 1),
        "same_as_before": total(same, starts) / words, "short_words": total(lengths <= 3, starts) / words, "capital_words": total(capital, starts) / words,
    }
    longest = np.zeros(n)
    if len(codes):
        full = np.flatnonzero(count)
        longest[full] = np.maximum.reduceat(lengths, starts[full])
    out["longest"] = np.log1p(longest)
    return np.stack([out[f] for f in FEATURES], axis=1)


def _tree(gradient: np.ndarray, hessian: np.ndarray, l2: float = 2.0) -> np.ndarray:
    """Values of a depth-two regression tree over ordered bins (one Newton step)."""

    def cut(a: int, z: int) -> int:
        g, h = np.cumsum(gradient[a:z]), np.cumsum(hessian[a:z])
        gain = g[:-1] ** 2 / (h[:-1] + l2) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + l2)
        return a + 1 + int(np.argmax(gain)) if len(gain) else z

    n = len(gradient)
    middle = cut(0, n)
    out = np.zeros(n)
    edges = sorted({0, cut(0, middle) if middle > 1 else middle, middle, cut(middle, n) if n - middle > 1 else n, n})
    for a, z in zip(edges, edges[1:], strict=False):
        out[a:z] = -gradient[a:z].sum() / (hessian[a:z].sum() + l2)
    return out


def _crossed(gradient: np.ndarray, hessian: np.ndarray, l2: float = 5.0) -> tuple[float, np.ndarray]:
    """(gain, values) of the best tree that cuts both axes once."""
    g, h = (np.pad(np.cumsum(np.cumsum(x, 0), 1), ((1, 0), (1, 0))) for x in (gradient, hessian))

    def quarters(x: np.ndarray) -> list[np.ndarray]:
        inner, right, low, all_ = x[1:-1, 1:-1], x[1:-1, -1:], x[-1:, 1:-1], x[-1, -1]
        return [inner, right - inner, low - inner, all_ - right - low + inner]

    parts = list(zip(quarters(g), quarters(h), strict=True))
    gain = sum(a**2 / (b + l2) for a, b in parts)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.zeros(gradient.shape)
    for k, where in enumerate(((slice(None, i + 1), slice(None, j + 1)), (slice(None, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(None, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        out[where] = -parts[k][0][i, j] / (parts[k][1][i, j] + l2)
    return float(gain[i, j]), out


@dataclass
class Model:
    """Bin edges, a table for each feature, and tables for pairs of coarser bins."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]
    coarse: int

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.intercept)
        for k, t in enumerate(self.tables):
            z += t[b[:, k]]
        for i, j, t in self.pairs:
            z += t[b[:, i] // self.coarse, b[:, j] // self.coarse]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, bins: int = 32, coarse: int = 4, cycles: int = 120, pairs: int = 6, pair_cycles: int = 40, rate: float = 0.1) -> Model:
    """Boost the tables by cycles over the features, then over the pairs with most gain."""
    n, count = x.shape
    if not n:
        return Model(0.0, [np.zeros(0)] * count, [np.zeros(1)] * count, [], coarse)
    weight = np.ones(n) if weight is None else weight
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(count)]
    share = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
    model = Model(float(np.log(share / (1 - share))), edges, [np.zeros(len(e) + 1) for e in edges], [], coarse)
    b = model.bins(x)
    z = np.full(n, model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return weight * (p - y), weight * p * (1 - p)

    for _ in range(cycles):
        for k, t in enumerate(model.tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(b[:, k], g, len(t)), np.bincount(b[:, k], h, len(t)))
            t += step
            z += step[b[:, k]]
    wide = [len(e) // coarse + 1 for e in edges]

    def grid(i: int, j: int) -> tuple[float, np.ndarray]:
        g, h = slopes()
        at = (b[:, i] // coarse) * wide[j] + b[:, j] // coarse
        shape = (wide[i], wide[j])
        return _crossed(*(np.bincount(at, v, wide[i] * wide[j]).reshape(shape) for v in (g, h)))

    able = [(i, j) for i in range(count) for j in range(i) if wide[i] > 1 and wide[j] > 1]
    chosen = sorted(able, key=lambda p: -grid(*p)[0])[:pairs]
    model.pairs = [(i, j, np.zeros((wide[i], wide[j]))) for i, j in chosen]
    for _ in range(pair_cycles):
        for i, j, t in model.pairs:
            step = rate * grid(i, j)[1]
            t += step
            z += step[b[:, i] // coarse, b[:, j] // coarse]
    return model


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, z, texts in text.parts(batch):
            x = features(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))], ["y", "x"])


def trained(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = FIT_PER_CLASS) -> Model:
    """Fit on at most per_class documents of each label; classes are weighted back to their true shares."""
    sample = labelled(docs, labels, label, per_class)
    rows = sample.select("y", "text").mapInArrow(_feature_rows, "y int, x array<double>").collect()
    x, y = np.array([r.x for r in rows], float).reshape(len(rows), len(FEATURES)), np.array([r.y for r in rows], float)
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    if not len(rows):
        return fit(x, y)
    truth = {r.y: r["n"] for r in labels.where(f"{label} IN (0, 1)").where(~held_out()).groupBy(F.col(label).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = np.where(y == 1, truth[1] / max(y.sum(), 1) if 1 in truth else 1, truth[0] / max((1 - y).sum(), 1) if 0 in truth else 1)
    return fit(x, y, weight / weight.mean())


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z, texts in text.parts(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), pa.array(model.score(features(texts)))], ["doc_id", "score"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = own.mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model does not reject, with all their columns."""
    place = docs.columns.index("text")
    schema = docs.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.RecordBatch.from_arrays([batch.column(place)], ["text"])
            good = [model.score(features(texts)) >= THRESHOLD for _, _, texts in text.parts(own)]
            yield batch.filter(pa.array(np.concatenate(good) if good else np.zeros(0, bool)))

    return docs.mapInArrow(keep, schema)
