"""Name similarity: Jaro-Winkler without a boost threshold, token sort, initials."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _codes(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(code points, one text a row, -1 behind its end; lengths)."""
    raw = [np.frombuffer(t.encode("utf-32-le"), "<i4") for t in texts]
    size = np.array([len(r) for r in raw])
    out = np.full((len(raw), max(int(size.max(initial=0)), 1)), -1, np.int32)
    out[np.arange(out.shape[1]) < size[:, None]] = np.concatenate(raw) if len(raw) else []
    return out, size


def jaro_winklers(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Jaro-Winkler of all pairs at once, a character of the left sides at a time; lower case, no threshold for the prefix."""
    (x, n), (y, k) = _codes(a.str.lower()), _codes(b.str.lower())
    rows, place = np.arange(len(x)), np.arange(y.shape[1])
    reach = np.maximum(np.maximum(n, k) // 2 - 1, 0)
    taken, order = np.zeros(y.shape, bool), np.full(x.shape, -1)
    for i in range(x.shape[1]):
        able = (y == x[:, i : i + 1]) & ~taken & (x[:, i : i + 1] >= 0) & (np.abs(place - i) <= reach[:, None])
        first = able.argmax(axis=1)
        hit = able[rows, first]
        taken[rows[hit], first[hit]] = True
        order[hit, i] = first[hit]
    m = taken.sum(axis=1)
    # matched characters of both sides, each in its own order
    left, right = (np.argsort(~mask, axis=1, kind="stable") for mask in (order >= 0, taken))
    wide = min(left.shape[1], right.shape[1])
    differ = (np.take_along_axis(x, left, 1)[:, :wide] != np.take_along_axis(y, right, 1)[:, :wide]) & (np.arange(wide) < m[:, None])
    moved = differ.sum(axis=1) / 2
    some = np.maximum(m, 1)
    jaro = np.where(m > 0, (m / np.maximum(n, 1) + m / np.maximum(k, 1) + (m - moved) / some) / 3, 0.0)
    four = min(4, x.shape[1], y.shape[1])
    prefix = np.cumprod((x[:, :four] == y[:, :four]) & (x[:, :four] >= 0), axis=1).sum(axis=1)
    out = jaro + prefix * 0.1 * (1 - jaro)
    return np.where((n == 0) | (k == 0), 0.0, np.where((n == k) & (m == n) & (moved == 0), 1.0, out))


def jaro_winkler(a: str, b: str) -> float:
    return float(jaro_winklers(pd.Series([a]), pd.Series([b]))[0])


@F.pandas_udf(T.DoubleType())
def _jw(a: pd.Series, b: pd.Series) -> pd.Series:
    """In slices of like length, so that one long text does not widen all the others."""
    known = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    at = np.flatnonzero(known)
    size = np.maximum(a.str.len().to_numpy()[at], b.str.len().to_numpy()[at])
    for part in np.array_split(at[np.argsort(size, kind="stable")], max(1, len(at) // 512)):
        if len(part):
            out[part] = jaro_winklers(a.iloc[part], b.iloc[part])
    return pd.Series(out).where(pd.Series(known), None).astype("float64")


def similarity(a: Column, b: Column) -> Column:
    return _jw(a, b)


def _sorted_tokens(t: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(t, r"[\s,]+"), lambda w: w != "")), " ")


def token_sort(a: Column, b: Column) -> Column:
    return _jw(_sorted_tokens(a), _sorted_tokens(b))


def initials(a: Column, b: Column) -> Column:
    """0.80 where one name is the initials of the other's first words, else 0."""

    def letters(t: Column) -> Column:
        return F.lower(F.regexp_replace(t, r"[^\p{L}]", ""))

    dotted = lambda t: (F.length(t) <= 8) & F.contains(t, F.lit("."))
    capitals = lambda t: (F.length(t) <= 4) & (F.upper(t) == t) & t.rlike(r"^\p{L}+$")
    short = F.when(dotted(a), letters(a)).when(dotted(b), letters(b)).when(capitals(a), F.lower(a)).when(capitals(b), F.lower(b))
    long = F.when(dotted(a), b).when(dotted(b), a).when(capitals(a), b).when(capitals(b), a)
    words = F.filter(F.split(long, r"\s+"), lambda w: w != "")
    heads = F.array_join(F.transform(words, lambda w: F.lower(F.left(w, F.lit(1)))), "")
    return F.when((F.size(words) >= F.length(short)) & F.startswith(heads, short), 0.80).otherwise(0.0)


def combined(a: Column, b: Column) -> Column:
    return F.greatest(similarity(a, b), token_sort(a, b), initials(a, b))
