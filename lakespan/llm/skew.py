"""Joins that deal hot keys apart from the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the large side's rows on; so there are at most 1000 hot keys.
HOT_SHARE = 1000


def _parts(large: DataFrame, small: DataFrame, key: str, rows: str, total: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of hot keys, joined; the other rows of large; the other rows of small)."""
    least = max(2, -(-total // HOT_SHARE))
    hot = small.where(F.col(rows) >= least)
    if hot.count() > HOT_SHARE:
        raise ValueError(f"more than {HOT_SHARE} keys with {least} rows: the total of {total} rows is too small")
    return large.join(F.broadcast(hot), key), large.join(F.broadcast(hot.select(key)), key, "left_anti"), small.where(F.col(rows) < least)


def join_counted(large: DataFrame, small: DataFrame, key: str, rows: str, total: int) -> DataFrame:
    """Inner join on key, where small has one row for each key and in `rows` its rows in large.

    Keys with at least total / 1000 rows (at most 1000 of them, as the rows add
    up to total) are joined by broadcast where the large side lies; the rest is
    shuffled by key. More hot keys than that mean that total is too small: an error.
    """
    one, rest, cold = _parts(large, small, key, rows, total)
    return one.unionByName(rest.join(cold, key).select(one.columns))


def left_counted(large: DataFrame, small: DataFrame, key: str, rows: str, total: int) -> DataFrame:
    """The same, and the rows of large whose key small lacks, with nulls."""
    one, rest, cold = _parts(large, small, key, rows, total)
    return one.unionByName(rest.join(cold, key, "left").select(one.columns))
