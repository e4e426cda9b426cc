"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import scratch


def _total(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """node, component (its smallest node) for each node in links(a, b); nodes are longs or strings.

    Each step takes the least neighbour by a grouped minimum with map-side
    combine and joins it back, so a node with very many neighbours is never
    gathered in one task; a step's edges are written to the shared folder. Steps
    go on until nothing changes; if a bound on the rounds comes first, that is an error.
    """
    edges = scratch.written(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for n in itertools.count():
        state = _total(edges)
        if state == before or not state[0]:
            break
        if n == rounds:
            raise RuntimeError(f"components still change after {rounds} rounds")
        before = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = scratch.written(small.where("a != b").distinct(), "edges")
    return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
