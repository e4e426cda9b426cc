"""Components that grow as links come in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..sources import scratch


def extended(known: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, component after more links(a, b), given those known so far.

    Links are first drawn between components, so that only what is new is walked.
    """
    if known is None:
        return scratch.written(components(links), "components")
    of = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    drawn = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    more = scratch.written(components(drawn), "components").withColumnsRenamed({"node": "old", "component": "new"})
    kept = known.join(more, known["component"] == more["old"], "left").select("node", F.coalesce("new", "component").alias("component"))
    fresh = more.join(known.select(F.col("node").alias("old")), "old", "left_anti").select(F.col("old").alias("node"), F.col("new").alias("component"))
    return scratch.written(kept.unionByName(fresh), "components")
