"""Overlap resolution: islands of overlapping spans, one winner each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed


def rank(category: str | Column = "category") -> Column:
    c = F.col(category) if isinstance(category, str) else category
    out = F.lit(0)
    for name, r in fixed.RANKS.items():
        out = F.when(c == name, r).otherwise(out)
    return out


def islands(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds island, island_start, island_end: spans belong together while they overlap; touching ones do not."""
    rows = found.withColumn("rank", rank()).withColumn("end", F.col("start") + F.col("len"))
    order = Window.partitionBy(key).orderBy("start", F.desc("rank"), "rule", "matched")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("opens", F.coalesce(F.col("start") >= before, F.lit(True)).cast("int"))
    rows = rows.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(order))
    own = Window.partitionBy(key, "island")
    return rows.withColumn("island_start", F.min("start").over(own)).withColumn("island_end", F.max("end").over(own)).drop("opens")


def resolved_by_posterior(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds winner: by meeting its cutoff, then posterior, then rank, then the last in order."""
    rows = islands(found, key)
    best = Window.partitionBy(key, "island").orderBy(F.desc("meets"), F.desc("posterior"), F.desc("rank"), "place")
    return rows.withColumn("winner", F.row_number().over(best) == 1)


def resolved_by_confidence(found: DataFrame, key: str = "doc_id", epsilon: float = 0.02) -> DataFrame:
    """Adds winner: a later span replaces the best so far if its confidence is larger
    by more than epsilon, or within epsilon if its rank is larger.

    That rule is not transitive, so an island is folded in order rather than
    sorted; an island is as long as spans overlap, within one document.
    """
    rows = islands(found, key)
    own = rows.groupBy(key, "island").agg(F.array_sort(F.collect_list(F.struct("place", "confidence", "rank"))).alias("s"))

    def better(a: Column, x: Column) -> Column:
        gap = x["confidence"] - a["confidence"]
        return F.when(F.abs(gap) > epsilon, gap > 0).otherwise(x["rank"] > a["rank"])

    fold = F.aggregate(F.slice("s", 2, F.size("s")), F.element_at("s", 1), lambda a, x: F.when(better(a, x), x).otherwise(a))
    own = own.select(key, "island", fold["place"].alias("best"))
    return rows.join(own, [key, "island"]).withColumn("winner", F.col("place") == F.col("best")).drop("best")


def survivors(resolved: DataFrame, key: str = "doc_id") -> DataFrame:
    """Winners, widened to their island's range."""
    return resolved.where("winner").withColumn("start", F.col("island_start")).withColumn("len", F.col("island_end") - F.col("island_start"))


def suppressed_counts(resolved: DataFrame, key: str = "doc_id") -> DataFrame:
    """category, suppressed: losers, but for those of the winner's own range and category."""
    wins = resolved.where("winner").select(key, "island", F.col("start").alias("w_start"), F.col("end").alias("w_end"), F.col("category").alias("w_category"))
    lost = resolved.where(~F.col("winner")).join(wins, [key, "island"])
    same = (F.col("start") == F.col("w_start")) & (F.col("end") == F.col("w_end")) & (F.col("category") == F.col("w_category"))
    return lost.where(~same).groupBy("category").agg(F.count(F.lit(1)).alias("suppressed"))


def merged(found: DataFrame, key: str = "doc_id", gap: int = 0) -> DataFrame:
    """key, start, len, n: spans merged while the gap between them is at most `gap` characters."""
    order = Window.partitionBy(key).orderBy("start", "len")
    rows = found.withColumn("end", F.col("start") + F.col("len"))
    rows = rows.withColumn("opens", F.coalesce(F.col("start") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)) + gap, F.lit(True)).cast("int"))
    rows = rows.withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")).select(key, "start", (F.col("end") - F.col("start")).alias("len"), "n")


def greedy(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans kept in the order of confidence unless they overlap one already kept."""
    rows = found.withColumn("end", F.col("start") + F.col("len"))
    own = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("o"), "start", "end", "matched", "confidence"))).alias("s"))
    none = F.slice("s", 1, 0)
    keep = F.aggregate("s", none, lambda kept, x: F.when(F.exists(kept, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"])), kept).otherwise(F.concat(kept, F.array(x))))
    return own.select(key, F.inline(keep)).select(key, "start", (F.col("end") - F.col("start")).alias("len"), "matched", "confidence")
