"""Working with results: filters, orders, selection, caps, counts and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE_CAP, HIGH, VERY_HIGH = 500, 0.75, 0.90
_ORDERS = ("discovery", "confidence", "page")


def filtered(found: DataFrame, categories: list[str] | None = None, least: float | None = None, sources: list[str] | None = None, applied: bool | None = None) -> DataFrame:
    """Results of some categories, sources, confidence or state; what is None does not filter. A null confidence counts as 0."""
    out = found
    if categories is not None:
        out = out.where(F.col("category").isin(*categories))
    if sources is not None:
        out = out.where(F.col("source").isin(*sources))
    if least is not None:
        out = out.where(F.coalesce("confidence", F.lit(0.0)) >= least)
    return out if applied is None else out.where(F.col("applied") == applied)


def ordered(found: DataFrame, by: str = "discovery") -> DataFrame:
    """In the order of discovery (document, place), of falling confidence (null as 0), or of pages."""
    if by not in _ORDERS:
        raise ValueError(f"not an order: {by}")
    place = ["doc_id", "start", "category", "len"]
    return found.orderBy(F.desc(F.coalesce("confidence", F.lit(0.0))), *place) if by == "confidence" else found.orderBy(*place)


def selected(found: DataFrame, by: str = "high", category: str | None = None, doc_id: int | None = None) -> DataFrame:
    """Adds selected: by a confidence of 75 % (high) or 90 % (very high), by category, all or none; within a document if one is named."""
    tests = {"high": F.col("confidence") >= HIGH, "very high": F.col("confidence") >= VERY_HIGH, "category": F.col("category") == category, "all": F.lit(True), "none": F.lit(False)}
    if by not in tests:
        raise ValueError(f"not a selection: {by}")
    scope = F.lit(True) if doc_id is None else F.col("doc_id") == doc_id
    return found.withColumn("selected", F.coalesce(tests[by] & scope, F.lit(False)))


def highlights(found: DataFrame, cap: int = PAGE_CAP) -> DataFrame:
    """The first results of each page, with saturated where a page has more (the cap is the feature)."""
    order = Window.partitionBy("doc_id").orderBy("start", "category", "len")
    rows = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap + 1)
    more = F.max("n").over(Window.partitionBy("doc_id")) > cap
    return rows.withColumn("saturated", more).where(F.col("n") <= cap).drop("n")


def occurrences(found: DataFrame) -> DataFrame:
    """doc_id, spans, occurrences: distinct places and lengths, however many patterns meet there."""
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("spans"), F.count_distinct("start", "len").alias("occurrences"))


def category_counts(found: DataFrame) -> DataFrame:
    """category, spans, place: most frequent first, then by name."""
    rows = found.groupBy("category").agg(F.count(F.lit(1)).alias("spans"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("spans"), "category")))


def line_confidence(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """doc_id, region, least, mean: confidence of the recognised lines(doc_id, start, len, confidence) that each region covers."""
    a = regions.select("doc_id", F.col("start").alias("r0"), (F.col("start") + F.col("len")).alias("r1"))
    met = a.join(lines, "doc_id").where((F.col("start") < F.col("r1")) & (F.col("r0") < F.col("start") + F.col("len")))
    return met.groupBy("doc_id", F.col("r0").alias("region")).agg(F.min("confidence").alias("least"), F.avg("confidence").alias("mean"))


def term_set(terms: DataFrame) -> DataFrame:
    """text, needs_boundary: each text once; a boundary is needed only if every entry needs it."""
    return terms.where("text IS NOT NULL AND trim(text) != ''").groupBy("text").agg(F.bool_and("needs_boundary").alias("needs_boundary"))


def runs(glyphs: DataFrame) -> DataFrame:
    """Adds run: characters (doc_id, line, x, width) belong together until the line ends or a gap is 1.5 times the width before it."""
    order = Window.partitionBy("doc_id").orderBy("line", "x")
    end = F.lag(F.col("x") + F.col("width")).over(order)
    opens = F.coalesce((F.col("line") != F.lag("line").over(order)) | (F.col("x") - end >= F.lag("width").over(order) * 1.5), F.lit(True))
    rows = glyphs.withColumn("opens", opens.cast("int"))
    return rows.withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("opens")


def positives(words: Column, sentinels: list[str]) -> Column:
    """The words of an array that are no sentinels."""
    return F.array_sort(F.array_except(words, F.array(*map(F.lit, sentinels))))


def partitioned(found: DataFrame, families: tuple[str, ...] = ("account", "phone", "mrn", "ein", "itin")) -> DataFrame:
    """Adds family: whether a category's spans get a posterior or keep their confidence."""
    return found.withColumn("family", F.when(F.col("category").isin(*families), "scored").otherwise("plain"))
