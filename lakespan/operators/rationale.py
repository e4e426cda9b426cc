"""Reverse rationale: what each category says of a snippet that a reader asks about, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, normalize
from . import detect
from .search import checked_terms, unsafe

#: Cutoff of a category that the preset has none for.
DEFAULT_CUTOFF = 0.5


def _term(snippet: Column, literals: list[str], patterns: list[str]) -> Column:
    """The whole snippet is one of the terms."""
    out = F.lit(False)
    for t in checked_terms(list(literals)) if literals else []:
        out = out | (normalize.surface_form(snippet) == normalize.surface_form(F.lit(t)))
    for p in patterns:
        if unsafe(p):
            raise ValueError(f"pattern refused: {unsafe(p)}")
        out = out | snippet.rlike(rf"\A(?:{p})\z")
    return out


def explained(
    texts: DataFrame, asked: DataFrame, cutoffs: dict[str, float], doctype: str | None = None,
    never: tuple[list[str], list[str]] = ([], []), always: tuple[list[str], list[str]] = ([], []),
) -> DataFrame:
    """doc_id, snippet, category, reason, confidence: a row for each category and snippet asked(doc_id, snippet).

    texts(doc_id, text and, if named, the class in `doctype`) has a row for each
    doc_id. The first occurrence of the snippet counts, and of a category's spans
    that meet it the first. Reasons, in this order: snippetNotInContext,
    doctypeGated, suppressedByUserTerm, matchedAlwaysFlag, noMatch,
    aboveThreshold, belowThreshold. never and always are (literals, patterns).
    """
    rows = asked.select("doc_id", "snippet").distinct().join(texts, "doc_id")
    at = F.when(F.col("snippet") != "", F.instr("text", F.col("snippet")) - 1).otherwise(-1)
    rows = rows.select("doc_id", "snippet", F.coalesce(at, F.lit(-1)).alias("at"), (F.col(doctype) if doctype else F.lit(None).cast("string")).alias("doctype"))
    dims = rows.withColumn("category", F.explode(F.array(*map(F.lit, detect.CATEGORIES))))
    found = detect.detected(texts.join(asked.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text"))
    hit = rows.join(found.select("doc_id", "category", "start", "len", "confidence"), "doc_id").where((F.col("start") < F.col("at") + F.length("snippet")) & (F.col("at") < F.col("start") + F.col("len")) & (F.col("at") >= 0))
    first = hit.groupBy("doc_id", "snippet", "category").agg(F.min(F.struct("start", (-F.col("confidence")).alias("least"))).alias("m"))
    out = dims.join(first.withColumnsRenamed({"doc_id": "d", "snippet": "s", "category": "c"}), (F.col("doc_id") == F.col("d")) & F.col("snippet").eqNullSafe(F.col("s")) & (F.col("category") == F.col("c")), "left")
    cutoff, gated = F.lit(DEFAULT_CUTOFF), F.lit(False)
    for c, v in cutoffs.items():
        cutoff = F.when(F.col("category") == c, v).otherwise(cutoff)
    for c, classes in fixed.GATES.items():
        gated = gated | ((F.col("category") == c) & ~F.col("doctype").isin(classes))
    why = (
        F.when(F.col("at") < 0, "snippetNotInContext").when(gated, "doctypeGated").when(_term(F.col("snippet"), *never), "suppressedByUserTerm").when(_term(F.col("snippet"), *always), "matchedAlwaysFlag")
        .when(F.col("m").isNull(), "noMatch").when(-F.col("m.least") >= cutoff, "aboveThreshold").otherwise("belowThreshold")
    )
    out = out.withColumn("reason", why)
    score = F.when(F.col("reason") == "matchedAlwaysFlag", 1.0).when(F.col("reason").endswith("Threshold"), F.round(-F.col("m.least"), 6))
    return out.select("doc_id", "snippet", "category", "reason", score.alias("confidence"))
