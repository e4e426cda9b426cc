"""User terms: never-flag suppression, always-flag hits, surface forms, and a term store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalize
from .search import Options, checked_terms, literal, regex, unsafe


def stored(spark, terms: list[tuple[str, str, bool]]) -> DataFrame:
    """list, pattern, is_regex: terms that pass their checks, each once in its list."""
    good, seen = [], set()
    for name, pattern, is_regex in terms:
        ok = not unsafe(pattern) if is_regex else 0 < len(pattern.strip()) <= 200
        key = (name, pattern.strip().lower(), is_regex)
        if ok and key not in seen:
            seen.add(key)
            good.append((name, pattern.strip() if not is_regex else pattern, is_regex))
    return spark.createDataFrame(good, "list string, pattern string, is_regex boolean")


def with_template(terms: DataFrame, template: DataFrame) -> DataFrame:
    """The stored terms and those of a template(list, pattern, is_regex) that are not among them, whatever their case."""
    key = lambda d: d.withColumn("key", F.when(F.col("is_regex"), F.col("pattern")).otherwise(F.lower(F.trim("pattern"))))
    new = key(template).where("trim(pattern) != '' AND length(pattern) <= 200").dropDuplicates(["list", "key", "is_regex"]).join(key(terms).select("list", "key", "is_regex"), ["list", "key", "is_regex"], "left_anti")
    return terms.unionByName(new.select("list", F.trim("pattern").alias("pattern"), "is_regex"))


def never_flagged(found: DataFrame, literals: list[str], patterns: list[str] = ()) -> DataFrame:
    """Spans but those whose normalised text is a literal, or wholly matches a pattern."""
    spark = found.sparkSession
    for p in patterns:
        if unsafe(p):
            raise ValueError(f"pattern refused: {unsafe(p)}")
    dim = spark.createDataFrame([(t,) for t in checked_terms(list(literals))] if literals else [], "literal string").select(normalize.surface_form(F.col("literal")).alias("form"))
    out = found.withColumn("form", normalize.surface_form(F.col("matched"))).join(dim, "form", "left_anti")
    for p in patterns:
        out = out.where(~F.col("matched").rlike(f"^(?:{p})$"))
    return out.select(*found.columns)


def always_flagged(texts: DataFrame, literals: list[str], patterns: list[str] = ()) -> DataFrame:
    """doc_id, category, rule, start, len, matched, confidence: hits of the terms, at full confidence."""
    parts = [literal(texts, t, Options()) for t in checked_terms(list(literals))] + [regex(texts, p) for p in patterns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("doc_id", F.lit("user").alias("category"), F.lit("user.alwaysFlag").alias("rule"), "start", "len", "matched", F.lit(1.0).alias("confidence"))


def surface_decisions(decisions: DataFrame, cap: int = 10_000) -> DataFrame:
    """form, accepted: the last decision on each form, for the `cap` latest forms. decisions(text, accepted, ts)."""
    last = decisions.withColumn("form", normalize.surface_form(F.col("text"))).groupBy("form").agg(F.max(F.struct("ts", "accepted")).alias("d"))
    return last.orderBy(F.desc("d.ts"), "form").limit(cap).select("form", F.col("d.accepted").alias("accepted"))


def with_surface_decisions(found: DataFrame, forms: DataFrame) -> DataFrame:
    """Rejected forms go; accepted ones count at least 0.90 and need no threshold (bypass)."""
    rows = found.withColumn("form", normalize.surface_form(F.col("matched"))).join(forms, "form", "left").where("coalesce(accepted, true)")
    sure = F.coalesce("accepted", F.lit(False))
    return rows.withColumn("confidence", F.when(sure, F.greatest("confidence", F.lit(0.90))).otherwise(F.col("confidence"))).withColumn("bypass", sure).drop("form", "accepted")
