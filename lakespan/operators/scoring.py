"""Calibrated scores: context features, posterior, presets and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.spans import contains_any
from .detect import window

EPSILON = 1e-6
SCORED = ("account", "phone", "mrn", "ein", "itin")


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1 - EPSILON))
    return F.ln(p / (1 - p))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def _families() -> dict[str, tuple[list[str], list[str]]]:
    out = {c: (fixed.PROFILES[c][0], fixed.PROFILES[c][1]) for c in ("account", "mrn", "ein", "itin")}
    return out | {"phone": (fixed.PHONE_WORDS, fixed.PHONE_OTHER)}


def _nearest(words: list[str]) -> Column:
    """1 / (1 + gap / 10) of the nearest keyword on either side, within 200 characters; 0 without one."""
    left, right = F.lower(F.col("before")), F.lower(F.col("after"))
    gaps = []
    for w in words:
        back = F.instr(F.reverse(left), w[::-1])
        ahead = F.instr(right, w)
        gaps += [F.when(back > 0, back - 1), F.when(ahead > 0, ahead - 1), F.when(F.contains(F.lower(F.col("matched")), F.lit(w)), F.lit(0))]
    gap = F.least(*gaps) if gaps else F.lit(None).cast("int")
    return F.coalesce(F.lit(1.0) / (F.lit(1.0) + gap / 10.0), F.lit(0.0))


def features(found: DataFrame, doctype: str) -> DataFrame:
    """Adds features: the thirteen context features of each span."""
    words = window(F.col("before"), F.col("after"), 5)

    def of(make) -> Column:
        out = F.lit(0.0)
        for name, sets in _families().items():
            out = F.when(F.col("category") == name, make(sets)).otherwise(out)
        return out

    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    left = F.element_at(F.split(F.rtrim(F.regexp_replace("before", fixed.WHITE + "+", " ")), " "), -1)
    line_start = F.col("before").rlike(r"(^|[\n\r])[\t \x{A0}]*$") & ((F.col("start") <= F.length("before")) | F.col("before").rlike(r"[\n\r][\t \x{A0}]*$"))
    row = F.array(
        of(lambda s: one(contains_any(words, s[0]))), of(lambda s: one(contains_any(words, s[1]))), of(lambda s: _nearest(s[0])), of(lambda s: _nearest(s[1])),
        F.length(F.regexp_replace("matched", r"[^\p{N}]", "")).cast("double"), one(F.col("matched").rlike(r"[^\p{L}\p{N}]")), one(left.rlike("[:#]$")), one(line_start),
        *(one(F.col(doctype) == name) for name in fixed.DOCTYPES),
    )
    return found.withColumn("features", row)


def context_logit() -> Column:
    """The learned context term; families without weights have none."""
    out = F.lit(0.0)
    for name, w in fixed.CONTEXT_WEIGHTS.items():
        total = F.lit(w["bias"])
        for i, (mean, scale, weight) in enumerate(zip(w["means"], w["scales"], w["weights"], strict=True)):
            if weight:
                total = total + (F.col("features")[i] - mean) / scale * weight
        out = F.when(F.col("category") == name, total).otherwise(out)
    return out


def posterior(raw: Column, prior_mean: Column, context: Column) -> Column:
    """Raw score, prior and context added in log odds; the prior counts at least 0.35."""
    return sigmoid(logit(raw) + logit(F.greatest(prior_mean, F.lit(0.35))) + context)


def floored(post: Column, raw: Column, cutoff: Column) -> Column:
    """Account and phone spans confirmed by keywords do not sink below their raw score or the strict cutoff."""
    return F.when(F.col("category").isin("account", "phone") & (raw >= 0.70), F.greatest(post, F.least(raw, cutoff))).otherwise(post)


def preset(name: str, overrides: dict[str, float] | None = None) -> dict[str, float]:
    """Cutoffs of a preset; overrides are clamped to 0..1."""
    return fixed.PRESETS[name] | {k: min(max(v, 0.0), 1.0) for k, v in (overrides or {}).items()}


def cutoffs(spark, table: dict[str, float]) -> DataFrame:
    return spark.createDataFrame(sorted(table.items()), "category string, cutoff double")


def thresholded(found: DataFrame, table: dict[str, float], score: str = "confidence") -> DataFrame:
    """Spans that reach their category's cutoff (17 rows, broadcast); a category without one passes."""
    dim = F.broadcast(cutoffs(found.sparkSession, table))
    return found.join(dim, "category", "left").where(F.col("cutoff").isNull() | (F.col(score) >= F.col("cutoff")))


def composed(found: DataFrame, doctype: str, priors: DataFrame | None = None) -> DataFrame:
    """Adds posterior: for all spans, with priors(category, mean) or fresh ones of 0.5."""
    rows = features(found, doctype).withColumn("context", context_logit())
    if priors is None:
        rows = rows.withColumn("prior", F.lit(0.5))
    else:
        rows = rows.join(F.broadcast(priors.select("category", F.col("mean").alias("prior"))), "category", "left").withColumn("prior", F.coalesce("prior", F.lit(0.5)))
    strict = F.lit(1.0)
    for c, cut in fixed.PRESETS["conservative"].items():
        strict = F.when(F.col("category") == c, cut).otherwise(strict)
    post = posterior(F.col("confidence"), F.col("prior"), F.col("context"))
    return rows.withColumn("posterior", floored(post, F.col("confidence"), strict))


def suppressed(score: Column, keywords: list[tuple[str, float]], context: Column, floor: Column) -> Column:
    """Negative context: the largest weight of a keyword found shrinks the score, by three quarters at most."""
    weight = F.greatest(*[F.when(F.contains(context, F.lit(k)), F.lit(w)) for k, w in keywords], F.lit(None).cast("double")) if len(keywords) > 1 else F.when(F.contains(context, F.lit(keywords[0][0])), F.lit(keywords[0][1]))
    factor = F.coalesce(F.greatest(F.lit(0.25), F.lit(1.0) - weight * 0.75), F.lit(1.0))
    return F.greatest(floor, score * factor)
