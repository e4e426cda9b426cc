"""Document classes: distinct keywords, structural bonuses and a softmax."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}'\-]+"), lambda w: w != ""))


def evidence(text: Column, name: str, words: Column) -> tuple[Column, Column, Column]:
    """(keywords found, bonuses applied, score) of a class."""
    found = F.array_sort(F.array_intersect(words, F.array(*map(F.lit, fixed.DOCTYPE_KEYWORDS[name]))))
    bonuses, total = [], F.least(F.size(found), F.lit(5)).cast("double")
    for own, rule, pattern, bonus in fixed.DOCTYPE_BONUSES:
        if own == name:
            hit = F.lower(text).rlike(pattern)
            bonuses.append(F.when(hit, F.lit(rule)))
            total = total + F.when(hit, bonus).otherwise(0.0)
    return found, F.filter(F.array(*bonuses), lambda b: b.isNotNull()) if bonuses else F.array().cast("array<string>"), total


def classified(texts: DataFrame, temperature: float = 1.0) -> DataFrame:
    """All columns but text's class evidence added: scores, probabilities, primary, runner_up, keywords, bonuses.

    Ties go to the class first by name, so a text without evidence is of the first.
    """
    rows = texts.withColumn("words", _words(F.coalesce("text", F.lit(""))))
    parts = {name: evidence(F.coalesce("text", F.lit("")), name, F.col("words")) for name in fixed.DOCTYPES}
    rows = rows.select("*", F.array(*(parts[n][2] for n in fixed.DOCTYPES)).alias("scores"), F.flatten(F.array(*(parts[n][0] for n in fixed.DOCTYPES))).alias("keywords"), F.flatten(F.array(*(parts[n][1] for n in fixed.DOCTYPES))).alias("bonuses")).drop("words")
    most = F.array_max("scores")
    rows = rows.withColumn("exps", F.transform("scores", lambda s: F.exp((s - most) / temperature)))
    total = F.aggregate("exps", F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumn("probabilities", F.transform("exps", lambda e: e / total)).drop("exps")
    ranked = F.array_sort(F.arrays_zip(F.transform("probabilities", lambda p: -p).alias("p"), F.array(*map(F.lit, fixed.DOCTYPES)).alias("name")))
    return rows.withColumn("primary", F.element_at(ranked, 1)["name"]).withColumn("runner_up", F.element_at(ranked, 2)["name"])


def log_probabilities(column: str = "probabilities") -> Column:
    return F.transform(column, lambda p: F.when(p > 0, F.ln(p)).otherwise(-30.0))


def explained(classes: DataFrame, classes_shown: int = 3, keywords_shown: int = 5) -> DataFrame:
    """Adds top (the likeliest classes with their probabilities, ties by name), top_keywords and rules."""
    ranked = F.array_sort(F.arrays_zip(F.transform("probabilities", lambda p: -p).alias("p"), F.array(*map(F.lit, fixed.DOCTYPES)).alias("name")))
    top = F.transform(F.slice(ranked, 1, classes_shown), lambda r: F.struct(r["name"].alias("name"), (-r["p"]).alias("probability")))
    return classes.withColumn("top", top).withColumn("top_keywords", F.slice("keywords", 1, keywords_shown)).withColumn("rules", F.array_sort("bonuses"))


def carried(pages: DataFrame, group: str, order: str) -> DataFrame:
    """effective: the class of the page before if that page had keywords, else the page's own."""
    before = F.lag(F.when(F.size("keywords") > 0, F.col("primary"))).over(Window.partitionBy(group).orderBy(order))
    return pages.withColumn("effective", F.coalesce(before, F.col("primary")))
