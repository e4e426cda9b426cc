"""The whole category scan, negative context, names without a prefix, and a SQL surface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, normalize
from ..functions.spans import cut, pieces_of, spans
from ..sources.scratch import written
from . import detect, entities, overlap, scoring, terms

#: Lowest confidence that suppression leaves to a category.
FLOORS = {"ssn": 0.25}


def scanned(texts: DataFrame, categories: list[str] | None = None, cutoffs: dict[str, float] | None = None, never: tuple[list[str], list[str]] = ([], []), always: tuple[list[str], list[str]] = ([], [])) -> DataFrame:
    """doc_id, category, rule, start, len, matched, confidence of a scan, in its order:
    detection, never-flag terms, one winner of those that overlap, cutoffs, and always-flag terms beside them."""
    columns = ["doc_id", "category", "rule", "start", "len", "matched", "confidence"]
    found = detect.detected(texts, categories).select(*columns)
    if any(never):
        found = terms.never_flagged(found, *never)
    found = overlap.survivors(overlap.resolved_by_confidence(found)).select(*columns)
    found = scoring.thresholded(found, cutoffs or scoring.preset("balanced")).select(*columns)
    return found.unionByName(terms.always_flagged(texts, *always)) if any(always) else found


def suppressed(found: DataFrame, keywords: DataFrame, doctype: str = "doctype") -> DataFrame:
    """Adds suppressed_by and lowers confidence: of the keywords(category, doctype, keyword, weight) of a span's
    scope that stand around it the largest weight counts, by three quarters at most, down to the category's floor."""
    near = F.lower(F.concat_ws(" ", "before", "matched", "after"))
    scope = keywords.groupBy("category", F.col("doctype").alias("scope")).agg(F.collect_list(F.struct("weight", F.lower("keyword").alias("keyword"))).alias("words"))
    rows = found.withColumn("near", near).join(F.broadcast(scope), (found["category"] == scope["category"]) & (F.col(doctype) == F.col("scope")), "left").drop(scope["category"]).drop("scope")
    best = F.array_max(F.filter("words", lambda w: F.contains(F.col("near"), w["keyword"])))
    floor = F.lit(0.0)
    for c, f in FLOORS.items():
        floor = F.when(F.col("category") == c, f).otherwise(floor)
    rows = rows.withColumn("best", best)
    factor = F.greatest(F.lit(0.25), F.lit(1.0) - F.col("best.weight") * 0.75)
    lowered = F.when(F.col("best").isNull(), F.col("confidence")).otherwise(F.greatest(floor, F.col("confidence") * factor))
    return rows.withColumn("confidence", lowered).withColumn("suppressed_by", F.col("best.keyword")).drop("words", "best", "near")


def shares(window: Column, words: list[str], boost: Column) -> Column:
    """array<struct<keyword, share>>: the boost dealt evenly to the keywords that stand in the window, by name."""
    found = F.array_sort(F.filter(F.array(*map(F.lit, sorted(set(words)))), lambda w: F.contains(window, w)))
    return F.transform(found, lambda w: F.struct(w.alias("keyword"), (boost / F.size(found)).alias("share")))


_NAME = r"(?<![\p{L}\p{N}])\p{Lu}[\p{L}'’-]+(?: \p{Lu}[\p{L}'’.-]*){0,2}(?![\p{L}\p{N}])"
#: Where a separator that a shadow turns into a space may join two words of a run.
_GLUED = r"[:;,/]\p{Lu}"


def names(texts: DataFrame, surnames: DataFrame, given: DataFrame) -> DataFrame:
    """doc_id, start, len, matched, confidence: names known to gazetteers, with or without a prefix.

    There is no statistical recogniser: candidates are runs of one to three
    capitalised words, of the text and of its shadow (names in capitals or glued
    to labels), and each needs a known surname, or for a single word a known given
    name. Text and shadow have the same places, so a name found in both is one.
    Fuzzy surnames count only in the text as it is.

    Texts are read once: their runs are written to the shared folder, and all that
    asks the gazetteers reads those. A shadow is only made where its runs can
    differ from those of the text; elsewhere a run stands for both.
    """
    text = F.coalesce("text", F.lit(""))
    differs = normalize.shadow_recases(F.col("text")) | F.col("text").rlike(_GLUED)
    same = F.array(F.struct(F.when(F.col("text").rlike("[:;,/]"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))).alias("strict"), F.col("text").alias("t")))
    both = F.array(F.struct(F.array(F.lit(False)).alias("strict"), F.col("text").alias("t")), F.struct(F.array(F.lit(True)).alias("strict"), normalize.shadow(F.col("text")).alias("t")))
    # exploded, so that a shadow is a column that is computed once
    rows = texts.select("doc_id", text.alias("text")).select("doc_id", "text", F.inline(F.when(differs, both).otherwise(same)))
    shadowed = F.col("strict")[0]
    rows = rows.where(~shadowed | (F.col("t") != F.col("text")))
    rows = rows.select("doc_id", "strict", spans(F.col("t"), _NAME).alias("runs"), F.when(shadowed, pieces_of(F.col("text"))).alias("pieces"))
    own = lambda r: F.when(F.col("pieces").isNotNull(), cut(F.col("pieces"), r["start"], F.length(r["matched"]))).otherwise(r["matched"])
    rows = rows.select("doc_id", "strict", F.inline(F.transform("runs", lambda r: F.struct(r["start"].alias("run"), r["matched"].alias("words"), own(r).alias("own")))))
    runs = written(rows, "name-runs")

    def endings() -> Column:
        """The run, and the run without its first words, which may be a label."""
        each = [F.substring_index("words", " ", -n) for n in (1, 2, 3)]  # _NAME has no longer run
        count = F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit(""))) + 1
        return F.slice(F.array(*(F.struct((F.length("words") - F.length(e)).alias("skip"), e.alias("name")) for e in each)), F.lit(1), count)

    rows = runs.select("doc_id", "strict", "run", "own", F.inline(endings()))
    distinct = written(rows.select("name").distinct().select(F.col("name").alias("id"), "name"), "names")
    verdict = entities.gazetteer_verdict(distinct, surnames, given).where("boost > 0 OR given_only").select(F.col("id").alias("name"), "boost", "given_only")
    rows = rows.join(written(verdict, "known-names"), "name")
    size = F.length("name")
    rows = rows.select("doc_id", F.explode("strict").alias("strict"), "run", (F.col("run") + F.col("skip")).alias("start"), size.alias("len"), F.substring("own", F.col("skip") + 1, size).alias("matched"), "boost", "given_only")
    rows = rows.where((F.col("boost") > F.when(F.col("strict"), 0.05).otherwise(0.0)) | F.col("given_only"))
    # of a run's endings the best known, then the longest
    best = rows.groupBy("doc_id", "strict", "run").agg(F.max(F.struct("boost", "len", "start", "matched")).alias("m")).select("doc_id", "m.*")
    out = best.groupBy("doc_id", "start", "len").agg(F.max(F.struct("boost", "matched")).alias("m"))
    return out.select("doc_id", "start", "len", F.col("m.matched").alias("matched"), (F.col("m.boost") + 0.70).alias("confidence"))


def register_views(spark: SparkSession, texts: DataFrame, prefix: str = "lakespan") -> None:
    """A SQL surface: temporary views <prefix>_texts, _spans (scored), _kept (balanced preset) and _rules; the function
    spans_of(text, categories), an array to be selected and then taken apart by inline; and the table function detect_spans(text,
    categories) over one text. Both functions give what the patterns find, before any check."""
    found = detect.detected(texts)
    texts.createOrReplaceTempView(f"{prefix}_texts")
    found.createOrReplaceTempView(f"{prefix}_spans")
    scoring.thresholded(found, scoring.preset("balanced")).createOrReplaceTempView(f"{prefix}_kept")
    rules = ", ".join(f"('{r}', '{c}')" for r, c in fixed.CATALOGUE.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {prefix}_rules AS SELECT * FROM VALUES {rules} AS t(rule, catalogue)")
    arms = []
    for category, rule, pattern, group in fixed.PATTERNS:
        literal = pattern.replace("\\", "\\\\").replace("'", "\\'")
        arms.append(f"transform(regexp_extract_all(t, '{literal}', {1 if group else 0}), m -> named_struct('category', '{category}', 'rule', '{rule}', 'matched', m))")
    chosen = "filter(flatten(array(" + ", ".join(arms) + ")), s -> categories IS NULL OR array_contains(split(categories, ','), s.category))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION spans_of(t STRING, categories STRING) RETURNS ARRAY<STRUCT<category: STRING, rule: STRING, matched: STRING>> RETURN {chosen}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION detect_spans(t STRING, categories STRING) RETURNS TABLE(category STRING, rule STRING, matched STRING) RETURN SELECT inline(a) FROM (SELECT spans_of(t, categories) AS a)")
