"""Reports: coverage, histogram, run difference, audit records, evaluation, priors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, normalize

BANDS = 5


def coverage(found: DataFrame) -> DataFrame:
    """category (null: all), candidates, documents, below: a total with a row for each category."""
    rows = found.rollup("category").agg(F.count(F.lit(1)).alias("candidates"), F.count_distinct("doc_id").alias("documents"), F.count_if(F.col("confidence") < F.col("cutoff")).alias("below"))
    return rows


def histogram(found: DataFrame) -> DataFrame:
    """category, band0..band4: spans by fifths of confidence, the last closed."""
    band = F.least(F.greatest(F.floor(F.round(F.col("confidence") * BANDS, 9)), F.lit(0)), F.lit(BANDS - 1))
    out = found.withColumn("band", band)
    return out.groupBy("category").agg(*(F.count_if(F.col("band") == b).alias(f"band{b}") for b in range(BANDS)))


def fingerprint() -> Column:
    """Place and category of a span, never its text."""
    return F.concat_ws("|", F.col("doc_id").cast("string"), F.col("start").cast("string"), F.col("len").cast("string"), F.col("category"))


def run_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """fingerprint, change: added, removed or unchanged, over distinct fingerprints."""
    a = before.select(fingerprint().alias("fingerprint")).distinct().withColumn("a", F.lit(True))
    b = after.select(fingerprint().alias("fingerprint")).distinct().withColumn("b", F.lit(True))
    return a.join(b, "fingerprint", "full").select("fingerprint", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("unchanged").alias("change"))


def with_snapshots(live: DataFrame, applied: DataFrame) -> DataFrame:
    """Live results completed by applied snapshots, by fingerprint; the live one counts."""
    a = live.withColumn("fingerprint", fingerprint()).select("fingerprint", F.col("confidence").alias("live"))
    b = applied.withColumn("fingerprint", fingerprint()).select("fingerprint", F.col("confidence").alias("kept"))
    return a.join(b, "fingerprint", "full").select("fingerprint", F.coalesce("live", "kept").alias("confidence"), F.col("kept").isNotNull().alias("applied"))


def summary(signals: Column) -> Column:
    """Signals(type, name, value) as text, joined by "; "."""

    def one(s: Column) -> Column:
        value = F.format_number(s["value"], 2)
        return (
            F.when(s["type"] == "regex", F.concat(F.lit("regex("), s["name"], F.lit(")")))
            .when(s["type"] == "validator", F.concat(F.lit("validator("), s["name"], F.lit(")")))
            .when(s["type"] == "ctx+", F.concat(F.lit("ctx+("), value, F.lit(")")))
            .when(s["type"] == "ctx-", F.concat(F.lit("ctx-("), value, F.lit(")")))
            .when(s["type"].isin("bloom.surname", "bloom.given"), s["type"])
            .when(s["type"].isin("bloom.fuzzy", "ocr"), F.concat(s["type"], F.lit("("), value, F.lit(")")))
            .otherwise(F.concat(s["type"], F.lit("("), s["name"], F.lit(")")))
        )

    return F.array_join(F.filter(F.transform(signals, one), lambda s: s.isNotNull()), "; ")


def signals() -> Column:
    """Of a scored span: its rule, its check, and what its context did."""
    from .detect import VALID

    kind = lambda t, n, v=None: F.struct(F.lit(t).alias("type"), n.alias("name"), (F.lit(v).cast("double") if v is None else v).alias("value"))
    boosted = F.col("confidence") > F.col("base")
    lowered = F.col("confidence") < F.col("base")
    parts = F.array(
        kind("regex", F.col("rule")), F.when(F.col("rule").isin(*VALID), kind("validator", F.col("rule"))),
        F.when(boosted, kind("ctx+", F.lit(""), F.col("confidence"))), F.when(lowered, kind("ctx-", F.lit(""), F.col("confidence") / F.col("base"))),
    )
    return F.filter(parts, lambda s: s.isNotNull())


#: Columns of an audit record, in order.
AUDIT_COLUMNS = [
    "id", "pageIndex", "matchedText", "source", "piiCategory", "piiConfidence", "term", "ruleID", "ruleVersion", "gazetteerManifestVersion", "finalScore", "appliedThreshold", "rationaleSummary",
    "isSelected", "wasApplied", "suppressedByOverlap", "foiaExemption", "foiaCitation", "foiaNote",
]


def audit_records(found: DataFrame, cutoffs: dict[str, float], sensitive: bool = False, manifest: str = "") -> DataFrame:
    """Records with AUDIT_COLUMNS, all as text, of scored spans; selected, applied, suppressed, term and notes are taken from columns of these names if there are any.

    Unless sensitive texts are asked for, the match is masked, the term is the
    category's name (or masked), and the patterns of user flags are taken out of
    the reasons. Every cell that a spreadsheet would take for a formula gets a quote.
    """
    catalogue = F.create_map(*(F.lit(x) for pair in fixed.CATALOGUE.items() for x in pair))
    has = lambda c, otherwise: F.col(c) if c in found.columns else F.lit(otherwise)
    cutoff = F.lit(None).cast("double")
    for c, v in cutoffs.items():
        cutoff = F.when(F.col("category") == c, v).otherwise(cutoff)
    why = summary(signals())
    term = has("term", "").cast("string")
    shown = F.col("matched") if sensitive else normalize.masked(F.col("matched"))
    number = lambda c: F.when(c.isNotNull(), F.format_string("%.4f", c.cast("double"))).otherwise("")
    flag = lambda c: F.when(F.coalesce(c.cast("boolean"), F.lit(False)), "true").otherwise("false")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    cells = [
        F.sha2(fingerprint(), 256), text(F.col("doc_id")), text(shown), text(has("source", "textLayer")), text(F.col("category")), number(F.col("confidence")),
        text(term if sensitive else F.coalesce("category", normalize.masked(term))), text(F.col("rule")), text(F.try_element_at(catalogue, F.col("rule"))), F.lit(manifest), number(F.col("confidence")), number(cutoff),
        text(why if sensitive else sanitised(why)), flag(has("selected", False)), flag(has("applied", False)), flag(has("suppressed", False)), text(has("exemption", "")), text(has("citation", "")), text(has("note", "")),
    ]
    return found.select(*(normalize.neutralised(c).alias(n) for c, n in zip(cells, AUDIT_COLUMNS, strict=True)))


def audit(found: DataFrame) -> DataFrame:
    """Audit records: places, masked text, scores and reasons; no matched text in clear."""
    catalogue = F.create_map(*(F.lit(x) for pair in fixed.CATALOGUE.items() for x in pair))
    rows = found.withColumn("why", summary(signals()))
    return rows.select(
        "doc_id", "category", "rule", F.try_element_at(catalogue, F.col("rule")).alias("catalogue"), "start", "len", normalize.neutralised(normalize.masked(F.col("matched"))).alias("masked"),
        F.round("confidence", 6).alias("confidence"), normalize.neutralised(F.col("why")).alias("why"), F.sha2(fingerprint(), 256).alias("fingerprint"),
    )


def sanitised(why: Column) -> Column:
    """Without the patterns of user flags."""
    return F.trim(F.regexp_replace(why, r"user(?:Always|Never)[Ff]lag\(.*?\)(?=;|$)", "userFlag([redacted])"))


def evaluation(found: DataFrame, truth: DataFrame) -> DataFrame:
    """category, true_positives, false_negatives, false_positives: labels(doc_id, category, start, len) met by any overlap."""
    f = found.select("doc_id", "category", F.col("start").alias("s"), (F.col("start") + F.col("len")).alias("e")).distinct()
    t = truth.select("doc_id", "category", F.col("start").alias("ts"), (F.col("start") + F.col("len")).alias("te")).distinct()
    met = t.join(f, ["doc_id", "category"]).where((F.col("s") < F.col("te")) & (F.col("ts") < F.col("e")))
    hit = t.join(met.select("doc_id", "category", "ts", "te").distinct(), ["doc_id", "category", "ts", "te"], "left_semi").groupBy("category").agg(F.count(F.lit(1)).alias("true_positives"))
    all_ = t.groupBy("category").agg(F.count(F.lit(1)).alias("labels"))
    extra = f.join(met.select("doc_id", "category", "s", "e").distinct(), ["doc_id", "category", "s", "e"], "left_anti").groupBy("category").agg(F.count(F.lit(1)).alias("false_positives"))
    rows = all_.join(hit, "category", "left").join(extra, "category", "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select("category", zero("true_positives").alias("true_positives"), (zero("labels") - zero("true_positives")).alias("false_negatives"), zero("false_positives").alias("false_positives"))


def scan_report(found: DataFrame, cutoffs: dict[str, float]) -> DataFrame:
    """category (null: all), candidates, pages, applied, deselected, below, suppressed of spans(applied, selected, suppressed)."""
    cutoff = F.lit(None).cast("double")
    for c, v in cutoffs.items():
        cutoff = F.when(F.col("category") == c, v).otherwise(cutoff)
    below = F.coalesce(F.col("confidence") < cutoff, F.lit(False))
    return found.rollup("category").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_distinct("doc_id").alias("pages"), F.count_if("applied").alias("applied"),
        F.count_if(~F.col("selected") & ~F.col("suppressed") & ~below).alias("deselected"), F.count_if(below).alias("below"), F.count_if("suppressed").alias("suppressed"),
    )


def evaluation_cells(found: DataFrame, truth: DataFrame) -> DataFrame:
    """category, doctype, bucket, true_positives, false_negatives, false_positives, suppress_total, suppress_fired.

    truth(doc_id, doctype, bucket, category, start, len, outcome) has the labels; one
    whose outcome is suppress must not be met. Spans and labels of a category meet
    by any overlap; a span of a document without labels counts in no cell.
    """
    cell = ["category", "doctype", "bucket"]
    f = found.select("doc_id", "category", F.col("start").alias("s"), (F.col("start") + F.col("len")).alias("e")).distinct()
    t = truth.select("doc_id", *cell, F.col("start").alias("ts"), (F.col("start") + F.col("len")).alias("te"), F.coalesce("outcome", F.lit("redact")).alias("outcome")).distinct()
    met = t.join(f, ["doc_id", "category"]).where((F.col("s") < F.col("te")) & (F.col("ts") < F.col("e")))
    labels = t.join(met.select("doc_id", "category", "ts", "te").distinct().withColumn("hit", F.lit(True)), ["doc_id", "category", "ts", "te"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    quiet = F.col("outcome") == "suppress"
    own = labels.groupBy(*cell).agg(F.count_if(~quiet & F.col("hit")).alias("true_positives"), F.count_if(~quiet & ~F.col("hit")).alias("false_negatives"), F.count_if(quiet).alias("suppress_total"), F.count_if(quiet & ~F.col("hit")).alias("suppress_fired"))
    places = truth.select("doc_id", "doctype", "bucket").distinct()
    extra = f.join(met.select("doc_id", "category", "s", "e").distinct(), ["doc_id", "category", "s", "e"], "left_anti").join(places, "doc_id").groupBy(*cell).agg(F.count(F.lit(1)).alias("false_positives"))
    rows = own.join(extra, cell, "full")
    names = ["true_positives", "false_negatives", "false_positives", "suppress_total", "suppress_fired"]
    return rows.select(*cell, *(F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names))


def priors(decisions: DataFrame) -> DataFrame:
    """category, alpha, beta, mean, decisions: accepted and rejected decisions folded in order of time.

    A streak of five in one direction stops counting, the mass is held at 50, so
    the order matters: decisions(category, ts, id, accepted), ties by id. One
    category's decisions are one ordered fold by nature; what the fold carries
    is bounded, and only the decision bits are gathered.
    """
    ordered = decisions.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("ts", "id", "accepted"))).alias("d"))
    start = F.struct(F.lit(1.0).alias("alpha"), F.lit(1.0).alias("beta"), F.lit(0).alias("side"), F.lit(0).alias("streak"))

    def step(s: Column, x: Column) -> Column:
        side = F.when(x["accepted"], 1).otherwise(-1)
        alpha, beta = s["alpha"] + F.when(side == 1, 1.0).otherwise(0.0), s["beta"] + F.when(side == -1, 1.0).otherwise(0.0)
        over = alpha + beta > 50
        scale = F.lit(50.0) / (alpha + beta)
        following = F.struct(
            F.when(over, F.greatest(F.lit(1.0), alpha * scale)).otherwise(alpha).alias("alpha"), F.when(over, F.greatest(F.lit(1.0), beta * scale)).otherwise(beta).alias("beta"),
            side.alias("side"), F.when(s["side"] == side, F.least(s["streak"] + 1, F.lit(255))).otherwise(1).alias("streak"),
        )
        return F.when((s["side"] == side) & (s["streak"] >= 5), s).otherwise(following)

    rows = ordered.select("category", F.aggregate("d", start, step).alias("s"), F.size("d").alias("decisions"))
    mean = F.lit(0.95) * F.col("s.alpha") / (F.col("s.alpha") + F.col("s.beta")) + 0.025
    return rows.select("category", F.col("s.alpha").alias("alpha"), F.col("s.beta").alias("beta"), mean.alias("mean"), "decisions")


def merged_priors(a: DataFrame, b: DataFrame) -> DataFrame:
    """category, alpha, beta of two folds: masses added without the second's starting one, held at 50."""
    rows = a.select("category", F.col("alpha").alias("a1"), F.col("beta").alias("b1")).join(b.select("category", F.col("alpha").alias("a2"), F.col("beta").alias("b2")), "category", "full")
    alpha = F.when(F.col("a1").isNull(), F.col("a2")).when(F.col("a2").isNull(), F.col("a1")).otherwise(F.col("a1") + F.col("a2") - 1)
    beta = F.when(F.col("b1").isNull(), F.col("b2")).when(F.col("b2").isNull(), F.col("b1")).otherwise(F.col("b1") + F.col("b2") - 1)
    scale = F.when(alpha + beta > 50, F.lit(50.0) / (alpha + beta))
    held = lambda x: F.when(scale.isNotNull(), F.greatest(F.lit(1.0), x * scale)).otherwise(x)
    return rows.select("category", held(alpha).alias("alpha"), held(beta).alias("beta"))


def recent(queries: DataFrame, cap: int = 5) -> DataFrame:
    """user_id, query, place: each user's last distinct queries. queries(user_id, ts, query)."""
    last = queries.groupBy("user_id", "query").agg(F.max("ts").alias("ts"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), "query"))
    return last.withColumn("place", place).where(F.col("place") <= cap).select("user_id", "query", "place")


def word_list(texts: DataFrame, anchors: list[str], top: int = 50, budget: int = 150) -> DataFrame:
    """word, place: anchors first, then the most frequent words of five letters or more."""
    words = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{5,}"), F.lit(0))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    best = words.where(~F.col("word").isin(*[a.lower() for a in anchors])).orderBy(F.desc("n"), "word").limit(top)
    rows = best.select("word", (-F.col("n")).alias("o")).unionByName(texts.sparkSession.createDataFrame([(a.lower(), -(1 << 60) + i) for i, a in enumerate(anchors)], "word string, o long"))
    place = F.row_number().over(Window.partitionBy().orderBy("o", "word"))
    return rows.withColumn("place", place).where(F.col("place") <= budget).select("word", "place")
